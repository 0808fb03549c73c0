"""Listings from pages: discovery by pages, declarative readers for embedded JSON, units, fees and provenance."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.sources.pages import flight_rows, objects

UNIT = "unit_key string, kind string, beds int, baths double, sqft int, base_min double, base_max double, total double, available_on string"
LISTING = f"listing_id string, name string, street string, city string, zip string, lat double, lon double, phone string, units array<struct<{UNIT.replace(' ', ':').replace(',:', ',')}>>, facts map<string,string>"


@dataclass(frozen=True)
class Spec:
    """How a site keeps a listing in its page's JSON: where the JSON is, what marks the listing's object, and the names of fields, each as
    alternatives tried in order; a name may go through objects by dots, and through all items of a list by *. Plans hold units; a plan
    without any counts as one itself. Where units stand beside plans, plan_ref names the unit's and the plan's field that agree.
    skip_unit and need_unit are fields of units that must be false or absent, and true; skip_plan likewise of plans. JSON may also follow a text in the page
    (`after`). Where the flag of `instead` holds for a unit, its fields have other names. plans_alone: plans count where the page has no unit."""

    script_id: str | None = "__NEXT_DATA__"
    script_type: str | None = None
    flight: bool = False
    whole: bool = False
    after: str | None = None
    instead: tuple[str, dict[str, tuple[str, ...]]] | None = None
    plans_alone: bool = False
    plan_ref: tuple[str, str] | None = None
    skip_plan: tuple[str, ...] = ()
    skip_unit: tuple[str, ...] = ()
    need_unit: tuple[str, ...] = ()
    marks: tuple[str, ...] = ()
    fields: dict[str, tuple[str, ...]] = field(default_factory=dict)
    plans: tuple[str, ...] = ()
    units: tuple[str, ...] = ()
    unit_fields: dict[str, tuple[str, ...]] = field(default_factory=dict)
    fact_fields: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _at(value, path: str):
    names = path.split(".")
    for k, name in enumerate(names):
        if name == "*":
            rest = ".".join(names[k + 1 :])
            found = [_at(v, rest) if rest else v for v in value] if isinstance(value, list) else []
            return [x for f in found for x in (f if isinstance(f, list) else [f]) if x is not None]
        if name.isdigit() and isinstance(value, list):
            value = value[int(name)] if int(name) < len(value) else None
        elif isinstance(value, dict):
            value = value.get(name)
        else:
            return None
    return value


def _pick(value, names: tuple[str, ...]):
    return next((v for n in names if (v := _at(value, n)) not in (None, "", [])), None)


def number(v) -> float | None:
    """A number, or the first one in a text; zero and below count as unknown."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return float(v) if v > 0 else None
    m = re.search(r"\d[\d,]*(?:\.\d+)?", str(v))
    x = float(m[0].replace(",", "")) if m else 0.0
    return x or None


def beds(v) -> int | None:
    if isinstance(v, str) and "studio" in v.lower():
        return 0
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return int(v) if 0 <= v < 1000 else None
    m = re.search(r"\d+", str(v or ""))
    return int(m[0]) if m and len(m[0]) < 4 else None


def _script(spec: Spec, html: str) -> Iterator:
    if spec.after:
        at = html.find(spec.after)
        if at >= 0:
            yield json.JSONDecoder().raw_decode(html, at + len(spec.after))[0]
        return
    if spec.whole:
        texts = [html]
    elif spec.flight:
        texts = [content for _, content in flight_rows(html)]
    else:
        tag = rf"id=[\"']{re.escape(spec.script_id)}[\"']" if spec.script_id else rf"type=[\"']{re.escape(spec.script_type or 'application/json')}[\"']"
        texts = [m[1] for m in re.finditer(rf"(?is)<script[^>]*{tag}[^>]*>(.*?)</script>", html)]
    for text in texts:
        try:
            yield json.loads(text)
        except ValueError:
            continue


def _pairs(spec: Spec, o: dict) -> Iterator[tuple[dict, dict | None]]:
    """Plans with each of their units, or with None for a plan that has none."""
    plans = [p for p in (_pick(o, spec.plans) or []) if isinstance(p, dict) and not any(_at(p, n) for n in spec.skip_plan)]

    def good(units) -> list[dict]:
        return [u for u in units or [] if isinstance(u, dict) and not any(_at(u, n) for n in spec.skip_unit) and all(_at(u, n) for n in spec.need_unit)]

    if spec.plan_ref:
        mine, theirs = spec.plan_ref
        by = {str(_at(p, theirs)): p for p in plans}
        for u in good(_pick(o, spec.units)):
            yield by.get(str(_at(u, mine)), {}), u
        if spec.plans_alone and not _pick(o, spec.units):
            for p in plans:
                yield p, None
        return
    for p in plans:
        for u in good(_pick(p, spec.units)) or [None]:
            yield p, u


def _day(v) -> str | None:
    """The day of a moment: seconds since 1970, or a text that starts with the day."""
    if isinstance(v, bool) or not v:
        return None
    if isinstance(v, (int, float)) or re.fullmatch(r"\d{9,}", v if isinstance(v, str) else ""):
        n = float(v)
        return datetime.fromtimestamp(n, UTC).date().isoformat() if 0 < n < 1e11 else None  # to the year 5138
    return str(v)[:10]


def _unit(spec: Spec, plan: dict, unit: dict | None, k: int) -> dict | None:
    """A unit's row; what it doesn't say is its plan's. None without a price."""
    u = spec.unit_fields
    if spec.instead and _at(plan if unit is None else unit, spec.instead[0]):
        u = u | spec.instead[1]

    def get(name: str):
        own = _pick(unit, u.get(name, ())) if unit is not None else None
        return _pick(plan, u.get(name, ())) if own is None else own

    low, high, total = (number(get(n)) for n in ("price_min", "price_max", "total"))
    if low is None and high is None and total is None:
        return None
    key = get("key") if unit is not None else _pick(plan, u.get("plan_key", u.get("key", ())))
    size = number(get("sqft"))
    return {"unit_key": str(key if key is not None else k), "kind": "unit" if unit is not None else "floorplan", "beds": beds(get("beds")), "baths": number(get("baths")), "sqft": int(size) if size else None,
            "base_min": low or high, "base_max": high or low, "total": total, "available_on": _day(get("available"))}


def read_listings(spec: Spec) -> Callable[[str], list[tuple]]:
    """A reader of pages (see pages.read_pages) with the columns of LISTING. Unit keys that a page repeats get a number."""

    def read(html: str) -> list[tuple]:
        out = []
        for data in _script(spec, html):
            for o in objects(data):
                if spec.marks and not all(m in o for m in spec.marks):
                    continue
                units = [r for k, (plan, unit) in enumerate(_pairs(spec, o)) if (r := _unit(spec, plan, unit, k))]
                seen: dict[str, int] = {}
                for r in units:
                    seen[r["unit_key"]] = n = seen.get(r["unit_key"], 0) + 1
                    if n > 1:
                        r["unit_key"] += f"#{n}"
                f = spec.fields
                text = lambda name: None if (v := _pick(o, f.get(name, ()))) is None else str(v)  # noqa: B023, E731
                place = [_pick(o, f.get(n, ())) for n in ("lat", "lon")]
                facts = {k: str(v) for k, names in spec.fact_fields.items() if (v := _pick(o, names)) is not None}
                out.append((text("id"), text("name"), text("street"), text("city"), text("zip"), *(float(x) if isinstance(x, (int, float)) else None for x in place), text("phone"), units, facts))
        return out

    return read


def discover(cities: DataFrame, city: str, fetch: Callable[[str, int], tuple[list[dict], int | None]], schema: str, key: str, most_pages: int = 100) -> DataFrame:
    """Stubs of each city, a page at a time, till a page brings no new keys or all that the source promised have come. `fetch` gives a page's stubs and
    the promised number; it holds the transport, the pause between requests and the policy."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b[city]:
                seen: dict = {}
                for page in range(1, most_pages + 1):
                    stubs, total = fetch(name, page)
                    fresh = {s[key]: s for s in stubs if s[key] not in seen}
                    seen |= fresh
                    if not fresh or total is not None and len(seen) >= total:
                        break
                if seen:
                    yield pd.DataFrame([{city: name, **s} for s in seen.values()])

    return cities.select(city).mapInPandas(run, schema)


def may_qualify(prices_by_beds, allowed: tuple[int, ...], cap: float) -> Column:
    """Whether a map of least price by beds has a known price up to the cap for an allowed number of beds."""
    return F.exists(F.map_entries(prices_by_beds), lambda e: e["key"].isin(*allowed) & F.coalesce(e["value"].between(1, cap), F.lit(False)))


def flatten_units(listings: DataFrame) -> DataFrame:
    """A row for each unit of nested listings."""
    return listings.select("listing_id", F.explode("units").alias("u")).select("listing_id", "u.*")


def expense_rollup(df: DataFrame, keys: list[str], label: str, amount: str) -> DataFrame:
    """Per label: its distinct amounts, sorted, and whether they vary."""
    g = df.where(F.col(amount).isNotNull()).groupBy(*keys, label).agg(F.array_sort(F.collect_set(amount)).alias("amounts"))
    return g.withColumn("varies", F.size("amounts") > 1)
