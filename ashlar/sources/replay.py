"""Requests answered from recorded replies under the rules of polite reading: a few redirects on the same host, a few more tries, and no more of a host that blocks.

Nothing here waits or goes to a network. Replies are a table, so all requests take each step at once, by joins; what a live run does one after the other is told by the
requests' order: a host's requests after the one that was blocked aren't made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ashlar.functions.scalars import c
from ashlar.sources.pages import content_address, looks_like_challenge
from ashlar.tables import cut, discard

# Requests to a page with redirects, and tries of one that fails.
MOST_HOPS = 5
MOST_TRIES = 3


def host_of(url) -> Column:
    return F.lower(F.regexp_extract(c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def target_of(url, location) -> Column:
    """Where a redirect leads: a whole address, one of the same host (from a slash), or one beside the page."""
    url, location = c(url), F.coalesce(c(location), F.lit(""))
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"[^/]*$", "")
    beside = F.concat(origin, F.when(folder == "", "/").otherwise(folder), location)
    return (
        F.when(location.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), location).when(location.startswith("//"), F.concat(scheme, location)).when(location.startswith("/"), F.concat(origin, location))
        .when(location == "", url).otherwise(beside)
    )


def replies(recorded: DataFrame, most_tries: int = MOST_TRIES) -> DataFrame:
    """url, status, location, body, tries: what a page answers after as many tries as it takes. recorded: url, attempt (from 1), status (null: no connection), location, body.
    No connection and 5xx are tried again; the last try's reply stands."""
    reply = F.struct("status", "location", "body", F.col("attempt").alias("tries"))
    good = F.col("status").isNotNull() & (F.col("status") < 500)
    within = recorded.where(F.col("attempt").between(1, most_tries))
    g = within.groupBy("url").agg(F.min_by(reply, F.when(good, F.col("attempt"))).alias("good"), F.max_by(reply, "attempt").alias("last"))
    return g.select("url", F.coalesce("good", "last").alias("r")).select("url", "r.*")


def fetch_recorded(requests: DataFrame, recorded: DataFrame, ordinal: str = "ordinal", most_hops: int = MOST_HOPS, most_tries: int = MOST_TRIES) -> DataFrame:
    """requests (url, ordinal: their order; others) with outcome, reason, final_url, status, body, sha256 and calls (requests it took).

    Outcomes: `ok`; `blocked` by 403, 429, 202, a challenge, or a redirect to a page about limits; `skipped` after a blocked request of the same host; `failed` otherwise: another status,
    a redirect to another host, too many of them, no connection, nothing recorded. A null url fails. Requests that repeat are requests of their own; ties of ordinals on a blocking host are made."""
    # Each hop joins the pages that are still going somewhere; the others wait in the same rows.
    answers = cut(replies(recorded, most_tries).select(F.col("url").alias("__at"), F.struct("status", "location", "body", "tries").alias("__r")))
    df = requests.withColumn("__at", F.col("url")).withColumn("__host", host_of("url")).withColumn("calls", F.lit(0)).withColumn("__end", F.lit(None).cast("struct<outcome:string,reason:string,status:int,body:string>"))

    def end(outcome: str, reason, keep: bool = False) -> Column:
        reason = reason if isinstance(reason, Column) else F.lit(reason)
        status, body = (F.col("__r.status").cast("int"), F.col("__r.body") if keep else F.lit(None).cast("string"))
        return F.struct(F.lit(outcome).alias("outcome"), reason.cast("string").alias("reason"), status.alias("status"), body.alias("body"))

    status, target = F.col("__r.status"), target_of("__at", "__r.location")
    moved = status.isin(301, 302, 303, 307, 308) & F.col("__r.location").isNotNull()
    for hop in range(1, most_hops + 1):
        df = df.withColumn("__key", F.when(F.col("__end").isNull(), F.col("__at")))
        df = df.join(answers.withColumnRenamed("__at", "__key"), "__key", "left")
        found = (
            F.when(F.col("__r").isNull() | status.isNull(), end("failed", "no connection"))
            .when(moved & (F.contains(host_of(target), F.lit("ratelimit")) | F.contains(F.lower(target), F.lit("captcha"))), end("blocked", F.concat(F.lit("redirected to "), target)))
            .when(moved & (host_of(target) != F.col("__host")), end("failed", "redirect to another host"))
            .when(moved, end("failed", "too many redirects") if hop == most_hops else F.lit(None))
            .when(status.isin(403, 429), end("blocked", F.concat(F.lit("HTTP "), status.cast("string"))))
            .when(looks_like_challenge("__r.body"), end("blocked", "challenge"))
            .when(status == 202, end("blocked", "HTTP 202"))
            .when(status == 200, end("ok", F.lit(None), keep=True))
            .otherwise(end("failed", F.concat(F.lit("HTTP "), status.cast("string"))))
        )
        open_ = F.col("__end").isNull()
        calls = F.when(open_, F.col("calls") + F.coalesce("__r.tries", F.lit(most_tries))).otherwise(F.col("calls"))
        df = df.select(*(x for x in df.columns if x not in ("__key", "__r", "__at", "calls", "__end")), calls.alias("calls"), F.when(open_ & moved, target).otherwise(F.col("__at")).alias("__at"), F.when(open_, found).otherwise(F.col("__end")).alias("__end"))
    df = cut(df)
    discard(answers)
    # One row for each host that blocks, however many requests it has.
    stop = df.where("__end.outcome = 'blocked'").groupBy("__host").agg(F.min(ordinal).alias("__stop"))
    df = df.join(stop, "__host", "left")
    made = F.coalesce(F.col(ordinal) <= F.col("__stop"), F.lit(True))
    e = F.when(made, F.col("__end"))
    body = e["body"]
    return df.select(
        *requests.columns, F.coalesce(e["outcome"], F.lit("skipped")).alias("outcome"), F.when(made, e["reason"]).otherwise("blocked earlier").alias("reason"), F.when(made, F.col("__at")).alias("final_url"),
        e["status"].alias("status"), body.alias("body"), F.when(body.isNotNull(), content_address(body)).alias("sha256"), F.when(made, F.col("calls")).otherwise(0).alias("calls"),
    )


def robots_by_status(df: DataFrame, status: str = "status") -> Column:
    """What a host's robots.txt means by its status alone: 4xx allows all, 5xx nothing; null: read its rules."""
    return F.when(F.col(status).between(400, 499), True).when(F.col(status) >= 500, False)


def paced(requests: DataFrame, intervals: dict[str, float], default: float = 2.0, host: str = "host", ordinal: str = "ordinal") -> DataFrame:
    """requests with starts_at: the second from the host's first request at which each may start. Between two of a host's requests lie its interval and up to a quarter of
    it more; which part is told by a hash of the host and the ordinal, so plans can be repeated."""
    least = F.lit(default)
    for name, seconds in intervals.items():
        least = F.when(F.col(host) == name, F.lit(seconds)).otherwise(least)
    w = Window.partitionBy(host).orderBy(ordinal)
    jitter = F.pmod(F.xxhash64(host, ordinal), F.lit(1000)) / 4000
    wait = F.when(F.row_number().over(w) == 1, 0.0).otherwise(least * (1 + jitter))
    return requests.withColumn("__wait", wait).withColumn("starts_at", F.sum("__wait").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__wait")
