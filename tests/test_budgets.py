from datetime import datetime, timedelta

from ashlar.streaming import budgets
from ashlar.streaming.streams import read_stream


def plain(calls, budget, failures):
    """Decisions call by call."""
    state, out = {}, {}
    for source, call, at, failed in calls:
        month = (at - timedelta(hours=8)).strftime("%Y-%m")  # of winter months alone
        s = state.get(source)
        if s is None or month > s[0]:
            s = state[source] = [month, 0, 0, False]
        if month < s[0]:
            out[call] = (source, month, None, "late")
            continue
        s[1] += 1
        granted = not s[3] and s[1] <= budget
        out[call] = (source, month, s[1], "granted" if granted else "breaker open" if s[3] else "over budget")
        if granted:
            s[2] = s[2] + 1 if failed else 0
            s[3] = s[2] >= failures
    return out


def test_counts_go_on_after_a_restart(spark, tmp_path):
    at = lambda d, h=12: datetime(2026, 1, 1, h) + timedelta(days=d)
    first = [("a", k, at(k), k % 3 == 0) for k in range(1, 20)] + [("b", 100 + k, at(k), True) for k in range(1, 12)]
    second = [("a", 30 + k, at(20, k), False) for k in range(1, 9)] + [("a", 50, at(31, 7), False), ("a", 51, at(31, 9), False), ("b", 150, at(32), False), ("b", 151, at(25), False), (None, 160, at(3), False), ("c", 161, at(40), None)]
    third = [("a", 60, at(75), False), ("a", 61, at(30), False)]
    source, root = f"file://{tmp_path}/in", f"file://{tmp_path}/kept"
    seen = []
    for part in (first, second, third):
        spark.createDataFrame(part, "source string, call long, at timestamp, failed boolean").coalesce(1).write.mode("append").parquet(source)
        seen += sorted((c for c in part if c[0]), key=lambda c: (c[0], c[2], c[1]))
        rows = budgets.keep(budgets.ledger(read_stream(spark, source), 22, 5, "10 days"), root).collect()
        got = {r["call"]: (r["source"], r["period"], r["call_no"], r["decision"]) for r in rows if r["decision"] != "closed"}
        want = plain(seen, 22, 5)
        assert {k: v for k, v in got.items() if k in want} == got and all(got.get(k) == v for k, v in want.items() if v[3] != "late")
    closed = sorted((r["source"], r["period"], r["call_no"]) for r in rows if r["decision"] == "closed")
    assert closed == [("a", "2026-01", 28), ("a", "2026-02", 1), ("b", "2026-01", 12), ("b", "2026-02", 1), ("c", "2026-02", 1)]
    assert {v[3] for v in got.values()} >= {"granted", "over budget", "breaker open"}
