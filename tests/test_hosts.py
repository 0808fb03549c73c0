import ipaddress
import random

from pyspark.sql import functions as F

from ashlar.sources import hosts


def number(a):
    return int(ipaddress.IPv4Address(a))


def test_blocks_are_the_range(spark):
    rng = random.Random(1)
    ranges = [(a, b) for _ in range(300) for a, b in [sorted(rng.randint(0, 2 ** rng.choice([4, 16, 32]) - 1) for _ in range(2))]] + [(0, 2**32 - 1), (5, 5), (0, 0)]
    df = spark.createDataFrame(ranges, "f long, l long").select("f", "l", hosts.aligned_blocks(F.col("f"), F.col("l")).alias("b"))
    for r in df.collect():
        want = {(int(n.network_address), 32 - n.prefixlen) for n in ipaddress.summarize_address_range(ipaddress.IPv4Address(r["f"]), ipaddress.IPv4Address(r["l"]))}
        assert {(b["start"], b["bits"]) for b in r["b"]} == want and len(r["b"]) == len(want) <= 62


def test_large_lists_without_a_cross_join(spark):
    rng = random.Random(2)
    text = lambda n: str(ipaddress.IPv4Address(n))
    ranges = [(text(a), text(min(a + rng.choice([0, 3, 1000, 10**6]), 2**32 - 1)), f"r{k}") for k in range(10_000) for a in [rng.randint(0, 2**32 - 1)]]
    suffixes = [(f"n{k}.test", f"s{k}") for k in range(100_000)]
    names = [f"a.b{k}.n{k * 37 % 200_000}.test" for k in range(2_000)] + ["n5.test", "xn5.test", "N6.TEST.", "test", ""]
    addresses = [text(rng.randint(0, 2**32 - 1)) for _ in range(1_500)] + [r[0] for r in ranges[:200]] + ["1.2.3", "1.2.3.999", "::1", "x", None]
    s = spark.createDataFrame(suffixes, "suffix string, label string")
    got = {r["k"]: r["label"] for r in hosts.longest_suffix(spark.createDataFrame(list(enumerate(names)), "k long, n string"), "k", "n", s).collect()}
    by = dict(suffixes)
    want = {}
    for k, n in enumerate(names):
        labels = n.lower().rstrip(".").split(".")
        if hit := next((by[x] for i in range(len(labels)) if (x := ".".join(labels[i:])) in by), None):
            want[k] = hit
    assert got == want and len(want) > 900
    found = hosts.narrowest_range(spark.createDataFrame(list(enumerate(addresses)), "k long, a string"), "k", "a", spark.createDataFrame(ranges, "first string, last string, label string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    spans = [(number(f), number(z), label) for f, z, label in ranges]
    want = {}
    for k, a in enumerate(addresses):
        if a and a.count(".") == 3 and all(p.isdigit() and int(p) < 256 for p in a.split(".")):
            hits = [(z - f, label) for f, z, label in spans if f <= number(a) <= z]
            if hits:
                want[k] = min(hits)[1]
    assert {r["k"]: r["label"] for r in found.collect()} == want and len(want) > 200


def test_what_tells(spark):
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    asked = df([("A.Blocked.test.",), ("b.test",), ("c.test",), ("d.test",), (None,), ("b.test",), ("e.test",)], "host string")
    resolved = df([("a.blocked.test", ["x.edge.net"], ["1.1.1.1"]), ("b.test", ["b.test", "q.edge.net", "z.edge.net"], ["1.1.1.1"]), ("c.test", ["c.test"], ["9.9.9.9", "1.1.1.2", "1.1.1.1"]), ("d.test", None, [None])], "host string, names array<string>, addresses array<string>")
    out = hosts.blocked_hosts(asked, "host", resolved, df([("blocked.test", "N"), ("blocked.test", "M")], "suffix string, label string"), df([("edge.net", "E"), ("z.edge.net", "Z")], "suffix string, label string"), df([("1.1.1.0", "1.1.1.255", "R"), ("1.1.1.2", "1.1.1.2", "one")], "first string, last string, label string"))
    assert {tuple(r) for r in out.collect()} == {("a.blocked.test", "name", "M", "a.blocked.test"), ("b.test", "alias", "E", "q.edge.net"), ("c.test", "address", "one", "1.1.1.2")}
    none = df([], "suffix string, label string")
    assert hosts.blocked_hosts(asked, "host", resolved, none, none, df([], "first string, last string, label string")).collect() == []
