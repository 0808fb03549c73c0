from fractions import Fraction

import numpy as np
import pytest

from ashlar.llm import whitening
from ashlar.llm.whitening import centred, decompose, digits_for, lengths, op12_whiten, products, whiten

FOLDER = "/root/testdata/sf0.001"


def plain(vectors):
    """n, z = n*x - S as Python's integers, and the covariance as float64 of exact fractions."""
    x = [[int(np.floor(np.float64(c) * 1024)) + 100_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    sums = [sum(v[k] for v in x) for k in range(dim)]
    z = [[n * v[k] - sums[k] for k in range(dim)] for v in x]
    cov = [[sum(v[a] * v[b] for v in z) for b in range(dim)] for a in range(dim)]
    return n, z, np.array([[float(Fraction(c, n**3)) for c in row] for row in cov])


def check(rows, vectors, most=8, tight=1e-8):
    """rows: (id, component) to Row; vectors by id."""
    ids = list(vectors)
    n, z, cov = plain([vectors[k] for k in ids])
    dim = len(cov)
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    assert set(rows) == {(k, c) for k in ids for c in range(1, min(most, dim) + 1)}
    for at, k in enumerate(ids):
        for c in range(1, min(most, dim) + 1):
            r = rows[k, c]
            assert r["n"] == n and r["deviation_exact"] == sum(v * v for v in z[at])
            assert r["deviation"] == (r["deviation_exact"] if r["deviation_exact"] < 2**63 else None)
            assert r["explained"] == pytest.approx(e[c - 1] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-9
    for c in range(1, min(most, dim) + 1):
        want = (np.array(z, float) / n) @ q[:, c - 1] / np.sqrt(e[c - 1])
        got = np.array([rows[k, c]["whitened"] for k in ids])
        assert np.abs(got - want * np.sign(got @ want)).max() < tight


def test_query(spark):
    rows = {(r["vec_id"], r["component"]): r for r in op12_whiten(spark, FOLDER).collect()}
    check(rows, {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()})


@pytest.fixture
def query(spark, tmp_path):
    def run(rows, kind="float"):
        at = tmp_path / str(len(list(tmp_path.iterdir())))
        spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, whitened int, x string, n int").repartition(3).write.parquet(f"{at}/embeddings.parquet")
        return op12_whiten(spark, str(at)).collect()

    return run


def test_odd_rows(query):
    rng = np.random.default_rng(1)
    good = {k: [float(c) for c in rng.normal(size=3) * [1, 1e-2, 30]] for k in range(20)}
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [0.0, float("inf"), 0.0], [1.0, 2.0], [1e300, 0.0, 0.0]]
    rows = query([(k, v, 1, "a", 2) for k, v in good.items()] + [(100 + k, v, 1, "a", 2) for k, v in enumerate(bad)], "double")
    check({(r["vec_id"], r["component"]): r for r in rows}, good)


def test_large_entries(query):
    rng = np.random.default_rng(2)
    vectors = {k: [float(c) for c in rng.normal(size=4) * [1e12, 1e12, 1e9, 1e6]] for k in range(40)}
    check({(r["vec_id"], r["component"]): r for r in query([(k, v, 1, "a", 2) for k, v in vectors.items()], "double")}, vectors, tight=1e-5)


def test_no_variance_repeats_and_empty(spark, query):
    assert query([(1, None, 1, "a", 2)]) == []
    rows = query([(k, [1.0, 2.0], 1, "a", 2) for k in (1, 1, None)])
    assert len(rows) == 6 and all(r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in rows)
    flat = query([(k, [float(k), 2.0 * k, 0.0], 1, "a", 2) for k in range(9)])
    assert {r["component"]: r["explained"] for r in flat} == {1: 1.0, 2: 0.0, 3: 0.0} and all((r["whitened"] is None) == (r["component"] > 1) for r in flat)
    assert max(r["identity_error"] for r in flat) < 1e-12


@pytest.mark.parametrize("largest", [1, 200, 2**15, 2**40, 2**62, 2**80])
def test_digits_against_big_integers(largest):
    rng = np.random.default_rng(3)
    z = [[int(rng.integers(-(2**62), 2**62)) * largest >> 62 for _ in range(5)] for _ in range(50)]
    count = digits_for(max(abs(v) for r in z for v in r))
    held = np.array(z, np.int64 if count <= 4 else object)
    total, got = products(held, count), lengths(held, count)
    for a in range(5):
        for b in range(5):
            assert sum(int(total[p][a][b]) << 16 * p for p in range(2 * count - 1)) == sum(r[a] * r[b] for r in z)
    assert got == [sum(v * v for v in r) for r in z]


def test_centring_that_runs_over():
    x = np.array([[2**61, -(2**61)], [2**61 + 5, 7 - 2**61]])
    n = 1000
    sums = [n * 2**61 + 3, -n * 2**61 + 11]
    assert centred(x, n, sums, 2).tolist() == [[-3, -11], [4997, 6989]] == [[int(v) for v in r] for r in centred(x, n, sums, 5)]


def test_small_eigenvalues_beside_large_ones():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    a = [[int(v) for v in r] for r in np.rint(rng.normal(size=(50, 6)) @ np.diag([2.0**40, 2.0**38, 2.0**20, 2.0**18, 2.0**17, 2.0**16]) @ q)]
    cov = [[sum(r[i] * r[j] for r in a) for j in range(6)] for i in range(6)]
    values, vectors, trace = decompose(cov, 7)
    rest = [[Fraction(sum(Fraction(vectors[k, i]) * cov[k][m] for k in range(6))) for m in range(6)] for i in range(6)]
    for i in range(6):
        for j in range(6):
            v = float(sum(rest[i][m] * Fraction(vectors[m, j]) for m in range(6)) / 7**3)
            assert abs(v - (values[i] if i == j else 0)) <= 1e-15 * values[0]
    assert trace == pytest.approx(sum(cov[k][k] for k in range(6)) / 343)
    assert whitening.decompose([[0, 0], [0, 0]], 3)[2] == 0


def test_blocks(spark, monkeypatch):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    whole = {r["vec_id"]: r["whitened"] for r in whiten(df).collect()}
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    dealt = {r["vec_id"]: r["whitened"] for r in whiten(df.repartition(5)).collect()}
    assert dealt == {k: pytest.approx(v, rel=1e-12, abs=1e-12) for k, v in whole.items()}
