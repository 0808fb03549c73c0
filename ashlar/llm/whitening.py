"""Embedding whitening by digit-slice products: vectors are centred as integers, the integers split into small digits so that float64 BLAS products
are exact, the digits' products added up and recombined as big integers, and the exact covariance is decomposed.

Vectors x of long entries, n of them with sums S, are centred without rounding as z = n*x - S. Then n^3 times the covariance is the sum of z z^T.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import cut, small_batches, table, tidy

#: x = floor(SCALE * entry) + SHIFT.
SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Bits of a digit; products of two digits then have 32, and a float64 adds 2^21 of them exactly.
DIGIT = 16
BLOCK_ROWS = 1 << 14
#: Entries from here on aren't taken for numbers: SCALE times them is no long.
LARGEST = 2.0**52


def usable(vector: str, dim: int | None = None) -> Column:
    """Whether a vector is there and all its entries are finite and small enough to become longs; with dim, also that it has so many."""
    good = F.coalesce(F.forall(F.col(vector), lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False))), F.lit(False))  # NaN is above all numbers
    return good if dim is None else good & (F.size(vector) == dim)


def integers(vector: str) -> Column:
    """x of each entry."""
    return F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT).cast("long"))


def digits(z: np.ndarray, count: int) -> list[np.ndarray]:
    """z (int64, or object if longer) as float64 digits of DIGIT bits, the lowest first; the last has the sign."""
    out = []
    for k in range(count):
        out.append((z if k == count - 1 else z & ((1 << DIGIT) - 1)).astype(np.float64))
        z = z >> DIGIT
    return out


def digits_for(largest: int) -> int:
    return max(1, -(-(int(largest).bit_length() + 1) // DIGIT))


def centred(x: np.ndarray, n: int, sums: list[int], count: int) -> np.ndarray:
    """n*x - S of rows of longs, exactly: in int64 where that fits (what runs over on the way is right again in the end), else Python's integers."""
    if count * DIGIT <= 64:
        return n * x - np.array([s % (1 << 64) for s in sums], np.uint64).view(np.int64)
    return n * x.astype(object) - np.array(sums, object)


def products(z: np.ndarray, count: int) -> np.ndarray:
    """The digits' products summed over rows, for each place (sum of the two digits' places): int64 (2*count - 1) x dim x dim. Exact: a block's sums stay below 2^53."""
    parts, dim = digits(z, count), z.shape[1]
    out = np.zeros((2 * count - 1, dim, dim), np.int64)
    flat = np.concatenate(parts, axis=1)
    gram = (flat.T @ flat).reshape(count, dim, count, dim)
    for a in range(count):
        for b in range(count):
            out[a + b] += gram[a, :, b].astype(np.int64)
    return out


def lengths(z: np.ndarray, count: int) -> list[int]:
    """The sum of squares of each row, exactly."""
    parts = [d.astype(np.int64) for d in digits(z, count)]
    if count == 1:
        return (parts[0] ** 2).sum(axis=1).tolist()
    out = [0] * len(z)
    for a in range(count):
        for b in range(a, count):
            s = (parts[a] * parts[b]).sum(axis=1).tolist()  # below dim * 2^32
            shift = DIGIT * (a + b) + (a < b)
            out = [o + (v << shift) for o, v in zip(out, s)]
    return out


@dataclass
class Whitening:
    """What was fitted: n, sums, digits that centred entries need, eigenvalues and unit eigenvectors (columns), by falling eigenvalue, and the trace."""

    n: int
    sums: list[int]
    digits: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace else np.full(len(self.values), np.nan)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """x - S/n on the components, over the roots of their eigenvalues; NaN where there is no variance."""
        z = centred(x, self.n, self.sums, self.digits)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (z.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values), np.nan)


def decompose(cov: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, falling, and unit eigenvectors of the big integers `cov` over n^3. The eigenbasis of float64 is turned by Jacobi rotations in extended precision until
    what is off the diagonal is nothing beside the two eigenvalues, so small ones are as right as large ones."""
    top = max((abs(v) for row in cov for v in row), default=0)
    dim = len(cov)
    if not top:
        return np.zeros(dim), np.eye(dim), 0.0
    shift = max(0, top.bit_length() - 1000)
    wide = np.array([[_wide(v >> shift) for v in row] for row in cov], np.longdouble)
    scale = np.ldexp(np.longdouble(1), shift) / _wide(n) / _wide(n) / _wide(n)
    unit = np.abs(wide).max()
    wide /= unit
    _, q = np.linalg.eigh(wide.astype(np.float64))
    q = q.astype(np.longdouble)
    q = q @ (1.5 * np.eye(dim, dtype=np.longdouble) - 0.5 * (q.T @ q))  # orthonormal in extended precision
    b = q.T @ wide @ q
    eps = np.finfo(np.longdouble).eps
    for _ in range(30):
        d = np.abs(np.diag(b))
        off = np.triu(np.abs(b), 1) > np.maximum(8 * eps * np.sqrt(np.outer(d, d)), eps * eps)
        if not off.any():
            break
        for i, j in zip(*np.nonzero(off)):
            if b[i, j] == 0:
                continue
            t = (b[j, j] - b[i, i]) / (2 * b[i, j])
            t = (1 if t >= 0 else -1) / (abs(t) + np.sqrt(t * t + 1))
            c = 1 / np.sqrt(t * t + 1)
            turn = np.array([[c, c * t], [-c * t, c]], np.longdouble)
            b[:, [i, j]] = b[:, [i, j]] @ turn
            b[[i, j], :] = turn.T @ b[[i, j], :]
            q[:, [i, j]] = q[:, [i, j]] @ turn
    values = np.diag(b)
    values = np.where(values > dim * eps * values.max(), values, 0)
    order = np.argsort(-values, kind="stable")
    vectors = q[:, order] / np.sqrt((q[:, order] ** 2).sum(axis=0))
    return (values[order] * unit * scale).astype(np.float64), vectors.astype(np.float64), float(np.trace(wide) * unit * scale)


def _wide(v: int) -> np.longdouble:
    """A big integer in extended precision: its upper 62 bits and the power of two."""
    drop = max(0, abs(v).bit_length() - 62)
    return np.ldexp(np.longdouble(v >> drop), drop)


def fit(df: DataFrame, vector: str = "x") -> Whitening | None:
    """Fits all rows of df, whose column `vector` has arrays of longs, all of one length; None for no rows.

    Two passes: count, sums and extremes, then products of digits. Each task gives one matrix of sums for each pair of digits' places, by entry, and Spark adds
    them up by entry, first in the tasks. The driver gets dim^2 / 2 big integers, whatever the number of rows.
    """
    first = df.select(F.size(vector)).first()
    if first is None or not first[0]:
        return None
    dim = first[0]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, dim)
            if len(x):
                columns = [np.arange(dim), np.full(dim, len(x)), (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0), x.max(axis=0), x.min(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "n", "lower", "upper", "high", "low"])

    seen = df.select(vector).mapInArrow(tidy(look), "i long, n long, lower long, upper long, high long, low long")
    halves = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("lower", "upper")]
    got = sorted(seen.groupBy("i").agg(F.sum("n").alias("n"), *halves, F.max("high").alias("high"), F.min("low").alias("low")).collect())
    n, sums = got[0]["n"], [int(r["lower"]) + (int(r["upper"]) << 32) for r in got]
    count = digits_for(max(abs(n * v - s) for r, s in zip(got, sums) for v in (r["high"], r["low"])))
    sent = df.sparkSession.sparkContext.broadcast(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * count - 1, dim, dim), np.int64)
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, dim)
            for at in range(0, len(x), BLOCK_ROWS):
                total += products(centred(x[at : at + BLOCK_ROWS], n, sent.value, count), count)
        i, j = np.triu_indices(dim)
        for place in range(2 * count - 1):
            yield pa.RecordBatch.from_arrays([pa.array(i * dim + j), pa.array(np.full(len(i), place)), pa.array(total[place][i, j])], names=["at", "place", "v"])

    parts = df.select(vector).mapInArrow(tidy(run), "at long, place long, v long")
    entries = parts.groupBy("at", "place").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v"))
    cov = [[0] * dim for _ in range(dim)]
    for r in entries.collect():
        i, j = divmod(r["at"], dim)
        cov[i][j] += int(r["v"]) << DIGIT * r["place"]
    for i in range(dim):
        for j in range(i):
            cov[i][j] = cov[j][i]
    values, vectors, trace = decompose(cov, n)
    return Whitening(n, sums, count, values, vectors, trace)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """id_col, deviation (decimal), whitened (array of doubles, a component each), explained (array), n: one row for each usable row.

    A row is left out if its vector is null, or has an entry that is null, not finite or of 2^52 or more, which SCALE times is no long. Vectors of another length than most
    rows have (of equally many, the shorter) can't be multiplied with theirs and are left out as well; empty vectors are. A row that repeats counts each time, a null id is kept. Components
    without variance, where the vectors lie in fewer dimensions, have a null for `whitened`, and a null for `explained` if nothing varies at all. No usable row: no rows.
    Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(usable("v")).where(F.size("v") > 0)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>")
    x = rows.where(F.size("v") == common["dim"]).select("id", integers("v").alias("x"))
    fitted = fit(x)
    kept = min(most, common["dim"])
    fitted.values, fitted.vectors, dim = fitted.values[:kept], fitted.vectors[:, :kept], common["dim"]
    sent = spark.sparkContext.broadcast(fitted)
    kind = x.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            v = b.column(1).flatten().to_numpy().reshape(-1, dim)
            white = m.apply(v)
            dev = [Decimal(d) if d < 10**38 else None for d in lengths(centred(v, m.n, m.sums, m.digits), m.digits)]
            flat = pa.array(white.ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * white.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dev, pa.decimal128(38, 0)), lists], names=["id", "deviation", "whitened"])

    with small_batches(spark):
        out = cut(x.mapInArrow(tidy(run), f"id {kind}, deviation decimal(38,0), whitened array<double>"))
    explained = F.array(*(F.lit(None if np.isnan(e) else float(e)).cast("double") for e in fitted.explained))
    return out.select(F.col("id").alias(id_col), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"))


def identity_error(white: DataFrame, column: str = "whitened") -> float | None:
    """The largest absolute entry of the covariance of a column of arrays (divisor the number of rows, centred before multiplying) less the identity, of
    the components that have variance; None if there are none or no rows."""
    first = white.select(F.size(column).alias("k"), F.transform(column, lambda v: v.isNull()).alias("none")).first()
    there = [k for k in range(first["k"]) if not first["none"][k]] if first else []
    if not there:
        return None
    item = {k: F.element_at(column, k + 1) for k in there}
    mean = white.agg(*(F.avg(item[k]).alias(f"m{k}") for k in there)).first()
    off = {k: item[k] - F.lit(mean[f"m{k}"]) for k in there}
    pairs = [(a, b) for a in there for b in there if a <= b]
    cov = white.agg(*(F.avg(off[a] * off[b]).alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(cov[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def op12_whiten(spark, sf_dir: str) -> DataFrame:
    """Every usable row of embeddings on each of the first components. deviation is null where it is no long; deviation_exact has up to 38 digits."""
    white = whiten(table(spark, sf_dir, "embeddings"))
    error = identity_error(white)
    each = white.select("vec_id", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c"))
    fits = F.col("deviation") <= F.lit(2**63 - 1)
    return each.select(
        "vec_id", (F.col("k") + 1).alias("component"), "n", F.when(fits, F.col("deviation")).cast("long").alias("deviation"), F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"), F.col("deviation").alias("deviation_exact"),
    )
