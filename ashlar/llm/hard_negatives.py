"""Hard-negative mining over k-means inverted lists that store their centroids' radii.

A row x of a list with centroid c and radius r scores at most a.c + |a| r with an anchor a, and at least a.c - |a| r (Cauchy-Schwarz). Lists are visited by
falling upper bound; a list outside the window of scores that is asked for is skipped, and a search stops when the bound is strictly below its k-th score. All vectors and
centroids are integers and all scores exact, so the result doesn't depend on the lists: every row is in one, and none is left out that could count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ashlar.llm.common import cut, small_batches, table, tidy
from ashlar.llm.whitening import usable
from ashlar.tables import discard

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: Negatives score from LEAST to MOST hundredths of the positive.
LEAST, MOST = 30, 90
#: Rows that k-means is fitted on (about as many are drawn at random; all rows are indexed), its rounds, and how many lists there are.
SAMPLE_ROWS = 8192
ROUNDS = 8
ROWS_A_LIST = 512
MOST_LISTS = 1024
#: Rows of a block, the part of a list that is visited at once; searches of a tile, about; blocks that a tile's task is sent at most, about.
BLOCK = 2048
TILE = 1024
BLOCKS_A_TASK = 512
_CELLS = 1 << 20
_FAR = 1 << 62
_BINARY = ("a", "b", "c", "d", "e", "x")
_ROW_SQL = "tile long, list int, bound double, far long, a binary, b binary, c binary, d binary, e binary, x binary"


@dataclass
class Lists:
    """What every task knows of the index: centroids, radii, and the sample that they were fitted on with its labels. Its size follows the parameters, not the rows."""

    centers: np.ndarray
    sample: np.ndarray
    labels: np.ndarray
    exact: bool  # whether float64 holds all sums of products
    radii: np.ndarray | None = None

    @property
    def kind(self) -> str:
        return "<i4" if self.exact else "<i8"

    def dots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inner products of all rows of two integer matrices."""
        if self.exact:
            return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        return a.astype(np.int64) @ b.astype(np.int64).T

    def read(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind).reshape(-1, self.centers.shape[1])


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k centroids of whole numbers. Begins with the first k different rows; a centroid without rows stays where it is."""
    _, first = np.unique(x, axis=0, return_index=True)
    c = x[np.sort(first)[:k]].astype(np.float64)
    for _ in range(rounds if len(c) > 1 else 0):
        near = ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
        order = np.argsort(near, kind="stable")
        there, at = np.unique(near[order], return_index=True)
        c[there] = np.add.reduceat(x[order], at, axis=0) / np.diff([*at, len(x)])[:, None]
    return np.rint(c).astype(np.int64)


@dataclass
class Index:
    lists: Lists
    rows: DataFrame  # id, label, anchor, row (unique), list, x (binary)
    blocks: DataFrame  # list, sub, far (the largest squared distance to the centroid), a (row), b (whether the id is null), c (label), d (id), x
    sizes: DataFrame  # list, subs
    blocks_in_all: int


def build(df: DataFrame, **options) -> Index | None:
    """The index of rows (id, label, anchor: a flag that stays with the row, x: array of longs, all of one length and without nulls). None if there are no rows."""
    spark = df.sparkSession
    o = dict(sample_rows=SAMPLE_ROWS, rows_a_list=ROWS_A_LIST, most_lists=MOST_LISTS, block=BLOCK) | options
    head = df.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim"), F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("largest")).first()
    n, dim, largest = head["n"], head["dim"], head["largest"]
    if not n:
        return None
    if 100 * dim * (2 * largest) ** 2 >= 1 << 63:
        raise ValueError("scores of vectors this long are no longs")
    drawn = df.where(F.rand(7) < min(1.0, o["sample_rows"] / n)).select("x", "label").toPandas()  # about sample_rows of them
    if drawn.empty:
        drawn = df.select("x", "label").limit(1).toPandas()
    sample = np.array(drawn["x"].tolist(), np.int64)
    centers = kmeans(sample, max(1, min(o["most_lists"], n // o["rows_a_list"])))
    lists = Lists(centers, sample, drawn["label"].to_numpy(np.int64), dim * (2 * largest) ** 2 < 1 << 53 and largest < 1 << 30)
    sent = spark.sparkContext.broadcast(lists)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        norms = (m.centers * m.centers).sum(axis=1)
        for b in batches:
            x = b.column(4).flatten().to_numpy().reshape(-1, dim)
            near, far = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
            step = max(1, _CELLS // len(norms))
            for at in range(0, len(x), step):
                part = slice(at, at + step)
                away = norms - 2 * m.dots(x[part], m.centers)
                near[part] = away.argmin(axis=1)
                far[part] = away.min(axis=1) + (x[part] * x[part]).sum(axis=1)
            packed = pa.array([v.tobytes() for v in x.astype(m.kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(near), pa.array(far), packed], names=["id", "label", "anchor", "row", "list", "far", "x"])

    numbered = df.select("id", "label", "anchor", F.monotonically_increasing_id().alias("row"), "x")
    rows = cut(numbered.mapInArrow(tidy(assign), "id long, label long, anchor boolean, row long, list int, far long, x binary"))
    found = rows.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row a list
    lists.radii = np.zeros(len(centers))
    for r in found:
        lists.radii[r["list"]] = np.sqrt(float(r["far"])) * (1 + 1e-9)
    subs = [(r["list"], -(-r["n"] // o["block"])) for r in found]
    sizes = spark.createDataFrame(subs, "list int, subs long")
    dealt = rows.join(F.broadcast(sizes), "list").withColumn("sub", F.pmod(F.xxhash64("row"), "subs"))

    def packed(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids = t["id"].fill_null(0).to_numpy().astype("<i8")
        none = np.array(t["id"].is_null().to_pylist(), np.uint8)
        one = [t["list"][0].as_py(), t["sub"][0].as_py(), max(t["far"].to_pylist())]
        raw = [t["row"].to_numpy().astype("<i8").tobytes(), none.tobytes(), t["label"].to_numpy().astype("<i8").tobytes(), ids.tobytes(), b"".join(t["x"].to_pylist())]
        return pa.table([[v] for v in one + raw], schema=pa.schema([("list", pa.int32()), ("sub", pa.int64()), ("far", pa.int64()), *((c, pa.binary()) for c in "abcdx")]))

    blocks = cut(dealt.groupBy("list", "sub").applyInArrow(packed, "list int, sub long, far long, a binary, b binary, c binary, d binary, x binary"))
    return Index(lists, rows, blocks, sizes, sum(s for _, s in subs))


def _bounds(lists: Lists, x: np.ndarray, center: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest and the smallest score of each row of x with any row of each list."""
    mid = lists.dots(x, center).astype(np.float64)
    reach = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * radius[None, :] * (1 + 1e-9) + 1e-9 * np.abs(mid)
    return mid + reach, mid - reach


class Tile:
    """Searches that visit blocks together: of each the window of scores, the best found so far, and the score that a row must reach."""

    def __init__(self, lists: Lists, row: dict, same: bool, k: int):
        self.lists, self.same, self.k = lists, same, k
        self.keys, self.wants, self.labels = (np.frombuffer(row[c], "<i8") for c in "abc")
        self.low, self.high = np.frombuffer(row["d"], "<i8").reshape(2, -1)
        x = lists.read(row["x"])
        _, first, self.anchor = np.unique(self.keys, return_index=True, return_inverse=True)  # an anchor's searches share its vector
        self.x = x[first]
        n = len(self.keys)
        self.kth = self.low.copy()  # a candidate must score more, or as much with a smaller id than `last`
        self.last = np.full(n, np.iinfo(np.int64).max)
        self.full = np.zeros(n, bool)
        self.best = tuple(np.empty(0, np.int64) for _ in range(4))  # search, score, order of the id, id's null

    def visit(self, row: dict) -> None:
        m = self.lists
        upper, lower = _bounds(m, self.x, m.centers[row["list"]][None, :], np.array([np.sqrt(float(row["far"]))]))
        wanted = np.flatnonzero((upper[self.anchor, 0] >= self.kth) & (lower[self.anchor, 0] <= self.high))
        if not len(wanted):
            return
        rows, labels, ids = (np.frombuffer(row[c], "<i8") for c in "acd")
        none = np.frombuffer(row["b"], np.uint8).astype(np.int64)
        order = np.where(none == 1, np.iinfo(np.int64).max, ids)
        x = m.read(row["x"])
        step = max(1, _CELLS // len(rows))
        for at in range(0, len(wanted), step):
            w = wanted[at : at + step]
            used, back = np.unique(self.anchor[w], return_inverse=True)
            s = m.dots(self.x[used], x)[back]
            alike = self.labels[w, None] == labels[None, :]
            kth = self.kth[w, None]
            good = (s >= kth) & (s <= self.high[w, None]) & (alike if self.same else ~alike)
            good &= (s > kth) | ~self.full[w, None] | (order[None, :] < self.last[w, None])
            if self.same:
                good &= rows[None, :] != self.keys[w, None]
            i, j = np.nonzero(good)
            if len(i):
                self._keep(w[i], s[i, j], order[j], none[j])

    def _keep(self, *new: np.ndarray) -> None:
        search, score, order, none = (np.concatenate(p) for p in zip(self.best, new))
        at = np.lexsort((order, -score, search))
        search = search[at]
        starts = np.flatnonzero(np.diff(search, prepend=-1))
        rank = np.arange(len(search)) - np.repeat(starts, np.diff([*starts, len(search)]))
        at, search, rank = at[rank < self.k], search[rank < self.k], rank[rank < self.k]
        self.best = search, score[at], order[at], none[at]
        whole = rank == self.k - 1
        self.kth[search[whole]], self.last[search[whole]], self.full[search[whole]] = self.best[1][whole], self.best[2][whole], True

    def over(self, bound: float) -> bool:
        """Whether no block of this bound or a smaller one can change anything."""
        return bool((bound < self.kth).all())

    def result(self) -> pa.RecordBatch:
        search, score, order, none = self.best
        ids = pa.array(order, pa.int64(), mask=none == 1)
        return pa.RecordBatch.from_arrays([pa.array(self.keys[search]), pa.array(self.wants[search]), pa.array(score), ids], names=["key", "want", "score", "id"])


def search(index: Index, wants: DataFrame, same: bool, k: int, tile: int = TILE, blocks_a_task: int = BLOCKS_A_TASK) -> DataFrame:
    """key, want, score, id, rank: for each search the first k rows, by falling score and rising id (nulls last), that score from `low` to `high`
    with its vector and have the same label (same, the row `key` itself left out) or another one.

    wants: key (the row of the vector), want (a number; with key it names the search), label, list, x, low, high. Searches are gathered in tiles, those of like vectors together. A tile tells by
    the bounds which lists it must see, and each of their blocks is sent to it. What it must reach at first it learns from the sample. A hot list is many blocks,
    and its searches many tiles, so no task gets more than a tile and its share of the blocks.
    """
    spark = wants.sparkSession
    counts = sorted(wants.groupBy("list").count().collect())  # a row a list
    total, starts = 0, []
    for r in counts:
        parts = -(-r["count"] // tile)
        starts.append((r["list"], total // tile, parts))
        total += parts * tile if parts > 1 else r["count"]
    tiles = max(1, -(-total // tile))
    slices = max(-(-index.blocks_in_all // blocks_a_task), -(-2 * spark.sparkContext.defaultParallelism // tiles))
    slices = max(1, min(slices, index.blocks_in_all))
    where = spark.createDataFrame(starts, "list int, start long, parts long")
    tiled = wants.join(F.broadcast(where), "list").withColumn("tile", F.col("start") + F.pmod(F.xxhash64("key"), "parts"))
    sent = spark.sparkContext.broadcast(index.lists)

    def aim(t: pa.Table) -> pa.Table:
        m, t = sent.value, t.combine_chunks()
        n, one = t.num_rows, t["tile"][0].as_py()
        x = m.read(b"".join(t["x"].to_pylist()))
        labels, low, high = (t[c].to_numpy() for c in ("label", "low", "high"))
        low = low.copy()
        step = max(1, _CELLS // len(m.sample))
        for at in range(0, n if len(m.sample) > k else 0, step):
            part = slice(at, at + step)
            s = m.dots(x[part], m.sample)
            alike = labels[part, None] == m.labels[None, :]
            s[~((alike if same else ~alike) & (s >= low[part, None]) & (s <= high[part, None]))] = -_FAR
            floor = np.partition(s, -k - 1, axis=1)[:, -k - 1]  # one more than k: the row itself may be in the sample
            low[part] = np.maximum(low[part], floor)
        upper, lower = _bounds(m, x, m.centers, m.radii)
        alive = (upper >= low[:, None]) & (lower <= high[:, None])
        bound = np.where(alive, np.minimum(upper, high[:, None]), -np.inf).max(axis=0)
        seen = np.flatnonzero(alive.any(axis=0))
        raw = [t["key"].to_numpy().astype("<i8").tobytes(), t["want"].to_numpy().astype("<i8").tobytes(), labels.astype("<i8").tobytes(), np.concatenate([low, high]).astype("<i8").tobytes(), None, x.tobytes()]
        none = [None] * len(seen)
        columns = [[one] * (len(seen) + 1), [-1, *seen.tolist()], [np.inf, *bound[seen].tolist()], [None, *none], *([v, *none] for v in raw)]
        fields = [("tile", pa.int64()), ("list", pa.int32()), ("bound", pa.float64()), ("far", pa.int64()), *((c, pa.binary()) for c in _BINARY)]
        return pa.table(columns, schema=pa.schema(fields))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, here = None, None
        for b in batches:
            for at in range(b.num_rows):
                row = {c: b.column(c)[at].as_py() for c in ("tile", "slice", "list", "bound")}
                if row["list"] < 0:
                    if now is not None:
                        yield now.result()
                    here, now = (row["tile"], row["slice"]), Tile(sent.value, {c: b.column(c)[at].as_py() for c in _BINARY}, same, k)
                elif (row["tile"], row["slice"]) != here:
                    raise RuntimeError("a block came before its tile")
                elif not now.over(row["bound"]):
                    now.visit(row | {c: b.column(c)[at].as_py() for c in ("far", *_BINARY)})
        if now is not None:
            yield now.result()

    with small_batches(spark, 16):
        aimed = cut(tiled.groupBy("tile").applyInArrow(aim, _ROW_SQL))
        own = aimed.where("list < 0").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        seen = aimed.where("list >= 0").select("tile", "list", "bound").join(F.broadcast(index.sizes), "list").withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)))
        blocks = seen.join(index.blocks, ["list", "sub"]).withColumn("slice", F.pmod(F.xxhash64("list", "sub"), F.lit(slices)).cast("int")).withColumn("e", F.lit(None).cast("binary"))
        columns = ["tile", "slice", "list", "bound", "far", *_BINARY]
        sent_to = own.select(columns).unionByName(blocks.select(columns)).repartition("tile", "slice").sortWithinPartitions("tile", "slice", F.desc("bound"), "list")
        found = cut(sent_to.mapInArrow(tidy(visit), "key long, want long, score long, id long"))
    discard(aimed)
    first = Window.partitionBy("key", "want").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def _floor(a, b: int):
    """a / b, rounded down, of a long."""
    return F.expr(f"(({a}) - pmod({a}, {b}L)) div {b}L")


def mine(df: DataFrame, anchor, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, **options) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor: a condition over df's columns that tells which rows are anchors.

    A row's score is the integer product of its vector with the anchor's, each entry taken as floor(256 * entry). An anchor's positives are the first `positives` other rows of its label; for each of
    them the first `negatives` rows of other labels come whose score is from least to most hundredths of the positive's. Higher scores come first, of equal ones the smaller id, null ids last.

    Rows with a null label, a null or empty vector, or an entry that is null or not finite take no part, nor do vectors of another length than most rows have (of equally many, the
    shorter). A row that repeats counts each time: it can be its copy's positive, and is an anchor of its own. A positive of a negative score has no negatives, as its window is empty. No usable row, no anchor: no rows.
    Scores that might be no longs (entries beyond some 70,000 at 64 dimensions) are a ValueError. Other columns are read by `anchor` alone.
    """
    spark = df.sparkSession
    good = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    good = good.where(F.col("label").isNotNull() & usable("v")).where(F.size("v") > 0)
    common = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if common is None:
        return empty
    whole = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x")
    index = build(good.where(F.size("v") == common["dim"]).select("id", "label", "anchor", whole), **{k: v for k, v in options.items() if k not in ("tile", "blocks_a_task")})
    anchors = index.rows.where("anchor")
    within = {k: v for k, v in options.items() if k in ("tile", "blocks_a_task")}
    wide = anchors.select(F.col("row").alias("key"), F.lit(0).cast("long").alias("want"), "label", "list", "x", F.lit(-_FAR).alias("low"), F.lit(_FAR).alias("high"))
    near = cut(search(index, wide, True, positives, **within).select("key", F.col("rank").cast("long").alias("want"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")))
    windows = near.withColumn("low", -_floor(f"-{least} * positive_score", 100)).withColumn("high", _floor(f"{most} * positive_score", 100)).where("low <= high")
    asked = windows.join(anchors.select(F.col("row").alias("key"), "label", "list", "x"), "key").select("key", "want", "label", "list", "x", "low", "high")
    found = search(index, asked, False, negatives, **within)
    named = near.join(anchors.select(F.col("row").alias("key"), F.col("id").alias("anchor_id")), "key")
    out = found.join(named, ["key", "want"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row of embeddings among all rows; every seventh row has the next label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return mine(rows, F.col("vec_id") % 100 == 0)


SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x, row_number() OVER () AS i
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: isfinite(c))) = len(embedding) AND len(embedding) > 0),
s AS (SELECT a.i, a.vec_id AS anchor_id, b.vec_id, b.i AS j, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM r a JOIN r b ON a.i <> b.i WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (SELECT p.i, p.k, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.i, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM p JOIN s ON p.i = s.i AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
