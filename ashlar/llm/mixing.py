"""Mixing sources to target weights: fixed-length blocks of words, multinomial counts for each shard, keyed permutations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ashlar.llm.common import cut, table, tidy

BLOCK_WORDS = 128
SHARD_SLOTS = 8192
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_TIMES = 2
SEED = 20260
#: Sources are a setting of a mix, named by people; the driver holds their totals. More than this is refused, not cut.
MOST_SOURCES = 200_000
#: Documents of a source whose offsets one task sums, about.
BUCKET_ROWS = 4096
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_count(text):
    """Number of runs of characters other than space and \\t-\\r; null has none."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")
    return F.length(F.translate(squeezed, " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most_times: float = MOST_TIMES) -> list[float]:
    """share x all sizes by weight, none above most_times its size: what is over is dealt again by weight until none is above."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w > most_times * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most_times * sizes[i])
        left -= sum(out[i] for i in over)
        free -= over
    return out


def _mixed(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of range(n), at the places x alone: a four-round Feistel network, walked until inside the range."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little")) for r in range(4)]
    out = x.astype(np.uint64)
    todo = np.ones(len(out), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            v = out[todo]
            a, b = v >> shift, v & mask
            for k in reversed(keys) if back else keys:
                a, b = ((_mixed(a, k) & mask) ^ b, a) if back else (b, a ^ (_mixed(b, k) & mask))
            out[todo] = v = (a << shift) | b
            todo[todo] = v >= np.uint64(n)
    return out.astype(np.int64)


def drawn(left: np.ndarray, want: int, seed) -> np.ndarray:
    """Multinomial counts of `want` slots in all, by what is left of each source and never above it."""
    rng, out, left = np.random.default_rng(seed), np.zeros(len(left), np.int64), left.copy()
    want = min(int(want), int(left.sum()))
    while want:
        got = np.minimum(rng.multinomial(want, left / left.sum()), left)
        out += got
        left -= got
        want -= int(got.sum())
    return out


def group_counts(quota: np.ndarray, sizes: list[int], g: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of group g of those with these sizes: each source's count, and how many slots of it the groups before have. Halves of the groups are drawn
    from each other down to g, each split from its own seed, so that every task finds the same counts and holds a row of them."""
    counts, before, a, z = quota, np.zeros(len(quota), np.int64), 0, len(sizes)
    while z - a > 1:
        m = (a + z) // 2
        first = drawn(counts, sum(sizes[a:m]), [seed, a, z])
        if g < m:
            counts, z = first, m
        else:
            counts, before, a = counts - first, before + first, m
    return counts, before


@dataclass(frozen=True)
class Source:
    """A source's place in the mix. The words it gives are passes over all its blocks, each in another order; the last
    pass stops, within a block if need be, when the target is reached."""

    name: str | None
    size: int
    target: float
    block: int
    seed: int

    @property
    def blocks(self) -> int:
        return -(-self.size // self.block)

    @property
    def words(self) -> int:
        return min(round(self.target), MOST_TIMES * self.size)

    def key(self, epoch: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{self.seed}/{self.name!r}/{epoch}".encode()).digest()[:8], "little")

    @property
    def slots(self) -> int:
        if not self.size:
            return 0
        full, rest = divmod(self.words, self.size)
        return full * self.blocks + self._rest(full, rest)[0]

    def _rest(self, epoch: int, rest: int) -> tuple[int, int]:
        """Slots of the last, partial pass, and words of its last slot. Only the block at the source's end may be short."""
        if not rest:
            return 0, 0
        short = self.size - (self.blocks - 1) * self.block
        at = int(permute(np.array([self.blocks - 1]), self.blocks, self.key(epoch), back=True)[0])
        if rest <= at * self.block:
            n, before = -(-rest // self.block), 0
        else:
            before = self.block - short
            n = max(at + 1, -(-(rest + before) // self.block))
        if n == at + 1:
            return n, rest - at * self.block
        return n, rest - ((n - 1) * self.block - before)

    def picked(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pass, block and number of words of the slots [first, last)."""
        slot = np.arange(first, last)
        epoch, at = slot // max(1, self.blocks), slot % max(1, self.blocks)
        block = np.empty(len(slot), np.int64)
        for e in np.unique(epoch):
            block[epoch == e] = permute(at[epoch == e], self.blocks, self.key(int(e)))
        take = np.minimum(self.block, self.size - block * self.block)
        if last == self.slots and len(slot):
            full, rest = divmod(self.words, self.size)
            if rest:
                take[-1] = self._rest(full, rest)[1]
        return epoch, block, take


def plan_sources(sized: DataFrame, block: int, weights: tuple, share: float, seed: int) -> list[Source]:
    """Totals by source, a row each, and what each is to give."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()  # placed() has refused more than MOST_SOURCES
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["size"] or 0) for r in rows]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share)
    return [Source(r["source"], s, t, block, seed) for r, s, t in zip(rows, sizes, aims)]


def placed(sized: DataFrame) -> DataFrame:
    """Adds `first`: where a document's words start among its source's. A source's rows go to as many buckets as it needs
    (so that no task holds a large source), the buckets' totals are summed in order, then the rows within each bucket."""
    counts = cut(sized.groupBy(F.col("source").alias("__s")).agg(F.ceil(F.count("*") / BUCKET_ROWS).alias("__n")))
    if counts.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    counted = sized.join(F.broadcast(counts), sized["source"].eqNullSafe(counts["__s"]))  # at most MOST_SOURCES rows
    rows = counted.select(*sized.columns, F.pmod(F.xxhash64("id", "key"), F.col("__n")).alias("bucket"))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("id", "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.join(bases, rows["source"].eqNullSafe(bases["s"]) & (rows["bucket"] == bases["b"]))
    return joined.select("id", "key", "source", "size", (F.col("base") + F.col("inner")).alias("first"))


def slots(spark, sources: list[Source], shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """shard, slot, source (its number), epoch, block, take: the mix itself. Counts of each source are drawn for groups of
    shards, at most 1024, and then for each shard of a group, by the group's task, from fixed seeds. A task holds a row of counts."""
    quota = np.array([s.slots for s in sources], np.int64)
    total = int(quota.sum())
    shards = -(-total // shard_slots)
    groups = min(1024, shards)
    sizes = [len(range(g, shards, groups)) * shard_slots for g in range(groups)]
    if sizes:
        sizes[(shards - 1) % groups] -= shards * shard_slots - total
    sent = spark.sparkContext.broadcast((sources, quota, sizes))  # a row for each source, and a number for each group

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sources, quota, sizes = sent.value
        for b in batches:
            for g in b["id"]:
                left, first = group_counts(quota, sizes, int(g), seed)
                for k, shard in enumerate(range(int(g), shards, groups)):
                    inner = drawn(left, shard_slots, [seed + 1, int(g), k])
                    parts = []
                    for s in np.flatnonzero(inner):
                        epoch, block, take = sources[s].picked(int(first[s]), int(first[s] + inner[s]))
                        parts.append(pd.DataFrame({"source": np.int32(s), "epoch": epoch, "block": block, "take": take}))
                    out = pd.concat(parts, ignore_index=True)
                    order = np.random.default_rng([seed, int(g), k]).permutation(len(out))
                    out = out.iloc[order].reset_index(drop=True)
                    yield out.assign(shard=shard, slot=np.arange(len(out)))[["shard", "slot", "source", "epoch", "block", "take"]]
                    left, first = left - inner, first + inner

    ids = spark.range(0, groups, 1, max(1, min(groups, 1024)))
    return ids.mapInPandas(tidy(draw), "shard long, slot long, source int, epoch long, block long, take long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK_WORDS, weights: tuple = WEIGHTS, share: float = SHARE, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, list[Source]]:
    """(pieces, rows, sources). rows: id, key, source, size, first of each input row. pieces: the mix, a row for each part of a
    row's text in a slot: id, key, source (its number), first, shard, slot, epoch, a, z (words [a, z) of that text), at (its place in the slot).

    Each source's words, its documents in a fixed order, are cut into blocks of `block` words; slots of the mix are mapped
    to blocks by a permutation of each source, and blocks joined to documents by (source, block). A block is
    in each pass once and a source gives at most two passes, so no word is taken more than twice. Each source
    gives its target to the nearest word.

    A row with words is known by (source, first), so rows that share an id, or repeat whole, stay apart. Null texts have no words; null sources are a source; null ids are ids. An empty table gives an empty mix.
    """
    sized = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = cut(placed(cut(sized)))
    sources = plan_sources(rows, block, weights, share, seed)
    spark = df.sparkSession
    numbers = spark.createDataFrame([(s.name, i, s.size, s.target) for i, s in enumerate(sources)], "name string, number int, source_size long, target double")
    rows = rows.join(F.broadcast(numbers), rows["source"].eqNullSafe(numbers["name"])).drop("name")  # at most MOST_SOURCES rows
    spans = rows.where("size > 0").select("id", "key", F.col("number").alias("source"), "first", "size", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))).alias("block"))
    begin = F.col("block") * block
    a = F.greatest(F.col("first"), begin) - F.col("first")
    z = F.least(F.col("first") + F.col("size"), begin + F.col("take")) - F.col("first")
    # Both sides grow with the input; the second looks small to the planner, which only sees a range of group numbers.
    joined = spans.hint("merge").join(slots(spark, sources, shard_slots, seed), ["source", "block"])
    pieces = joined.select("id", "key", "source", "first", "shard", "slot", "epoch", a.alias("a"), z.alias("z"), F.greatest(F.lit(0), F.col("first") - begin).alias("at")).where("z > a")
    return pieces, rows, sources


def taken(pieces: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with `sum`, the words the mix takes of each. A row with words is known by its source and place there."""
    sums = pieces.groupBy(F.col("source").alias("number"), F.col("first").alias("at")).agg(F.sum(F.col("z") - F.col("a")).alias("sum"))
    match = (rows["number"] == sums["number"]) & (rows["first"] == sums["at"]) & (rows["size"] > 0)
    return rows.join(sums, match, "left").select(rows["*"], F.coalesce("sum", F.lit(0)).alias("sum"))


def slice_words(text: str, spans: list[tuple[int, int]]) -> str:
    """Words [a, z) of each span with the blanks before each word; what follows the last word goes with it."""
    starts = [m.start() for m in _WORD.finditer(text)]
    if not starts:
        return ""
    edges = [0, *starts[1:], len(text)]
    return "".join(text[edges[a] : edges[z]] for a, z in spans)


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as rows of df: for each pass over its source, a row with the words of the text that the pass took, in their
    order. A document taken whole twice gives two equal rows; one not taken gives none. All other columns stay as they were.
    n_chars, if df has it, is the new text's length. Rows equal in id, source and text are given back from one of them."""
    pieces, rows, sources = mix(df, id_col, text_col, source_col, **options)
    names = df.sparkSession.createDataFrame([(i, x.name) for i, x in enumerate(sources)], "number int, __source string")
    spans = pieces.groupBy("id", "key", "source", "first", "epoch").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("spans"))
    spans = spans.join(F.broadcast(names), spans["source"] == names["number"])  # at most MOST_SOURCES rows
    cols = df.columns
    keyed = df.withColumn("__key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = ["id", "key", "source"]
    if not rows.where("size > 0").groupBy(*same).count().where("count > 1").isEmpty():
        keyed = keyed.dropDuplicates([id_col, "__key", source_col])
    spans = spans.select(F.col("id").alias("__id"), F.col("key").alias("__k"), "__source", F.col("spans").alias("__spans"))
    match = keyed[id_col].eqNullSafe(spans["__id"]) & (keyed["__key"] == spans["__k"]) & keyed[source_col].eqNullSafe(spans["__source"])
    both = keyed.join(spans, match).select(*(keyed[c] for c in cols), "__spans")
    schema = both.drop("__spans").schema
    at = cols.index(text_col)

    def run(batches):
        for b in batches:
            texts, spans = b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            new = [slice_words(t, [(s["a"], s["z"]) for s in ss]) for t, ss in zip(texts, spans)]
            out = b.select(list(range(b.num_columns - 1)))
            out = out.set_column(at, out.schema.field(at), pa.array(new, out.column(at).type))
            if "n_chars" in cols:
                i = cols.index("n_chars")
                out = out.set_column(i, out.schema.field(i), pa.array([len(t) for t in new], out.column(i).type))
            yield out

    return both.mapInArrow(tidy(run), schema)


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with the words the mix takes of it."""
    pieces, rows, _ = mix(table(spark, sf_dir, "documents"))
    return taken(pieces, rows).select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.col("sum").cast("long").alias("taken"))
