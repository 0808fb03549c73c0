"""SimHash near-dedup: exact comparison of all fingerprints by tiles, skipping tile pairs whose population counts differ too much."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import cut, skew_join, small_batches, table, tidy
from ashlar.operators.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints in a tile, about.
TILE = 8192
#: Population counts are kept for so many equal parts of the 64 bits: a pair within the radius differs by no more in their sum.
PARTS = 4
_CHUNK = 1 << 16
#: Comparisons done at a time.
_CELLS = 1 << 20


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits: bytes of 0 and 1 are added eight at a time, 255 rows before any byte could run over."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    rows = -(-len(bits) // 255) * 255
    if rows > len(bits):
        bits = np.concatenate([bits, np.zeros((rows - len(bits), 64), np.uint8)])
    sums = bits.view(np.uint64).reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text: a bit is set if over half the shingles' hashes have it; no words give 0."""
    words = (text or "").encode().lower().split()  # of bytes: lower() changes A-Z alone, split() parts at \x20 and \x09-\x0D
    n = max(1, len(words) - size + 1)
    if not words:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + size - 1]
        flat = b" ".join(part)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        k = min(size, len(part))
        m = len(part) - k + 1
        cuts = map(slice, starts[:m].tolist(), ends[k - 1 :].tolist())
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(flat.__getitem__, cuts), repeat(SEED)), np.uint64, m)
        counts += _bit_counts(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """id, fp (long, the 64 bits) of each row. A null text has no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, size) for t in b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "fp": fp.view(np.int64)})

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(tidy(run), "id long, fp long")


def spanning(size: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of links (i, j) between the numbers below `size`, as they come in blocks, a spanning forest: as few that connect the same. A block is held at a time."""
    lab = np.arange(size)
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in links:
        while True:
            a, b = lab[i], lab[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            high, first = np.unique(np.maximum(a, b), return_index=True)
            up = np.arange(size)
            up[high] = np.minimum(a, b)[first]
            us.append(i[first])
            vs.append(j[first])
            while True:
                to = up[up]
                if np.array_equal(to, up):
                    break
                up = to
            lab = up[lab]
    return np.concatenate(us), np.concatenate(vs)


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles within the radius, exactly compared, as a spanning forest: ends (u, v) such that two
    fingerprints are connected by them if and only if they are by all links. At most len(left) + len(right) - 1 of them."""
    step = max(1, _CELLS // max(1, len(right)))

    def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(left), step):
            i, j = np.nonzero(np.bitwise_count(left[at : at + step, None] ^ right[None, :]) <= radius)
            yield i + at, j + len(left)

    u, v = spanning(len(left) + len(right), near())
    return left[u], right[v - len(left)]


def _steps(radius: int, parts: int) -> list[tuple[int, bool]]:
    """Differences of population-count vectors (32 to the power of the part a unit) that the radius allows, one of each pair of opposites."""
    out = []
    for d in product(range(-radius, radius + 1), repeat=parts):
        if sum(map(abs, d)) <= radius and d >= (0,) * parts:
            out.append(sum(x * 32**k for k, x in enumerate(d)))
    return out


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) between distinct fingerprints `fp` that connect just those that differ by `radius` bits or fewer, or chains of such.

    Fingerprints of equal population counts, in each quarter of their bits, form a cell; cells are cut into tiles of about
    `tile`. Two tiles are compared, all against all, only if their counts differ by no more than the radius in sum, which no
    closer pair can exceed. Each tile is sent to the tiles it is compared with, packed, and streams past them.
    """
    spark = fps.sparkSession
    width = 64 // PARTS
    cell = sum((F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit((1 << width) - 1).cast("long"))).cast("long") * 32**k for k in range(PARTS)), F.lit(0).cast("long"))
    celled = fps.select("fp", cell.alias("cell"))
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n"))  # at most (width + 1) ** PARTS rows, 83,521, whatever the input
    tiles = celled.join(F.broadcast(sizes), "cell").withColumn("sub", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / tile)))
    tiles = cut(tiles.groupBy("cell", "sub").agg(F.collect_list("fp").alias("fps")))
    steps = F.explode(F.array(*(F.lit(s).cast("long") for s in _steps(radius, PARTS))))
    a = tiles.select(F.col("cell").alias("a_cell"), F.col("sub").alias("a_sub")).withColumn("step", steps)
    a = a.withColumn("cell", F.col("a_cell") + F.col("step"))
    pairs = a.join(tiles.select("cell", "sub"), "cell").where("step <> 0 or a_sub <= sub")
    sent = pairs.join(tiles, ["cell", "sub"]).select("a_cell", "a_sub", F.lit(1).alias("kind"), "fps")
    own = tiles.select(F.col("cell").alias("a_cell"), F.col("sub").alias("a_sub"), F.lit(0).alias("kind"), "fps")
    rows = own.union(sent).repartition("a_cell", "a_sub").sortWithinPartitions("a_cell", "a_sub", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, mine = None, None
        for b in batches:
            us, vs = [], []
            for key, group in b.groupby(["a_cell", "a_sub"], sort=False):
                others = [np.asarray(x, np.int64) for x in group["fps"]]
                if key != here:
                    here, mine = key, others.pop(0).view(np.uint64)
                if others:
                    u, v = forest(mine, np.concatenate(others).view(np.uint64), radius)
                    us.append(u[u != v].view(np.int64))
                    vs.append(v[u != v].view(np.int64))
            if us:
                yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return rows.mapInPandas(tidy(run), "u long, v long")


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """id, fp, component of each row: the smallest id that links of `radius` or fewer differing bits reach, its own included. Also
    root: the smallest fingerprint of the component, which tells components apart where rows of one id are in several.

    Exact over all rows: rows of equal fingerprints are one node, and all distinct fingerprints are compared by tiles.
    Null texts and texts without words have fingerprint 0 and link like any other. Null ids are nobody's smallest;
    a component of null ids alone has null. Repeated ids are rows of their own. Empty in, empty out. Other columns are not read.
    """
    with small_batches(df.sparkSession):
        rows = cut(fingerprints(df, id_col, text_col, size))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("rows")))
    roots = cut(components(cut(links(nodes.select("fp"), radius))))
    total = nodes.agg(F.sum("rows")).first()[0] or 0
    linked = cut(roots.join(nodes, roots["node"] == nodes["fp"]).select("node", "root", "low"))
    groups = cut(linked.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("n")))
    named = skew_join(linked, groups, ["root"], "n", groups.agg(F.sum("n")).first()[0] or 0).select(F.col("node").alias("fp"), "root", "component")
    named = cut(nodes.join(named, "fp", "left").select("fp", "rows", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("component")).alias("component")))
    return skew_join(rows, named, ["fp"], "rows", total).select("id", "fp", "component", "root")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """df without all but one row of each component: of the rows of its smallest id the one of the least fingerprint stays, once for each
    of its different texts' repeats. Rows are known by id and fingerprint, so a row that shares its id alone with a dropped one stays.
    A row of a null id goes if its component has an id, and stays if not."""
    found = cut(near_components(df, id_col, text_col, radius, size))
    named = found.where(F.col("id").isNotNull())
    best = named.groupBy("root").agg(F.min(F.struct("id", "fp")).alias("best")).select(F.col("best.id").alias("__id"), F.col("best.fp").alias("__fp"))
    fps = F.pandas_udf(lambda texts: pd.Series(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)), "long")
    rows = df.withColumn("__print", fps(F.col(text_col)))
    first = rows.where(F.col(id_col).isNotNull()).join(best, (F.col(id_col) == F.col("__id")) & (F.col("__print") == F.col("__fp")), "left_semi")
    again = named.groupBy("id", "fp").count().where("count > 1")
    first = first if again.isEmpty() else first.dropDuplicates([id_col, "__print"])
    alone = found.where("component is null").select(F.col("fp").alias("__fp")).distinct()
    null = rows.where(F.col(id_col).isNull()).join(alone, F.col("__print") == F.col("__fp"), "left_semi")
    return first.unionByName(null).drop("__print")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its fingerprint and component."""
    out = near_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
