"""Near copies by SimHash and exact similarity: fingerprints of 256 bits find groups of candidates, whole shingle sets decide within them.

All fingerprints are compared, tile against tile, by exclusive-or and bit counts; tiles of texts whose sizes rule out the similarity are
skipped. A tile pair hands on a spanning forest of its links, and the links' components are the groups of candidates: a group of any
size costs as many rows as it has members. In a group every text's set is compared exactly with every other's, by an index of
their shingles; large groups are compared in parts, so that no task holds one. Again only a spanning forest is handed on."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import cut, give_back, skew_join, small_batches, tidy
from ashlar.llm.simhash import SEED, _bit_counts, spanning
from ashlar.operators.components import components

SHINGLE = 5
LEAST = 0.8
#: Candidates differ in so many of the first 64 bits and of all 256 at most. Long texts of Jaccard 0.8 differ in 9.7 and 38.8 on average, with
#: deviations of 2.9 and 5.7; texts that share nothing differ in 128 with a deviation of 8.
RADIUS, RADIUS_ALL = 20, 60
WORDS = 4
#: Texts in a tile, about; cells of sizes to a factor of 1 / least; and bytes of shingle sets compared by one task, about.
TILE = 1 << 15
FINE = 4
SET_BYTES = 1 << 20
_CHUNK = 1 << 16
_CELLS = 1 << 20


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles, words as op4 takes them. A text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    n = len(words) - size + 1
    parts = []
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + size - 1]
        flat = b" ".join(part)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        m = len(part) - size + 1
        cuts = map(slice, (ends - lengths)[:m].tolist(), ends[size - 1 :].tolist())
        parts.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(flat.__getitem__, cuts), repeat(SEED)), np.uint64, m)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Other 64 bits of each hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _majority(h: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), _CHUNK):
        counts += _bit_counts(h[at : at + _CHUNK])
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def node_of(s: np.ndarray) -> int:
    """A hash of a whole set."""
    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0])


def sketch(s: np.ndarray) -> tuple[int, ...]:
    """node (a hash of the whole set), n (its size), and the 256 bits of its SimHash as four longs."""
    row = [node_of(s), len(s)]
    for _ in range(WORDS):
        row.append(_majority(s))
        s = _mixed(s)
    return tuple(row)


def sketches(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, hash (of the text), node, n, and the words of the fingerprint, fp0 and on, of each row."""
    names = ["node", "n", *(f"fp{k}" for k in range(WORDS))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = np.array([sketch(shingle_set(t, size)) for t in b["text"]], np.int64).reshape(-1, len(names))
            out = pd.DataFrame({"id": b["id"].astype("Int64"), "hash": b["hash"]})
            yield out.assign(**{c: found[:, k] for k, c in enumerate(names)})

    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text")).mapInPandas(tidy(run), "id long, hash long, " + ", ".join(f"{c} long" for c in names))


def _candidates(f: np.ndarray, g: np.ndarray, m: np.ndarray, n: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of fingerprints of two tiles (a row each) within the radii, of texts whose sizes m and n allow the similarity."""
    step = max(1, _CELLS // len(g))
    for at in range(0, len(f), step):
        d = np.bitwise_count(f[at : at + step, 0, None] ^ g[None, :, 0])
        flat = np.flatnonzero(d.reshape(-1) <= RADIUS)
        i, j = flat // len(g) + at, flat % len(g)
        near = d.reshape(-1)[flat].astype(np.int64)
        for w in range(1, WORDS):
            near += np.bitwise_count(f[i, w] ^ g[j, w])
        ok = (near <= RADIUS_ALL) & (np.minimum(m[i], n[j]) >= least * np.maximum(m[i], n[j]))
        yield i[ok], j[ok]


def candidate_links(nodes: DataFrame, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """Links (u, v) that connect just those nodes that chains of candidates connect: sizes within `least`, fingerprints within the radii.

    Nodes are tiled by size; tiles whose sizes can be within the ratio are compared, all against all. A tile goes to
    the tiles it is compared with, packed, once each, and streams past them."""
    fields = ("node", "n", *(f"fp{k}" for k in range(WORDS)))
    cell = F.floor(F.log(F.greatest("n", F.lit(1))) * F.lit(FINE / -np.log(least))).alias("cell")
    celled = nodes.where("n > 0").select(*fields, cell)
    sizes = celled.groupBy("cell").agg(F.count("*").alias("many"))  # a few hundred rows: sizes are 63-bit numbers
    tiles = celled.join(F.broadcast(sizes), "cell").withColumn("sub", F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / tile)))
    tiles = cut(tiles.groupBy("cell", "sub").agg(F.collect_list(F.struct(*fields)).alias("s")).select("cell", "sub", *(f"s.{c}" for c in fields)))
    steps = F.explode(F.array(*(F.lit(k).cast("long") for k in range(FINE + 1))))
    a = tiles.select(F.col("cell").alias("a_cell"), F.col("sub").alias("a_sub"), steps.alias("step")).withColumn("cell", F.col("a_cell") + F.col("step"))
    pairs = a.join(tiles.select("cell", "sub"), "cell").where("step > 0 or a_sub <= sub")
    sent = pairs.join(tiles, ["cell", "sub"]).select("a_cell", "a_sub", F.when(F.expr("step = 0 and a_sub = sub"), 1).otherwise(2).alias("kind"), *fields)
    own = tiles.select(F.col("cell").alias("a_cell"), F.col("sub").alias("a_sub"), F.lit(0).alias("kind"), *fields)
    rows = own.union(sent).repartition("a_cell", "a_sub").sortWithinPartitions("a_cell", "a_sub", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, mine = None, None
        for b in batches:
            for r in b.itertuples(index=False):
                node, n, *words = (np.asarray(x, np.int64) for x in r[3:])
                theirs = node, n, np.column_stack(words).view(np.uint64)
                if (r.a_cell, r.a_sub) != here:
                    here, mine = (r.a_cell, r.a_sub), theirs
                    continue
                links = ((i, j + len(mine[0])) for i, j in _candidates(mine[2], theirs[2], mine[1], theirs[1], least))
                if r.kind == 1:
                    links = ((i, j - len(mine[0])) for i, j in links)
                u, v = spanning(len(mine[0]) + len(theirs[0]), links)
                if len(u):
                    other = mine[0] if r.kind == 1 else theirs[0]
                    yield pd.DataFrame({"u": mine[0][u], "v": other[v if r.kind == 1 else v - len(mine[0])]})

    with small_batches(nodes.sparkSession, 16):
        return cut(rows.mapInPandas(tidy(run), "u long, v long"))


def exact_links(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets with a Jaccard similarity of `least` or more. Each shingle's sets are listed once, so a set meets
    only sets that share something with it; a set at a time."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    listed, first = owner[order], np.searchsorted(code[order], np.arange(code.max() + 2))
    edges = np.r_[0, np.cumsum(sizes)]

    def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(len(sets)):
            a, z = first[code[edges[k] : edges[k + 1]]], first[code[edges[k] : edges[k + 1]] + 1]
            many = z - a
            at = np.repeat(a - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            both = np.bincount(listed[at], minlength=len(sets))[k + 1 :]
            j = np.flatnonzero(both >= least * (sizes[k] + sizes[k + 1 :] - both)) + k + 1
            yield np.full(len(j), k), j

    return spanning(len(sets), near())


def similar(df: DataFrame, nodes: DataFrame, groups: DataFrame, id_col: str, text_col: str, size: int, least: float) -> DataFrame:
    """Links (u, v) that connect just what chains of texts with a Jaccard similarity of `least` or more connect, within the groups (node, root).

    Only texts of groups are read into sets again, one for each different set. Groups of up to SET_BYTES of sets share a task; larger ones are cut into
    tiles of about that, of which every two meet in a task."""
    wanted = groups.join(nodes, "node").select("root", "n", "node", "rep.id", "rep.hash")
    weights = cut(groups.join(nodes.select("node", "n"), "node").groupBy("root").agg((F.sum("n") * 8).alias("bytes"), F.count("*").alias("many")))
    total = weights.agg(F.sum("bytes"), F.sum("many")).first()
    buckets = max(1, -(-(total[0] or 0) // SET_BYTES))
    wanted = cut(skew_join(wanted, weights, ["root"], "many", total[1] or 0).select("root", "id", "hash", F.ceil(F.col("bytes") / SET_BYTES).alias("tiles")))
    texts = df.select(F.col(id_col).alias("t_id"), F.xxhash64(text_col).alias("t_hash"), F.col(text_col).alias("text"))
    texts = texts.join(wanted.hint("merge"), F.col("t_id").eqNullSafe(F.col("id")) & (F.col("t_hash") == F.col("hash"))).select("root", "tiles", "text", "id", "hash")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, size) for t in b["text"]]
            yield pd.DataFrame({"root": b["root"], "tiles": b["tiles"], "node": [node_of(s) for s in sets], "s": [s.tobytes() for s in sets]})

    def compare(group: pa.Table) -> pa.Table:
        give_back()
        roots, names = group["root"].to_numpy(), group["node"].to_numpy()
        order = np.lexsort((names, roots))
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for part in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1) if len(order) else ():
            part = part[np.r_[True, names[part][1:] != names[part][:-1]]]  # a row that repeats with its id is read twice
            if len(part) > 1:
                u, v = exact_links([np.frombuffer(group["s"][int(k)].as_buffer(), np.uint64) for k in part], least)
                us.append(names[part][u])
                vs.append(names[part][v])
        return pa.table({"u": np.concatenate(us), "v": np.concatenate(vs)})

    with small_batches(df.sparkSession, 1000):
        sets = texts.mapInPandas(tidy(read), "root long, tiles long, node long, s binary")
        mine = F.pmod(F.xxhash64("node"), F.col("tiles"))
        other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("tiles") - 1, F.lit(1))), lambda k: k != mine))  # of one tile, to no other
        sent = sets.select("root", "tiles", "node", "s", mine.alias("mine"), other.alias("other"))
        key = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("root"), F.lit(buckets))).otherwise(F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")))
        return cut(sent.select(key.alias("task"), "root", "node", "s").groupBy("task").applyInArrow(compare, "u long, v long"))


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """df without all but one row of each group of near copies: that of the smallest id stays, of its texts that of the smallest hash, once.

    Texts of equal shingle sets are near copies, and so are those with a similarity of `least` or more among the candidates, and
    chains of such. Rows that repeat an id are told apart by their texts. A group of null ids alone keeps them all."""
    with small_batches(df.sparkSession):
        rows = cut(sketches(df, id_col, text_col, size))
    rep = F.min(F.struct(F.isnull("id").alias("none"), "id", "hash")).alias("rep")
    nodes = cut(rows.groupBy("node").agg(rep, F.count("*").alias("rows"), *(F.min(c).alias(c) for c in ("n", *(f"fp{k}" for k in range(WORDS))))))
    groups = cut(components(candidate_links(nodes, least)))
    roots = cut(components(similar(df, nodes, groups, id_col, text_col, size, least)))
    named = cut(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "rep", "rows"))
    best = cut(named.groupBy("root").agg(F.min("rep").alias("rep")))
    kept = best.where("NOT rep.none").select(F.col("rep.id").alias("__id"), F.col("rep.hash").alias("__hash"))
    out = df.withColumn("__text", F.xxhash64(text_col))
    again = cut(rows.groupBy("id", "hash").count().where("count > 1 and id is not null").select("id", "hash"))
    first = out.where(F.col(id_col).isNotNull()).join(kept, (F.col(id_col) == F.col("__id")) & (F.col("__text") == F.col("__hash")), "left_semi")
    first = first if again.isEmpty() else first.dropDuplicates([id_col, "__text"])
    if rows.where("id is null").isEmpty():
        return first.drop("__text")
    alone = named.join(best.where("rep.none").select("root"), "root", "left_semi").select("node", "rows")
    null = skew_join(rows.where("id is null").select("node", "hash"), alone.withColumn("alone", F.lit(True)), ["node"], "rows", rows.count())
    alone = null.where("alone").select(F.col("hash").alias("__hash")).distinct()
    return first.unionByName(out.where(F.col(id_col).isNull()).join(alone, F.col("__text") == F.col("__hash"), "left_semi")).drop("__text")
