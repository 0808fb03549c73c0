"""Best-fit packing of token sequences by exact complements: sums of one, two and three lengths are indexed, combinations that fill a gap
exactly are consumed as long as there are pieces of their lengths, and what is left is packed by best fit.

Only the lengths decide a packing, and there are no more of them than a sequence has places. So the driver plans with a count for each
length, whatever the number of pieces, and Spark deals the pieces out to the plan by their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ashlar.llm.common import cut, small_batches, table, tidy

CAPACITY = 1024
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Characters of text that are tokenized at a time; longer texts are cut where that changes no id.
RUN_CHARS = 1 << 20
#: Words that a worker remembers the ids of for good and for a while, and how long they may be: about 100 and 40 MB.
KNOWN_WORDS = 500_000
RECENT_WORDS = 200_000
KNOWN_CHARS = 32

_GAP = re.compile(r"(?<=\S) (?=\S)")
_SPACES = [chr(k) for k in range(0x3001) if chr(k).isspace() and k != 0x20]
_ASCII_SPACES = [c for c in _SPACES if c.isascii()]
_SPACE = re.compile(r"\s")
_ENDS = ".,;:!?"
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("nth", pa.int64())])
_PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"


class Ids:
    """Ids of whole texts by a file of the tokenizers library, as little-endian 32-bit numbers.

    A byte-level vocabulary never joins what stands on both sides of a single space between two visible characters: the space begins
    a word of its own; nor across a single line feed between such, which is a word alone. So texts are taken apart there, and each different word is tokenized once and
    remembered: those that begin with a line feed as they are, all others with a space before them.
    """

    _kept: dict[str, Ids] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, bool)  # ids that begin with a space
        self.begins[[k for t, k in vocab.items() if t.startswith("Ġ")]] = True
        self.feeds = self.begins & False  # the line feed's
        self.feeds[vocab["Ċ"]] = True
        self.known: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.ends = dict(zip(_ENDS, (x.tobytes() for x in self._encode(list(_ENDS)))))

    @classmethod
    def of(cls, path: str) -> Ids:
        """One for each worker: what it remembers serves all its tasks."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words. A letter and a mark after it are never joined either, so a known word with a mark is known. The others are tokenized as one text, if what begins
        them is nowhere inside."""
        out = {}
        for w in words:
            if w[-1] in _ENDS and w[-2:-1].isascii() and w[-2:-1].isalpha() and (ids := self.known.get(w[:-1])):
                out[w] = ids + self.ends[w[-1]]
        rest = [w for w in words if w not in out]
        out |= self._together([w for w in rest if w[0] != "\n" and " " not in w], " ", self.begins)
        out |= self._together([w for w in rest if w[0] == "\n" and not _SPACE.search(w, 1)], "", self.feeds)
        rest = [w for w in rest if w not in out]
        return out | dict(zip(rest, (x.tobytes() for x in self._encode([w if w[0] == "\n" else " " + w for w in rest]))))

    def _together(self, words: list[str], before: str, begins: np.ndarray) -> dict[str, bytes]:
        """Words as one text, told apart by the ids that begin them; none if those are not as many."""
        if not words:
            return {}
        ids = self._encode(["".join(before + w for w in words)])[0]
        at = [*np.flatnonzero(begins[ids]).tolist(), len(ids)]
        raw = ids.tobytes()
        return {w: raw[4 * a : 4 * z] for w, a, z in zip(words, at, at[1:])} if len(at) == len(words) + 1 and at[0] == 0 else {}

    def runs(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        cut_up = [_GAP.split(t) if _odd(t) else t.replace("\n", " \n").split(" ") for t in texts]
        heads = self._encode([w[0] for w in cut_up])
        words = [w for ws in cut_up for w in ws[1:]]
        found = list(map(self.known.get, words))
        if None in found:
            missing = [k for k, x in enumerate(found) if x is None]
            new = self._learn([w for w in dict.fromkeys([words[k] for k in missing]) if w not in self.recent])
            short = {w: x for w, x in new.items() if len(w) <= KNOWN_CHARS}
            for k in missing:
                found[k] = new.get(words[k]) or self.recent[words[k]]
            if len(self.known) < KNOWN_WORDS:
                self.known.update(short)
            else:
                if len(self.recent) > RECENT_WORDS:
                    self.recent.clear()
                self.recent.update(short)
        out, at = [], 0
        for head, ws in zip(heads, cut_up):
            out.append(head.tobytes() + b"".join(found[at : at + len(ws) - 1]))
            at += len(ws) - 1
        return out

    def texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; many short texts or a part of a long one at a time."""
        group: list[str] = []
        size = 0
        for t in texts:
            t = t or ""
            if group and size + len(t) > RUN_CHARS:
                yield from self.runs(group)
                group, size = [], 0
            if len(t) > RUN_CHARS:
                yield b"".join(x for part in _parts(t) for x in self.runs([part]))
            else:
                group.append(t)
                size += len(t)
        yield from self.runs(group)


def _odd(text: str) -> bool:
    """Whether a space or line feed stands at an end or beside white space, so that not every one begins a word."""
    if "  " in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n"):
        return True
    return any(c in text and (" " + c in text or c + " " in text or "\n" + c in text or c + "\n" in text) for c in (_ASCII_SPACES if text.isascii() else _SPACES))


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that begin at a single space between visible characters, where there is one after RUN_CHARS characters."""
    at = 0
    while len(text) - at > RUN_CHARS and (m := _GAP.search(text, at + RUN_CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def cuts_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """Where n ids, one at least, are cut: (start, length). All pieces are full but the first, which may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int | None = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of each row: doc_id, piece, start, length, ids_crc32, with keep_ids also ids (binary, little-endian 32-bit); and where they were made, part and nth (the
    how-manieth of its length in that part). Written to the shared folder: later steps rely on these numbers."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    schema = _PIECE.append(pa.field("ids", pa.binary())) if keep_ids else _PIECE
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, seen = Ids.of(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for doc, raw in zip(b.column(0).to_pylist(), ids.texts(_each(b.column(1)))):
                raw += end
                for k, (s, n) in enumerate(cuts_of(len(raw) // 4, capacity) if raw else ()):
                    own = raw[4 * s : 4 * (s + n)]
                    rows.append((doc, k, s, n, zlib.crc32(own), part, int(seen[n]), *([own] if keep_ids else ())))
                    seen[n] += 1
                size += len(raw) * keep_ids
                if size > 1 << 24:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            yield _batch(rows, schema)

    with small_batches(df.sparkSession):
        return cut(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), _PIECE_SQL + ", ids binary" * keep_ids))


def _each(column: pa.Array) -> Iterator[str | None]:
    return (x.as_py() for x in column)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


class Sums:
    """Which lengths, pairs of lengths and triples sum to a number: for each sum the largest members, falling. Built once of the lengths there are; an entry whose
    pieces have run out is passed over. For n lengths up to a capacity c there are at most n*c/2 pairs, and n*c triples told by their largest member."""

    def __init__(self, counts: np.ndarray):
        self.counts, top = counts, len(counts) - 1
        there = np.flatnonzero(counts)
        self.pairs: list[np.ndarray] = []
        self.triples: list[np.ndarray] = []
        holds = counts > 0
        for s in range(top + 1):
            a = there[(there >= (s + 1) // 2) & (there < s)][::-1]
            self.pairs.append(a[holds[s - a]])
        for s in range(top + 1):
            a = there[(3 * there >= s) & (there < s)][::-1]
            self.triples.append(a[[len(self.pairs[s - x]) > 0 for x in a]] if len(a) else a)

    def _enough(self, *lengths: int) -> bool:
        return all(self.counts[x] >= lengths.count(x) for x in set(lengths))

    def exact(self, gap: int, held: tuple[int, ...] = (), most: int = 3) -> tuple[int, ...] | None:
        """A single length, pair or triple (if `most` is 3) of pieces still there that sums to the gap, besides those held; the one of the largest piece."""
        if self._enough(*held, gap):
            return (gap,)
        if most < 3:
            return None
        for a in self.pairs[gap]:
            if self._enough(*held, int(a), gap - int(a)):
                return int(a), gap - int(a)
        for a in self.triples[gap]:
            a = int(a)
            if self._enough(*held, a):
                for b in self.pairs[gap - a]:
                    if b <= a and self._enough(*held, a, int(b), gap - a - int(b)):
                        return a, int(b), gap - a - int(b)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """How pieces of these lengths, so many of each, are packed: (lengths of a sequence, falling, and how many sequences are such).

    First, from the longest length down, a piece's gap is filled exactly by the index of sums, as long as pieces last; then what is left is packed by best fit. Either way a
    combination is used as often as its scarcest length allows, so the number of steps follows the number of lengths, not of pieces. Pairs and triples fill gaps that
    single pieces leave, but use up short pieces that would fill others later: the plan is made with them and without, and the one with fewer sequences is taken.
    """
    made = [_planned(counts, capacity, 3, _refilled), _planned(counts, capacity, 1, _best_fit)]
    return min(made, key=lambda p: sum(m for _, m in p))


def _planned(counts, capacity, most, rest) -> list[tuple[tuple[int, ...], int]]:
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    sums, out = Sums(left), []

    def use(lengths: tuple[int, ...]) -> None:
        many = min(int(left[x]) // lengths.count(x) for x in set(lengths))
        for x in lengths:
            left[x] -= many
        out.append((tuple(sorted(lengths, reverse=True)), many))

    if left[capacity]:
        use((capacity,))
    for n in range(capacity - 1, 0, -1):
        while left[n] and (more := sums.exact(capacity - n, (n,), most)):
            use((n, *more))
    rest(left, sums, use, out)
    return out


def _refilled(left, sums, use, out) -> None:
    """From the longest piece down, the longest piece that fits the gap goes in, and the index is asked for the exact complement of each gap that this leaves."""
    capacity = len(left) - 1
    for n in range(capacity - 1, 0, -1):
        while left[n]:
            held, gap = (n,), capacity - n
            while gap:
                if more := sums.exact(gap, held):
                    held, gap = held + more, 0
                    break
                fits = np.flatnonzero(left[: gap + 1])[::-1]
                best = next((int(x) for x in fits if left[x] > held.count(int(x))), None)
                if best is None:
                    break
                held, gap = (*held, best), gap - best
            use(held)


def _best_fit(left, sums, use, out) -> None:
    """From the longest piece down, each goes to the open sequence whose gap is the smallest that holds it, or opens one."""
    capacity = len(left) - 1
    opened: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by gap

    def put(lengths, many):
        if many:
            opened.setdefault(capacity - sum(lengths), []).append((lengths, many))

    for n in range(capacity - 1, 0, -1):
        while left[n]:
            gap = min((g for g in opened if g >= n), default=None)
            if gap is None:
                full, over = divmod(int(left[n]), capacity // n)
                put((n,) * (capacity // n), full)
                put((n,) * over, int(over > 0))
                left[n] = 0
                break
            lengths, many = opened[gap].pop()
            if not opened[gap]:
                del opened[gap]
            taken = min(int(left[n]), many)
            put(lengths, many - taken)
            put((*lengths, n), taken)
            left[n] -= taken
    out += [x for g in sorted(opened) for x in opened[g]]


@dataclass
class Places:
    """A plan as what a piece needs to find its place: by length and rank."""

    keys: np.ndarray  # length << 44 | first rank
    times: np.ndarray  # pieces of the length in such a sequence
    base: np.ndarray  # the first sequence
    offset: np.ndarray  # of the first of them

    @staticmethod
    def of(made: list[tuple[tuple[int, ...], int]]) -> Places:
        rows, ranks, base = [], {}, 0
        for lengths, many in made:
            at = 0
            for n in dict.fromkeys(lengths):
                times = lengths.count(n)
                rows.append((n << 44 | ranks.get(n, 0), times, base, at))
                ranks[n] = ranks.get(n, 0) + times * many
                at += n * times
            base += many
        return Places(*np.array(sorted(rows) or np.empty((0, 4)), np.int64).T)

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences and offsets of pieces."""
        at = np.searchsorted(self.keys, lengths << 44 | ranks, side="right") - 1
        nth = ranks - (self.keys[at] & ((1 << 44) - 1))
        return self.base[at] + nth // self.times[at], self.offset[at] + nth % self.times[at] * lengths


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int | None = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of all rows with sequence_id and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with keep_ids the ids too.

    A row's ids are those of its whole text and end_id after them (None: none). A null text is empty. Texts of more than `capacity` ids, and no others, are cut. A row that
    repeats is a document of its own, a null id is an id; other columns are not read, whatever they are called. A row without ids has no piece (only where end_id is None).
    Empty in, empty out. Full pieces and any other hot length are dealt out by rank, so no length's pieces meet in a task.
    """
    found = pieces(df, id_col, text_col, capacity, tokenizer, end_id, keep_ids)
    parts = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    sent = df.sparkSession.sparkContext.broadcast(Places.of(plan(counts, capacity)))
    ranked = found.join(first, ["length", "part"]).withColumn("rank", F.col("first") + F.col("nth"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    schema = pa.schema([*(_PIECE.append(pa.field("ids", pa.binary())).field(c) for c in kept), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, at = sent.value.find(b.column(kept.index("length")).to_numpy(), b.column(len(kept)).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(seq), pa.array(at)], schema=schema)

    types = dict(x.split() for x in f"{_PIECE_SQL}, ids binary".split(", "))
    return ranked.select(*kept, "rank").mapInArrow(tidy(run), ", ".join(f"{c} {types[c]}" for c in kept) + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of what pack(keep_ids=True) gives: sequence_id, length, ids (binary, little-endian 32-bit) and the documents' doc_ids and offsets in order.
    A sequence has `capacity` ids at most, which bounds a group."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("rows"))
    joined = F.aggregate("rows", F.lit(b""), lambda a, r: F.concat(a, r["ids"]))
    return rows.select("sequence_id", F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["length"]).alias("length"), joined.alias("ids"), F.transform("rows", lambda r: r["doc_id"]).alias("doc_ids"), F.transform("rows", lambda r: r["offset"]).alias("offsets"))


def op11_pack(spark, sf_dir: str) -> DataFrame:
    """Every piece of all documents with its sequence and offset."""
    return pack(table(spark, sf_dir, "documents"))
