"""Suffix-array dedup: suffixes are ordered only through THRESHOLD bytes, by most-significant-digit radix passes.

The string of THRESHOLD bytes at a place is its suffix as far as it is ever looked at; equal ones are the repeated windows.
To be ordered, suffixes that may be equal must meet. Sending every one of them with its bytes would shuffle THRESHOLD times the text, so
they are dealt out in runs: each is filed under one key of its own, the DIGIT bytes in it whose hash is least (the first such), and neighbours
that share their key travel together. Equal windows have equal keys at equal offsets, so:

1. Dealing out, by the key's hash: a bucket holds a range of hashes. A key that only one document has ends here;
   its windows repeat nowhere. Documents are told which of their keys are left. In a bucket 32 bits of a hash stand for it: a key that is taken for
   another's goes on for nothing.
2. The windows of the keys that are left, packed as the bytes around the key, go to the key's bucket. There the suffixes at the keys are ordered
   by radix passes, the first bytes first, down to THRESHOLD: a pass parts each group by its next digit, and groups of one document go no
   further. So are the bytes before the keys. A window is in the groups of its two parts; one whose group has a smaller document is covered.
3. Covered runs are merged for each document and cut out.

Before the first shuffle each chunk of text (about CHUNK bytes of many documents) is grouped by itself, before the second GATHERED windows of a task: a
key or a packed window that several of their documents share is sent on once, however many they are. What the steps before the last have shuffled goes as soon as
each is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import cut, discard, give_back, passing_shuffles, small_batches, table, tidy

THRESHOLD = 50
DIGIT = 16
#: Bytes that one pass orders by.
PASS = 8
#: Bytes of text grouped at a time; a longer text is taken in pieces that overlap by a window less one byte.
CHUNK = 1 << 21
#: Packed windows that a task groups at a time, a chunk's more at most. The more there are, the more of a bucket's travel in one row.
GATHERED = 250_000
#: Bytes of text to a bucket of digits.
BUCKET_BYTES = 16 << 20
#: Tasks to a shuffle; with more buckets a task takes several, one after the other.
MOST_TASKS = 20_000
_SPREAD = THRESHOLD - DIGIT  # a digit starts at most so far from its window's start
_WIDTH = _SPREAD + THRESHOLD  # bytes that all windows of a digit can span
_REACH = np.arange(-_SPREAD, THRESHOLD)  # these bytes, by their distance from the digit
_LENGTH = 7  # bits that hold the length of a digit's span, _WIDTH at most
_PLACE = np.uint64((1 << 24) - 1)
_MANY = np.uint16(0xFFFF)
_MULT = 0x9E3779B97F4A7C15


def _hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the DIGIT bytes at each place; those that run past the end read zeros."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(DIGIT, np.uint8)])
    eight = np.ndarray((n + 8,), np.dtype("<u8"), padded, 0, (1,))
    h = eight[:n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h += eight[8:] * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    return h


def digits(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a chunk of pieces (bounds: their starts, and the end): piece, place of the digit, first and last start of the windows
    filed under it, and its hash; one entry for each digit in use, in order of place."""
    h = _hashes(raw)
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= _SPREAD + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < _SPREAD + 1:
        rest = _SPREAD + 1 - width
        low = np.minimum(low[:-rest], low[rest:])
    lengths = np.diff(bounds)
    long = np.flatnonzero(lengths >= THRESHOLD)
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[bounds[long]] += 1
    edge[bounds[long] + lengths[long] - THRESHOLD + 1] -= 1
    starts = np.flatnonzero(np.cumsum(edge[:-1]))
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none, none, np.empty(0, np.uint64)
    place = (low[starts] & _PLACE).astype(np.int64)
    piece = np.repeat(long, lengths[long] - THRESHOLD + 1)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])])
    last = np.r_[new[1:], len(starts)] - 1
    at = place[new]
    return piece[new], at, starts[new], starts[last], h[at]


def _chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of a batch of texts (all their bytes, and where each starts): first row, place in its text, bytes, bounds of pieces."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        size = offsets[row + 1] - offsets[row]
        if size > CHUNK:
            step = CHUNK - THRESHOLD + 1
            for at in range(0, int(size) - THRESHOLD + 1, step):
                part = data[offsets[row] + at : min(offsets[row] + at + CHUNK, offsets[row + 1])]
                yield row, at, part, np.array([0, len(part)])
            row += 1
            continue
        end = min(max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1), row + int(_MANY) - 1)
        yield row, 0, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value starts."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _grouped(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary values: values cut at starts."""
    edges = (np.r_[starts, len(values)] * values.itemsize * (values.shape[1] if values.ndim > 1 else 1)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.r_[True, new])


def _own_names(cuts: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows cut at `cuts` from entries of pieces: each entry's place among its row's pieces, and the pieces of all rows with where each row's
    start. A row names only the documents that it holds, so what is sent follows the entries and not how many buckets there are."""
    row = np.repeat(np.arange(len(cuts)), np.diff(np.r_[cuts, len(piece)]))
    used, entry = np.unique(row * (int(_MANY) + 1) + piece, return_inverse=True)
    first = np.searchsorted(used, np.arange(len(cuts)) * (int(_MANY) + 1))
    return entry - first[row], used % (int(_MANY) + 1), first


def _per_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A range of mixed hashes to a bucket. Digits are the least hashes of their windows, so their own leading bits are nearly all zero."""
    mixed = hashes * np.uint64(_MULT)
    return (((mixed >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _marks(hashes: np.ndarray) -> np.ndarray:
    """What stands for hashes among those of one bucket or one document: 32 bits that their choice as least hashes and their bucket leave as they were."""
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


_FIRST = "dest long, doc_id long, digits binary, who binary, ids binary"


def _first_pass(buckets: int):
    schema = pa.schema([("dest", pa.int64()), ("doc_id", pa.int64()), ("digits", pa.binary()), ("who", pa.binary()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            give_back()
            ids = b.column(0).to_numpy()
            data, offsets = _bytes_of(b.column(1))
            for row, _, raw, bounds in _chunks(data, offsets):
                piece, _, _, _, h = digits(raw, bounds)
                if not len(h):
                    continue
                order = np.argsort(h, kind="stable")
                h, piece = h[order], piece[order]
                doc = ids[row + piece]
                at = _starts(h)
                many = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
                one = h[at]
                whose = piece[at]
                told = np.repeat(many, np.diff(np.r_[at, len(h)]))
                d, x = doc[told], _marks(h[told])
                by = np.argsort(d, kind="stable")
                d, x = d[by], x[by]
                cuts = _starts(d)
                if len(cuts):
                    none = pa.nulls(len(cuts), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(d[cuts] % buckets), pa.array(d[cuts]), _grouped(x, cuts), none, none], schema=schema)
                dest = _per_bucket(one, buckets)
                by = np.argsort(dest, kind="stable")
                one, many, dest = one[by], many[by], dest[by]
                cuts = _starts(dest)
                entry, named, first = _own_names(cuts, whose[by])
                who = np.where(many, _MANY, entry.astype(np.uint16))
                names = ids[row + named].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(dest[cuts]), pa.nulls(len(cuts), pa.int64()), _grouped(_marks(one), cuts), _grouped(who, cuts), _grouped(names, first)], schema=schema)

    return run


def _unpacked(rows: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """How many items of a kind of number each row's packed value holds, and the items. A row for each item is what other steps see, so that their number
    follows the text's and not how many buckets there are."""
    data, offsets = _bytes_of(rows[column])
    return np.diff(offsets) // np.dtype(kind).itemsize, np.frombuffer(data.tobytes(), kind)


def _listed(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each row's items start among all items of a list column, with the end; null lists are empty."""
    return np.r_[0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy())].astype(np.int64), column.flatten()


def _left_over(group: pa.Table) -> pa.Table:
    """Of a bucket: (document, digit) for each digit that another document has too. What chunks found by themselves is passed on."""
    give_back()
    own = pa.compute.is_valid(group["doc_id"])
    found, rest = group.filter(own), group.filter(pa.compute.invert(own))
    each, out = _unpacked(found, "digits", np.uint32)
    docs_out = np.repeat(found["doc_id"].to_numpy().astype(np.int64), each)
    if rest.num_rows:
        h, w = (np.frombuffer(_bytes_of(rest[n])[0].tobytes(), kind) for n, kind in (("digits", np.uint32), ("who", np.uint16)))
        names, starts = _bytes_of(rest["ids"])
        many = w == _MANY
        row = np.repeat(starts[:-1] // 8, np.diff(_bytes_of(rest["who"])[1]) // 2)
        doc = np.frombuffer(names.tobytes(), np.int64)[row + np.where(many, 0, w)]
        order = np.argsort(h, kind="stable")
        h, doc, many = h[order], doc[order], many[order]
        at = _starts(h)
        shared = (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)) | np.logical_or.reduceat(many, at)
        told = np.repeat(shared, np.diff(np.r_[at, len(h)])) & ~many
        docs_out, out = np.r_[docs_out, doc[told]], np.r_[out, h[told]]
    return pa.table([pa.array(docs_out, pa.int64()), pa.array(out.view(np.int32), pa.int32())], names=["doc_id", "digit"])


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, the first bytes of all of them first: most of a small number's bytes are zero."""
    return np.ascontiguousarray(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes()


def _packed(whole: np.ndarray, entry: np.ndarray, place: np.ndarray, doc: np.ndarray, th: np.ndarray) -> bytes:
    """A row of the second pass: windows (bytes around a digit, least and greatest offset), each with the number of its document among those named and its place
    there; the documents named, doc and th. Of the bytes around a digit those in use are sent, see _in_use."""
    head = np.array([len(whole), len(doc)], np.int32).tobytes()
    offsets = whole[:, _WIDTH:]
    return b"".join([head, _planes(entry.astype(np.uint16)), _planes(place.astype(np.int32)), _planes(doc.astype(np.int64)), _planes(th.astype(np.int64)), offsets.T.tobytes(), whole[:, :_WIDTH][_in_use(offsets)].tobytes()])


def _in_use(offsets: np.ndarray) -> np.ndarray:
    """Which bytes around their digits the windows with these least and greatest offsets hold."""
    o1, o2 = offsets[:, :1].astype(np.int64), offsets[:, 1:].astype(np.int64)
    return (_REACH >= -o2) & (_REACH < THRESHOLD - o1)


def _as_packed(data: bytes) -> tuple[np.ndarray, ...]:
    """What _packed was given."""
    n, named = np.frombuffer(data, np.int32, 2).tolist()
    at, out = 8, []
    for kind, many in ((np.uint16, n), (np.int32, n), (np.int64, named), (np.int64, named)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size * many, at).reshape(size, many).T).view(kind).ravel())
        at += size * many
    whole = np.zeros((n, _WIDTH + 2), np.uint8)
    whole[:, _WIDTH:] = np.frombuffer(data, np.uint8, 2 * n, at).reshape(2, n).T
    whole[:, :_WIDTH][_in_use(whole[:, _WIDTH:])] = np.frombuffer(data, np.uint8, -1, at + 2 * n)
    return whole, *out


_SECOND = "dest long, doc_id long, th long, spans binary, packed binary"


def _second_pass(buckets: int):
    schema = pa.schema([("dest", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("spans", pa.binary()), ("packed", pa.binary())])

    def grouped(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        whole, h, place, name, ids, ths = map(np.concatenate, zip(*held))
        doc, th = ids[name], ths[name]
        _, same = np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_inverse=True)
        low = np.full(same.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, same, doc)
        covered = doc > low[same]
        if covered.any():
            o1, o2 = whole[covered, _WIDTH:].T.astype(np.int64)
            yield _told(doc[covered], th[covered], _spans(place[covered], o1, o2), schema, buckets)
        # Rows of the least document go on, each a place of its own.
        go = ~covered
        dest = _per_bucket(h[go], buckets)
        by = np.lexsort((h[go], dest))
        order, dest = np.flatnonzero(go)[by], dest[by]
        cuts = _starts(dest)
        entry, named, first = _own_names(cuts, name[order])
        packed = [pack(_packed(whole[order[a:z]], entry[a:z], place[order[a:z]], ids[named[c:d]], ths[named[c:d]])) for a, z, c, d in zip(cuts, np.r_[cuts[1:], len(order)], first, np.r_[first[1:], len(named)])]
        nulls = pa.nulls(len(cuts), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(dest[cuts]), nulls, nulls, pa.nulls(len(cuts), pa.binary()), pa.array(packed, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows, texts = [], 0, 0
        for b in batches:
            give_back()
            ids, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, offsets = _bytes_of(b.column(2))
            cuts, flat = _listed(b.column(3))
            flat = flat.to_numpy().view(np.uint32)
            left = [flat[a:z] for a, z in zip(cuts[:-1], cuts[1:])]
            for row, base, raw, bounds in _chunks(data, offsets):
                piece, at, s1, s2, h = digits(raw, bounds)
                edges, marks = np.searchsorted(piece, np.arange(len(bounds))), _marks(h)
                keep = np.zeros(len(h), bool)
                for k in range(len(bounds) - 1):
                    if edges[k] < edges[k + 1]:
                        keep[edges[k] : edges[k + 1]] = np.isin(marks[edges[k] : edges[k + 1]], left[row + k])
                if not keep.any():
                    continue
                piece, at, s1, s2, h = piece[keep], at[keep], s1[keep], s2[keep], h[keep]
                around = raw[np.clip(at[:, None] + _REACH, 0, len(raw) - 1)]
                used = np.column_stack([at - s2, at - s1]).astype(np.uint8)
                around[~_in_use(used)] = 0
                named, name = np.unique(piece, return_inverse=True)
                if held and (windows >= GATHERED or texts + len(named) >= int(_MANY)):
                    yield from grouped(held)
                    held, windows, texts = [], 0, 0
                held.append((np.concatenate([around, used], axis=1), h, at - bounds[piece] + base, texts + name, ids[row + named], ths[row + named]))
                windows, texts = windows + len(h), texts + len(named)
        if held:
            yield from grouped(held)

    return run


def _spans(place: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The stretches that windows at offsets least to most from digits at these places cover, a number each: start and length."""
    return ((place - most) << _LENGTH) | (most - least + THRESHOLD)


def _told(doc, th, spans, schema, buckets) -> pa.RecordBatch:
    """Rows (document, its covered spans)."""
    order = np.lexsort((spans, th, doc))
    doc, th = doc[order], th[order]
    cuts = _starts(doc, th)
    none = pa.nulls(len(cuts), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(doc[cuts] % buckets), pa.array(doc[cuts]), pa.array(th[cuts]), _grouped(spans[order].astype(np.int64), cuts), none], schema=schema)


def ordered(strings: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings (rows of bytes) of documents, and how many bytes each shares with the one before it in that order.

    Ordered by most-significant-digit passes over PASS bytes each: a pass orders the rows of every group by their next digit and parts the
    group where it changes, and only groups of two documents or more go on. Rows of a group of one document keep any order."""
    n, depth = strings.shape
    order, group, open_ = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for at in range(0, depth, PASS):
        part = strings[order[open_], at : at + PASS]
        if part.shape[1] < PASS:
            part = np.concatenate([part, np.zeros((len(part), PASS - part.shape[1]), np.uint8)], axis=1)
        digit = np.ascontiguousarray(part).view(">u8").ravel().astype(np.uint64)
        by = np.lexsort((digit, group[open_])) if at else np.argsort(digit, kind="stable")
        order[open_] = order[open_][by]
        digit = digit[by]
        starts = _starts(digit, group[open_])
        sizes = np.diff(np.r_[starts, len(open_)])
        group[open_] = np.repeat(open_[starts], sizes)
        docs = doc[order[open_]]
        open_ = open_[np.repeat(np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts), sizes)]
        if not len(open_):
            break
    differ = strings[order[1:]] != strings[order[:-1]]
    return order, np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), depth)]


def covered_offsets(whole: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of packed windows (bytes around a key, least and greatest offset in use) of documents: the least and greatest offset at
    which a window equals one of a smaller document; greatest below least if none. Windows of one key overlap, so what is
    covered lies between.

    The suffixes that start at the keys are ordered, and so are the strings before the keys, read backwards. Where neighbours in these orders share
    fewer than k bytes a new group of k bytes starts, which gives the groups of every length at once. A window that holds its key at offset o is
    the o bytes before it and the THRESHOLD - o from it on: windows are equal if both are of the same groups, and only then."""
    n = len(whole)
    around, o1, o2 = whole[:, :_WIDTH], whole[:, _WIDTH].astype(np.int64), whole[:, _WIDTH + 1].astype(np.int64)
    least, most = np.full(n, 255), np.full(n, -1)
    order, shared = ordered(np.ascontiguousarray(around[:, _SPREAD:]), doc)
    back, shared_back = ordered(np.ascontiguousarray(around[:, _SPREAD - 1 :: -1]), doc)
    before = np.empty(n, np.int64)
    o1, o2, docs = o1[order], o2[order], doc[order]
    for o in range(_SPREAD + 1):
        use = np.flatnonzero((o1 <= o) & (o <= o2))
        if len(use) < 2:
            continue
        after = np.cumsum(shared < THRESHOLD - o)[use]
        new = np.r_[True, after[1:] != after[:-1], True]
        together = ~(new[:-1] & new[1:])
        use, after = use[together], after[together]
        if not len(use):
            continue
        before[back] = np.cumsum(shared_back < o) if o else 0
        key = after * (n + 1) + before[order[use]]
        by = np.argsort(key, kind="stable")
        use, at = use[by], _starts(key[by])
        low = np.repeat(np.minimum.reduceat(docs[use], at), np.diff(np.r_[at, len(use)]))
        hit = order[use[docs[use] > low]]
        least[hit] = np.minimum(least[hit], o)
        most[hit] = np.maximum(most[hit], o)
    return least, most


def _full_depth(group: pa.Table) -> pa.Table:
    """Of a bucket: (document, text, span) for each stretch that a smaller document covers."""
    give_back()
    own = pa.compute.is_valid(group["doc_id"])
    found, rest = group.filter(own), group.filter(pa.compute.invert(own))
    each, spans = _unpacked(found, "spans", np.int64)
    docs, ths = (np.repeat(found[n].to_numpy().astype(np.int64), each) for n in ("doc_id", "th"))
    if rest.num_rows:
        unpack = zstandard.ZstdDecompressor().decompress
        whole, entry, place, doc, th = zip(*(_as_packed(unpack(x.as_py())) for x in rest["packed"]))
        name = np.concatenate([e + first for e, first in zip(entry, np.cumsum([0, *map(len, doc)]))])
        whole, place, doc, th = map(np.concatenate, (whole, place, doc, th))
        doc = doc[name]
        least, most = covered_offsets(whole, doc)
        hit = most >= 0
        docs, ths = np.r_[docs, doc[hit]], np.r_[ths, th[name[hit]]]
        spans = np.r_[spans, _spans(place[hit].astype(np.int64), least[hit], most[hit])]
    return pa.table([pa.array(x, pa.int64()) for x in (docs, ths, spans)], names=["doc_id", "th", "span"])


def _by_bucket(df: DataFrame, buckets: int, work, schema: str) -> DataFrame:
    """What `work` makes of the table of each bucket. Buckets are dealt out to tasks one after the other: by their hashes some tasks would get several more
    than others. A task holds one bucket at a time."""
    tasks = min(buckets, MOST_TASKS)
    dealt = df.repartitionById(tasks, (F.col("dest") % tasks).cast("int")).sortWithinPartitions("dest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for b in batches:
            dest = b.column(0).to_numpy()
            cuts = _starts(dest)
            for start, end in zip(cuts, np.r_[cuts[1:], len(dest)]):
                if held and dest[start] != bucket:
                    yield from work(pa.Table.from_batches(held)).to_batches()
                    held = []
                bucket = dest[start]
                held.append(b.slice(start, end - start))
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return dealt.mapInArrow(tidy(run), schema)


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans [a, z) merged where they overlap or touch."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    at = np.flatnonzero(new)
    return np.column_stack([spans[at, 0], reach[np.r_[at[1:], len(spans)] - 1]])


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: id_col, n_bytes, n_removed, n_spans, kept (the bytes that stay, as binary).

    Removed is each byte covered by a THRESHOLD-byte string that also starts in a row with a smaller id, judged on the
    input. Runs may begin and end inside a UTF-8 character, so `kept` is binary. Nulls count as empty texts. A null id is neither smaller nor larger, so its
    row keeps all and covers nothing; rows of the same id don't cover each other. Texts shorter than a window keep all.
    Empty in, empty out. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    named = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= THRESHOLD))

    first = named.select("doc_id", "text").mapInArrow(tidy(_first_pass(buckets)), _FIRST)
    left = _by_bucket(first, buckets, _left_over, "doc_id long, digit int")
    with small_batches(df.sparkSession, 1000), passing_shuffles(df.sparkSession):
        left = cut(left.groupBy("doc_id").agg(F.collect_list("digit").alias("digits")))
    # Hints: both sides grow with the input, and what comes out of Python looks small to the planner.
    todo = named.join(left.hint("merge"), "doc_id").select("doc_id", "th", "text", "digits")
    second = todo.mapInArrow(tidy(_second_pass(buckets)), _SECOND)
    spans = _by_bucket(second, buckets, _full_depth, "doc_id long, th long, span long")
    with small_batches(df.sparkSession, 250), passing_shuffles(df.sparkSession):
        spans = cut(spans.groupBy("doc_id", "th").agg(F.collect_list("span").alias("spans")))
    discard(left)
    out = rows.join(spans.hint("merge"), ["doc_id", "th"], "left").select("doc_id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
            data, offsets = _bytes_of(b.column(1))
            removed, runs, kept = [], [], []
            at, flat = _listed(b.column(2))
            flat = flat.to_numpy()
            spans = np.column_stack([flat >> _LENGTH, (flat >> _LENGTH) + (flat & ((1 << _LENGTH) - 1))])
            for k in range(b.num_rows):
                raw = data[offsets[k] : offsets[k + 1]]
                cuts = merged(spans[at[k] : at[k + 1]])
                edges = np.r_[0, cuts.ravel(), len(raw)]
                kept.append(b"".join(raw[a:z].tobytes() for a, z in edges.reshape(-1, 2)))
                removed.append(len(raw) - len(kept[-1]))
                runs.append(len(cuts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    done = out.mapInArrow(tidy(remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumnRenamed("doc_id", id_col)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents, with what is removed of it and a digest of what stays."""
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
