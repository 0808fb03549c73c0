import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ashlar.llm import packing
from ashlar.llm.packing import Ids, cuts_of, op11_pack, pack, plan, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", " a b", "a  b c", "tabs\tand\nlines \n here  ", "it's we'll don't 'tis '´", "x<|endoftext|> y <|endoftext|>z  <|endoftext|> w",
    "naïve  café 　wide  line \x85next \x1cfs a\x1c b", "\U0001f600 \U0001f600\U0001f680 ok", "... ,, !? ( a ) 12 3456,7 -8", "a" * 5000, "word " * 2000, "\n" * 300 + "x", "中文 中文。 русский",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("run", [1 << 20, 40])
def test_ids_are_the_tokenizers(tokenizer, monkeypatch, run):
    monkeypatch.setattr(packing, "RUN_CHARS", run)
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab's .,\n\t 9é -") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    ids = Ids(PATH)
    for _ in range(2):  # the second time from what it remembers
        got = list(ids.texts(texts))
        assert [np.frombuffer(x, "<u4").tolist() + [2] for x in got] == [plain_ids(tokenizer, t) for t in texts]


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (4, [(0, 4)]), (5, [(0, 1), (1, 4)]), (8, [(0, 4), (4, 4)]), (11, [(0, 3), (3, 4), (7, 4)])])
def test_cuts(n, want):
    assert cuts_of(n, 4) == want


def fewest(lengths, capacity):
    """The least number of sequences, by trying all ways."""
    best = len(lengths)

    def go(k, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if k == len(lengths):
            best = len(gaps)
            return
        for i, g in enumerate(gaps):
            if g >= lengths[k] and g not in gaps[:i]:
                go(k + 1, [*gaps[:i], g - lengths[k], *gaps[i + 1 :]])
        go(k + 1, [*gaps, capacity - lengths[k]])

    go(0, [])
    return best


def test_plan_against_all_ways():
    rng, over = random.Random(1), 0
    for _ in range(150):
        capacity = rng.choice([10, 16, 30])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 9))), reverse=True)
        counts = {n: lengths.count(n) for n in set(lengths)}
        made = plan(counts, capacity)
        used = {}
        for ls, many in made:
            assert sum(ls) <= capacity and many > 0 and list(ls) == sorted(ls, reverse=True)
            for n in ls:
                used[n] = used.get(n, 0) + many
        assert used == counts
        over += sum(m for _, m in made) - fewest(lengths, capacity)
    assert over <= 3


def test_plan_of_any_size():
    rng = random.Random(2)
    counts = {n: rng.randint(0, 10**9) for n in range(1, 1025)}
    made = plan(counts, 1024)
    total = sum(n * c for n, c in counts.items())
    assert len(made) < 3000 and sum(m for _, m in made) <= 1.01 * max(total / 1024, sum(c for n, c in counts.items() if n > 512))
    exact = plan({600: 5, 424: 3, 400: 1, 24: 2, 200: 3, 212: 2}, 1024)
    assert sum(m for _, m in exact) == 6 and ((600, 400, 24), 1) in exact and ((600, 212, 212), 1) in exact
    assert plan({}, 8) == [] and plan({8: 3}, 8) == [((8,), 3)]


def check_packing(rows, texts, tokenizer, capacity):
    """rows: of a packing with ids, texts: by doc_id, of different texts."""
    spans, held = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4") if "ids" in r else None
        held.setdefault((r["doc_id"], r["start"]), []).append(r)
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert ids is None or (len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"])
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts.items():
        ids = plain_ids(tokenizer, text)
        for k, (s, n) in enumerate(cuts_of(len(ids), capacity)):
            (r,) = held.pop((doc, s))
            assert (r["piece"], r["length"], r["ids_crc32"]) == (k, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))
    assert not held
    return len(spans), sum(r["length"] for r in rows)


def test_query_on_whole_documents(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = [r.asDict() for r in op11_pack(spark, folder).collect()]
    n, ids = check_packing(rows, texts, tokenizer, 1024)
    assert n <= 1.01 * ids / 1024 + 1


def test_odd_rows(spark, tokenizer):
    texts = dict(enumerate(TEXTS))
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()], "doc_id long, text string, ids string, length int").repartition(3)
    packed = pack(df, keep_ids=True, capacity=64).cache()
    rows = [r.asDict() for r in packed.collect()]
    check_packing(rows, texts, tokenizer, 64)
    whole = {r["sequence_id"]: r for r in sequences(packed).collect()}
    for r in rows:
        s = whole[r["sequence_id"]]
        assert bytes(s["ids"])[4 * r["offset"] :][: 4 * r["length"]] == bytes(r["ids"]) and s["length"] * 4 == len(s["ids"])


def test_repeats_nulls_and_empty(spark):
    same = spark.createDataFrame([(7, "one two three")] * 50 + [(None, None)] * 20, "doc_id long, text string").repartition(4)
    rows = pack(same, capacity=8).collect()
    assert len(rows) == 70 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 70
    assert sum(r["doc_id"] is None and r["length"] == 1 for r in rows) == 20
    long = len([r for r in rows if r["doc_id"] == 7]) * next(r["length"] for r in rows if r["doc_id"] == 7)
    assert len({r["sequence_id"] for r in rows}) == -(-(long + 20) // 8)
    assert pack(same.limit(0)).count() == 0
    assert pack(same.where("doc_id IS NULL"), end_id=None).count() == 0
