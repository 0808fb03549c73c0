import random

import numpy as np
import pytest

from ashlar.llm import near_copies
from corpus_pipeline import near_dedup


def jaccard(a, b, size=5):
    x, y = ({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_stage_drops_planted_copies(spark, docs):
    rnd = random.Random(11)
    word = lambda: "w%d" % rnd.randrange(5000)
    rows, copies, others = [], set(), set()
    for k in range(60):
        base = [word() for _ in range(rnd.randint(60, 600))]
        near = list(base)
        aim = 0.6 if k % 4 == 3 else rnd.uniform(0.81, 0.95)
        while jaccard(" ".join(base), " ".join(near)) > aim + 0.02:
            near[rnd.randrange(len(near))] = word()
        assert (jaccard(" ".join(base), " ".join(near)) >= 0.8) == (k % 4 < 3)
        (copies if k % 4 < 3 else others).add(1000 + k)
        rows += [(k, " ".join(base), "s"), (1000 + k, " ".join(near).upper(), "s")]
    got = {r.doc_id for r in near_dedup(spark, docs(rows), "").collect()}
    assert got == set(range(60)) | others


def test_repeated_and_null_ids(spark, docs):
    text = " ".join(f"a{k}" for k in range(50))
    rows = [(1, text, "s"), (1, text, "s"), (1, "of no other kind at all", "s"), (2, text + " more", "s"), (2, "a text of its own here", "s"), (None, text.upper(), "s"), (None, "null", "s"), (None, "null", "s"), (3, "", "s"), (4, None, "s")]
    got = sorted(((r.doc_id, r.text) for r in near_copies.drop_similar(docs(rows)).collect()), key=str)
    assert got == sorted([(1, text), (1, rows[2][1]), (2, rows[4][1]), (None, "null"), (None, "null"), (3, "")], key=str)
    assert near_copies.drop_similar(docs([])).count() == 0


def brute(texts, least=0.8, size=5):
    """Classes of texts joined by chains of Jaccard similarities over whole shingle sets."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x == y or x and y and len(x & y) / len(x | y) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(sets))]


@pytest.mark.parametrize("tile, set_bytes", [(1 << 15, 1 << 20), (8, 6000)])
def test_group_of_many_variants(spark, docs, monkeypatch, tile, set_bytes):
    """A chain of edits, a dense group, and texts apart: the same classes however small the tiles and parts are."""
    monkeypatch.setattr(near_copies, "SET_BYTES", set_bytes)
    monkeypatch.setattr(near_copies.candidate_links, "__defaults__", (near_copies.LEAST, tile))
    rnd = random.Random(3)
    word = lambda: "w%d" % rnd.randrange(4000)
    texts, now = [], [word() for _ in range(200)]
    for _ in range(40):
        texts.append(" ".join(now))
        now = list(now)
        now[rnd.randrange(200)] = word()
    base = [word() for _ in range(150)]
    for _ in range(60):
        near = list(base)
        for _ in range(rnd.randint(1, 9)):
            near[rnd.randrange(150)] = word()
        texts.append("\n".join(near))
    texts += [" ".join(word() for _ in range(rnd.randint(1, 90))) for _ in range(40)] + ["", None, "one two", "ONE  two", "one two three"]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    texts = [texts[k] for k in order]
    got = {r.doc_id for r in near_copies.drop_similar(docs([(k, t, "s") for k, t in enumerate(texts)])).collect()}
    assert got == set(brute(texts))


def test_exact_links_against_brute_force():
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(0, 60, rnd.integers(1, 60)).astype(np.uint64)) for _ in range(80)]
    u, v = near_copies.exact_links(sets, 0.5)
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.5}
    assert set(zip(u.tolist(), v.tolist())) <= want

    def classes(edges):
        root = list(range(80))
        for _ in range(80):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert classes(list(zip(u, v))) == classes(list(want))
