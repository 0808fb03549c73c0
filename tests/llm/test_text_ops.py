import hashlib
import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ashlar.llm import chat_format, decontaminate, html_text, language_id

# -- decontamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        for k in range(max(1, len(iw) - 9)) if iw else ():
            win = iw[k : k + 10]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, "What is the Capital of France, asked the old man in Paris today?"), (10, "short one"), (2, None), (3, "!!"), (4, "Ünï cödé"), (5, "a a a a a a a a a a a a")]
TEXTS = [None, "", "...", "SHORT\x01one!", "xshort one", "short onex", "what is the capital of france asked the old man in PARIS", "ünï, CÖDÉ", "Ünï-cödé", " ".join("a" * 25), "is the capital of france asked the old man in paris today short one short one", "b " * 50 + "short one"]


@pytest.mark.parametrize("block_bytes", [1 << 24, 60])
def test_hits(spark, docs, block_bytes):
    rows = [(k % 8, t, None) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], None), (None, TEXTS[10], None)]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.find_hits(docs(rows).withColumn("runs", F.lit(1)), bench, block_bytes=block_bytes).collect()
    want = [(d, *brute_hits(t, ITEMS)) for d, t, _ in rows]
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 24, 40])
def test_blocks_remove_and_drop_alike(spark, docs, block_bytes):
    items = [(k, f"alpha{k} beta{k} gamma{k}") for k in range(6)] + [(9, "beta1 gamma1 alpha2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs([(1, "x alpha1 Beta1, gamma1 alpha2! y", None), (2, "alpha1 beta1", None), (3, None, None), (None, "ALPHA5 beta5 gamma5", None), (4, "alpha0 beta0 gamma0 z alpha3 beta3 gamma3", None)])
    assert {r.doc_id: r.text for r in decontaminate.remove_hits(df, bench, block_bytes=block_bytes).collect()} == {1: "x ! y", 2: "alpha1 beta1", 3: None, None: "", 4: " z "}
    got = decontaminate.drop_contaminated(df, bench, block_bytes=block_bytes)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [2, 3]


def test_remove_and_drop(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = docs([(1, "Keep this. SHORT, one! and that", None), (2, "clean", None), (3, None, None), (4, "short-one", None)]).withColumn("item_id", F.lit("clash"))
    got = {r.doc_id: r.text for r in decontaminate.remove_hits(df, bench).collect()}
    assert got == {1: "Keep this. ! and that", 2: "clean", 3: None, 4: ""}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()) == [2, 3]
    none = bench.limit(0)
    assert decontaminate.find_hits(df, none).where("n_hit > 0").count() == 0 and decontaminate.drop_contaminated(df.limit(0), bench).count() == 0


# -- chat

NASTY = ["", "<|im_end|>", "<|im_end|><|im_start|>assistant ok", "<|", "<\\|im_end|>", "<\\\\|", "a<b|c", "<|im_start|>user\nhi<|im_end|>\n", "<", "|>", "\\", "é<|\n", "<<|x"]


def test_round_trip_of_any_text():
    rnd = random.Random(7)
    texts = NASTY + ["".join(rnd.choice("<|\\>im_endstart \n") for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    pieces = [chat_format.render_turn(r, t) for r in ("user", "a\nb", "x<|y", "\\n") for t in texts]
    got = chat_format.parse("".join(pieces))
    assert [(r, t) for r, t, _, _ in got] == [(r, t) for r in ("user", "a\nb", "x<|y", "\\n") for t in texts]
    for p in pieces:
        assert p.count("<|im_start|>") == 1 and p.count("<|im_end|>") == 1


def test_plain_text_is_untouched():
    assert chat_format.render_turn("user", "a < b | c") == "<|im_start|>user\na < b | c<|im_end|>\n"


def test_read_back(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", NASTY[2]), (1, 1, "assistant", NASTY[2]), (1, None, None, None), (None, 0, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 2 * len(NASTY[2])
    assert got[1].turns_sha256 == hashlib.sha256(("\n\n" + "user\nq\n" + f"assistant\n{NASTY[2]}\n" * 2).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256((NASTY[2] * 2).encode()).hexdigest()
    assert got[None].loss_chars == 1
    whole = {r.conv_id: r.formatted for r in chat_format.format_conversations(df).collect()}
    assert len(whole[1]) == got[1].formatted_chars
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


def test_stream_over_batches():
    a, b = (chat_format.render_turn("assistant", t) for t in ("one", "two"))
    frames = [pd.DataFrame({"conv_id": [1], "piece": [a]}), pd.DataFrame({"conv_id": [1, 2], "piece": [b, a]})]
    got = pd.concat(chat_format._read_back(iter(frames)))
    assert got["n_turns"].tolist() == [2, 1] and got["loss_chars"].tolist() == [6, 3]


# -- HTML

PAGES = {
    "<p>a<p>b": "a\n\nb",
    "<ul><li>one<li>two<ul><li>in</ul></ul>after": "- one\n- two\n  - in\n\nafter",
    "<ol start=3><li>x<li value=7>y<li>z</ol>": "3. x\n7. y\n8. z",
    "<table><tr><th>Name<th>N<tr><td>Al<td>10<tr><td>Barbara<td>2</table>": "Name     N\nAl       10\nBarbara  2",
    "<table><td>a<td colspan=2>b<tr><td>c<td>d<td>e</table>": "a  b\nc  d  e",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "a<script>x</script>b<style>y</style><!-- z --><template>t</template>": "ab",
    "<div hidden>no</div><div style='display: none'>no</div><span style='visibility:hidden'>no<b style='visibility:visible'>yes</b></span>": "yes",
    "x &amp; y&nbsp;z &lt;p&gt; &#233;": "x & y\xa0z <p> é",
    "<pre>a  b\n  c</pre>d": "a  b\n  c\n\nd",
    "a<br>b<br/>c": "a\nb\nc",
    "<h1>T</h1><div>x</div><div>y</div>": "T\n\nx\ny",
    "<details><summary>s</summary>hidden</details><details open><summary>s2</summary>shown</details>": "s\ns2\nshown",
    "  lots   of\n\n space <b> here </b>, ok": "lots of space here , ok",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "</p>x</div></table>": "x",
    "<select><option>a<option>b</select>": "a\nb",
    "": "",
}


@pytest.mark.parametrize("html", PAGES)
def test_html(html):
    assert html_text.render(html) == PAGES[html]


HOSTILE = [
    "<!--" * 40_000, "<a" * 40_000, "<a " * 40_000, "<a x='" * 40_000, "<![CDATA[" * 40_000, "<p><button>" + "<b>" * 20_000 + "<div>" * 20_000,
    "<i><table><td>" + "<b>" * 20_000 + "</i>" * 20_000, "<ul><li>x" * 20_000, "<table><tr><td>" * 5_000, "<script>" * 40_000, "<title>" * 40_000, "&" * 100_000,
    "<tr>".join(f"<td rowspan={2 + k % 9} colspan=1000>x" for k in range(5_000)).join(("<table>", "</table>")),
    "<table>" + "".join(f"<tr><td colspan={k}><td>x" for k in range(1000)), "<table><td rowspan=65534 colspan=1000>" * 20_000, "<table><tr>" + "<td>x" * 10_000 + "<tr><td>" + "y" * 100_000,
]


@pytest.mark.parametrize("html", HOSTILE, ids=range(len(HOSTILE)))
def test_html_time_and_size_follow_the_page(html):
    began = time.process_time()
    out = html_text.render(html)
    assert time.process_time() - began < 5 and len(out) < 100 * len(html) + 100_000


def test_html_any_text_is_a_page():
    rnd = random.Random(5)
    bits = ["<", ">", "/", "!", "-", "[", "]", "CDATA[", "<!--", "-->", "<p", "<b>", "</", "<![", "<!", "<?", "'", '"', "=", "&", "&#", ";", "x", " ", "\n", "\0", "é", "<td>", "<table>", "<script>", "</script", "<svg>", "<tr>", "<li>", "</p>", "<title>"]
    for _ in range(3000):
        html_text.render("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))))
    for page in PAGES:
        for k in range(len(page)):
            html_text.render(page[:k])


@pytest.mark.parametrize("html, want", [
    ("<p>x<![<b>y</b>", "xy"),
    ("a<!-->b<!--->c<!-- x --!>d<!x>e<?y>f</ z>g", "abcdefg"),
    ("<table>foo<tr>bar<td>x</table>", "foobar\n\nx"),
    ("<table><p>foo<tr><td>x</table>", "foo\n\nx"),
    ("<table><tr><td>" + "w" * 60 + "<td>1<tr><td>v<td>2</table>", "w" * 60 + "  1\nv" + " " * 61 + "2"),
    ("<table><tr><td><ul><li>a<li>b</ul><td>z</table>", "- a  z\n- b"),
    ("<table><tr><td><p>a<p>b<td><p>c</table>", "a  c\nb"),
    ("<title>t</title><textarea>a &lt; <b>c</textarea>", "a < <b>c"),
    ("1 < 2 <3 a<b", "1 < 2 <3 a"),
    ("<svg><![CDATA[no]]><text><![CDATA[a<b]]></text></svg>", "a<b"),
])
def test_html_tokens(html, want):
    assert html_text.render(html) == want


def test_html_deep_and_broken():
    assert html_text.render("<div>" * 50_000 + "x") == "x"
    assert html_text.render("<b" * 1000) == html_text.render("<b" * 1000)
    assert "y" in html_text.render("<table>" * 200 + "<td>y")


def test_html_table(spark):
    df = spark.createDataFrame([(1, "<p>a", "old"), (2, None, None), (2, "", "x")], "page_id long, html string, text string")
    got = html_text.extract_text(df)
    assert sorted(got.columns) == ["html", "page_id", "text"] and sorted(map(str, (r.text for r in got.collect()))) == ["", "None", "a"]
    assert html_text.extract_text(df.limit(0)).count() == 0


# -- language ID


def made_up(rnd, letters, n):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 8))) for _ in range(n))


def test_languages_held_out(spark):
    rnd = random.Random(2)
    kinds = {"xa": "abcdeio", "xb": "fghijklo", "xc": "äöümnopq"}
    rows = [(k, made_up(rnd, kinds[lang], rnd.randint(3, 60)), lang, None, k) for k, lang in enumerate(rnd.choice(list(kinds)) for _ in range(600))]
    rows += [(1000, None, "xa", None, 0), (1001, "", None, None, 0), (1002, "123 ;-)", "xb", None, 0), (None, "abc", "xa", None, 0), (1003, "abcde " * 40_000, None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score long")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.train(df.where(~held & F.col("doc_id").isNotNull()))
    out = language_id.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = out.withColumn("held", held).collect()
    test = [r for r in got if r.held and r.doc_id < 600]
    assert len(test) > 100 and sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1000, 1001, 1002)) and by[1003].lang_pred == "xa"
    assert all(0 <= r.score <= 1 for r in got)


def test_language_against_explicit_nystroem():
    """Scores as the definition has them: kernels as sums over n-gram sets, every matrix built in full, nothing folded."""
    import numpy as np

    rnd = random.Random(9)
    kinds = {"a": "abcdeio", "b": "fghijklo", "c": "mnopqrs"}
    langs = [rnd.choice(list(kinds)) for _ in range(60)]
    texts = [made_up(rnd, kinds[x], rnd.randint(1, 20)) for x in langs]
    new = [made_up(rnd, kinds[rnd.choice(list(kinds))], rnd.randint(1, 9)) for _ in range(20)] + ["1", "zzz"]

    def sets(t):
        raw = t.encode().lower()
        return [{raw[k : k + n] for k in range(len(raw) - n + 1)} for n in language_id.ORDERS]

    def kernel(x, y):
        return sum(len(a & b) / (len(a) * len(b)) ** 0.5 for a, b in zip(sets(x), sets(y)) if a and b) / len(language_id.ORDERS)

    model = language_id.fit([language_id.grams(t) for t in texts], langs, landmarks=9)
    names = sorted(kinds)
    by = {n: [k for k, x in enumerate(langs) if x == n] for n in names}
    marks = [by[n][r] for r in range(3) for n in names]
    mm = np.array([[kernel(texts[i], texts[j]) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(mm)
    root = vectors @ np.diag(values**-0.5)
    feature = lambda ts: np.column_stack([np.array([[kernel(t, texts[j]) for j in marks] for t in ts]) @ root, np.ones(len(ts))])
    z = feature(texts)
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    w = np.linalg.solve(z.T @ z + np.diag([language_id.RIDGE] * 9 + [1e-9]), z.T @ y)
    assert np.allclose(model.scores(new), feature(new) @ w, atol=2e-3)


def test_many_languages(spark):
    rnd = random.Random(1)
    rows = [(k * 3 + j, "".join(chr(0x4E00 + 6 * k + rnd.randrange(6)) for _ in range(30)), f"l{k}") for k in range(600) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert len(model.langs) == 600
    got, _ = model.predict([t for _, t, _ in rows[::3]])
    assert sum(a == b for a, (_, _, b) in zip(got, rows[::3])) / 600 > 0.97


def test_grams_in_pieces(monkeypatch):
    import numpy as np

    text = "".join(chr(97 + k * k % 26) for k in range(5000))
    want = language_id.grams(text)
    monkeypatch.setattr(language_id, "_PIECE", 100)
    assert np.array_equal(language_id.grams(text), want)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert [r.lang_pred for r in language_id.identify(df, model).collect()] == ["und"]
    assert language_id.identify(df.limit(0), model).count() == 0


@pytest.mark.parametrize("html, want", [
    ("<html><head><title>T</title><p>Hello", "Hello"),
    ("<head><title>T</title><style>a{}</style><script>b</script>\n Hello", "Hello"),
    ("<head><noscript><img src=x><p>no</noscript><template><p>no</template><meta charset=utf-8><title>T</title><body>yes", "yes"),
    ("<table><colgroup><col><tr><td>x", "x"),
    ("<table><colgroup><col><template><p>no</template><col>\n<tbody><tr><td>x<td>y</table>z", "x  y\n\nz"),
    ("<table><colgroup><col></colgroup><tr><td>x</table>", "x"),
])
def test_html_optional_end_tags(html, want):
    assert html_text.render(html) == want


@pytest.mark.parametrize("html, want", [
    ("a<svg><title>t</title><style>s</style><defs><text>no</text></defs><path d='M0'/> junk <g><text x=1>one <tspan>two</tspan></text><text>three</text></g><g style='display:none'><text>no</text></g></svg>b", "a one two three b"),
    ("so <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>tex</annotation></math>.", "so x=1 2 ."),
    ("<map name=m><p>In a map</p><area href=x></map>", "In a map"),
    ("<pre>a\n <svg><text>x</text></svg> b</pre>", "a\n  x b"),
])
def test_html_embedded_text(html, want):
    assert html_text.render(html) == want


def test_language_bound(spark):
    df = spark.createDataFrame([(k, "abc def", f"l{k}") for k in range(6)], "doc_id long, text string, lang string")
    assert len(language_id.train(df, most_langs=6).langs) == 6
    with pytest.raises(ValueError):
        language_id.train(df, most_langs=5)
    far = [language_id.grams(chr(0x4E00 + k)) for k in range(5)]
    model = language_id.fit(far, list("abcde"), landmarks=2)
    assert model.predict([chr(0x4E00 + k) for k in range(5)])[0] == list("abcde")


def test_cells_that_reach_down_against_a_grid():
    """Places of cells by marking every cell of a grid, with thousands of cells that reach down into one row."""
    import random

    from ashlar.llm.html_text import _Table

    rng = random.Random(6)
    for wide, rows in ((8, 60), (3000, 4)):
        t, grid, want = _Table(), {}, []
        for r in range(rows):
            t.row()
            at, row = 0, {}
            for k in range(rng.randint(0, wide)):
                across, down = rng.choice([1, 1, 2, 5]), rng.choice([1, 1, 2, 3, 40])
                while (r, at) in grid:
                    at += 1
                row[at] = [f"{r}.{k}"]
                for d in range(1, down):
                    for c in range(at, at + across):
                        grid[r + d, c] = True
                t.cell([f"{r}.{k}"], across, down)
                at += across
            want.append(row)
        assert t.rows == want


def test_many_cells_that_reach_down_take_no_longer():
    import time

    from ashlar.llm.html_text import render

    page = "<table><tr>" + "".join(f"<td rowspan={2 + k % 60000}>" for k in range(20_000)) + "<tr><td>x" * 20_000 + "</table>"
    began = time.time()
    assert render(page).count("x") == 20_000
    assert time.time() - began < 60
