"""Language ID by a string kernel: blended-spectrum n-gram presence, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import table, tidy

#: Lengths of the byte n-grams that are blended, each with the same weight.
ORDERS = (1, 2, 3, 4)
#: The training sample: rows in all (but LEAST_PER_LANG of each language), and of a language, at most. Longer texts than SAMPLE_BYTES are not drawn.
SAMPLE_ROWS = 4000
SAMPLE_PER_LANG = 300
SAMPLE_BYTES = 1 << 18
#: Rows of a language that are drawn however many languages there are, so the sample grows with their number alone.
LEAST_PER_LANG = 8
#: The ridge regression's matrices are (LEAST_PER_LANG x languages) x languages in the driver, 256 MB for so many; more are an error, so that none is left out unseen.
MOST_LANGS = 2000
#: Landmarks, in all; one a language if there are more languages.
LANDMARKS = 240
RIDGE = 1e-2
UNKNOWN = "und"
_PIECE = 1 << 16
_BATCH = 128
#: Products held at a time: three arrays of 4 MB.
_CELLS = 1 << 20
#: A part of a model on its way to the driver.
MODEL = pa.schema([("k", pa.int64()), ("langs", pa.list_(pa.string())), ("vocabulary", pa.binary()), ("weights", pa.binary()), ("bias", pa.binary())])
_LETTER = re.compile(r"[^\W\d_]")


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of a whole text as sorted codes: the order in the upper half, the bytes in the lower. A-Z count as a-z.
    Long texts are taken in overlapping pieces, so memory follows the number of distinct n-grams."""
    raw = np.frombuffer(text.encode().lower(), np.uint8)
    found = []
    for at in range(0, max(1, len(raw)), _PIECE):
        piece = raw[at : at + _PIECE + max(ORDERS) - 1].astype(np.uint64)
        codes, c = [], np.zeros(len(piece), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            m = len(piece) - n + 1
            if m <= 0:
                break
            c = (c[:m] << np.uint64(8)) | piece[n - 1 :]
            if n in ORDERS:
                codes.append(c | np.uint64(n << 32))
        found.append(np.unique(np.concatenate(codes)) if codes else np.empty(0, np.uint64))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def _weights(codes: np.ndarray) -> np.ndarray:
    """Each n-gram's entry in the normalised feature vector: orders have length 1 each, the whole has too."""
    order = (codes >> np.uint64(32)).astype(np.int64)
    size = np.bincount(order, minlength=max(ORDERS) + 1)
    return (1 / np.sqrt(len(ORDERS) * np.maximum(size, 1)))[order].astype(np.float32)


def sparse(rows: list[np.ndarray], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature vectors over the vocabulary as a sparse matrix: columns and values of all entries, and where each row's start, with the end.
    What is outside the vocabulary still counts for a row's length."""
    columns, values, edges = [np.empty(0, np.int64)], [np.empty(0, np.float32)], [0]
    for codes in rows:
        if len(vocabulary) and len(codes):
            at = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
            known = vocabulary[at] == codes
            columns.append(at[known])
            values.append(_weights(codes)[known])
        edges.append(edges[-1] + (len(columns[-1]) if len(vocabulary) and len(codes) else 0))
    return np.concatenate(columns), np.concatenate(values), np.array(edges)


def product(rows: list[np.ndarray], vocabulary: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """The sparse matrix of the rows times a dense one, in blocks of columns that bound the memory: entries times dense rows, summed by row."""
    columns, values, edges = sparse(rows, vocabulary)
    out = np.zeros((len(rows), dense.shape[1]), np.float32)
    full = np.flatnonzero(np.diff(edges))
    width = max(1, _CELLS // max(1, len(columns)))
    for k in range(0, dense.shape[1], width) if len(full) else ():
        out[full, k : k + width] = np.add.reduceat(dense[columns, k : k + width] * values[:, None], edges[full], axis=0)
    return out


@dataclass
class Model:
    langs: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray  # vocabulary x langs: landmarks' features times their coefficients
    bias: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Ridge scores (texts x langs), about 1 for the language and -1 for others. The kernel against the landmarks times
        their coefficients is a matrix product of three; the last two are multiplied once."""
        parts = [product([grams(t) for t in texts[k : k + _BATCH]], self.vocabulary, self.weights) for k in range(0, len(texts), _BATCH)]
        return np.concatenate(parts) + self.bias if parts else np.zeros((0, len(self.langs)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores from 0 to 1; `und` and 0 for texts that are null or without a letter, and if nothing was learned."""
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [k for k, t in enumerate(texts) if has_letter(t)] if self.langs else []
        s = self.scores([texts[k] for k in known])
        for k, row in zip(known, s):
            best = int(row.argmax())
            names[k], score[k] = self.langs[best], min(1.0, max(0.0, (float(row[best]) + 1) / 2))
        return names, score


def fit(rows: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fits the model. Landmarks are dealt round the languages, in the order of the rows."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.empty(0, np.uint64), np.empty((0, 0), np.float32), np.empty(0))
    by = {n: [k for k, x in enumerate(langs) if x == n] for n in names}
    turns = sorted((r, n, k) for n, ks in by.items() for r, k in enumerate(ks))
    marks = [k for _, _, k in turns[: max(landmarks, len(names))]]
    vocabulary = np.unique(np.concatenate([rows[k] for k in marks]))
    columns, entries, edges = sparse([rows[k] for k in marks], vocabulary)
    owners = np.repeat(np.arange(len(marks)), np.diff(edges))
    order = np.argsort(columns, kind="stable")
    columns, entries, owners = columns[order], entries[order], owners[order]

    def slices() -> Iterator[tuple[int, np.ndarray]]:
        """The landmarks' features, n-grams x landmarks, so many n-grams at a time that memory is bounded."""
        step = max(1, _CELLS // len(marks))
        for k in range(0, len(vocabulary), step):
            at = slice(*np.searchsorted(columns, (k, k + step)))
            lm = np.zeros((min(step, len(vocabulary) - k), len(marks)), np.float32)
            lm[columns[at] - k, owners[at]] = entries[at]
            yield k, lm

    kernel, gram = np.zeros((len(rows), len(marks))), np.zeros((len(marks), len(marks)))
    for at, lm in slices():
        part = vocabulary[at : at + len(lm)]
        for k in range(0, len(rows), _BATCH):
            kernel[k : k + _BATCH] += product(rows[k : k + _BATCH], part, lm)
        gram += lm.T @ lm
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-6 * max(values.max(), 1e-12)
    half = vectors[:, good] / np.sqrt(values[good])
    z = np.column_stack([kernel @ half, np.ones(len(rows))])
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    w = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    back = half @ w[:-1]
    return Model(names, vocabulary, np.concatenate([lm @ back for _, lm in slices()]).astype(np.float32), w[-1])


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", most_langs: int = MOST_LANGS) -> Model:
    """Fits on a sample of labelled rows: at most SAMPLE_PER_LANG of a language and SAMPLE_ROWS in all, but LEAST_PER_LANG of each, drawn by a hash of
    order_col, texts up to SAMPLE_BYTES, whole. Rows without a language or a letter teach nothing. n-grams are taken by the
    executors, and one task, whose memory the sample bounds, fits; the driver gets the model. More than most_langs languages are a ValueError."""
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(order_col).cast("string"), F.lit("sample")).alias("h"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").where(F.octet_length("text") <= SAMPLE_BYTES)
    counts = rows.groupBy("lang").count().limit(most_langs + 1).collect()
    if len(counts) > most_langs:
        raise ValueError(f"over {most_langs} languages are labelled; raise most_langs")
    if not counts:
        return fit([], [])
    each = max(LEAST_PER_LANG, min(SAMPLE_PER_LANG, SAMPLE_ROWS // len(counts)))
    shares = df.sparkSession.createDataFrame([(r["lang"], min(1.0, 2.0 * each / r["count"] + 4 * each**0.5 / r["count"])) for r in counts], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1_000_003)) < F.col("share") * 1_000_003)  # at most most_langs rows

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[has_letter(t) for t in b["text"]]]
            yield pd.DataFrame({"lang": b["lang"], "h": b["h"], "codes": [grams(t).tobytes() for t in b["text"]]})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list] = {}
        for b in batches:
            for r in zip(*(b.column(n).to_pylist() for n in ("lang", "h", "codes"))):
                got.setdefault(r[0], []).append(r[1:])
            for rows in got.values():  # what is not taken isn't held either
                rows.sort()
                del rows[each:]
        taken = {lang: [np.frombuffer(codes, np.uint64) for _, codes in got[lang]] for lang in sorted(got)}
        m = fit([c for cs in taken.values() for c in cs], [n for n, cs in taken.items() for _ in cs])
        step = max(1, _CELLS // max(1, len(m.langs)))
        for k in range(0, max(1, len(m.vocabulary)), step):
            yield pa.RecordBatch.from_pylist([{"k": k, "langs": m.langs, "vocabulary": m.vocabulary[k : k + step].tobytes(), "weights": m.weights[k : k + step].tobytes(), "bias": m.bias.tobytes()}], MODEL)

    taught = drawn.select("text", "lang", "h").mapInPandas(tidy(features), "lang string, h long, codes binary")
    parts = sorted(taught.groupBy(F.lit(0).alias("one")).applyInArrow(tidy(learn), "k long, langs array<string>, vocabulary binary, weights binary, bias binary").collect(), key=lambda r: r["k"])
    if not parts:
        return fit([], [])
    langs = list(parts[0]["langs"])
    vocabulary, weights = np.concatenate([np.frombuffer(r["vocabulary"], np.uint64) for r in parts]), np.concatenate([np.frombuffer(r["weights"], np.float32) for r in parts])
    return Model(langs, vocabulary, weights.reshape(-1, len(langs)), np.frombuffer(parts[0]["bias"]))


def identify(df: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df with the language and score of each whole text; columns that have these names are replaced. Null, empty and
    letterless texts get `und` and 0. Rows are scored alone: nothing is shuffled, repeats agree, an empty table stays empty."""
    sent = df.sparkSession.sparkContext.broadcast((model.langs, model.vocabulary, model.weights, model.bias))  # the sample's size bounds it

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model(*sent.value)
        for b in batches:
            names, score = m.predict([None if pd.isna(t) else t for t in b])
            yield pd.DataFrame({"lang": names, "score": score})

    found = F.pandas_udf(tidy(run), "lang string, score double")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (lang_out, score_out)]
    return df.select(*kept, found(F.col(text_col)).alias("__found")).select(*kept, F.col("__found.lang").alias(lang_out), F.col("__found.score").alias(score_out))


def held_out(doc_id):
    """Whether a document is never learned from: CRC-32 of its id as text leaves 2 when divided by 4. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its predicted language; the model has seen none of those held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
