"""A training corpus from raw documents, in five stages, each by an operator of ashlar.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm import common
from ashlar.llm.common import small_batches, table
from ashlar.llm.decontaminate import drop_contaminated
from ashlar.llm.language_id import UNKNOWN, held_out, identify, train
from ashlar.llm.mixing import mixed_documents
from ashlar.llm.near_copies import drop_similar
from ashlar.llm.sharding import shard
from ashlar.tables import discard

#: A document whose best language scores below this is rejected. 0.5 is where that language's vote changes sign; down to 0.3 a document is still nearer to it than to
#: any other, and short or mixed texts of a known language, which are clean, score there.
LEAST_SCORE = 0.3


def cut(rows: DataFrame) -> DataFrame:
    """rows, written in the shared folder. They hold whole texts and stay until somebody discards them or the session ends, those of several stages at once, so they are packed tighter than Spark's default does."""
    return common.cut(rows, "zstd")


def _written(rows: DataFrame) -> DataFrame:
    """rows, written while Python gets small batches of texts: the size of a batch is settled where a plan runs, not where it is made."""
    with small_batches(rows.sparkSession):
        return cut(rows)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labels teach. Documents without a letter, or like none of the languages, go,
    null texts with them. Documents of a null id teach nothing, but are judged like others; rows that repeat are judged alike."""
    model = train(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    found = identify(docs, model, lang_out="__lang", score_out="__score")
    return _written(found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more.
    A row of a null id stays unless its group has an id; of rows that repeat whole one stays; rows that share their id alone are told apart."""
    return drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark. Each row is judged by its text, whatever its id is."""
    return _written(drop_contaminated(docs, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents: one row for each pass over its source that takes words of a document. A null id or source
    is one like any other; rows that repeat are documents of their own."""
    return _written(mixed_documents(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix as shards of about the target size and returns it as read back, with each row's shard and tier.
    Every row of the mix is in one shard, nulls and repeats included."""
    return shard(docs).read()


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing", mix), ("sharding", sharding)]

#: SQL can express neither the classifier nor the mix; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder. Each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = docs if hasattr(docs, "cut_path") else cut(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
