"""What the third round's findings asked for of the pipeline."""

from pathlib import Path

import pyarrow.parquet as pq

import corpus_pipeline as P


def test_texts_go_to_python_in_small_batches(spark, folder, monkeypatch):
    docs = spark.createDataFrame([(k, f"text of {k % 7} words and {k}", "xa", f"s{k % 2}", 30) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    path = folder(documents=docs, benchmark=spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    key, seen, cut = "spark.sql.execution.arrow.maxRecordsPerBatch", [], P.cut
    old = spark.conf.get(key)
    monkeypatch.setattr(P, "cut", lambda df: (seen.append(int(spark.conf.get(key))), cut(df))[1])
    for stage in (P.language_id, P.decontaminate, P.mix):
        docs = stage(spark, docs, path)
    assert seen == [1000] * 3 and spark.conf.get(key) == old and docs.count() > 0


def test_what_stages_leave_in_the_shared_folder_is_packed_tight(spark, folder):
    docs = spark.createDataFrame([(k, " ".join(f"word{k * j % 997}" for j in range(300)), "xa", f"s{k % 2}", 30) for k in range(400)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    path = folder(documents=docs, benchmark=spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    plain = sum(f.stat().st_size for f in Path(f"{path}/documents.parquet").glob("*.parquet"))
    out = P.decontaminate(spark, docs, path)
    files = list(Path(out.cut_path.removeprefix("file://")).glob("*.parquet"))
    assert {pq.ParquetFile(f).metadata.row_group(0).column(1).compression for f in files} == {"ZSTD"} and out.count() == 400
    assert sum(f.stat().st_size for f in files) < 0.85 * plain
