from ashlar.streaming import streams as S


def add(spark, path, rows, n):
    spark.createDataFrame(rows, "k long, t long, x string").coalesce(1).write.mode("append").parquet(path)


def test_latest_by_key_goes_on_in_a_second_run(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/kept"
    add(spark, source, [(1, 1, "a"), (2, 5, "b"), (1, 0, "old")], 0)
    run = lambda: sorted(map(tuple, S.latest_by_key(S.read_stream(spark, source), ["k"], ["t"], target).collect()))
    assert run() == [(1, 1, "a"), (2, 5, "b")]
    add(spark, source, [(3, 9, "c"), (2, 4, "late"), (1, 2, "new")], 1)
    assert run() == [(1, 2, "new"), (2, 5, "b"), (3, 9, "c")]
    assert run() == [(1, 2, "new"), (2, 5, "b"), (3, 9, "c")]


def test_latest_by_key_of_one_call(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    add(spark, source, [(1, 1, "a"), (1, 1, "b"), (None, 3, None)], 0)
    assert sorted(map(tuple, S.latest_by_key(S.read_stream(spark, source), ["k"], ["t"]).collect()), key=str) == [(1, 1, "b"), (None, 3, None)]
