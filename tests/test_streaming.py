"""The streaming extension gives what a batch run over the same files gives."""

from datetime import datetime, timedelta

from loomgraph.streaming import vocabulary as V


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, f"word{'abc'[k % 3]} common text-{'xy'[k % 2]}", datetime(2024, 1, 1) + timedelta(minutes=k)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ts timestamp")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    V.run_available(V.new_types(V.stream_tokens(stream)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.token for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.token for r in V.stream_tokens(docs).select("token").distinct().collect()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)
    assert sum(r.tokens for r in V.windowed_counts(V.stream_tokens(docs)).collect()) == V.stream_tokens(docs).count()
