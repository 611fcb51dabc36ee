from pyspark.sql import functions as F

from pagemill.operators import chunk
from pagemill.streaming import chunks

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = chunks.read_files(spark, str(tmp_path / "in"), docs.schema, 1)
    chunks.publish(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("epoch")
    want = chunk.records(chunk.fixed(docs))
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).count() == 0


def test_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = chunks.windowed(chunks.read_files(spark, str(tmp_path / "in"), events.schema), "ts", "10 minutes", "1 day")
    q = stream.writeStream.format("memory").queryName("per_day").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("per_day").agg(F.sum("n")).first()[0] == events.count()


def test_upserts_keep_the_newest(spark, tmp_path):
    """Batches in no order, a batch run again, and tables of earlier batches that go."""
    rows = [[("a", 1, "x"), ("b", 5, "x")], [("a", 3, "y"), ("c", 1, "y")], [("a", 2, "z"), ("b", 4, "z")], [("c", 9, "w")]]
    kind = "key string, version int, value string"
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = chunks.read_files(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema, 1)
        chunks.upsert_into(stream, str(tmp_path / "out"), str(tmp_path / "check"), "key", "version").awaitTermination(120)
        want = {}
        for k, v, x in (r for b in rows[: i + 1] for r in b):
            want[k] = max(want.get(k, (0, "")), (v, x))
        assert {r.key: (r.version, r.value) for r in chunks.read_upserted(spark, str(tmp_path / "out")).collect()} == want
    assert len(list((tmp_path / "out").glob("epoch=*"))) == 2
