"""Structured Streaming: pages in, chunk records out; upserts and windows on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators import chunk, retrieval, store


def read_files(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def publish(docs: DataFrame, out: str, checkpoint: str, kind: str = "fixed", key: str = "doc_id", **how) -> StreamingQuery:
    """Chunk records of a stream of documents, appended batch by batch. A batch that is run again overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        made = chunk.records(chunk.chunk(batch, kind, **how), key)
        made.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def messages(records: DataFrame) -> DataFrame:
    """(key, value) of chunk records: their id, and the twelve fields as JSON, absent ones included as null."""
    fields = ("chunk_id", "url", "chunk_number", "total_chunks", "chunk_content", "chunk_type", "timestamp", "word_count", "position", "content_type", "heading", "code_language")
    return records.select(F.col("chunk_id").alias("key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def to_kafka(records: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Chunk records as messages; needs Spark's Kafka package on the class path."""
    rows = messages(records)
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def windowed(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour", *keys: str) -> DataFrame:
    """Counts by event-time window, late rows within the watermark included."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def fresh(requests: DataFrame, key: str = "key", ts: str = "ts", ttl: str = "1 day") -> DataFrame:
    """The first request of each key within the time to live."""
    return requests.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def _epochs(spark: SparkSession, path: str) -> dict[int, object]:
    """The epochs whose tables are whole, with their folders."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return {int(x.getPath().getParent().getName().removeprefix("epoch=")): x.getPath().getParent() for x in found}


def upsert_into(stream: DataFrame, path: str, checkpoint: str, key: str, version: str, *ties: str) -> StreamingQuery:
    """Keeps one row a key, the newest version, of a stream, as a table under path; read_upserted() reads it.

    Each batch writes a table of its own from the one before it; a table counts once its success mark stands. A batch that is
    run again starts from the same table and writes its own anew. The last two tables are kept.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = {k: v for k, v in _epochs(spark, path).items() if k < epoch}
        both = batch
        if before:
            both = spark.read.schema(batch.schema).parquet(before[max(before)].toString()).unionByName(batch)
        store.upsert(both, batch.limit(0), key, version, *ties).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        for k in sorted(before)[:-1]:
            before[k].getFileSystem(spark._jsc.hadoopConfiguration()).delete(before[k], True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    found = _epochs(spark, path)
    return spark.read.parquet(found[max(found)].toString())


def embed_and_store(docs: DataFrame, out: str, checkpoint: str, embed=retrieval.hashed_embedding, kind: str = "fixed", key: str = "doc_id", **how) -> StreamingQuery:
    """Chunk records of a stream of documents with the vector of each, appended batch by batch, as publish() does."""

    def write(batch: DataFrame, epoch: int) -> None:
        made = chunk.records(chunk.chunk(batch, kind, **how), key)
        made.withColumn("embedding", embed(F.col("chunk_content"))).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
