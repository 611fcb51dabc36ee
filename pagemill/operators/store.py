"""Keyed tables: the result cache, upserts, collection statistics and recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The options that tell cached results apart, sorted, with their defaults.
CACHE_OPTIONS = {"includeRawHtml": False, "includeScreenshot": False, "mobile": False, "onlyMainContent": True, "waitFor": 0}


def cache_key(url: Column, **options) -> Column:
    """scrape: and the sha256 of the address and the options as JSON with sorted keys."""
    values = CACHE_OPTIONS | options
    told = ",".join(f'"{k}":{str(v).lower()}' for k, v in sorted(values.items()))
    return F.concat(F.lit("scrape:"), F.sha2(F.concat_ws("|", url, F.lit("{" + told + "}")), 256))


def file_key(content: Column, kind: Column) -> Column:
    return F.concat(F.lit("file:"), F.sha2(F.concat_ws("|", F.sha2(content, 256), kind), 256))


def split_hits(requests: DataFrame, cache: DataFrame, now: Column, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits with value and cached = true, misses): a hit is a key written less than its time to live before now."""
    live = cache.where(now < F.col("written_at") + F.make_dt_interval(secs=F.col("ttl_seconds")))
    newest = live.groupBy(key).agg(F.max_by("value", "written_at").alias("value"))
    hits = requests.join(newest, key).withColumn("cached", F.lit(True))
    return hits, requests.join(newest.select(key), key, "left_anti")


def put(cache: DataFrame, rows: DataFrame, now: Column, ttl_seconds: int = 86400) -> DataFrame:
    """cache with the successful rows (key, value, success) written now; newer entries win when read."""
    new = rows.where("success").select("key", "value", now.alias("written_at"), F.lit(ttl_seconds).cast("long").alias("ttl_seconds"))
    return cache.unionByName(new)


def invalidate(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("key"), "key", "left_anti")


def encoded(value: Column) -> Column:
    """A cache value as JSON, fields that are null included."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def decoded(value: Column, schema: str) -> Column:
    """A cache value from JSON; null for what doesn't parse."""
    return F.from_json(value, schema, {"mode": "PERMISSIVE"})


def upsert(old: DataFrame, new: DataFrame, key: str, version: str, *ties: str) -> DataFrame:
    """One row a key, the newest version: an aggregation, so that rows of a hot key are combined before they are moved."""
    both = old.unionByName(new)
    newest = F.max_by(F.struct(*both.columns), F.struct(version, *ties)).alias("_row")
    return both.groupBy(F.col(key).alias("_key")).agg(newest).select("_row.*")


def add_to_collection(chunks: DataFrame, collection: str = "collection_id", order: str = "position") -> DataFrame:
    """chunks with ids of their own, the collection's name and their rank in it from 0."""
    rank = F.row_number().over(Window.partitionBy(collection).orderBy(order)) - 1
    return chunks.withColumn("id", F.concat_ws("_chunk_", F.col(collection), rank.cast("string")))


def replace_collections(stored: DataFrame, new: DataFrame, collection: str = "collection_id") -> DataFrame:
    """stored with the collections of `new` as they are there: each is deleted and made again."""
    return stored.join(new.select(collection).distinct(), collection, "left_anti").unionByName(new)


def collections(chunks: DataFrame, meta: DataFrame, collection: str = "collection_id") -> DataFrame:
    """(collection, name, n_chunks) sorted by name: the address if it is known, else the id; ones without a chunk are left out."""
    counted = chunks.groupBy(collection).agg(F.count("*").alias("n_chunks"))
    named = counted.join(meta.select(collection, "url"), collection, "left")
    return named.select(collection, F.coalesce(F.nullif("url", F.lit("")), collection).alias("name"), "n_chunks").orderBy("name", collection)


def save_history(chat: DataFrame, path: str, conv: str = "conv_id") -> None:
    """Chat histories as JSON, a folder a conversation; conversations that are there are overwritten, others stay."""
    spark = chat.sparkSession
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        chat.repartition(F.col(conv)).write.partitionBy(conv).mode("overwrite").json(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def load_history(spark: SparkSession, path: str, schema: str, ids: DataFrame | None = None, conv: str = "conv_id") -> DataFrame:
    """Chat histories by id, all without ids; ones that aren't there, and a folder that isn't, give no rows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).json(path)
    return found if ids is None else found.join(ids.select(conv).distinct(), conv, "left_semi")


def job_metrics(rows: DataFrame, ok: Column, seconds: Column, *keys: str) -> DataFrame:
    """requests, errors, and the sum and quantiles of the seconds that they took, by keys."""
    quantiles = F.percentile(seconds, [0.5, 0.95])
    return rows.groupBy(*keys).agg(F.count("*").alias("requests"), F.count_if(~ok).alias("errors"), F.sum(seconds).alias("seconds"), quantiles[0].alias("p50"), quantiles[1].alias("p95"))


def elapsed(began: Column, ended: Column) -> Column:
    """Seconds between two timestamps."""
    return (F.unix_micros(ended.cast("timestamp")) - F.unix_micros(began.cast("timestamp"))) / 1e6


def recent(rows: DataFrame, by: str, n: int = 100, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(by), *ties).limit(n)


def collection_stats(rows: DataFrame, **dims: Column) -> DataFrame:
    """(dimension, value, n): the total, and counts by each dimension, in one aggregation over grouping sets."""
    named = rows.select(*[c.alias(k) for k, c in dims.items()])
    names = list(dims)
    sets = [[F.col(k)] for k in names] + [[]]
    out = named.groupingSets(sets, *names).agg(F.count("*").alias("n"), *[F.grouping(k).alias(f"_g_{k}") for k in names])
    which, value = F.lit("total"), F.lit(None).cast("string")
    for k in names:
        which, value = F.when(F.col(f"_g_{k}") == 0, k).otherwise(which), F.when(F.col(f"_g_{k}") == 0, F.col(k)).otherwise(value)
    return out.select(which.alias("dimension"), value.alias("value"), "n")


def rate_limited(rows: DataFrame, client: str, ts: str, most: int = 50, seconds: int = 3600) -> DataFrame:
    """rows with the number of the client's rows in the window that ends here, and whether that is allowed."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    window = Window.partitionBy(client).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    n = F.count("*").over(window)
    return rows.withColumn("in_window", n).withColumn("allowed", n <= most)
