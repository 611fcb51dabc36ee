"""Queries on stores, collections, search and chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions import errors, files
from pagemill.operators import chunk, retrieval, store
from pagemill.plans.registry import query
from pagemill.session import table
from pagemill.storage import shared_folder


@query(
    """
    WITH e AS (SELECT event_id AS k, value, event_type, 'scrape:' || sha256('http://h/' || event_id || '|{"includeRawHtml":false,"includeScreenshot":false,"mobile":' || (event_id % 2 = 0) || ',"onlyMainContent":true,"waitFor":0}') AS key FROM events)
    -- Written twice where k % 3 = 0; k % 4 = 1 failed; k % 5 = 0 was deleted; k % 7 = 0 has expired, but for those written again.
    SELECT k AS event_id, key, k % 4 <> 1 AND k % 5 <> 0 AND (k % 7 <> 0 OR k % 3 = 0) AS hit, CASE WHEN k % 4 <> 1 AND k % 5 <> 0 AND (k % 7 <> 0 OR k % 3 = 0) THEN event_type || CASE WHEN k % 3 = 0 THEN '2' ELSE '1' END END AS kind,
        CASE WHEN k % 4 <> 1 AND k % 5 <> 0 AND (k % 7 <> 0 OR k % 3 = 0) THEN value END AS value
    FROM e
    """
)
def cache_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """A cache that is written, written again, emptied in part, and read: keys with options, values as JSON, times to live."""
    k = F.col("event_id")
    pages = table(spark, d, "events").select("event_id", "event_type", "value", F.when(k % 2 == 0, store.cache_key(F.concat(F.lit("http://h/"), k.cast("string")), mobile=True)).otherwise(store.cache_key(F.concat(F.lit("http://h/"), k.cast("string")))).alias("key"))
    made = lambda n: store.encoded(F.struct(F.concat("event_type", F.lit(str(n))).alias("kind"), F.col("value").alias("value"), F.lit(None).cast("string").alias("nothing")))
    at = lambda x: F.lit(x).cast("timestamp")
    empty = spark.createDataFrame([], "key string, value string, written_at timestamp, ttl_seconds long")
    long_ago = pages.select("key", made(1).alias("value"), ((k % 7 == 0) & (k % 4 != 1)).alias("success"))
    cache = store.put(empty, long_ago, at("2024-01-01"))
    cache = store.put(cache, pages.select("key", made(1).alias("value"), ((k % 7 != 0) & (k % 4 != 1)).alias("success")), at("2024-01-02"))
    cache = store.put(cache, pages.where(k % 3 == 0).select("key", made(2).alias("value"), (k % 4 != 1).alias("success")), at("2024-01-02 01:00:00"))
    cache = store.invalidate(cache, pages.where(k % 5 == 0))
    hits, misses = store.split_hits(pages.select("event_id", "key"), cache, at("2024-01-02 12:00:00"))
    read = store.decoded(F.col("value"), "kind string, value double")
    found = hits.select("event_id", "key", F.lit(True).alias("hit"), read.alias("v")).select("event_id", "key", "hit", "v.kind", "v.value")
    return found.unionByName(misses.select("event_id", "key", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("value")))


@query(
    """
    SELECT doc_id, sha256(coalesce(text, '')) AS sha256, 'file:' || sha256(sha256(coalesce(text, '')) || '|pdf') AS key, strlen(coalesce(text, ''))::BIGINT AS size_bytes, '.md' AS extension, doc_id || '.x.MD' AS filename,
        ['png', 'jpeg', 'gif', NULL][(doc_id % 4 + 1)::INT] AS format, doc_id % 4 < 2 AS allowed, CASE WHEN doc_id % 4 < 3 THEN 'data:image/' || ['png', 'jpeg', 'gif'][(doc_id % 4 + 1)::INT] || ';base64,'
            || to_base64(from_hex(['89504E470D0A1A0A', 'FFD8FFE0', '474946383961', '25504446'][(doc_id % 4 + 1)::INT] || hex(encode(left(coalesce(text, ''), 20))))) END AS uri
    FROM documents
    """
)
def file_functions(spark: SparkSession, d: str) -> DataFrame:
    """Keys and metadata of files; images by their first bytes, as data URIs."""
    content, k = F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.col("doc_id")
    head = F.element_at(F.array(*[F.lit(x) for x in ("89504E470D0A1A0A", "FFD8FFE0", "474946383961", "25504446")]), (k % 4 + 1).cast("int"))
    image = F.unhex(F.concat(head, F.hex(F.left(F.coalesce("text", F.lit("")), F.lit(20)).cast("binary"))))
    meta = files.file_metadata(F.concat(F.lit("/a/b.c/"), k.cast("string"), F.lit(".x.MD")), content)
    return table(spark, d, "documents").select("doc_id", store.file_key(content, F.lit("pdf")).alias("key"), meta.alias("m"), files.image_format(image).alias("format"), files.is_image(image, ("PNG", "jpeg")).alias("allowed"), files.data_uri(image).alias("uri")).select("doc_id", "key", "m.*", "format", "allowed", "uri")


@query(
    """
    WITH c AS (SELECT doc_id, i, source, 'c_' || source AS collection_id FROM (SELECT doc_id, source, text, unnest(range(0, (length(text) + 999) // 1000)) AS i FROM documents WHERE length(text) > 0)), n AS (
        SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY doc_id, i) - 1 AS k FROM c
    )
    -- The collections of the even documents' sources were made again from the even documents alone; those of odd ones only stay.
    SELECT collection_id, collection_id || '_chunk_' || (row_number() OVER (PARTITION BY collection_id ORDER BY doc_id, i) - 1) AS id, doc_id, i::INTEGER AS position FROM c
    WHERE doc_id % 2 = 0 OR collection_id NOT IN (SELECT collection_id FROM c WHERE doc_id % 2 = 0)
    """
)
def collection_add(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents added to a collection a source, then collections made again from the even documents."""
    docs = table(spark, d, "documents")
    made = chunk.fixed(docs).join(docs.select("doc_id", F.concat(F.lit("c_"), "source").alias("collection_id")), "doc_id").withColumn("place", F.struct("doc_id", "position"))
    stored = store.add_to_collection(made, order="place")
    again = store.add_to_collection(made.where("doc_id % 2 = 0"), order="place")
    return store.replace_collections(stored, again).select("collection_id", "id", "doc_id", "position")


@query(
    """
    SELECT source AS collection_id, CASE WHEN source LIKE '%1' OR source LIKE '%2' THEN source ELSE 'http://' || source || '/' END AS name, count(*) AS n_chunks FROM documents WHERE source IS NOT NULL GROUP BY source
    """
)
def collections_sorted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source is not null").withColumnRenamed("source", "collection_id")
    url = F.when(F.col("collection_id").endswith("2"), "").otherwise(F.concat(F.lit("http://"), "collection_id", F.lit("/")))
    meta = docs.select("collection_id").distinct().where(~F.col("collection_id").endswith("1")).select("collection_id", url.alias("url"))
    return store.collections(docs, meta)


@query(
    """
    SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 THEN 'again ' || text ELSE text END AS text FROM conversations WHERE conv_id % 4 <> 1
    """
)
def chat_history(spark: SparkSession, d: str) -> DataFrame:
    """Histories saved as JSON, some of them saved again, and loaded by id; a history that was never saved has no rows."""
    import uuid

    chat = table(spark, d, "conversations")
    path = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    schema = "turn long, role string, text string, conv_id long"
    assert store.load_history(spark, path, schema).limit(1).count() == 0
    store.save_history(chat.where("conv_id % 4 <> 3"), path)
    store.save_history(chat.where("conv_id % 4 = 3"), path)
    store.save_history(chat.where("conv_id % 3 = 0").withColumn("text", F.concat(F.lit("again "), "text")), path)
    ids = chat.select("conv_id").distinct().where("conv_id % 4 <> 1").union(spark.range(1).select(F.lit(-5).cast("long")))
    return store.load_history(spark, path, schema, ids).select("conv_id", "turn", "role", "text")


@query(
    """
    SELECT event_type, count(*) AS requests, count(*) FILTER (value < 20) AS errors, round(sum(value), 4) AS seconds, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS tokens,
        round(max(epoch_us(ts)) / 1e6 - min(epoch_us(ts)) / 1e6, 3) AS elapsed
    FROM events GROUP BY event_type
    """
)
def job_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Requests, errors and durations by kind, sums of tokens, and the time from the first to the last."""
    events = table(spark, d, "events")
    metrics = store.job_metrics(events, F.col("value") >= 20, F.col("value"), "event_type")
    tokens = F.get_json_object("props", "$.k").cast("long")
    more = events.groupBy("event_type").agg(F.sum(tokens).alias("tokens"), F.round(store.elapsed(F.min("ts"), F.max("ts")), 3).alias("elapsed"))
    return metrics.join(more, "event_type").select("event_type", "requests", "errors", F.round("seconds", 4).alias("seconds"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "tokens", "elapsed")


@query(
    """
    SELECT event_id, ['URL_FETCH_ERROR', 'RATE_LIMIT_EXCEEDED', 'TIMEOUT_ERROR', 'FILE_SIZE_EXCEEDED', 'SCRAPER_ERROR', 'VALIDATION_ERROR'][(event_id % 6 + 1)::INT] AS code, [400, 429, 408, 413, 500, 422][(event_id % 6 + 1)::INT] AS status,
        ['Failed to fetch URL: http://h/' || event_id, 'Rate limit of ' || user_id || ' requests per 60 seconds exceeded', 'Operation timed out: ' || event_type, 'File size (' || event_id || 'MB) exceeds limit of 5MB', 'odd ' || event_type, 'Request validation failed'][(event_id % 6 + 1)::INT] AS message
    FROM events
    """
)
def error_values(spark: SparkSession, d: str) -> DataFrame:
    """Failures of several kinds as rows carry them."""
    k = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("url_fetch", "rate_limit", "timeout", "file_size", "unheard of", "validation")]), (k % 6 + 1).cast("int"))
    told = {"url": F.concat(F.lit("http://h/"), k.cast("string")), "limit": F.col("user_id"), "period": F.lit(60), "operation": F.col("event_type"), "size_mb": k, "limit_mb": F.lit(5), "message": F.concat(F.lit("odd "), "event_type")}
    # A size's limit and a rate's limit have names of their own.
    details = F.create_map(*[x for name, v in told.items() for x in (F.lit(name), v.cast("string"))])
    e = errors.error(kind, details)
    return table(spark, d, "events").select("event_id", e["code"].alias("code"), e["status"].alias("status"), e["message"].alias("message"))


_COSINE = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _mixed(a: str, b: str, share: str) -> Column:
    """A vector between two: so that queries have near, middling and far rows."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") * F.col(share) + y.cast("double") * (1 - F.col(share)))


@query(
    """
    WITH q AS (
        SELECT a.vec_id AS query_id, list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * s + b.embedding[i]::DOUBLE * (1 - s)) AS embedding
        FROM (SELECT *, (vec_id % 7) / 6 AS s FROM embeddings WHERE vec_id % 25 = 0) a JOIN embeddings b ON b.vec_id = a.vec_id + 1
    ), top AS (
        SELECT query_id, vec_id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rn FROM (SELECT query_id, vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding) AS s FROM q, embeddings v)
    ), best AS (
        SELECT *, max(score) OVER (PARTITION BY query_id) AS most FROM top WHERE rn <= 4
    )
    SELECT query_id, vec_id, round(score, 6) AS score, CASE WHEN most >= 0.7 THEN 'strict' ELSE 'exact' END AS tier FROM best WHERE most < 0.7 OR score >= 0.65
    """
)
def vector_search_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The best rows of many queries, by tiers."""
    rows = table(spark, d, "embeddings")
    one = rows.where("vec_id % 25 = 0").select("vec_id", F.col("embedding").alias("a"), ((F.col("vec_id") % 7) / 6).alias("s"))
    two = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    asked = one.join(two, "vec_id").select(F.col("vec_id").alias("query_id"), _mixed("a", "b", "s").alias("query_vector"))
    return retrieval.search_many(asked, rows, k=4).withColumn("score", F.round("score", 6))


_NEAR = """
    WITH q AS (SELECT vec_id AS query_id, label, embedding FROM embeddings WHERE vec_id % 10 = 3), near AS (
        SELECT query_id, vec_id, 1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance FROM q JOIN embeddings v USING (label)
    ), found AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rn FROM near
    ), scored AS (
        SELECT query_id, vec_id, rn, 1 - distance / max(distance) OVER (PARTITION BY query_id) AS relevance FROM found WHERE rn <= 5
    )
"""


def _collection_hits(spark: SparkSession, d: str, floor: float) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumnRenamed("label", "collection_id")
    asked = rows.where("vec_id % 10 = 3").select(F.col("vec_id").alias("query_id"), "collection_id", F.col("embedding").alias("query_vector"))
    return retrieval.in_collection(asked, rows, n=5, floor=floor)


@query(_NEAR + "SELECT query_id, vec_id, round(relevance, 3) AS relevance FROM scored WHERE relevance >= 0.05")
def collection_query(spark: SparkSession, d: str) -> DataFrame:
    """The nearest rows of each query's own collection that are relevant enough."""
    return _collection_hits(spark, d, 0.05).drop("rank")


@query(
    _NEAR
    + """, passages AS (
        SELECT s.query_id, s.rn, CASE WHEN s.vec_id % 2 = 0 THEN 'From http://v/' || s.vec_id || ' (' || CASE WHEN s.vec_id % 4 = 0 THEN 'T' || s.vec_id ELSE '' END || '):' || chr(10) || 'passage ' || s.vec_id ELSE '[' || s.rn || '] passage ' || s.vec_id END AS t
        FROM scored s WHERE relevance >= 0.05
    ), contexts AS (
        SELECT query_id, string_agg(t, chr(10) || chr(10) ORDER BY rn) AS context FROM passages GROUP BY query_id
    ), tails AS (
        SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 5 GROUP BY conv_id
    )
    SELECT q.query_id, context, 'system: Answer from this.' || chr(10) || chr(10) || coalesce(context, '') || chr(10) || CASE WHEN history IS NULL THEN '' ELSE history || chr(10) END || 'user: question ' || q.query_id AS prompt
    FROM q LEFT JOIN contexts USING (query_id) LEFT JOIN tails ON conv_id = q.query_id % 40 WHERE q.query_id % 3 <> 0
    """
)
def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain from a question to what a model is asked: hits, context with its sources, last turns; blank questions have none."""
    v = F.col("vec_id")
    passages = _collection_hits(spark, d, 0.05).select("query_id", "rank", F.concat(F.lit("passage "), v.cast("string")).alias("text"), F.when(v % 2 == 0, F.concat(F.lit("http://v/"), v.cast("string"))).alias("url"), F.when(v % 4 == 0, F.concat(F.lit("T"), v.cast("string"))).alias("title"))
    q = table(spark, d, "embeddings").where("vec_id % 10 = 3").select(v.alias("query_id"), (v % 40).alias("conv_id"), F.when(v % 3 != 0, F.concat(F.lit("question "), v.cast("string"))).otherwise(" ").alias("question"))
    asked = retrieval.answer_prompt(q, passages, table(spark, d, "conversations"), "Answer from this.")
    return asked.select("query_id", "context", retrieval.flat_prompt(F.col("messages")).alias("prompt"))


@query("SELECT * FROM (VALUES ('max_depth', '4'), ('max_file_mb', '2.5'), ('only_main_content', 'False'), ('rate_limit', '50'), ('search_limit', '9')) AS t(name, value)")
def settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings from defaults, a file and the environment."""
    found = config.load('{"max_depth": 7, "max_file_mb": "2.5", "search_limit": 9, "unheard_of": 1}', {"PAGEMILL_MAX_DEPTH": "4", "PAGEMILL_ONLY_MAIN_CONTENT": "no", "HOME": "/x"})
    names = ("max_depth", "max_file_mb", "only_main_content", "rate_limit", "search_limit")
    return spark.createDataFrame([(n, str(getattr(found, n))) for n in names], "name string, value string")
