"""Named queries over the driver tables, each with its DuckDB form where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions import urls
from pagemill.operators import chunk, html, render, retrieval, store
from pagemill.plans.registry import ORACLES, QUERIES, query
from pagemill.session import table

__all__ = ["ORACLES", "QUERIES"]

_TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
_LANG = "split_part(regexp_extract(html, '(?is)<html\\b[^>]*?\\blang\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1), '-', 1)"
_HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_NO_SCRIPTS = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?(?:</script\\s*>|$)', ' ', 'g'), '(?is)<style\\b.*?(?:</style\\s*>|$)', ' ', 'g')"
_MAIN = f"regexp_extract({_NO_SCRIPTS}, '(?is)<article\\b[^>]*>(.*?)(?:</article\\s*>|$)', 1)"
_STRIP = "regexp_replace(url, '[;?#].*$', '')"


def _plain(body: str) -> str:
    out = f"regexp_replace(regexp_replace({body}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return f"trim(regexp_replace({out}, '[\\s ]+', ' ', 'g'))"


_WORDS = "CAST(len(list_filter(string_split({}, ' '), lambda x: x <> '')) AS BIGINT)"


@query(
    f"""
    WITH p AS (SELECT page_id, {_HOST} AS host, {_LANG} AS language, {_TITLE} AS title, {_WORDS.format(_plain(_MAIN))} AS words,
            CAST(len(list_filter(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref\\s*=\\s*["'']([^"'']*)["'']', 1), lambda x: x LIKE '/%')) AS BIGINT) AS same_host_links
        FROM pages)
    SELECT * FROM p ORDER BY words DESC, page_id LIMIT 20
    """
)
def page_overview(spark: SparkSession, d: str) -> DataFrame:
    """The 20 pages with the longest main text: host, language, title, words, links to the same host."""
    page, host = F.col("html"), urls.authority(F.col("url"))
    same = F.filter(html.hrefs(page), lambda x: urls.authority(urls.join(x, F.col("url"))) == host)
    out = table(spark, d, "pages").select(
        "page_id", host.alias("host"), html.primary_language(page, html.metas(page)).alias("language"), html.title(page).alias("title"),
        tx.word_count(html.plain_text(html.main_html(page))).alias("words"), F.size(same).cast("long").alias("same_host_links"),
    )
    return out.orderBy(F.desc("words"), "page_id").limit(20)


@query(f"SELECT page_id, {_HOST} AS host, {_LANG} AS language, {_TITLE} AS title FROM pages")
def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    page = F.col("html")
    return table(spark, d, "pages").select("page_id", urls.authority(F.col("url")).alias("host"), html.primary_language(page, html.metas(page)).alias("language"), html.title(page).alias("title"))


_LINKS = f"""SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS root FROM pages"""


@query(f"SELECT DISTINCT page_id, root || regexp_replace(href, '[;?#].*$', '') AS link FROM ({_LINKS}) WHERE href <> ''")
def page_links_abs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct absolute links of each page."""
    return html.links(table(spark, d, "pages")).select("page_id", "link").distinct()


@query(f"SELECT page_id, count(*) AS n_links FROM ({_LINKS}) WHERE href <> '' AND NOT regexp_matches(href, 'login|admin') GROUP BY page_id")
def same_host_link_filter(spark: SparkSession, d: str) -> DataFrame:
    found = html.links(table(spark, d, "pages"))
    kept = found.where(urls.admitted(F.col("link"), urls.authority(F.col("url")), exclude=("login", "admin")))
    return kept.groupBy("page_id").agg(F.count("*").alias("n_links"))


@query(f"SELECT page_id, {_WORDS.format(_plain(_MAIN))} AS words FROM pages")
def main_text_wordcount(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.word_count(html.plain_text(html.main_html(F.col("html")))).alias("words"))


@query(f"SELECT page_id, md5({_plain(_NO_SCRIPTS)}) AS text_md5 FROM pages")
def html_clean_native(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(html.plain_text(F.col("html")).cast("binary")).alias("text_md5"))


@query(f"SELECT page_id, {_STRIP} AS normal FROM pages")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.join(F.col("url"), F.col("url")).alias("normal"))


@query(f"SELECT page_id, {_HOST} || '_' || left(md5(url), 8) AS collection_id FROM pages")
def collection_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.collection_id(F.col("url")).alias("collection_id"))


@query(
    """
    SELECT 'total' AS dimension, NULL AS value, count(*) AS n FROM documents
    UNION ALL SELECT 'language', coalesce(nullif(lang, ''), 'en'), count(*) FROM documents GROUP BY 2
    UNION ALL SELECT 'domain', coalesce(nullif(source, ''), 'unknown'), count(*) FROM documents GROUP BY 2
    """
)
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.collection_stats(table(spark, d, "documents"), language=tx.or_default("lang", "en"), domain=tx.or_default("source", "unknown"))


@query(
    """
    SELECT doc_id, CAST(i AS INTEGER) AS position, md5(substr(text, i * 1000 + 1, 1000)) AS content_md5
    FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 999) // 1000)) AS i FROM documents WHERE length(text) > 0)
    """
)
def chunk_fixed_1000(spark: SparkSession, d: str) -> DataFrame:
    return chunk.fixed(table(spark, d, "documents")).select("doc_id", "position", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(
    """
    WITH l AS (SELECT doc_id, unnest(range(0, (length(text) + 999) // 1000)) AS i, text FROM documents WHERE length(text) > 0)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS chunk_number, count(*) OVER (PARTITION BY doc_id) AS total_chunks, 'text' AS chunk_type,
        CAST(len(regexp_extract_all(substr(text, i * 1000 + 1, 1000), '[^\\x20\\x09-\\x0D\\x1C-\\x1F\\x{85}\\x{A0}]+')) AS BIGINT) AS word_count FROM l
    """
)
def chunk_flatten_record(spark: SparkSession, d: str) -> DataFrame:
    records = chunk.records(chunk.fixed(table(spark, d, "documents")))
    return records.select("doc_id", "chunk_number", "total_chunks", "chunk_type", "word_count")


@query(
    """
    SELECT doc_id, count(*) AS total_chunks, round(avg(n), 6) AS avg_chunk_size FROM (
        SELECT doc_id, CAST(len(regexp_extract_all(substr(text, i * 1000 + 1, 1000), '[^\\x20\\x09-\\x0D\\x1C-\\x1F\\x{85}\\x{A0}]+')) AS BIGINT) AS n
        FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 999) // 1000)) AS i FROM documents WHERE length(text) > 0)
    ) GROUP BY doc_id
    """
)
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    made = chunk.fixed(table(spark, d, "documents")).withColumn("word_count", tx.word_count("content"))
    return chunk.stats(made).withColumn("avg_chunk_size", F.round("avg_chunk_size", 6))


@query(
    """
    SELECT doc_id, CASE WHEN text LIKE '#%' THEN 'header' WHEN text LIKE '```%' THEN 'code' WHEN text LIKE '- %' OR text LIKE '* %' OR text LIKE '1. %' THEN 'list'
            WHEN contains(text, '|') AND contains(text, '-|-') THEN 'table' ELSE 'text' END AS chunk_type,
        CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview, contains(text, '`') AS has_code
    FROM documents
    """
)
def chunk_type_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.chunk_type("text").alias("chunk_type"), tx.preview("text").alias("preview"), tx.has_code("text").alias("has_code"))


@query(f"SELECT page_id, page_id % 2 = 0 AND page_id % 6 <> 0 AS cached FROM pages WHERE {_HOST} <> ''")
def cache_hit_miss(spark: SparkSession, d: str) -> DataFrame:
    """Pages as requests against a cache of every second page, a third of which has expired."""
    pages = table(spark, d, "pages").select("page_id", "url")
    requests = pages.withColumn("key", store.cache_key(F.concat_ws("#", "url", "page_id")))
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    written = F.when(F.col("page_id") % 6 == 0, F.lit("2023-12-01").cast("timestamp")).otherwise(F.lit("2024-01-01 12:00:00").cast("timestamp"))
    cache = requests.where("page_id % 2 = 0").select("key", F.col("url").alias("value"), written.alias("written_at"), F.lit(86400).cast("long").alias("ttl_seconds"))
    hits, misses = store.split_hits(requests, cache, now)
    return hits.select("page_id", "cached").unionByName(misses.select("page_id", F.lit(False).alias("cached")))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return store.upsert(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 100")
def recent_topk(spark: SparkSession, d: str) -> DataFrame:
    return store.recent(table(spark, d, "events"), "ts", 100, "event_id").select("event_id", "user_id")


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {_Q})"


@query(f"WITH t AS (SELECT vec_id, {_COS} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 10) SELECT vec_id, round(s, 6) AS score FROM t WHERE s >= 0.65 OR (SELECT max(s) FROM t) < 0.65")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    first = vectors.where("vec_id = 0").first()
    return retrieval.search(vectors, list(first.embedding) if first else [], k=10).withColumn("score", F.round("score", 6))


@query(
    f"""
    WITH t AS (SELECT label AS query_id, vec_id, 1 - {_COS} AS distance FROM embeddings),
    r AS (SELECT query_id, vec_id, coalesce(1 - distance / nullif(max(distance) OVER (PARTITION BY query_id), 0), 1) AS relevance FROM t)
    SELECT query_id, vec_id, round(relevance, 3) AS relevance FROM r WHERE relevance >= 0.8
    """
)
def vector_relevance_filter(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    first = vectors.where("vec_id = 0").first()
    q = F.array(*[F.lit(float(x)) for x in (first.embedding if first else [])])
    distances = vectors.select(F.col("label").alias("query_id"), "vec_id", (1 - retrieval.cosine(F.col("embedding"), q)).alias("distance"))
    return retrieval.relevant(distances).select("query_id", "vec_id", "relevance")


@query(
    """
    SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS context
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 5 GROUP BY conv_id
    """
)
def chat_last5_context(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.last_turns(table(spark, d, "conversations"))


@query("SELECT event_id, n AS in_window, n <= 3 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n FROM events)")
def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    return store.rate_limited(table(spark, d, "events"), "user_id", "ts", most=3).select("event_id", "in_window", "allowed")


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\\S\\n]+', ' ', 'g'), '(?m)^ | $', '', 'g'), chr(10) || ' ') AS cleaned FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.clean_text("text").alias("cleaned"))


@query(
    """
    WITH w AS (SELECT r_regionkey, n_name, greatest(3, max(length(n_name)) OVER (PARTITION BY r_regionkey), length('nation')) AS w FROM region JOIN nation ON n_regionkey = r_regionkey)
    SELECT r_regionkey, '| ' || rpad('nation', any_value(w)::INT, ' ') || ' |' || chr(10) || '| ' || repeat('-', any_value(w)::INT) || ' |' || chr(10)
        || string_agg('| ' || rpad(n_name, w::INT, ' ') || ' |', chr(10) ORDER BY n_name) AS markdown FROM w GROUP BY r_regionkey
    """
)
def doc_table_render(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.transform(F.array_sort(F.collect_list("n_name")), lambda x: F.array(x))
    grouped = both.groupBy("r_regionkey").agg(F.concat(F.array(F.array(F.lit("nation"))), rows).alias("rows"))
    return grouped.select("r_regionkey", render.markdown_table(F.col("rows")).alias("markdown"))
