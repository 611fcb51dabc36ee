"""Queries on texts and their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import chunk
from pagemill.plans.registry import query
from pagemill.session import table
from pagemill.streaming.chunks import messages

_BLANK = r"\x20\x09-\x0D"
_WORDS = "CAST(len(regexp_extract_all({}, '[^\\x20\\x09-\\x0D\\x1C-\\x1F\\x{{85}}\\x{{A0}}]+')) AS BIGINT)"


def _as_markdown(docs: DataFrame) -> DataFrame:
    """Documents as Markdown: of ten lines one is a header of level 1 to 4, and two are fences, with a header mark inside."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 10 == 3, F.concat(F.repeat(F.lit("#"), (i % 4 + 1).cast("int")), F.lit(" Part "), i.cast("string")))
        .when(i % 10 == 6, F.concat(F.lit("```py"), i.cast("string"), F.lit("\n# not a header")))
        .when(i % 10 == 8, F.concat(x, F.lit("\n```")))
        .otherwise(x),
    )
    return docs.select("doc_id", F.array_join(lines, "\n").alias("markdown"))


@query(
    f"""
    WITH raw AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents
    ), lines AS (
        -- Each line with what it is: a header, code (fences included) or text, and the group that it belongs to.
        SELECT doc_id, i, 2 * i AS o, CASE WHEN i % 10 = 3 THEN repeat('#', (i % 4 + 1)::INT) || ' Part ' || i WHEN i % 10 = 6 THEN '```py' || i ELSE x END AS line, i % 10 = 3 AS header, i % 10 IN (6, 7, 8) AS code, i % 10 IN (3, 6, 9) AS starts FROM raw
        UNION ALL SELECT doc_id, i, 2 * i + 1, '# not a header', false, true, false FROM raw WHERE i % 10 = 6
        UNION ALL SELECT doc_id, i, 2 * i + 1, '```', false, true, false FROM raw WHERE i % 10 = 8
    ), grouped AS (
        SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY o) AS g,
            {", ".join(f"max(CASE WHEN header AND i % 4 + 1 = {k} THEN i END) OVER (PARTITION BY doc_id ORDER BY o) AS h{k}" for k in (1, 2, 3, 4))} FROM lines
    ), parts AS (
        SELECT doc_id, g, regexp_replace(string_agg(regexp_replace(line, '[ \\t]+$', ''), chr(10) ORDER BY o) FILTER (NOT header), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS content, bool_or(code) AS code, min(i) FILTER (code) AS fence,
            max(h1) AS h1, max(h2) AS h2, max(h3) AS h3, max(h4) AS h4 FROM grouped GROUP BY doc_id, g
    ), live AS (
        SELECT *, list_filter([CASE WHEN h1 IS NOT NULL THEN 'Part ' || h1 END, CASE WHEN h2 > coalesce(h1, -1) THEN 'Part ' || h2 END, CASE WHEN h3 > greatest(coalesce(h1, -1), coalesce(h2, -1)) THEN 'Part ' || h3 END,
            CASE WHEN h4 > greatest(coalesce(h1, -1), coalesce(h2, -1), coalesce(h3, -1)) THEN 'Part ' || h4 END], lambda x: x IS NOT NULL) AS path FROM parts WHERE content <> ''
    )
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INTEGER) AS position, md5(content) AS content_md5, CASE WHEN code THEN 'code' WHEN content LIKE '#%' THEN 'header' WHEN content LIKE '```%' THEN 'code'
            WHEN content LIKE '- %' OR content LIKE '* %' OR content LIKE '1. %' THEN 'list' WHEN contains(content, '|') AND contains(content, '-|-') THEN 'table' ELSE 'text' END AS type,
        CASE WHEN code THEN 'py' || fence END AS code_language, path[-1] AS heading, CAST(len(path) AS INTEGER) AS level, array_to_string(path, '/') AS path, {_WORDS.format("content")} AS word_count,
        CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS INTEGER) AS line_count, CAST(greatest(1, {_WORDS.format("content")} // 200) AS BIGINT) AS estimated_read_time,
        CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END AS content_preview, contains(content, '`') AS has_code, contains(content, '[') AND contains(content, '](') AS has_links,
        NOT code AND len(path) > 0 AND {_WORDS.format("content")} < 64 AS needs_merge, NOT code AND len(path) > 0 AND {_WORDS.format("content")} > 512 AS needs_split
    FROM live
    """
)
def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown with nested headers and fences, chunked: text before the first header, header stacks, code with
    header marks inside, measures, previews and size flags (the strict ones)."""
    made = chunk.markdown(_as_markdown(table(spark, d, "documents")), strict_size=True)
    return made.select(
        "doc_id", "position", F.md5(F.col("content").cast("binary")).alias("content_md5"), "type", "code_language", "heading", "level", F.array_join("path", "/").alias("path"), "word_count", "line_count",
        "estimated_read_time", "content_preview", "has_code", "has_links", "needs_merge", "needs_split",
    )


@query(
    f"""
    WITH RECURSIVE cutup AS (
        SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[\\s\\x0B]+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS pieces FROM documents WHERE text IS NOT NULL
    ), merge(doc_id, pieces, i, held, done) AS (
        SELECT doc_id, pieces, 0, '', NULL::VARCHAR FROM cutup
        UNION ALL
        SELECT doc_id, pieces, i + 1, CASE WHEN length(held || pieces[i + 1]) < 12 THEN held || pieces[i + 1] || ' ' ELSE '' END, CASE WHEN length(held || pieces[i + 1]) >= 12 THEN held || pieces[i + 1] END FROM merge WHERE i < len(pieces)
    ), sentences AS (
        SELECT doc_id, list(s ORDER BY i) AS s FROM (
            SELECT doc_id, i, done AS s FROM merge WHERE done IS NOT NULL UNION ALL SELECT doc_id, i + 1, trim(held, ' ') FROM merge WHERE i = len(pieces) AND trim(held, ' ') <> '') GROUP BY doc_id
    ), counted AS (
        SELECT doc_id, s, list_transform(s, lambda x: {_WORDS.format("x")}) AS w FROM sentences
    ), pack(doc_id, s, w, lo, hi, closed, closed_first, closed_last) AS (
        -- The chunk that is being filled runs from lo to hi; a closed one is told as it closes.
        SELECT doc_id, s, w, 1, 0, false, NULL::INT, NULL::INT FROM counted
        UNION ALL
        SELECT doc_id, s, w, CASE WHEN spilt THEN hi + 1 - keep ELSE lo END, hi + 1, spilt, CASE WHEN spilt THEN lo END, CASE WHEN spilt THEN hi END
        FROM (
            SELECT *, hi >= lo AND list_sum(w[lo:hi]) + w[hi + 1] > 512 AS spilt,
                CASE WHEN hi >= lo THEN coalesce(list_max(list_filter(range(1, hi - lo + 1), lambda k: list_sum(w[hi + 1 - k:hi]) <= 50)), 0) END AS keep
            FROM pack WHERE hi < len(w)
        )
    ), spans AS (
        SELECT doc_id, s, closed_first AS a, closed_last AS b FROM pack WHERE closed UNION ALL SELECT doc_id, s, lo, hi FROM pack WHERE hi = len(w) AND hi >= lo
    )
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS INTEGER) AS position, md5(array_to_string(s[a:b], ' ')) AS content_md5, 'text' AS type, {_WORDS.format("array_to_string(s[a:b], ' ')")} AS word_count, CAST(b - a + 1 AS INTEGER) AS sentence_count
    FROM spans
    """
)
def chunk_sentence(spark: SparkSession, d: str) -> DataFrame:
    """Documents by sentences: short ones joined, 512 words a chunk, up to 50 of the chunk before."""
    made = chunk.sentences(table(spark, d, "documents"))
    return made.select("doc_id", "position", F.md5(F.col("content").cast("binary")).alias("content_md5"), "type", "word_count", "sentence_count")


@query(
    """
    WITH RECURSIVE l AS (
        SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS parts FROM documents
    ), pack(doc_id, parts, i, n, c) AS (
        SELECT doc_id, parts, 1, length(parts[1]), 0 FROM l WHERE len(parts) > 0
        UNION ALL
        SELECT doc_id, parts, i + 1, CASE WHEN n + length(parts[i + 1]) > 2000 THEN length(parts[i + 1]) ELSE n + length(parts[i + 1]) END,
            CASE WHEN n + length(parts[i + 1]) > 2000 THEN c + 1 ELSE c END
        FROM pack WHERE i < len(parts)
    )
    SELECT doc_id, CAST(c AS INTEGER) AS position, md5(string_agg(parts[i], chr(10) ORDER BY i)) AS content_md5 FROM pack GROUP BY doc_id, c
    """
)
def chunk_paragraph_pack(spark: SparkSession, d: str) -> DataFrame:
    packed = chunk.paragraphs(table(spark, d, "documents"), limit=2000, separator="\n")
    return packed.select("doc_id", "position", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(
    f"""
    WITH l AS (SELECT doc_id, lang, i, substr(text, i * 1000 + 1, 1000) AS content FROM (SELECT doc_id, lang, text, unnest(range(0, (length(text) + 999) // 1000)) AS i FROM documents WHERE length(text) > 0)), r AS (
        SELECT doc_id, i, content, sha256(doc_id || '|' || i || '|' || content) AS id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id) AS n, 'doc:' || lang || '/' || doc_id AS url FROM l
    )
    SELECT id AS key, md5(concat('{{"chunk_id":"', id, '","url":"', url, '","chunk_number":', k, ',"total_chunks":', n, ',"chunk_content":', to_json(content), ',"chunk_type":"text","timestamp":"2024-01-02","word_count":', {_WORDS.format("content")},
        ',"position":', i, ',"content_type":"text","heading":null,"code_language":null}}')) AS value_md5 FROM r
    """
)
def chunk_messages(spark: SparkSession, d: str) -> DataFrame:
    """Chunk records as they are sent: key, and the twelve fields as JSON."""
    docs = table(spark, d, "documents")
    made = chunk.fixed(docs).join(docs.select("doc_id", "lang"), "doc_id")
    sent = messages(chunk.records(made, url=F.concat(F.lit("doc:"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")), processed_at=F.lit("2024-01-02")))
    return sent.select("key", F.md5(F.col("value").cast("binary")).alias("value_md5"))


_TAGGED = "concat('<', t, '>', 'a' || chr(10) || 'b', '</', t, '>', text, chr(10) || '  ' || chr(10) || chr(10), 'end', '[', b, ']x[/', b, '] ')"


@query(
    f"""
    WITH said AS (SELECT *, ['think', 'antThinking', 'reasoning', 'thought', 'thinking', 'internal', 'analysis'][(turn % 7 + 1)::INT] AS t, ['thinking', 'thought', 'reasoning'][(turn % 3 + 1)::INT] AS b FROM conversations)
    SELECT conv_id, turn, regexp_replace(regexp_replace(concat(CASE WHEN t = 'analysis' THEN '<analysis>a' || chr(10) || 'b</analysis>' ELSE '' END, text, chr(10) || '  ' || chr(10) || chr(10), 'end', CASE WHEN b = 'reasoning' THEN '[reasoning]x[/reasoning]' ELSE '' END),
        '\\n\\s*\\n', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS answer
    FROM said WHERE text IS NOT NULL UNION ALL SELECT conv_id, turn, NULL FROM said WHERE text IS NULL
    """
)
def response_clean(spark: SparkSession, d: str) -> DataFrame:
    """Answers without their reasoning, whatever its tags; sections that aren't such stay; empty lines are squeezed."""
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("turn") % len(names) + 1).cast("int"))
    t, b = pick(["think", "antThinking", "reasoning", "thought", "thinking", "internal", "analysis"]), pick(["thinking", "thought", "reasoning"])
    said = F.concat(F.lit("<"), t, F.lit(">a\nb</"), t, F.lit(">"), F.col("text"), F.lit("\n  \n\nend["), b, F.lit("]x[/"), b, F.lit("] "))
    return table(spark, d, "conversations").select("conv_id", "turn", tx.clean_response(said).alias("answer"))


@query(
    f"""
    WITH t AS (SELECT doc_id, text, doc_id % 5 AS m FROM documents)
    SELECT doc_id, {_WORDS.format("text")} AS word_count, CAST(greatest(1, {_WORDS.format("text")} // 200) AS BIGINT) AS read_time, left(text, 4000) AS truncated, replace(text, chr(10), '<br>') AS br,
        regexp_matches(text, '(?m)^[\\s\\x0B]*[-*][\\s\\x0B]') AS has_lists, ['pdf', 'docx', 'xlsx', 'pptx', NULL][m + 1] AS file_type, CASE WHEN m = 4 THEN 'document' ELSE 'a-b ' || doc_id || '.(x)_' END AS file_name,
        'p' || doc_id || '.png' AS image_name, CASE m WHEN 0 THEN '2024-01-02T03:04:05' WHEN 1 THEN '2024-01-02T03:04:05' WHEN 2 THEN 'D:2024' WHEN 3 THEN 'yesterday' END AS pdf_date,
        CASE m WHEN 0 THEN '' WHEN 1 THEN doc_id::VARCHAR WHEN 2 THEN doc_id || '.50' WHEN 3 THEN '-' || doc_id ELSE 'x.0' END AS cell, CAST(least(greatest(3, doc_id), 50) AS BIGINT) AS width,
        ['Windows', 'Mac', 'Linux', 'iOS', 'Windows'][m + 1] AS platform, ['Linux', 'Android'][doc_id % 2 + 1] AS mobile
    FROM t
    """
)
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions of one value: counts, cuts, names, dates, cells, platforms."""
    k, m = F.col("doc_id"), F.col("doc_id") % 5
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) if not isinstance(v, Column) else v for v in x]), (m + 1).cast("int"))
    words = tx.word_count("text")
    key = k.cast("string")
    return table(spark, d, "documents").select(
        "doc_id", words.alias("word_count"), tx.read_time(words).alias("read_time"), tx.truncate("text").alias("truncated"), tx.newline_to_br("text").alias("br"), tx.has_lists("text").alias("has_lists"),
        tx.file_type(pick("a/b.PDF", "x.y.docx", "/t/z.Xlsx", "p.pptx", "q.txt")).alias("file_type"), tx.safe_filename(F.when(m == 4, "??/ ").otherwise(F.concat(F.lit("a-b? "), key, F.lit("./(x)_é")))).alias("file_name"),
        _image(key).alias("image_name"), tx.pdf_date(F.when(m == 0, "D:20240102030405+01'00'").when(m == 1, "20240102030405").when(m == 2, "D:2024").when(m == 3, "yesterday")).alias("pdf_date"),
        tx.cell_text(F.when(m == 1, F.concat(key, F.lit(".0"))).when(m == 2, F.concat(key, F.lit(".50"))).when(m == 3, F.concat(F.lit("-"), key, F.lit(".000"))).when(m == 4, "x.0")).alias("cell"),
        tx.column_width(k).cast("long").alias("width"), tx.platform_of_agent(pick("Mozilla/5.0 (Windows NT 10.0)", "Mozilla/5.0 (MACINTOSH; Intel)", "X11; Linux x86_64", "iPad; CPU OS 17_0", "curl/8")).alias("platform"),
        tx.platform_of_agent(F.when(k % 2 == 0, "Linux; Android 14").otherwise("Android 14")).alias("mobile"),
    )


def _image(key: Column) -> Column:
    from pagemill.functions import urls

    return urls.image_name(F.concat(F.lit("/a/b/p"), key, F.lit(".png?x=1")))


@query(
    """
    SELECT doc_id, '# Title' || chr(10) || '- item one' || chr(10) || '---' || chr(10) || chr(10) || 'x y' || doc_id AS markdown, 'a b' || chr(10) || chr(10) || 'c' || doc_id AS cleaned, 'a' || chr(10) || '  b' || doc_id AS trimmed
    FROM documents
    """
)
def text_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Blanks, control characters, header and item marks, runs of empty lines, blanks at the ends of lines."""
    key = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select(
        "doc_id", tx.clean_markdown(F.concat(F.lit("#Title\n-item   one\n---\n\n\n\nx \t y"), key, F.lit(" \n"))).alias("markdown"),
        tx.clean_text(F.concat(F.lit("a\x00\x07  b \n\n\n\n c"), key, F.lit("\x1b"))).alias("cleaned"), tx.trim_lines(F.concat(F.lit("\na  \t\n  b"), key, F.lit("  \n\n"))).alias("trimmed"),
    )
