"""DuckDB forms of the queries that SQL can express: plain windows, joins and recursion over whole tables, none of the methods."""

from __future__ import annotations

from pagemill.llm import mixing, quality_rules
from pagemill.llm.common import WORD


def _crc_table() -> str:
    """The 256 entries of the reflected CRC-32 table, 8 hex digits each."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(f"{c:08x}")
    return "".join(out)


def crc32(text: str) -> str:
    """CRC-32 of a text's bytes, byte by byte."""
    entry = f"('0x' || substr('{_crc_table()}', (xor(c, b) & 255) * 8 + 1, 8))::BIGINT"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, {entry}), 4294967295::BIGINT), 4294967295)"


STRATUM = "CASE WHEN source IS NULL THEN '1' ELSE '0' || source END"
SIZE = f"coalesce(len(regexp_extract_all(text, '{WORD}')), 0)"

SHARDING = f"""
    WITH keyed AS (
        SELECT doc_id, {STRATUM} AS stratum, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size, {crc32("coalesce(text, '')")} AS text_crc32,
            ('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, text_crc32, size) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM keyed
    ), placed AS (
        SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2 * n), stratum, r) - 1 AS position, count(*) OVER () AS total FROM ranked
    )
    SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(position * 40 // total AS INTEGER) AS shard, CAST(position - (position * 40 // total * total + 39) // 40 AS BIGINT) AS slot,
        CAST(NULL AS INTEGER) AS grown_shard, stratum, CAST(position AS BIGINT) AS position
    FROM placed
"""

MIXING = f"""
    WITH rows AS (
        SELECT doc_id, {STRATUM} AS stratum, CAST({SIZE} AS BIGINT) AS size,
            greatest({mixing.LEAST_WEIGHT}, coalesce(length(regexp_replace(text, '[0-9#*$%&|<>!@^_~={{}}\\[\\]\\\\/+]', '', 'g')) / greatest(length(text), 1), 0)) AS weight,
            (('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
        FROM documents
    ), sizes AS (
        SELECT stratum, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY stratum) - 1) % 3 + 1.0::DOUBLE AS w, 3.0::DOUBLE * sum(size) AS cap FROM rows GROUP BY stratum
    ), levels AS (
        -- The water stands at this level if exactly the sources before this one, in order of cap per weight, are full.
        SELECT *, ((SELECT sum(source_size) FROM sizes) - coalesce(sum(cap) OVER (ORDER BY cap / w, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, stratum ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM sizes
    ), targets AS (
        SELECT stratum, source_size, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM levels WHERE level <= cap / w), 0) * w) AS target FROM levels
    ), ordered AS (
        SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
            coalesce(sum(size) OVER (PARTITION BY stratum ORDER BY -ln(u) / weight, coalesce(doc_id::VARCHAR, ''), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached
        FROM rows JOIN targets USING (stratum)
    ), taken AS (
        SELECT *, epochs + CASE WHEN reached + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END AS times FROM ordered
    )
    SELECT doc_id, size, source_size, target, CAST(times * size AS BIGINT) AS taken, CAST(times AS BIGINT) AS times FROM taken
"""

_WORDS_OF = f"len(regexp_extract_all(line, '{WORD}'))"
_COUNT = "len(regexp_extract_all(line, '{}'))"
_ENDING, _MARKS = quality_rules.ENDING, quality_rules.MARKS.replace("'", "''")
_FAILS = f"""(
    {_COUNT.format("[#*$%&|<>]")} * 2 > w OR ({_COUNT.format("[!?]")} * 2 > w AND w >= 3)
    OR (w BETWEEN {_ENDING[0]} AND {_ENDING[1]} AND NOT regexp_matches(right(rtrim(line), {quality_rules.LAST}), '{_MARKS}'))
    OR (w >= 3 AND NOT regexp_matches(line, '\\p{{Ll}}') AND regexp_matches(line, '\\p{{Lu}}{{2}}'))
    OR ({_COUNT.format("[|»›·•]")} >= 2 AND {_COUNT.format("[|»›·•]")} * 4 >= w))"""

QUALITY_RULES = f"""
    WITH lines AS (
        SELECT doc_id, i, line, lower(trim(line)) AS key, {_WORDS_OF} AS w
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
        WHERE regexp_matches(line, '{WORD}')
    ), company AS (
        SELECT key, w, length(line) < {40 * quality_rules.SHORT} AS short, lag(key) OVER d AS b, lead(key) OVER d AS a FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    ), boilerplate AS (
        SELECT key FROM company WHERE w <= {quality_rules.SHORT} AND short GROUP BY key
        HAVING least(count(DISTINCT coalesce(b, a, '')), count(DISTINCT coalesce(a, b, ''))) >= greatest({quality_rules.NEIGHBOURS}, {quality_rules.CHANGING} * count(*))
    ), judged AS (
        SELECT doc_id, line, w, {_FAILS} OR (w <= {quality_rules.SHORT} AND key IN (SELECT key FROM boilerplate)) AS fails FROM lines
    ), clean AS (
        SELECT doc_id, CAST(sum(w) FILTER (NOT fails) AS BIGINT) AS clean_words, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines FROM judged GROUP BY doc_id
    ), words AS (
        SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS words FROM documents)
    ), windows AS (
        SELECT doc_id, i, word, lead(word, 1) OVER d AS w1, lead(word, 2) OVER d AS w2, lead(word, 3) OVER d AS w3, lead(word, 4) OVER d AS w4 FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    ), twice AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w1, w2, w3, w4) AS times FROM windows WHERE w4 IS NOT NULL
    ), repeated AS (
        SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) WHERE times > 1 GROUP BY doc_id
    ), measured AS (
        SELECT d.doc_id, CAST({SIZE} AS BIGINT) AS n_words, CAST(length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
            CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
            coalesce(r.n, 0) AS n_repeat_words, coalesce(clean_words, 0) AS clean_words
        FROM documents d LEFT JOIN clean USING (doc_id) LEFT JOIN repeated r USING (doc_id)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND clean_words >= {quality_rules.LEAST_KEPT} * n_words AS kept, clean_words
    FROM measured
"""


def near_dedup(percent: int) -> str:
    """Links between all pairs of documents that share a shingle, and what is reachable over them."""
    return f"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
    ), shingles AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
        FROM words
    ), sizes AS (
        SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
    ), common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
    ), links AS (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)
    ), sides AS (
        SELECT a, b FROM links UNION ALL SELECT b, a FROM links
    ), reach AS (
        SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b FROM reach r JOIN sides ON a = other
    ), least AS (
        SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN least l USING (doc_id) LEFT JOIN sizes USING (doc_id)
    """


WARC_AUDIT = """
    WITH records AS (
        SELECT page_id, page_id // 2048 AS file,
            'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:pagemill:' || coalesce(page_id::VARCHAR, '') || '>'
            || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
            || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
            || chr(13) || chr(10) || chr(13) || chr(10) AS record
        FROM pages
    ), placed AS (
        SELECT *, sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, sha256(record) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM records
    )
    SELECT page_id, file, CAST(coalesce(before, 0) AS BIGINT) AS offset, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest,
        CASE WHEN page_id % 211 = 7 THEN 'missing' WHEN page_id % 97 = 5 THEN 'corrupt' ELSE 'intact' END AS status
    FROM placed
"""

TOPK = """
    WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
        SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score
        FROM whole q JOIN whole d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
    ), ranked AS (
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: BPE, the classifier, the language model and language identification aren't expressible; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op2_warc_audit": WARC_AUDIT,
    "op4_sharding": SHARDING,
    "op6_near_dedup": near_dedup(85),
    "op8_mixing": MIXING,
    "op9_quality_rules": QUALITY_RULES,
    "op10_topk": TOPK,
}
