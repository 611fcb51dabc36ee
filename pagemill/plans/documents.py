"""Queries on office documents, streams and the SQL surface. Documents are written from the rows of tables; the SQL works
their contents out from the columns."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators import render
from pagemill.plans.pages import text
from pagemill.plans.registry import query
from pagemill.session import table
from pagemill.sources import convert, surface
from pagemill.storage import shared_folder
from pagemill.streaming import chunks as streams


@F.pandas_udf(T.BinaryType())
def _zipped(parts: pd.Series) -> pd.Series:
    """Archives of the parts (name, text) of each row."""

    def one(files: list) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for x in files:
                z.writestr(x["name"], x["body"])
        return out.getvalue()

    return parts.map(one)


@F.pandas_udf(T.BinaryType())
def _deflated(data: pd.Series) -> pd.Series:
    return data.map(lambda x: zlib.compress(bytes(x)))


def _archive(parts: dict[str, Column]) -> Column:
    return _zipped(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("body")) for k, v in parts.items()]))


def _file(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    made = rows.select(path.alias("path"), content.alias("content"))
    return made.select("path", F.octet_length("content").cast("long").alias("length"), "content")


_CORE = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/">'
_SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _workbooks(spark: SparkSession, d: str) -> DataFrame:
    """A workbook a region: its nations (shared and inline texts, whole floats, blank rows and cells) and an empty sheet."""
    nations = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    rows = table(spark, d, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    line = lambda x, i: F.concat(F.lit('<row r="'), (i * 2 + 3).cast("string"), F.lit('"><c r="A'), (i * 2 + 3).cast("string"), F.lit('"><v>'), x["n_nationkey"].cast("string"), F.lit('.0</v></c><c r="C'), (i * 2 + 3).cast("string"), F.lit('" t="inlineStr"><is><t>'), x["n_name"], F.lit('|x</t></is></c><c r="D1"/></row><row r="'), (i * 2 + 4).cast("string"), F.lit('"/>'))
    sheet = text(f"<worksheet {_SHEET}><sheetData>", '<row r="1"><c r="A1" t="s"><v>1</v></c><c r="C1" t="s"><v>0</v></c></row>', F.array_join(F.transform("n", line), ""), "</sheetData></worksheet>")
    book = text(f'<workbook {_SHEET}><sheets><sheet name="', F.col("r_name"), '" r:id="r1"/><sheet name="None" r:id="r2"/></sheets></workbook>')
    links = text('<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
    content = _archive({
        "xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": links, "xl/worksheets/a.xml": sheet, "xl/worksheets/b.xml": text(f"<worksheet {_SHEET}><sheetData/></worksheet>"),
        "xl/sharedStrings.xml": text(f"<sst {_SHEET}><si><t>name</t></si><si><r><t>k</t></r><r><t>ey</t></r></si></sst>"),
        "docProps/core.xml": text(_CORE, "<dc:title>", F.col("r_name"), "</dc:title><dcterms:created>2024-01-02T03:04:05Z</dcterms:created></cp:coreProperties>"),
    })
    return _file(rows, text("mem:/", F.col("r_name"), ".xlsx"), content)


@query(
    """
    WITH t AS (
        SELECT r_name, n_nationkey, n_name || '\\|x' AS n, greatest(3, max(length(n_name)) OVER (PARTITION BY r_name) + 3) AS w FROM region JOIN nation ON n_regionkey = r_regionkey
    )
    SELECT 'mem:/' || r_name || '.xlsx' AS path, '## Sheet: ' || r_name || chr(10) || chr(10) || '| key |     | ' || rpad('name', any_value(w)::INT, ' ') || ' |' || chr(10) || '| --- | --- | ' || repeat('-', any_value(w)::INT) || ' |' || chr(10)
        || string_agg('| ' || rpad(n_nationkey::VARCHAR, 3, ' ') || ' |     | ' || rpad(n, w::INT, ' ') || ' |', chr(10) ORDER BY n_nationkey) AS markdown, r_name || chr(10) || 'None' AS sheets, r_name AS title, '2024-01-02T03:04:05' AS created, 1::BIGINT AS tables_count
    FROM t GROUP BY r_name
    """
)
def convert_xlsx(spark: SparkSession, d: str) -> DataFrame:
    """Workbooks to Markdown, with their properties and counts."""
    found = convert.elements(_workbooks(spark, d))
    meta = found.where("type = 'metadata'").select("path", F.col("attrs")["sheets"].alias("sheets"), F.col("attrs")["title"].alias("title"), F.col("attrs")["created"].alias("created"))
    return render.document(found, "path").join(meta, "path").join(render.counts(found, "path").select("path", "tables_count"), "path")


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'


def _letters(spark: SparkSession, d: str) -> DataFrame:
    """A text document a nation: headings, formatted runs, two lists, a table, an equation, a picture and a lost one."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    p = lambda body, props="", run="": text(f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>", body, "</w:t></w:r></w:p>")
    item = lambda body, which, depth: p(body, f'<w:numPr><w:ilvl w:val="{depth}"/><w:numId w:val="{which}"/></w:numPr>')
    picture = lambda link, told: text(f'<w:p><w:r><w:drawing><wp:inline><wp:extent cx="9" cy="7"/><wp:docPr id="1" descr="', told, f'"/><a:blip r:embed="{link}"/></wp:inline></w:drawing></w:r></w:p>')
    body = text(
        p(name, '<w:pStyle w:val="Heading1"/><w:jc w:val="center"/>'), "<w:p><w:r><w:t>Code </w:t></w:r><w:r><w:rPr><w:b/><w:i/></w:rPr><w:t>", k, "</w:t></w:r><w:r><w:rPr><w:u w:val='none'/></w:rPr><w:t> here</w:t></w:r></w:p>",
        item(F.lit("1. first"), 1, 0), item(text("2. second ", k), 1, 0), item(F.lit("dot"), 2, 0), item(F.lit("deep"), 2, 1), p(F.lit("Sub"), '<w:pStyle w:val="Heading2"/>'),
        "<w:tbl><w:tblPr><w:tblStyle w:val='Grid'/></w:tblPr><w:tr><w:tc>", p(F.lit("key")), "</w:tc><w:tc>", p(F.lit("x|y")), "</w:tc></w:tr><w:tr><w:tc>", p(k.cast("string")), p(F.lit("more")), "</w:tc></w:tr></w:tbl>",
        "<w:p><m:oMath><m:r><m:t>a+</m:t></m:r><m:r><m:t>b</m:t></m:r></m:oMath></w:p>", picture("i1", text("Flag of ", name)), picture("i9", F.lit("gone")),
    )
    core = text(_CORE, "<dc:title>", name, "</dc:title><dc:creator>A</dc:creator><dc:description>c</dc:description><cp:category>g</cp:category><cp:revision>", k, "</cp:revision><cp:lastModifiedBy>B</cp:lastModifiedBy><dcterms:modified>2024-01-02T03:04:05Z</dcterms:modified><cp:keywords/></cp:coreProperties>")
    content = _archive({
        "word/document.xml": text(f"<w:document {_W}><w:body>", body, "</w:body></w:document>"), "docProps/core.xml": core, "word/media/p.png": F.lit("x"),
        "word/_rels/document.xml.rels": text('<Relationships><Relationship Id="i1" Target="media/p.png"/></Relationships>'),
    })
    broken = F.when(k % 5 == 4, F.lit("nope").cast("binary")).otherwise(content)
    return _file(table(spark, d, "nation"), text("mem:/", name, F.when(k % 5 == 3, ".odt").otherwise(".docx")), broken)


@query(
    """
    SELECT 'mem:/' || n_name || CASE n_nationkey % 5 WHEN 3 THEN '.odt' ELSE '.docx' END AS path, n_nationkey % 5 < 3 AS success,
        CASE n_nationkey % 5 WHEN 3 THEN 'unsupported file type' WHEN 4 THEN 'File is not a zip file' ELSE 'Image relationship i9 not found' END AS warnings,
        CASE WHEN n_nationkey % 5 < 3 THEN '# ' || n_name || chr(10) || chr(10) || 'Code ***' || n_nationkey || '*** here' || chr(10) || chr(10) || '1. first' || chr(10) || '2. second ' || n_nationkey || chr(10) || chr(10) || '- dot' || chr(10) || '-     deep' || chr(10) || chr(10) || '## Sub' || chr(10) || chr(10)
            || '| ' || rpad('key', greatest(3, length(n_nationkey::VARCHAR) + 5)::INT, ' ') || ' | x\\|y |' || chr(10) || '| ' || repeat('-', greatest(3, length(n_nationkey::VARCHAR) + 5)::INT) || ' | ---- |' || chr(10) || '| ' || n_nationkey || ' more |      |' || chr(10) || chr(10) || '$$a+b$$' || chr(10) || chr(10) || '![Flag of ' || n_name || '](word/media/p.png)' END AS markdown,
        CASE WHEN n_nationkey % 5 < 3 THEN n_name || '/A/c/g/B/' || n_nationkey || '/2024-01-02T03:04:05' END AS properties, CASE WHEN n_nationkey % 5 < 3 THEN 'center/Grid/9/true' END AS styles, CASE WHEN n_nationkey % 5 < 3 THEN '1/1/1' ELSE '0/0/0' END AS counts,
        CASE WHEN n_nationkey % 5 < 3 THEN n_name || ' > Sub' END AS path_of_table
    FROM nation
    """
)
def convert_docx(spark: SparkSession, d: str) -> DataFrame:
    """Text documents to Markdown: properties, styles, relationships, numbered lists, section paths, warnings, files that fail."""
    found = convert.elements(_letters(spark, d))
    good, attr = found.where("error is null"), lambda k: F.col("attrs")[k]
    names = ("title", "author", "comments", "category", "last_modified_by", "revision", "modified")
    meta = good.where("type = 'metadata'").select("path", F.concat_ws("/", *[attr(n) for n in names]).alias("properties"))
    first = lambda kind, k: F.max(F.when(F.col("type") == kind, attr(k)))
    styles = good.groupBy("path").agg(F.concat_ws("/", first("heading", "alignment"), first("table", "style"), first("image", "width"), F.max(F.when((F.col("type") == "list") & (F.element_at("items", 1) == "first"), attr("ordered")))).alias("styles"))
    counts = render.counts(found, "path").select("path", F.concat_ws("/", "tables_count", "images_count", "equations_count").alias("counts"))
    sections = render.section_paths(good, "path")
    heads = good.where("type = 'heading'").select("path", F.col("ord").alias("at"), F.col("content").alias("title"))
    above = sections.where("type = 'table'").select("path", F.posexplode("section_path").alias("i", "at")).join(heads, ["path", "at"])
    above = above.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "title"))), lambda x: x["title"]), " > ").alias("path_of_table"))
    told = convert.warnings(found).withColumn("warnings", F.array_join("warnings", "; "))
    out = told.join(render.document(good, "path"), "path", "left")
    for more in (meta, styles, counts, above):
        out = out.join(more, "path", "left")
    return out.select("path", "success", "warnings", "markdown", "properties", "styles", "counts", "path_of_table")


@query(
    """
    SELECT 'mem:/' || r_regionkey || '.pdf' AS path, '## Page 1' || chr(10) || chr(10) || '# Chapter ' || r_name || chr(10) || chr(10) || 'plain text of ' || r_name || '.' || chr(10) || chr(10) || '- item one' || chr(10) || '- item ' || r_regionkey || chr(10) || chr(10) || '### 1.2 Scope' || chr(10) || chr(10)
        || '| name  | size |' || chr(10) || '| ----- | ---- |' || chr(10) || '| chalk | ' || rpad(r_regionkey::VARCHAR, 4, ' ') || ' |' || chr(10) || chr(10) || '![Image 1]()' || chr(10) || chr(10) || '## Page 2' || chr(10) || chr(10) || '## ALL CAPS' || chr(10) || chr(10) || 'the (end)' AS markdown,
        r_name AS title, '2024-01-02T03:04:05' AS created, 'jpeg' AS format, 'a stream with a filter that isn''t read' AS warnings
    FROM region
    """
)
def convert_pdf(spark: SparkSession, d: str) -> DataFrame:
    """Documents of plain and deflated text streams: information, pages, headings, lists, tables, pictures, streams that aren't read."""
    k, name = F.col("r_regionkey"), F.col("r_name")
    one = text("BT (Chapter ", name, ") Tj T* (plain text of ", name, ".) Tj T* (- item one) Tj T* (2\\) item ", k, ") Tj T* (1.2 Scope) Tj T* T* (name   |   size) Tj T* (chalk   |   ", k, ") Tj ET")
    two = text("BT [(ALL) -250 ( CAPS)] TJ T* (the \\(end\\)) Tj ET")
    raw = lambda x: text(x).cast("binary")
    data = F.concat(
        raw("%PDF-1.4\n1 0 obj <</Filter /FlateDecode>> stream\n"), _deflated(one.cast("binary")), raw("\nendstream endobj\n2 0 obj <</Subtype /Image /Filter /DCTDecode>> stream\nxx\nendstream endobj\n"),
        raw("3 0 obj <</Filter /LZWDecode>> stream\nyy\nendstream endobj\n4 0 obj <</Length 9>> stream\n"), two.cast("binary"), raw("\nendstream endobj\n5 0 obj <</Title ("), name.cast("binary"),
        raw(") /CreationDate (D:20240102030405+01'00') /Author ()>> endobj\ntrailer <</Info 5 0 R>>\n"),
    )
    found = convert.elements(_file(table(spark, d, "region"), text("mem:/", k, ".pdf"), data))
    attr = lambda kind, name_: F.max(F.when(F.col("type") == kind, F.col("attrs")[name_]))
    meta = found.groupBy("path").agg(attr("metadata", "Title").alias("title"), attr("metadata", "CreationDate").alias("created"), attr("image", "format").alias("format"))
    return render.document(found, "path").join(meta, "path").join(convert.warnings(found).select("path", F.array_join("warnings", "; ").alias("warnings")), "path")


def _stream(spark: SparkSession, rows: DataFrame, parts: int) -> tuple[DataFrame, str]:
    """A stream of rows that arrive in several files, one a batch, and a folder for its results."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.repartition(parts).write.parquet(f"{folder}/in")
    return streams.read_files(spark, f"{folder}/in", rows.schema, 1), folder


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of each key of a stream that comes in several batches in no order."""
    stream, folder = _stream(spark, table(spark, d, "events"), 3)
    streams.upsert_into(stream, f"{folder}/out", f"{folder}/check", "user_id", "ts", "event_id").awaitTermination()
    return streams.read_upserted(spark, f"{folder}/out").select("user_id", "event_id", "event_type", "value")


@query("SELECT doc_id, count(*) AS n_chunks, 64 AS dim, true AS all_embedded FROM (SELECT doc_id, unnest(range(0, (length(text) + 999) // 1000)) FROM documents WHERE length(text) > 0) GROUP BY doc_id")
def stream_embed_store(spark: SparkSession, d: str) -> DataFrame:
    """A stream of documents, chunked, embedded and stored."""
    stream, folder = _stream(spark, table(spark, d, "documents"), 2)
    streams.embed_and_store(stream, f"{folder}/out", f"{folder}/check").awaitTermination()
    stored = spark.read.parquet(f"{folder}/out")
    return stored.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.size("embedding")).alias("dim"), F.bool_and(F.exists("embedding", lambda x: x != 0) | (F.trim("chunk_content") == "") | ~F.col("chunk_content").rlike(r"\w")).alias("all_embedded"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts by event-time window of a stream in several batches, late rows included."""
    stream, folder = _stream(spark, table(spark, d, "events"), 3)
    counted = streams.windowed(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "4000 days", "6 hours", "event_type")
    counted.writeStream.outputMode("complete").foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id FROM events")
def stream_first_requests(spark: SparkSession, d: str) -> DataFrame:
    """The first request of each client within its time to live, over several batches."""
    stream, folder = _stream(spark, table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), 3)
    first = streams.fresh(stream, "user_id", "ts", "4000 days").select("user_id")
    first.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long").parquet(f"{folder}/out")


@query(
    """
    SELECT page_id, 'link' AS what, href AS value FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages) WHERE href <> ''
    UNION ALL SELECT page_id, 'charset', 'utf-8' FROM pages UNION ALL SELECT page_id, 'chunk', '0' FROM pages UNION ALL SELECT page_id, 'chunk', '1' FROM pages
    """
)
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """Table functions of the package in SQL: links, metadata and chunks of pages."""
    surface.register(spark)
    table(spark, d, "pages").createOrReplaceTempView("_pagemill_pages")
    return spark.sql("""
        SELECT page_id, 'link' AS what, l.href AS value FROM _pagemill_pages, LATERAL page_links(html) AS l
        UNION ALL SELECT page_id, m.key, m.value FROM _pagemill_pages, LATERAL page_metadata(html) AS m WHERE m.key = 'charset'
        UNION ALL SELECT page_id, 'chunk', string(c.position) FROM _pagemill_pages, LATERAL markdown_chunks(concat('intro\n# ', url, '\nbody')) AS c
    """)


@query("SELECT url, md5(html) AS html_md5, CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS status, false AS failed FROM pages UNION ALL SELECT NULL, NULL, NULL, true FROM range(2)")
def capture_source(spark: SparkSession, d: str) -> DataFrame:
    """Captured pages as JSON lines, read by the package's data source; two lines don't parse."""
    surface.register(spark)
    folder = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    status = F.when(F.col("page_id") % 5 == 0, 404)
    lines = table(spark, d, "pages").select(F.to_json(F.struct("url", "html", status.alias("status"))).alias("value"))
    lines.unionByName(spark.range(2).select(F.lit("{bad").alias("value"))).repartition(3).write.text(folder)
    # Spark names its text files itself; the source reads what a crawler would have written.
    import glob
    import os

    for i, name in enumerate(sorted(glob.glob(os.path.join(folder.removeprefix("file://"), "part-*")))):
        os.rename(name, os.path.join(folder.removeprefix("file://"), f"{i}.jsonl"))
    found = spark.read.format("page_captures").load(folder)
    return found.select("url", F.md5(F.col("html").cast("binary")).alias("html_md5"), "status", F.col("error").isNotNull().alias("failed"))
