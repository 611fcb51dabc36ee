import io
import json
import math
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions import urls
from pagemill.operators import chunk, crawl, dom, html, render, retrieval, store
from pagemill.sources import convert
from pagemill.streaming.chunks import messages


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_urls(spark):
    base = "http://h.org:80/a/b/page.html?q=1#f"
    cases = {"/x;p?q#f": "http://h.org:80/x", "y": "http://h.org:80/a/b/y", "../z": "http://h.org:80/a/z", "//o/p": "http://o/p", "": "http://h.org:80/a/b/page.html", "mailto:a@b": "mailto:a@b", "https://e/": "https://e/", "./": "http://h.org:80/a/b/"}
    got = one(spark, *[urls.join(F.lit(k), F.lit(base)) for k in cases])
    assert list(got) == list(cases.values())
    got = one(spark, urls.is_web(F.lit("ftp://x")), urls.is_web(F.lit("http://x/")), urls.is_web(F.lit("nonsense")), urls.image_name(F.lit("/a/b.png?x=1")))
    assert list(got) == [False, True, False, "b.png"]


def test_text(spark):
    got = one(spark, tx.word_count(F.lit("a b  c\n")), tx.word_count(F.lit("")), tx.read_time(F.lit(450)), tx.file_type(F.lit("x/Y.DOCX")), tx.safe_filename(F.lit("a/b?.txt")), tx.pdf_date(F.lit("D:20240102030405+00")), tx.pdf_date(F.lit("bad")), tx.cell_text(F.lit("3.0")))
    assert list(got) == [3, 0, 2, "docx", "ab.txt", "2024-01-02T03:04:05", "bad", "3"]
    md = "#Head\n-item\n---\n[x](/a#top)\n\n\n\ntext"
    assert one(spark, tx.clean_markdown(F.lit(md)))[0] == "# Head\n- item\n---\n[x](/a#top)\n\ntext"
    assert one(spark, tx.clean_response(F.lit("<think>a\nb</think>yes\n \n\n<internal>p</internal>no [thought]x[/thought]<analysis>")))[0] == "yes\n\nno <analysis>"
    assert one(spark, tx.fixed_slices(F.lit("abcde"), 2), tx.fixed_slices(F.lit(""), 2))[:] == (["ab", "cd", "e"], [])


META = """<html lang="fr-CA"><head><title> T </title><meta charset="utf-8"><meta name="description" content="d &amp; e">
<meta property="og:title" content="one"><meta property="og:title" content="two"><meta property="og:site_name" content="s"><meta name="twitter:card" content="c">
<script type="application/ld+json">{"@type":"A"}</script><script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@type":"B"},{"x":1}]</script></head></html>"""


def test_structured(spark):
    r = html.structured(spark.createDataFrame([(1, META)], "page_id long, html string")).withColumn("n", F.size("json_ld")).first()
    assert (r.title, r.language, r.charset, r.n) == ("T", "fr", "utf-8", 3)
    assert r.open_graph == {"title": "two", "site_name": "s"} and r.twitter_card == {"card": "c"} and r.meta_data == {"description": "d & e"}
    assert one(spark, html.renamed_open_graph(F.create_map(F.lit("site_name"), F.lit("s"), F.lit("audio"), F.lit("x"))))[0] == {"ogSiteName": "s", "ogAudio": "x"}


def test_bot_wall(spark):
    rows = [
        (1, "<title>Just a moment...</title>Ray ID: 1"), (2, "Ray ID: 7, cloudflare"), (3, "DataDome access denied"), (4, "fine"), (5, None),
        (6, '<div id="x" class="a incap-challenge">incapsula</div>'), (7, '<iframe src="https://recaptcha/api"></iframe><p class="g-recaptcha">verify you are human</p>'),
        (8, '<div class="cf-wrapper cf-browser-verification"><form id="challenge-form"></form></div>'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got = {r.page_id: (r.wall_detected, r.wall_type, r.wall_confidence) for r in html.bot_wall(pages).collect()}
    # 1: a pattern in the title and one in the text, and the title's phrase; 2, 3: two patterns each, not more than 30.
    assert got == {1: (True, "cloudflare", 55), 2: (False, None, 0), 3: (False, None, 0), 4: (False, None, 0), 5: (False, None, 0), 6: (False, None, 0), 7: (True, "generic_captcha", 45), 8: (False, None, 0)}
    hits = pages.withColumn("hits", dom.wall_selectors(F.col("html")))
    got = {r.page_id: (r.wall_type, r.wall_confidence) for r in html.bot_wall(hits, selector_hits=F.col("hits")).collect()}
    # 6: two selectors and a pattern; 7: an iframe, two by class, three patterns; 8: four selectors and a pattern.
    assert got[6] == ("incapsula", 55) and got[7] == ("generic_captcha", 45 + 60) and got[8] == ("cloudflare", 95)


def test_robots_groups(spark):
    """Agents in a row share the rules below them; a new group starts at the first agent after a rule."""
    body = "User-agent: *\nUser-agent: foo\nDisallow: /x # no\nAllow: /x/open\n\nUser-agent: bar\nDisallow: /y\nuser-AGENT: baz\nUser-agent: *\nDisallow: /z\nDisallow:"
    hosts = spark.createDataFrame([("h", body), ("g", None), ("i", "nothing here")], "host string, body string")
    assert {tuple(r) for r in crawl.robots_rules(hosts).collect()} == {("h", False, "/x"), ("h", True, "/x/open"), ("h", False, "/z")}
    assert {tuple(r) for r in crawl.robots_rules(hosts, "Bar").collect()} == {("h", False, "/y")}
    links = spark.createDataFrame([("http://h/x/1",), ("http://h/x/open/1",), ("http://h/y",), ("http://h/z",), ("http://i/x",), (None,)], "link string")
    assert {r.link for r in crawl.allowed(links, crawl.robots_rules(hosts)).collect()} == {"http://h/x/open/1", "http://h/y", "http://i/x", None}


PAGE = """<html><head><title>P</title></head><body><header><section>keep</section></header><nav><a href="/n">n</a></nav><div class="ad">long advertisement text here</div>
<article><h2>Head</h2><p>One <b>bold</b> and <a href="/x#top">link</a><br>next<p>Two &amp; three <code>c|d</code><ul><li>a<li>b<ol><li>c</ol></ul>
<pre><code class="language-py">x = 1
y</code></pre><table><tr><th>A<th>B|C<tr><td>1</table><img src="/i/p.png?w=1"><blockquote>said</blockquote><hr><script>"</p>"</script></article></body>"""


def test_dom(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<div>short</div><section>much longer text</section>"), (4, "plain < text")], "page_id long, html string")
    got = {r.page_id: r for r in dom.extract(pages).collect()}
    want = ["## Head", "One **bold** and [link](/x#top)\nnext", "Two & three `c|d`", "- a\n- b\n    1. c", "```py\nx = 1\ny\n```", "| A | B\\|C |\n| --- | --- |\n| 1 |  |", '![Image](/i/p.png?w=1 "p.png")', "> said", "---"]
    assert got[1].markdown.split("\n\n") == want
    assert [x.href for x in got[1].links] == ["/n", "/x#top"] and got[1].title == "P" and "script" not in got[1].main_html
    assert got[2].markdown == "" and got[3].markdown == "much longer text" and got[4].markdown.startswith("plain")
    wide = {r.page_id: r.markdown for r in dom.extract(pages, only_main=False).collect()}
    assert "keep" in wide[1] and "[n]" not in wide[1]
    assert dom.extract(pages, effective=True).first().markdown == "long advertisement text here"
    for x in want:
        assert dom.post_process(dom.post_process(x)) == dom.post_process(x)


@pytest.mark.parametrize("policy", ["EXCEPTION", "LAST_WIN"])
def test_records_by_key_policy(spark, policy):
    """What a page says of itself replaces what its record starts from, whatever the session does about equal keys; the rest stays."""
    page = """<html lang="de"><head><title>T</title><meta name="description" content="d"><meta name="description" content="e"><meta property="og:title" content="o"><meta property="og:title" content="p"></head></html>"""
    rows = [(1, "http://h/1", page), (2, "http://h/2", None), (3, None, ""), (4, "http://h/4", "<title></title>"), (5, "http://h/5", '<p lang="fr">x</p>')]
    session = spark.newSession()
    session.conf.set("spark.sql.mapKeyDedupPolicy", policy)
    got = {r.page_id: r.metadata for r in dom.records(session.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    start = {"title": None, "description": None, "language": None, "error": None, "statusCode": "200"}
    assert got == {
        1: start | {"sourceURL": "http://h/1", "title": "T", "description": "d", "language": "de", "ogTitle": "p"}, 2: start | {"sourceURL": "http://h/2", "statusCode": "500", "error": "no content"},
        3: start | {"sourceURL": None}, 4: start | {"sourceURL": "http://h/4", "title": ""}, 5: start | {"sourceURL": "http://h/5"},
    }


def test_dom_entities(spark):
    """Only whole entities are decoded; a cut one, as at the end of a shortened title, stays, in text and in attributes."""
    page = """<title>a&amp;b & c&amp</title><main><p>&lt;x&gt; &#65;&#x42; &amp;lt; &copy 1 &notit; Q&A &#6<a href="/?a=1&copy=2&amp;d=&quot;">l</a></main>"""
    got = dom.extract(spark.createDataFrame([(1, page)], "page_id long, html string")).first()
    assert got.title == got.metadata["title"] == "a&b & c&amp" and [x.href for x in got.links] == ['/?a=1&copy=2&d="']
    assert got.markdown == '<x> AB &lt; &copy 1 &notit; Q&A &#6[l](/?a=1&copy=2&d=")'


MD = "intro text\n# A\nalpha\n## B\nbeta\n```py\n# not a header\n```\nafter\n### C\n# D\n| a | b |\n|-|-|\n"


def test_semantic_chunks(spark):
    docs = spark.createDataFrame([(1, MD), (2, ""), (3, "no header"), (4, "# only"), (5, None)], "doc_id long, markdown string")
    rows = chunk.markdown(docs).orderBy("doc_id", "position").collect()
    got = [(r.doc_id, r.position, r.content, r.type, r.heading, r.path) for r in rows]
    assert got == [
        (1, 0, "intro text", "text", None, []), (1, 1, "alpha", "text", "A", ["A"]), (1, 2, "beta", "text", "B", ["A", "B"]),
        (1, 3, "```py\n# not a header\n```", "code", "B", ["A", "B"]), (1, 4, "after", "text", "B", ["A", "B"]), (1, 5, "| a | b |\n|-|-|", "table", "D", ["D"]),
        (3, 0, "no header", "text", None, []),
    ]
    twice = spark.createDataFrame([(1, "# A\nx\ny"), (1, "# A\nx\ny")], "doc_id long, markdown string")
    assert [r.content for r in chunk.markdown(twice).collect()] == ["x\ny", "x\ny"]
    assert rows[3].line_count == 3 and rows[2].parent_id == rows[3].parent_id is not None and rows[1].parent_id is None
    assert rows[3].code_language == "py" and rows[0].needs_merge is False and chunk.markdown(docs, strict_size=True).where("needs_merge").count() == 4


def test_sentences_and_paragraphs(spark):
    text = "One two three four. Five six seven eight! Ok. Nine ten eleven twelve? Last words come here now."
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    got = [r.content for r in chunk.sentences(docs, size=8, overlap=4).orderBy("position").collect()]
    assert got[0] == "One two three four. Five six seven eight!" and got[1].startswith("Five six seven eight!")
    assert all(len(x.split()) <= 9 for x in got)
    flat = chunk.sentences(docs, size=8, overlap=0).orderBy("position").collect()
    assert " ".join(r.content for r in flat).split() == text.split()
    para = spark.createDataFrame([(1, "aaa\n\nbb\n\ncccc\n\nd\n\n" + "e" * 9)], "doc_id long, text string")
    assert [r.content for r in chunk.paragraphs(para, limit=5).orderBy("position").collect()] == ["aaa\n\nbb", "cccc\n\nd", "e" * 9]
    made = chunk.records(chunk.markdown(spark.createDataFrame([(1, MD)], "doc_id long, markdown string")), url=F.lit("http://u"), processed_at=F.lit("2024-01-02"))
    told = [json.loads(r.value) | {"key": r.key} for r in messages(made).collect()]
    assert all(set(x) == {"key", "chunk_id", "url", "chunk_number", "total_chunks", "chunk_content", "chunk_type", "timestamp", "word_count", "position", "content_type", "heading", "code_language"} for x in told)
    assert all(x["key"] == x["chunk_id"] and x["url"] == "http://u" and x["timestamp"] == "2024-01-02" for x in told) and len({x["key"] for x in told}) == 6
    records = chunk.records(chunk.fixed(docs, n=40)).orderBy("chunk_number").collect()
    assert [r.chunk_number for r in records] == [1, 2, 3] and {r.total_chunks for r in records} == {3}


def test_crawl(spark):
    links = {"/a": ["/b", "/c", "http://other/x"], "/b": ["/d", "/a"], "/c": ["/d", "/private/p", "/missing"], "/d": ["/e"], "/e": ["/f"], "/private/p": []}
    pages = spark.createDataFrame([(f"http://h{k}", "<main>" + "".join(f'<a href="{x}">x</a>' for x in v) + "</main>") for k, v in links.items()], "url string, html string")
    edges, nodes = crawl.edges_of(pages), pages.select("url")
    robots = crawl.robots_rules(spark.createDataFrame([("h", "User-agent: *\nDisallow: /private\nAllow: /private/open # ok")], "host string, body string"))
    seen, stats = crawl.crawl(spark, "http://h/a#x", nodes, edges, max_depth=3, rules=robots)
    got = {r.url.removeprefix("http://h"): (r.depth, r.parent_url and r.parent_url.removeprefix("http://h"), r.found) for r in seen.collect()}
    assert got == {"/a": (0, None, True), "/b": (1, "/a", True), "/c": (1, "/a", True), "/d": (2, "/b", True), "/missing": (2, "/c", False), "/e": (3, "/d", True)}
    assert stats["total_urls"] == 6 and stats["failed_count"] == 1 and stats["skipped_count"] >= 2
    capped, _ = crawl.crawl(spark, "http://h/a", nodes, edges, max_depth=3, max_pages=2)
    assert sorted(r.url for r in capped.collect()) == ["http://h/a", "http://h/b"]
    assert {r.url: r.depth for r in crawl.reachable(edges, "http://h/a", 2).collect()}["http://h/d"] == 2
    with pytest.raises(ValueError):
        crawl.check(11, 10, ())


def test_cache(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    rows = [("k1", "old", "2024-01-01 01:00:00", 86400), ("k1", "new", "2024-01-01 02:00:00", 86400), ("k2", "gone", "2023-12-01", 86400)]
    cache = spark.createDataFrame(rows, "key string, value string, w string, ttl_seconds long").withColumn("written_at", F.col("w").cast("timestamp")).drop("w")
    asked = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string")
    hits, misses = store.split_hits(asked, cache, now)
    assert [(r.key, r.value) for r in hits.collect()] == [("k1", "new")] and sorted(r.key for r in misses.collect()) == ["k2", "k3"]
    grown = store.put(cache.select("key", "value", "written_at", "ttl_seconds"), spark.createDataFrame([("k3", "v", True), ("k4", "v", False)], "key string, value string, success boolean"), now)
    assert grown.count() == 4 and store.invalidate(grown, asked).count() == 0
    keys = one(spark, store.cache_key(F.lit("u")), store.cache_key(F.lit("u"), mobile=True))
    assert keys[0] != keys[1] and keys[0].startswith("scrape:")


def test_retrieval(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in retrieval.search(vectors, [1.0, 0.0]).collect()] == [1]
    assert [r.vec_id for r in retrieval.search(vectors, [-1.0, 0.2], k=2).collect()] == [3, 2]
    zero = spark.createDataFrame([(1, 1, 0.0), (2, 1, 0.1), (2, 2, 1.0)], "query_id int, chunk_id int, distance double")
    assert sorted((r.query_id, r.relevance) for r in retrieval.relevant(zero).collect()) == [(1, 1.0), (2, 0.9)]
    said = one(spark, retrieval.prompt(F.lit("s"), F.array().cast("array<struct<role:string,content:string>>"), F.lit("q")), retrieval.prompt(F.lit("s"), F.array().cast("array<struct<role:string,content:string>>"), F.lit(" ")))
    assert [m.role for m in said[0]] == ["system", "user"] and said[1] is None
    assert len(one(spark, retrieval.hashed_embedding(F.lit("a b a"), 8))[0]) == 8


def docx_bytes():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, props="", run="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"
    item = lambda t, k: p(t, f'<w:numPr><w:ilvl w:val="{k}"/></w:numPr>')
    body = p("Top", '<w:pStyle w:val="Heading1"/>') + p("hi", run="<w:b/><w:i/>") + item("a", 0) + item("b", 1) + item("c", 0)
    body += f"<w:tbl><w:tr><w:tc>{p('x')}</w:tc><w:tc>{p('y|z')}</w:tc></w:tr><w:tr><w:tc>{p('1')}</w:tc></w:tr></w:tbl>" + item("last", 0)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/media/p.png", b"x")
    return out.getvalue()


def xlsx_bytes():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = '<row r="1"/><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>3.0</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>in</t></is></c></row>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {s}><sheetData>{sheet}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>head</t></si></sst>")
    return out.getvalue()


def test_converters(spark, tmp_path):
    text = zlib.compress(b"BT (1.2 Scope) Tj T* (plain text here.) Tj T* (- item one) Tj ET")
    (tmp_path / "p.pdf").write_bytes(b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode>> stream\n" + text + b"\nendstream")
    (tmp_path / "d.docx").write_bytes(docx_bytes())
    (tmp_path / "x.xlsx").write_bytes(xlsx_bytes())
    (tmp_path / "bad.docx").write_bytes(b"nope")
    (tmp_path / "s.pptx").write_bytes(b"x")
    found = convert.elements(convert.files(spark, str(tmp_path))).cache()
    bad = {r.path.rsplit("/", 1)[1]: r.error for r in found.where("error is not null").collect()}
    assert set(bad) == {"bad.docx", "s.pptx"} and bad["s.pptx"] == "no converter for pptx"
    good = render.document(found.where("error is null"), "path")
    got = {r.path.rsplit("/", 1)[1]: r.markdown for r in good.collect()}
    assert got["d.docx"] == "# Top\n\n***hi***\n\n- a\n-     b\n- c\n\n| x   | y\\|z |\n| --- | ---- |\n| 1   |      |\n\n- last\n\n![Image 1](word/media/p.png)"
    assert got["x.xlsx"] == "## Sheet: S\n\n| head |     | 3   |\n| ---- | --- | --- |\n|      | in  |     |"
    assert got["p.pdf"] == "## Page 1\n\n### 1.2 Scope\n\nplain text here.\n\n- item one"
    counts = {r.path.rsplit("/", 1)[1]: (r.tables_count, r.images_count) for r in render.counts(found, "path").collect()}
    assert counts["d.docx"] == (1, 1)
    paths = render.section_paths(found.where("error is null and path like '%d.docx'"), "path").orderBy("ord").collect()
    assert paths[0].section_path == [0] and paths[-1].section_path == [0]
    assert convert.elements(convert.files(spark, str(tmp_path)), max_mb=1e-6).where("error = 'file too large'").count() == 4


def test_words_that_cancel_out_are_embedded(spark):
    """signed counts of these words sum to nothing; a text without words stays all zeros."""
    texts = ["g of.", "Éeauç êouç éleaux la.", " . ", "", None, "a b a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", retrieval.hashed_embedding(F.col("t")).alias("e")).orderBy("k").collect()
    assert [sum(x != 0 for x in r.e) > 0 for r in rows if r.k != 4] == [True, True, False, False, True]
    assert rows[4].e == [None] * 64 and all(len(r.e) == 64 for r in rows) and max(map(abs, rows[5].e)) == 2


def _odd_vectors(spark):
    """Vectors with equal, parallel, null, short and all-zero ones among them, and what their cosines are, one by one."""
    rnd = random.Random(3)
    vectors = [[float(rnd.randint(-3, 3)) for _ in range(4)] for _ in range(300)] + [[1.0, 2.0, 0.0, 1.0]] * 40 + [[0.0] * 4, None, [1.0, None, 2.0, 3.0], [1.0, 2.0]]
    rows = [(i * 7919 % len(vectors), "ab"[i % 5 == 0], v) for i, v in enumerate(vectors)]

    def cosine(a, b):
        if a is None or b is None or None in a + b or len(a) != len(b) or not any(a) or not any(b):
            return None
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return max(-1.0, min(1.0, dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))))

    return spark.createDataFrame(rows, "vec_id long, collection_id string, embedding array<double>"), rows, cosine


def test_collections_are_searched_in_blocks(spark, monkeypatch):
    """pairs are compared in blocks, not row by row of a join; the same hits as by brute force."""
    vectors, rows, cosine = _odd_vectors(spark)
    monkeypatch.setattr(retrieval, "BLOCK", 50)
    asked = vectors.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), "collection_id", F.col("embedding").alias("query_vector"))
    got = retrieval.in_collection(asked, vectors, n=5, floor=0.05)
    assert "CoGroupsInArrow" in got._jdf.queryExecution().toString()
    want = set()
    for q, c, a in rows:
        near = sorted((1 - s, i) for i, d, b in rows if q % 3 == 0 and c == d and (s := cosine(a, b)) is not None)[:5]
        most = max((d for d, _ in near), default=0)
        want |= {(q, i, round(r, 3)) for d, i in near if (r := 1 - d / most if most else 1.0) >= 0.05}
    assert {(r.query_id, r.vec_id, round(r.relevance, 3)) for r in got.collect()} == want and len(want) > 100


def test_many_queries_are_searched_in_blocks(spark, monkeypatch):
    """as F1, over all rows; k rows of each query, in tiers, as by brute force."""
    vectors, rows, cosine = _odd_vectors(spark)
    monkeypatch.setattr(retrieval, "BLOCK", 50)
    monkeypatch.setattr(retrieval, "AT_ONCE", 7)
    asked = vectors.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda x: x - 0.5).alias("query_vector"))
    got = retrieval.search_many(asked, vectors, k=4, floor=0.95, good=0.98)
    assert "CoGroupsInArrow" in got._jdf.queryExecution().toString()
    want = set()
    for q, _, a in rows:
        a = a and [x if x is None else x - 0.5 for x in a]
        near = sorted((-s, i) for i, _, b in rows if q % 3 == 0 and (s := cosine(a, b)) is not None)[:4]
        strict = bool(near) and -near[0][0] >= 0.98
        want |= {(q, i, -s, "strict" if strict else "exact") for s, i in near if not strict or -s >= 0.95}
    assert {(r.query_id, r.vec_id, r.score, r.tier) for r in got.collect()} == want and len({x[3] for x in want}) == 2


def test_metadata_alone(spark, monkeypatch):
    """metadata without a page's other outputs, as extract() has it, by one walk over the tree."""
    page = '<html lang="fr"><title>a <b>b</b></title><meta name="description" content=" d "><meta name="description" content="no"><meta property="og:title" content="t"><meta property="og:title" content=""><link rel="shortcut icon" href="/s"><time>x</time><time datetime="2024">y</time><meta property="article:tag" content="g"><img alt="The WRITER" src="w">'
    pages = spark.createDataFrame([(1, page), (2, ""), (3, None), (4, "<title></title><meta charset>")], "k int, html string")
    want = {r.k: r.metadata for r in dom.extract(pages).collect()}
    assert {r.k: r.m for r in pages.select("k", dom.metadata_map(F.col("html")).alias("m")).collect()} == want
    assert want[1] == {"title": "a b", "description": "d", "ogTitle": "t", "favicon": "/s", "language": "fr", "published_at": "2024", "categories": "g", "author_images": "w"}
    root, walks, walk = dom.parse(page.replace("<title>a <b>b</b></title>", "")), [], dom.Node.walk
    monkeypatch.setattr(dom.Node, "walk", lambda self: walks.append(1) or walk(self))
    assert dom.metadata(root)["language"] == "fr" and len(walks) == 1
