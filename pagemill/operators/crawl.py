"""Breadth-first crawl of a captured corpus, one level at a time."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.operators import html
from pagemill.storage import cut, drop


def check(max_depth: int, max_pages: int, patterns: tuple[str, ...]) -> None:
    if not 1 <= max_depth <= 10 or not 1 <= max_pages <= 1000:
        raise ValueError("max_depth must be 1 to 10 and max_pages 1 to 1000")
    for p in patterns:
        re.compile(p)


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(host, allow, path) of the rules for one agent, by default those for all, from (host, body).

    User-agent lines that follow each other share the rules after them; the first such line after a rule opens a new group.
    """
    lines = robots.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("o", "line"))
    field = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1))))
    value = F.trim(F.regexp_replace(F.regexp_replace("line", r"^[^:]*:", ""), r"\s*#.*$", ""))
    lines = lines.select("host", "o", field.alias("field"), value.alias("path")).where("field in ('user-agent', 'allow', 'disallow')")
    by_line = Window.partitionBy("host").orderBy("o")
    names = F.col("field") == "user-agent"
    opens = names & ~F.coalesce(F.lag(names).over(by_line), F.lit(False))
    lines = lines.withColumn("group", F.sum(opens.cast("int")).over(by_line))
    meant = F.bool_or(names & (F.lower("path") == agent.lower())).over(Window.partitionBy("host", "group"))
    rules = lines.withColumn("meant", meant).where(F.col("meant") & ~names & (F.col("path") != ""))
    return rules.select("host", (F.col("field") == "allow").alias("allow"), "path")


def mark_allowed(links: DataFrame, rules: DataFrame, link_col: str = "link", good_col: str = "good") -> DataFrame:
    """links with good_col false where the longest matching rule, if any, forbids them; allow wins among equals."""
    path = F.coalesce(F.nullif(F.try_parse_url(F.col(link_col), F.lit("PATH")), F.lit("")), F.lit("/"))
    keyed = links.withColumn("_host", urls.authority(F.col(link_col))).withColumn("_path", path)
    seen = keyed.select("_host", "_path").distinct()
    hit = seen.join(rules, (F.col("_host") == F.col("host")) & F.col("_path").startswith(F.col("path")))
    verdict = hit.groupBy("_host", "_path").agg(F.max(F.struct(F.length("path").alias("n"), "allow"))["allow"].alias("_ok"))
    judged = keyed.join(verdict, ["_host", "_path"], "left").withColumn(good_col, F.col(good_col) & F.coalesce("_ok", F.lit(True)))
    return judged.select(*links.columns)


def allowed(links: DataFrame, rules: DataFrame, link_col: str = "link") -> DataFrame:
    """The links that mark_allowed() lets be."""
    marked = mark_allowed(links.withColumn("_good", F.lit(True)), rules, link_col, "_good")
    return marked.where("_good").drop("_good")


def edges_of(pages: DataFrame, scope: str = "main") -> DataFrame:
    """(src, dst) of all pages (url, html), normalised; links of the main part or of the whole page."""
    body = html.main_html(F.col("html")) if scope == "main" else F.col("html")
    found = html.links(pages.select("url", body.alias("html")))
    return found.select(urls.strip(F.col("url")).alias("src"), F.col("link").alias("dst")).where("dst is not null").distinct()


def crawl(
    spark: SparkSession, seed: str, nodes: DataFrame, edges: DataFrame, max_depth: int = 3, max_pages: int = 100,
    exclude: tuple[str, ...] = (), include: tuple[str, ...] = (), rules: DataFrame | None = None,
) -> tuple[DataFrame, dict]:
    """(seen urls with depth, parent and found, statistics). nodes (url) are the pages that can be read; edges (src, dst).

    The cap is on seen addresses, admitted by depth and address; a page that isn't there is a failure. The loop has
    max_depth + 1 rounds at most, and each round's frontier at most max_pages rows.
    """
    check(max_depth, max_pages, (*exclude, *include))
    start = spark.createDataFrame([(seed,)], "url string").select(urls.strip(F.col("url")).alias("url"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"))
    seen = frontier = cut(start)
    known = nodes.select("url").distinct()
    total, skipped, host = 1, 0, urls.authority(urls.strip(F.lit(seed)))
    for depth in range(max_depth):
        # One pass over the edges a level: links of pages of the frontier that can be read, with what was found of each.
        out = edges.join(F.broadcast(frontier.select(F.col("url").alias("src"))), "src").join(known.select(F.col("url").alias("src")), "src", "left_semi")
        out = out.groupBy(F.col("dst").alias("url")).agg(F.min("src").alias("parent_url")).withColumn("good", urls.admitted(F.col("url"), host, exclude, include))
        out = cut(mark_allowed(out, rules, "url") if rules is not None else out)
        fresh = out.where("good").join(F.broadcast(seen.select("url")), "url", "left_anti")
        fresh = fresh.orderBy("url")
        n, rejected = fresh.count(), out.where("not good").count()
        taken = min(n, max(0, max_pages - total))
        skipped += rejected + n - taken
        total += taken
        if not taken:
            break
        admitted = cut(fresh.limit(taken).select("url", F.lit(depth + 1).alias("depth"), "parent_url"))
        drop(out)
        seen, frontier = cut(seen.unionByName(admitted)), admitted
    found = seen.join(nodes.select("url").distinct().withColumn("found", F.lit(True)), "url", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    ok = found.where("found").count()
    return found, {"total_urls": total, "success_count": ok, "failed_count": total - ok, "skipped_count": skipped}


def responses(records: DataFrame) -> DataFrame:
    """(url, markdown, structured_data) of the pages of a crawl that were read, as its answer gives them."""
    return records.where("success").select("url", "markdown", "structured_data")


def documents(records: DataFrame) -> DataFrame:
    """(url, content, title, description, language) of crawled pages, for retrieval; what meta tags don't say is null."""
    meta = F.col("structured_data.metaData")
    return responses(records).select("url", F.col("markdown").alias("content"), *[F.try_element_at(meta, F.lit(k)).alias(k) for k in ("title", "description", "language")])


def reachable(edges: DataFrame, seed: str, max_depth: int) -> DataFrame:
    """(url, depth): least depths, by a recursive query."""
    edges.createOrReplaceTempView("_pagemill_edges")
    quoted = seed.replace("'", "''")
    return edges.sparkSession.sql(f"""
        WITH RECURSIVE walk(url, depth) AS (
            SELECT '{quoted}', 0 UNION ALL
            SELECT e.dst, w.depth + 1 FROM walk w JOIN _pagemill_edges e ON e.src = w.url WHERE w.depth < {int(max_depth)}
        ) SELECT url, min(depth) AS depth FROM walk GROUP BY url
    """)
