"""Page extraction by column expressions: metadata, structured data, links, main text and page-quality labels.

Scripts are cut before anything else is looked for, so that tags inside them aren't found. Pages that need a tolerant tree
(Markdown, containers by attribute, selectors) go through operators.dom.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls

#: Open graph names with names of their own; all others get `og` and a capital, the rest in lower case.
OG_NAMES = {"title": "ogTitle", "description": "ogDescription", "image": "ogImage", "url": "ogUrl", "site_name": "ogSiteName", "locale": "ogLocale", "type": "og:type"}


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style|noscript|iframe)\b.*?(?:</\1\s*>|$)", " ")


def unescape(text: Column) -> Column:
    """The common entities; ampersands last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_lang(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([^"'\s>]+)""", 1)


def charset(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?is)<meta\b[^>]*?\bcharset\s*=\s*["']?([^"'\s/>]+)""", 1)


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not; empty where it has none."""
    quoted = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 1)
    single = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 2)
    bare = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 3)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(single, F.lit("")), bare)


def metas(html: Column) -> Column:
    """(name, content) of the page's meta tags in order: name, else property, else http-equiv."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    name = lambda t: F.coalesce(*[F.nullif(_attribute(t, a), F.lit("")) for a in ("name", "property", "http-equiv")])
    pairs = F.transform(tags, lambda t: F.struct(name(t).alias("name"), unescape(_attribute(t, "content")).alias("content")))
    return F.filter(pairs, lambda m: m["name"].isNotNull() & (m["content"] != ""))


def _last(pairs: Column, key) -> Column:
    """Map of (key(name), content), the last of equal keys winning."""
    entries = F.transform(pairs, lambda m: F.struct(key(m["name"]).alias("k"), m["content"].alias("v")))
    return F.aggregate(
        entries, F.create_map().cast("map<string,string>"),
        lambda a, e: F.map_concat(F.map_filter(a, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])),
    )


def open_graph(meta: Column) -> Column:
    return _last(F.filter(meta, lambda m: m["name"].startswith("og:")), lambda n: F.substring(n, 4, 1 << 20))


def twitter_card(meta: Column) -> Column:
    return _last(F.filter(meta, lambda m: m["name"].startswith("twitter:")), lambda n: F.substring(n, 9, 1 << 20))


def renamed_open_graph(og: Column) -> Column:
    """Open graph keys as page metadata names them."""

    def named(k: Column) -> Column:
        out = F.concat(F.lit("og"), F.upper(F.substring(k, 1, 1)), F.lower(F.substring(k, 2, 1 << 20)))
        for name, to in OG_NAMES.items():
            out = F.when(k == name, to).otherwise(out)
        return out

    return F.transform_keys(og, lambda k, _: named(k))


def primary_language(html: Column, meta: Column) -> Column:
    """html lang before a hyphen; else content-language, language or og:locale before an underscore; else empty."""
    of = lambda name: F.element_at(F.transform(F.filter(meta, lambda m: F.lower(m["name"]) == name), lambda m: F.split_part(m["content"], F.lit("_"), F.lit(1))), 1)
    own = F.nullif(F.split_part(html_lang(html), F.lit("-"), F.lit(1)), F.lit(""))
    first = lambda name: F.when(F.exists(meta, lambda m: F.lower(m["name"]) == name), of(name))
    return F.coalesce(own, first("content-language"), first("language"), first("og:locale"), F.lit(""))


def json_ld(html: Column) -> Column:
    """Parsed ld+json scripts; those that don't parse are left out one by one, lists are flattened."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1))
    parsed = F.filter(F.transform(found, lambda x: F.try_parse_json(x)), lambda v: v.isNotNull())
    one = lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    return F.flatten(F.transform(parsed, one))


def structured(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with title, language, charset, open_graph, twitter_card, meta_data and json_ld."""
    html = F.col(html_col)
    out = pages.withColumn("_meta", metas(html))
    plain = F.filter("_meta", lambda m: ~m["name"].startswith("og:") & ~m["name"].startswith("twitter:"))
    return out.select(
        *pages.columns, title(html).alias("title"), primary_language(html, F.col("_meta")).alias("language"), charset(html).alias("charset"),
        open_graph(F.col("_meta")).alias("open_graph"), twitter_card(F.col("_meta")).alias("twitter_card"), _last(plain, lambda n: n).alias("meta_data"),
        json_ld(html).alias("json_ld"),
    )


def hrefs(html: Column) -> Column:
    """Link targets of the whole page in order, repeats kept, empty ones left out."""
    return F.filter(F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\shref\s*=\s*["']([^"']*)["']"""), F.lit(1)), lambda x: x != "")


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page columns but the html, pos, href, link): each link with its absolute, stripped form."""
    kept = [c for c in pages.columns if c != html_col]
    out = pages.select(*kept, F.posexplode(hrefs(F.col(html_col))).alias("pos", "href"))
    return out.withColumn("link", urls.join(F.col("href"), F.col(url_col)))


def main_html(html: Column) -> Column:
    """The inside of main, else of article, else of the body, else all."""
    html = without_scripts(html)
    tries = [F.nullif(F.regexp_extract(html, rf"(?is)<{t}\b[^>]*>(.*?)(?:</{t}\s*>|$)", 1), F.lit("")) for t in ("main", "article", "body")]
    return F.coalesce(*tries, html)


def plain_text(html: Column) -> Column:
    """Text between tags, blanks squeezed."""
    text = F.regexp_replace(F.regexp_replace(without_scripts(html), r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape(text), r"[\s ]+", " "))


#: Patterns by which pages of bot protection are known, in the order in which ties are settled.
BOT_WALL_TEXT = {
    "cloudflare": ("cloudflare", "ray id:", "please wait while we verify", "please enable cookies", "please complete the security check", "checking your browser", "just a moment", "attention required", "cf-browser-verification", "cf-challenge-running"),
    "datadome": ("datadome", "access denied", "blocked by datadome", "captcha.*datadome"),
    "incapsula": ("incapsula", "incap_ses", "visid_incap", "blocked by incapsula"),
    "akamai": ("akamai", "ak-bmsc", "akamai.*bot.*manager"),
    "generic_captcha": ("captcha", "recaptcha", "hcaptcha", "security check", "verify.*human"),
}
#: Phrases of the titles of such pages.
BOT_WALL_TITLES = ("just a moment", "attention required", "checking your browser")


def bot_wall(pages: DataFrame, html_col: str = "html", selector_hits: Column | None = None) -> DataFrame:
    """pages with wall_type, wall_confidence and wall_detected: 15 a pattern, 25 for a title; more than 30 is a wall.

    selector_hits, a map of system to number of selectors found (operators.dom.wall_selectors gives it), adds 20 each.
    """
    text, scores = F.lower(F.col(html_col)), []
    for name, patterns in BOT_WALL_TEXT.items():
        points = sum((F.when(text.rlike(p), 15).otherwise(0) for p in patterns), F.lit(0))
        if name == "cloudflare":
            points = points + F.when(F.lower(title(F.col(html_col))).rlike("|".join(BOT_WALL_TITLES)), 25).otherwise(0)
        if selector_hits is not None:
            points = points + F.coalesce(selector_hits[name], F.lit(0)) * 20
        scores.append(F.struct(points.cast("long").alias("points"), F.lit(name).alias("name")))
    best = F.aggregate(F.array(*scores), scores[0], lambda a, x: F.when(x["points"] > a["points"], x).otherwise(a))
    out = pages.select("*", best.alias("_best"))
    hit = F.coalesce(F.col("_best.points") > 30, F.lit(False))
    return out.select(*pages.columns, hit.alias("wall_detected"), F.when(hit, F.col("_best.name")).alias("wall_type"), F.when(hit, F.col("_best.points")).otherwise(0).alias("wall_confidence"))


def structured_record(page: Column) -> Column:
    """jsonLd, openGraph, twitterCard and metaData of a page as one value; a page that is null has none of them, and no language.

    Empty contents are left out, metaData always has its language.
    """
    meta = metas(page)
    own = F.filter(meta, lambda m: ~m["name"].startswith("og:") & ~m["name"].startswith("twitter:"))
    language = F.create_map(F.lit("language"), F.coalesce(primary_language(page, meta), F.lit("")))
    plain = F.map_filter(_last(own, lambda n: n), lambda k, _: k != "language")
    none = F.create_map().cast("map<string,string>")
    return F.struct(
        F.coalesce(json_ld(page), F.array().cast("array<variant>")).alias("jsonLd"), F.coalesce(open_graph(meta), none).alias("openGraph"),
        F.coalesce(twitter_card(meta), none).alias("twitterCard"), F.map_concat(F.coalesce(plain, none), language).alias("metaData"),
    )


def valid_json_ld(found: Column) -> Column:
    """Of parsed ld+json values those with a context and a type."""
    return F.filter(found, lambda v: F.try_variant_get(v, "$['@context']", "string").isNotNull() & F.try_variant_get(v, "$['@type']", "string").isNotNull())
