"""Scalar text functions as columns: counts, previews, chunk types, cleaning, responses and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The reasoning tags that model answers may hold, as XML-like and as bracketed pairs.
XML_TAGS = ("think", "antThinking", "reasoning", "thought", "thinking", "internal")
BRACKET_TAGS = ("thinking", "thought")


#: Platforms by what their user agents hold, in the order in which they are looked for.
PLATFORMS = (("Windows", "windows"), ("Mac", "macintosh|mac os x"), ("Linux", "linux"), ("Android", "android"), ("iOS", "iphone|ipad"))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_count(text: Column | str) -> Column:
    """Words between runs of white space, Unicode's included; an empty text has none."""
    return F.coalesce(F.regexp_count(_col(text), F.lit(r"(?U)\S+")), F.lit(0)).cast("long")


def read_time(words: Column | str) -> Column:
    """Minutes at 200 words a minute, at least one."""
    return F.greatest(F.lit(1), F.floor(_col(words) / 200)).cast("long")


def preview(text: Column | str, n: int = 100) -> Column:
    text = _col(text)
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def truncate(text: Column | str, n: int = 4000) -> Column:
    return F.left(_col(text), F.lit(n))


def trim_lines(text: Column | str) -> Column:
    """Each line without blanks at its end, the whole without blank space at either end."""
    return F.regexp_replace(F.regexp_replace(_col(text), r"(?m)[ \t]+$", ""), r"^\s+|\s+$", "")


def chunk_type(text: Column | str) -> Column:
    """header, code, list, table or text, by the first rule that fits."""
    t = _col(text)
    return (
        F.when(t.startswith("#"), "header")
        .when(t.startswith("```"), "code")
        .when(t.startswith("- ") | t.startswith("* ") | t.startswith("1. "), "list")
        .when(F.contains(t, F.lit("|")) & F.contains(t, F.lit("-|-")), "table")
        .otherwise("text")
    )


def has_code(text: Column | str) -> Column:
    """Fences or code within a line."""
    return F.contains(_col(text), F.lit("`"))


def has_lists(text: Column | str) -> Column:
    return _col(text).rlike(r"(?m)^\s*[-*]\s")


def has_links(text: Column | str) -> Column:
    return F.contains(_col(text), F.lit("[")) & F.contains(_col(text), F.lit("]("))


def clean_markdown(text: Column | str) -> Column:
    """Chunk pre-clean: blank runs within lines to one, headers and list items with a blank, at most one empty line."""
    t = F.regexp_replace(_col(text), r"[^\S\n]+", " ")
    t = F.regexp_replace(t, r"(?m)^(#{1,6})([^#\s])", "$1 $2")
    t = F.regexp_replace(t, r"(?m)^(\s*)-([^\s-])", "$1- $2")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_text(text: Column | str) -> Column:
    """Control characters to blanks, blank runs to one, at most one empty line, lines without outer blanks."""
    t = F.regexp_replace(_col(text), r"[\p{C}&&[^\n\t]]", " ")
    t = F.regexp_replace(t, r"[^\S\n]+", " ")
    t = F.regexp_replace(t, r"(?m)^ | $", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_response(text: Column | str) -> Column:
    """A model's answer without its reasoning parts, empty lines squeezed."""
    t = _col(text)
    for tag in XML_TAGS:
        t = F.regexp_replace(t, rf"(?s)<{tag}>.*?</{tag}>", "")
    for tag in BRACKET_TAGS:
        t = F.regexp_replace(t, rf"(?s)\[{tag}\].*?\[/{tag}\]", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n\s*\n", "\n\n"), r"^\s+|\s+$", "")


def newline_to_br(text: Column | str) -> Column:
    return F.replace(_col(text), F.lit("\n"), F.lit("<br>"))


def fixed_slices(text: Column | str, n: int = 1000) -> Column:
    """Consecutive pieces of n characters; none of an empty or null text."""
    t = _col(text)
    return F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(0), F.length(t) - 1, F.lit(n)), lambda i: F.substring(t, i + 1, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def safe_filename(name: Column | str, default: str = "document") -> Column:
    plain = F.left(F.regexp_replace(_col(name), "[^-_.() a-zA-Z0-9]", ""), F.lit(255))
    return F.coalesce(F.nullif(F.trim(plain), F.lit("")), F.lit(default))


def file_type(path: Column | str) -> Column:
    """pdf, docx, xlsx or pptx by the extension, else null."""
    ext = F.lower(F.regexp_extract(_col(path), r"\.([^./]+)$", 1))
    return F.when(ext.isin("pdf", "docx", "xlsx", "pptx"), ext)


def or_default(value: Column | str, default: str) -> Column:
    """The default for null and for the empty text."""
    return F.coalesce(F.nullif(_col(value), F.lit("")), F.lit(default))


def platform_of_agent(agent: Column | str) -> Column:
    """The first platform whose name the user agent holds; Windows for all others."""
    out = F.lit("Windows")
    for name, marks in reversed(PLATFORMS):
        out = F.when(F.lower(_col(agent)).rlike(marks), name).otherwise(out)
    return out


def pdf_date(raw: Column | str) -> Column:
    """D:YYYYMMDDhhmmss as ISO; what doesn't parse stays."""
    digits = F.regexp_extract(_col(raw), r"^(?:D:)?(\d{14})", 1)
    return F.coalesce(F.date_format(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss")), "yyyy-MM-dd'T'HH:mm:ss"), _col(raw))


def cell_text(value: Column | str) -> Column:
    """A spreadsheet cell's text: null to nothing, whole floats without their zeros."""
    return F.coalesce(F.regexp_replace(_col(value), r"^(-?\d+)\.0+$", "$1"), F.lit(""))


def column_width(n: Column | str) -> Column:
    return F.least(F.greatest(F.lit(3), _col(n)), F.lit(50))
