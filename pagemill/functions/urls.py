"""URL functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def authority(url: Column) -> Column:
    """Host with port; null for what isn't an absolute URL."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def strip(url: Column) -> Column:
    """Without parameters, query and fragment."""
    return F.regexp_replace(url, r"[;?#].*$", "")


def _without_dots(path: Column) -> Column:
    """Removes . and .. segments of a path that starts with a slash."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))),
    )
    tail = F.element_at(parts, -1)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(tail.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def join(link: Column, base: Column) -> Column:
    """A link resolved against the page it stands on, stripped; null if either is null or the base isn't absolute.

    Other schemes than those of the base stay as they are: filters on the host drop them.
    """
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#;]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    base_path = F.regexp_replace(strip(base), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    link = F.regexp_replace(strip(F.trim(link)), r"\s+$", "")
    absolute = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
    resolved = (
        F.when(link == "", F.concat(root, base_path))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, _without_dots(link)))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, link))))
    )
    return F.coalesce(absolute, F.when(root != "", resolved))


def is_web(url: Column) -> Column:
    """http or https with a host."""
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & (F.coalesce(authority(url), F.lit("")) != ""), F.lit(False))


def collection_id(url: Column) -> Column:
    """The host and the first 8 hex digits of the address's md5."""
    return F.concat_ws("_", authority(url), F.substring(F.md5(url.cast("binary")), 1, 8))


def image_name(src: Column) -> Column:
    """Last path segment without its query."""
    return F.split_part(F.element_at(F.split(src, "/"), -1), F.lit("?"), F.lit(1))


def admitted(url: Column, host: Column | None = None, exclude: tuple[str, ...] = (), include: tuple[str, ...] = ()) -> Column:
    """Same host if one is given, no exclude pattern found, and some include pattern if there are any; exclude wins."""
    ok = F.lit(True) if host is None else F.coalesce(authority(url) == host, F.lit(False))
    if exclude:
        ok = ok & ~url.rlike("|".join(f"(?:{p})" for p in exclude))
    if include:
        ok = ok & url.rlike("|".join(f"(?:{p})" for p in include))
    return ok
