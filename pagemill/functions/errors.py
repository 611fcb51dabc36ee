"""Failures as values: what went wrong, as rows carry it and answers give it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of errors with their codes, statuses and messages; {} stand for details by name.
ERRORS = {
    "scraper": ("SCRAPER_ERROR", 500, "{message}"),
    "url_fetch": ("URL_FETCH_ERROR", 400, "Failed to fetch URL: {url}"),
    "content_extraction": ("CONTENT_EXTRACTION_ERROR", 500, "Failed to extract content"),
    "browser": ("BROWSER_ERROR", 500, "Browser operation failed: {action}"),
    "rate_limit": ("RATE_LIMIT_EXCEEDED", 429, "Rate limit of {limit} requests per {period} seconds exceeded"),
    "validation": ("VALIDATION_ERROR", 422, "Request validation failed"),
    "configuration": ("CONFIGURATION_ERROR", 500, "Configuration error: {parameter}"),
    "resource_cleanup": ("RESOURCE_CLEANUP_ERROR", 500, "Failed to cleanup {resource_type}"),
    "timeout": ("TIMEOUT_ERROR", 408, "Operation timed out: {operation}"),
    "file_conversion": ("FILE_CONVERSION_ERROR", 500, "File conversion failed: {reason}"),
    "file_size": ("FILE_SIZE_EXCEEDED", 413, "File size ({size_mb}MB) exceeds limit of {limit_mb}MB"),
}


def error(kind: Column, details: Column) -> Column:
    """struct(code, message, status, details) of a kind and a map of details; unknown kinds are those of the first one."""
    code, status, message = (F.lit(x).cast(t) for x, t in zip(ERRORS["scraper"], ("string", "int", "string"), strict=True))
    for name, (c, s, m) in ERRORS.items():
        code, status, message = F.when(kind == name, c).otherwise(code), F.when(kind == name, s).otherwise(status), F.when(kind == name, m).otherwise(message)
    told = F.aggregate(F.map_entries(details), message, lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
    return F.struct(code.alias("code"), told.alias("message"), status.alias("status"), details.alias("details"))
