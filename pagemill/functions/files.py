"""File contents as columns: image formats by their first bytes, data URIs, file metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Image formats and the hexadecimal forms of their first bytes.
MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "bmp": "424D", "tiff": "49492A00|4D4D002A", "webp": "52494646.{8}57454250"}


def image_format(content: Column) -> Column:
    """png, jpeg, gif, bmp, tiff or webp by the first bytes, else null."""
    head, out = F.hex(F.substring(content, 1, 12)), F.lit(None).cast("string")
    for name, start in MAGIC.items():
        out = F.when(head.rlike(f"^(?:{start})"), name).otherwise(out)
    return out


def is_image(content: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Whether the bytes are those of an image, of one of the formats if some are named."""
    found = image_format(content)
    return F.coalesce(found.isin(*[x.lower() for x in allowed]) if allowed else found.isNotNull(), F.lit(False))


def data_uri(content: Column, most_kb: int = 500) -> Column:
    """An image as a data URI with its own type; null for what isn't an image or is larger than most_kb (images aren't scaled)."""
    small = F.octet_length(content) <= most_kb * 1024
    return F.when(small & is_image(content), F.concat(F.lit("data:image/"), image_format(content), F.lit(";base64,"), F.base64(content)))


def file_metadata(path: Column, content: Column) -> Column:
    """Size, extension with its dot in lower case, name and sha256 of a file."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.struct(
        F.octet_length(content).cast("long").alias("size_bytes"), F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)).alias("extension"),
        name.alias("filename"), F.sha2(content, 256).alias("sha256"),
    )
