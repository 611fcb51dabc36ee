"""What SQL users see: table functions that take a page or a text apart, and a data source of page captures."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagemill.operators import chunk, dom


class MarkdownChunks:
    """The chunks of one Markdown text."""

    def eval(self, text: str) -> Iterator[tuple]:
        for i, (content, path, language, code) in enumerate(chunk.markdown_parts(text or "")):
            yield i, content, "code" if code else "text", language, path


class SentenceChunks:
    """The chunks of one text by sentences, of `size` words with `overlap` words of the chunk before."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        for i, (content, n) in enumerate(chunk.sentence_parts(text or "", size, overlap, 12)):
            yield i, content, n


class PageLinks:
    """The links of one page."""

    def eval(self, html: str) -> Iterator[tuple]:
        for n in dom.parse(html or "").walk():
            if n.tag == "a" and n.attrs.get("href"):
                yield n.attrs["href"], n.text(), n.attrs.get("rel", "")


class PageMetadata:
    """What one page says of itself."""

    def eval(self, html: str) -> Iterator[tuple]:
        yield from dom.metadata(dom.parse(html or "")).items()


class Captures(DataSource):
    """Pages captured as JSON lines (url, html, status), one file a split: spark.read.format("page_captures").load(path).

    The paths are opened by the executors, so the folder must be one that all of them see. Lines that don't parse are rows
    with an error.
    """

    @classmethod
    def name(cls) -> str:
        return "page_captures"

    def schema(self) -> str:
        return "url string, html string, status int, error string"

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options)


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "*.jsonl"))) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(x) for x in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8", errors="replace") as lines:
            for line in filter(str.strip, lines):
                try:
                    page = json.loads(line)
                    yield page.get("url"), page.get("html"), int(page.get("status") or 200), None
                except (ValueError, AttributeError) as e:
                    yield None, None, None, f"{type(e).__name__}: {e}"


#: Table functions by name, with the columns that they give.
FUNCTIONS = {
    "markdown_chunks": (MarkdownChunks, "position int, content string, type string, code_language string, path array<string>"),
    "sentence_chunks": (SentenceChunks, "position int, content string, sentences int"),
    "page_links": (PageLinks, "href string, text string, rel string"),
    "page_metadata": (PageMetadata, "key string, value string"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions and the source known by name to a session."""
    for name, (handler, columns) in FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(handler, returnType=columns))
    spark.dataSource.register(Captures)
