"""Chunkers: Markdown by headers and fences, sentences, packed paragraphs, fixed slices; and the flat chunk record."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as tx

FENCE, HEADER = "```", re.compile(r"(#{1,6}) ")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def chunk_id(*parts: Column) -> Column:
    """A stable id from what the chunk is."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def _fence(line: str) -> bool:
    return line.strip().startswith(FENCE)


def markdown_parts(text: str) -> Iterator[tuple[str, list[str], str | None, bool]]:
    """(content, path of headers, code language, whether it is code) of each part of a Markdown text, in order.

    One pass over the lines: a header or an opening fence ends what is held, a closing fence ends itself.
    """
    held: list[str] = []
    path: list[tuple[int, str]] = []
    language, in_code = None, False

    def part(code: bool) -> Iterator[tuple[str, list[str], str | None, bool]]:
        content = "\n".join(x.rstrip(" \t") for x in held).strip()
        if content:
            yield content, [h for _, h in path], language if code else None, code
        held.clear()

    for line in text.split("\n"):
        if _fence(line):
            if in_code:
                held.append(line)
                yield from part(True)
            else:
                yield from part(False)
                held.append(line)
                language = line.strip()[3:].strip() or None
            in_code = not in_code
        elif not in_code and (found := HEADER.match(line)):
            yield from part(False)
            level = len(found[1])
            path = [x for x in path if x[0] < level] + [(level, line[level:].strip())]
        else:
            held.append(line)
    yield from part(in_code)


def sentence_parts(text: str, size: int, overlap: int, least: int) -> Iterator[tuple[str, int]]:
    """(content, number of sentences) of each chunk of sentences, in order."""
    sentences, short = [], ""
    for x in filter(None, (x.strip(" ") for x in SENTENCE_END.split(text))):
        short += x
        if len(short) < least:
            short += " "
        else:
            sentences.append(short)
            short = ""
    if short.strip(" "):
        sentences.append(short.strip(" "))
    held: list[tuple[str, int]] = []
    words = 0
    for x in sentences:
        n = len(x.split())
        if held and words + n > size:
            yield " ".join(s for s, _ in held), len(held)
            # The longest end of the chunk within the overlap, shorter than the chunk, leads the next one.
            keep, kept = 0, 0
            while keep + 1 < len(held) and kept + held[-keep - 1][1] <= overlap:
                kept += held[-keep - 1][1]
                keep += 1
            held, words = held[len(held) - keep :], kept
        held.append((x, n))
        words += n
    if held:
        yield " ".join(s for s, _ in held), len(held)


def _parts(docs: DataFrame, id_col: str, text_col: str, schema: str, split) -> DataFrame:
    """(id, position, and the columns of a schema) of the parts that `split` makes of each text: Arrow-batched, one pass."""

    @F.pandas_udf(f"array<struct<{schema}>>")
    def run(texts: pd.Series) -> pd.Series:
        names = [x.split(":")[0] for x in re.split(r",(?=\w+:)", schema)]
        return pd.Series([[dict(zip(names, x, strict=True)) for x in split(t)] if t else [] for t in texts], dtype=object)

    return docs.select(F.col(id_col), F.posexplode(run(F.col(text_col))).alias("position", "_part")).select(id_col, "position", "_part.*")


def markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "markdown", min_words: int = 64, max_words: int = 512, strict_size: bool = False) -> DataFrame:
    """Chunks by header lines and code fences, with the stack of headers that they stand under.

    A header or an opening fence starts a chunk, and so does the line after a closing fence; headers inside fences are
    text. Text before the first header is a chunk of its own. Chunks without content are dropped before they are numbered.
    parent_id names the section above: a hash of the document and the path of its headers.
    Rows are chunked one by one: rows of one id stay apart, and a null text has no chunks.
    """
    found = _parts(docs, id_col, text_col, "content:string,path:array<string>,code_language:string,code:boolean", markdown_parts)
    words = tx.word_count("content")
    exempt = F.col("code") | (F.size("path") == 0)
    if not strict_size:
        exempt = exempt | (F.size("path") > 0)
    of_code = F.col("code")
    return found.select(
        id_col, "position", chunk_id(F.col(id_col), F.col("position"), F.col("content")).alias("chunk_id"), "content",
        F.when(of_code, "code").otherwise(tx.chunk_type("content")).alias("type"), "code_language",
        F.try_element_at("path", F.lit(-1)).alias("heading"), F.size("path").alias("level"), "path",
        F.when(F.size("path") > 1, chunk_id(F.col(id_col), F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), "\n"))).alias("parent_id"), words.alias("word_count"),
        F.regexp_count("content", F.lit("\n")).cast("int").alias("_lines"),
        tx.preview("content").alias("content_preview"), tx.has_code("content").alias("has_code"), tx.has_lists("content").alias("has_lists"),
        tx.has_links("content").alias("has_links"), tx.read_time(words).alias("estimated_read_time"),
        (~exempt & (words < min_words)).alias("needs_merge"), (~exempt & (words > max_words)).alias("needs_split"),
    ).withColumn("line_count", F.col("_lines") + 1).drop("_lines")


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 512, overlap: int = 50, least: int = 12) -> DataFrame:
    """Sentences filled greedily up to `size` words, each chunk led by the last ones of the chunk before, up to `overlap` words."""
    found = _parts(docs, id_col, text_col, "content:string,sentence_count:int", lambda t: sentence_parts(t, size, overlap, least))
    return found.select(id_col, "position", "content", F.lit("text").alias("type"), tx.word_count("content").alias("word_count"), "sentence_count")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4000, separator: str = "\n\n") -> DataFrame:
    """Paragraphs packed greedily while their characters (separators not counted) stay within the limit."""
    parts = F.filter(F.split(text_col, separator), lambda x: F.trim(x) != "")
    packed = F.aggregate(
        parts, F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n")),
        lambda a, x: F.when((F.size(a["now"]) > 0) & (a["n"] + F.length(x) > limit), F.struct(F.concat(a["done"], F.array(a["now"])).alias("done"), F.array(x).alias("now"), F.length(x).alias("n"))).otherwise(
            F.struct(a["done"].alias("done"), F.concat(a["now"], F.array(x)).alias("now"), (a["n"] + F.length(x)).alias("n"))
        ),
        lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]),
    )
    out = docs.select(F.col(id_col), F.posexplode(packed).alias("position", "_parts"))
    return out.withColumn("content", F.array_join("_parts", separator)).drop("_parts")


def fixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 1000) -> DataFrame:
    return docs.select(F.col(id_col), F.posexplode(tx.fixed_slices(F.col(text_col), n)).alias("position", "content"))


KINDS = {"semantic": markdown, "sentence": sentences, "paragraph": paragraphs, "fixed": fixed}


def chunk(docs: DataFrame, kind: str = "semantic", **how) -> DataFrame:
    """Dispatch by kind; any other name is the semantic chunker."""
    return KINDS.get(kind, markdown)(docs, **how)


def stats(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return chunks.groupBy(id_col).agg(F.count("*").alias("total_chunks"), F.coalesce(F.avg("word_count"), F.lit(0.0)).alias("avg_chunk_size"))


def records(chunks: DataFrame, key_col: str = "doc_id", url: Column | None = None, processed_at: Column | None = None) -> DataFrame:
    """Flat chunk records of twelve fields: number from 1 and total within the key, defaults for what a chunk lacks.

    A chunk without an id gets one of its key, position and content; the address is the key unless `url` is given.
    """
    have = set(chunks.columns)
    by = Window.partitionBy(key_col)
    pick = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
    none = F.lit(None).cast("string")
    return chunks.select(
        key_col, pick("chunk_id", chunk_id(F.col(key_col), F.col("position"), F.col("content"))).alias("chunk_id"), (F.col(key_col).cast("string") if url is None else url).alias("url"),
        F.row_number().over(by.orderBy("position")).alias("chunk_number"), F.count("*").over(by).alias("total_chunks"), F.coalesce("content", F.lit("")).alias("chunk_content"),
        pick("type", F.lit("text")).alias("chunk_type"), F.coalesce((none if processed_at is None else processed_at).cast("string"), F.lit("")).alias("timestamp"),
        pick("word_count", tx.word_count("content")).alias("word_count"), F.col("position"), pick("type", F.lit("text")).alias("content_type"),
        pick("heading", none).alias("heading"), pick("code_language", none).alias("code_language"),
    )
