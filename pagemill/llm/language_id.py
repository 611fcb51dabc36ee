"""Language identification by compression.

For each language, excerpts of its training documents are joined to a raw-content zstandard dictionary. A text is cut into
blocks, every block is compressed with every dictionary, and the language with the smallest total wins: its dictionary
holds most of the text's sequences. Blocks keep the dictionary's weight in long texts, whose later parts would otherwise
be compressed against their own beginning. A prediction whose margin over the second-best is narrow is rejected.

Every language of the training rows gets a dictionary; what is fitted of each is bounded: `slots` excerpts of `excerpt`
characters. A slot gets the excerpt whose document has the least hash, so the choice does not depend on the
partitioning. The dictionaries (slots * excerpt characters of a language at most) are all that goes to the driver and is
broadcast. A task holds the compressors of GROUP languages at a time and compares all of them.

Defined results: a text that is null or has no letter is `und` with score 0; so is every text where nothing could be
learned; ties go to the more frequent language; repeated rows get equal results; a very long text is compressed whole, a
block at a time (a batch of texts is bounded by Spark's spark.sql.execution.arrow.maxBytesPerBatch); an empty table gives an
empty one. classify() carries columns of any name; one that bears a result's name gives way, unless a prefix keeps them apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
#: Bytes of a block, the compression level, and the margin per byte below which a prediction is rejected.
BLOCK, LEVEL, NARROW = 2048, 6, 0.004
#: Languages whose compressors are held at a time.
GROUP = 64
_LETTER = regex.compile(r"\p{L}")


def learn(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", slots: int = 192, excerpt: int = 512) -> dict[str, bytes]:
    """Each language's dictionary, the most frequent language first, from the rows for which `train` holds."""
    text = F.lower(F.col(text_col))
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    h = F.xxhash64(F.lit("excerpt"), F.col(id_col), text)
    start = F.pmod(F.xxhash64(F.col(id_col), F.lit("start")), F.greatest(F.length(text) - excerpt, F.lit(0)) + 1) + 1
    pick = F.struct(h.alias("h"), F.substring(text, start.cast("int"), F.lit(excerpt)).alias("piece"))
    picked = rows.select(F.col(lang_col).alias("lang"), F.pmod(h, F.lit(slots)).alias("slot"), pick.alias("pick"))
    frequent = picked.groupBy("lang").count()
    best = picked.groupBy("lang", "slot").agg(F.min("pick").alias("pick")).join(frequent, "lang")
    out: dict[str, list] = {}
    for r in best.select("lang", "slot", "count", "pick.piece").orderBy(F.desc("count"), "lang", "slot").collect():
        out.setdefault(r.lang, []).append(r.piece)
    return {lang: " ".join(pieces).encode() for lang, pieces in out.items()}


def _packers(contents: list[bytes]) -> list:
    import zstandard as z

    packers = []
    for content in contents:
        trained = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        trained.precompute_compress(level=LEVEL)
        packers.append(z.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False))
    return packers


def _sizes(text: bytes, packers: list) -> np.ndarray:
    """Compressed bytes of a text by each packer, block by block; cuts fall on blanks near the block's end, if any."""
    total, at = np.zeros(len(packers)), 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text) and (blank := text.rfind(b" ", at + BLOCK // 2, end)) > 0:
            end = blank
        block = text[at:end]
        total += [len(p.compress(block)) for p in packers]
        at = end
    return total


def classify(
    docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", narrow: float = NARROW, prefix: str = "", reject: bool = True
) -> DataFrame:
    """docs with lang_pred (the smallest language; `und` where its margin is narrow, unless reject is false), score (0 to 1) and
    rejected (narrow margin)."""
    names = list(dictionaries)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    added = [f"{prefix}{c}" for c in ("lang_pred", "score", "rejected")]
    docs = docs.drop(*added)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema, *(T.StructField(c, t) for c, t in zip(added, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents = list(shared.value.values())
        held = _packers(contents) if len(contents) <= GROUP else None
        for batch in batches:
            langs, scores, rejected = [], [], []
            texts = [text.lower().encode() if contents and text is not None and _LETTER.search(text) else None for text in batch.column(at).to_pylist()]
            total = np.zeros((len(texts), len(contents)))
            for first in range(0, len(contents), GROUP):
                packers = held or _packers(contents[first : first + GROUP])
                for i, data in enumerate(texts):
                    if data is not None:
                        total[i, first : first + GROUP] = _sizes(data, packers)
            for data, sizes in zip(texts, total, strict=True):
                if data is None:
                    langs.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                best = int(sizes.argmin())
                # Bytes saved over each other language, a byte of text, as evidence of a logistic choice.
                evidence = (sizes - sizes[best]) / len(data)
                score = 1 / np.exp(-60 * evidence).sum()
                margin = np.partition(evidence, 1)[1] if len(evidence) > 1 else 1.0
                close = bool(margin < narrow)
                langs.append(UNKNOWN if close and reject else names[best]), scores.append(float(score)), rejected.append(close)
            columns = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    return docs.mapInArrow(run, schema)
