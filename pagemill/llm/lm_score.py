"""Subword lattice likelihood: the log-probability of a text, summed over all its segmentations.

The pieces of an existing vocabulary span a lattice over the bytes of each word (a blank leads the word, all 256 bytes are
pieces, so any text has a path). A log-space forward recursion sums the weights of all paths, so that no single
segmentation stands for the text. As no piece crosses a blank, the lattice of a document is the chain of its words'
lattices, and a word's sum is needed once, wherever the word stands.

Weights. The vocabulary file's scores are ranks, not probabilities; 1 / (10 + rank) is where expectation-maximisation
starts, over all distinct training words (forward and backward recursions, expected counts summed over the cluster).
Pieces that lead a word and pieces that go on, with the stop, are two distributions of sum 1. A word seen c times in training
is an arc of its lattice too, one that spans it whole: P(w) = (c - d) / N + d T / N * P_pieces(w), with T distinct tokens, N
tokens and d from the counts of counts, n1 / (n1 + 2 n2). That is a proper distribution over texts. Of a known word most of
the sum is on that arc; of an unknown one all is on the pieces. `score` is the sum over the whole lattice, `lattice_score`
that over the pieces alone, in which every text is spelled.

Word counts are a distributed table that grows with the corpus; nothing of it is sampled. Only the `frequent` words seen most
often are broadcast, with the weights of the vocabulary's pieces; words of over 64 bytes stand there by their sha256, so that
the broadcast is bounded in bytes. All others are joined by word, pre-aggregated within each document.

Defined results: a null or blank text is its end alone; repeated rows get equal scores; without training rows the base is
log10(1) a token and the lattice stands alone; a very long text is split into words in its task (a batch of texts is bounded
by Spark's spark.sql.execution.arrow.maxBytesPerBatch), and rows of its words go on 200,000 at a time; an empty table gives
an empty result. Only the columns named are read, whatever others there are.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import cut

#: Bounds of a task's memory: distinct words counted before they are sent on, and their bytes; bytes of a broadcast word.
HELD_WORDS, HELD_BYTES, SHORT = 400_000, 64 << 20, 64
#: Added to every expected count.
PRIOR = 0.01


def vocabulary(path: str) -> list[tuple[bytes, float]]:
    """(piece, starting weight) of a sentencepiece model: a leading blank marks word starts; bytes are always there."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    out: dict[bytes, float] = {}
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and b" " not in piece[1:]:
            out.setdefault(piece, 1 / (10 + max(0.0, -model.get_score(i))))
    for b in range(256):
        out.setdefault(bytes([b]), 1 / (10 + model.vocab_size()))
    return sorted(out.items())


class Lattice:
    """Forward and backward recursions over words of equal length at a time, in arrays."""

    _STEP = np.uint64(0x100000001B3)

    def __init__(self, pieces: list[bytes], weights: np.ndarray, stop: float):
        """weights: natural log-probabilities of the pieces, one more entry is made for what isn't a piece."""
        self.longest = max(map(len, pieces))
        hashes = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for b in p:
                    h = (h + np.uint64(b + 1)) * self._STEP
            hashes[i] = h ^ np.uint64(len(p))
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if len(np.unique(self.hashes)) < len(pieces):
            raise ValueError("two pieces have one hash")
        self.weights, self.stop = np.append(weights, -np.inf), stop

    def _found(self, words: list[bytes]) -> np.ndarray:
        """For words of one length L: the piece at each start and length, or the entry for none."""
        raw = np.frombuffer(b"".join(b" " + w for w in words), np.uint8).reshape(len(words), -1)
        n = raw.shape[1]
        most = min(n, self.longest)
        ids = np.full((len(words), n, most), len(self.weights) - 1, np.int32)
        h = np.zeros((len(words), n), np.uint64)
        for k in range(most):
            h[:, : n - k] = (h[:, : n - k] + (raw[:, k:].astype(np.uint64) + np.uint64(1))) * self._STEP
            key = h[:, : n - k] ^ np.uint64(k + 1)
            at = np.minimum(np.searchsorted(self.hashes, key), len(self.hashes) - 1)
            ids[:, : n - k, k] = np.where(self.hashes[at] == key, self.order[at], len(self.weights) - 1)
        return ids

    @staticmethod
    def _sum(x: np.ndarray) -> np.ndarray:
        most = x.max(1)
        base = np.where(np.isfinite(most), most, 0)
        with np.errstate(divide="ignore"):
            return base + np.log(np.exp(x - base[:, None]).sum(1))

    def _forward(self, weights: np.ndarray) -> np.ndarray:
        size, n, most = weights.shape
        alpha = np.full((size, n + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, n + 1):
            i = np.arange(max(0, j - most), j)
            alpha[:, j] = self._sum(alpha[:, i] + weights[:, i, j - i - 1])
        return alpha

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural log-probabilities, all segmentations summed, of words of one length."""
        return self._forward(self.weights[self._found(words)])[:, -1] + self.stop

    def expected(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words of one length."""
        ids = self._found(words)
        weights = self.weights[ids]
        size, n, most = weights.shape
        alpha, beta = self._forward(weights), np.full((size, n + 1), -np.inf)
        beta[:, n] = 0
        for i in range(n - 1, -1, -1):
            k = np.arange(min(most, n - i))
            beta[:, i] = self._sum(beta[:, i + k + 1] + weights[:, i, k])
        total = alpha[:, -1]
        for k in range(most):
            post = alpha[:, : n - k] + weights[:, : n - k, k] + beta[:, k + 1 :]
            weights[:, : n - k, k] = np.exp(post - total[:, None]) * times[:, None]
            weights[:, n - k :, k] = 0
        return np.bincount(ids.ravel(), weights.ravel(), minlength=len(self.weights))[:-1]


def _by_length(words: list[bytes], cells: int = 400_000) -> Iterator[np.ndarray]:
    """Places of words of equal length, in groups of bounded arrays."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(same):
            n = int(lengths[same[0]]) + 1
            step = max(1, cells // (n * min(n, 25)))
            for at in range(0, len(same), step):
                yield same[at : at + step]


def held_key(word: bytes) -> bytes:
    """By what a word is found among the broadcast ones."""
    return word if len(word) <= SHORT else hashlib.sha256(word).digest()


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, training) to (word, training count): 0 for words of other rows."""
    held: Counter = Counter()
    size = 0

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
        held.clear()
        return batch

    for batch in batches:
        for text, train in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = tokens(text.as_py())
            if train:
                held.update(words)
            else:
                for w in words:
                    held.setdefault(w, 0)
            size += len(text.as_py() or b"")
            if len(held) >= HELD_WORDS or size >= HELD_BYTES and len(held) * 16 >= HELD_WORDS:
                yield out()
                size = 0
    yield out()


def word_counts(docs: DataFrame, train: Column, text_col: str = "text") -> DataFrame:
    """(word, c) of all words of all rows, c being the count in training rows."""
    rows = docs.select(F.col(text_col).cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return rows.mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _normal(counts: np.ndarray, pieces: list[bytes], words: float) -> tuple[np.ndarray, float]:
    """Log-probabilities of the pieces and of the stop: leading pieces sum to 1, the others with the stop too."""
    lead = np.array([p[:1] == b" " for p in pieces])
    # Used at word starts only, resp. never there: a lone blank byte is a leading piece.
    more = (counts[~lead] + PRIOR).sum() + words + PRIOR
    out = np.log(counts + PRIOR)
    out[lead] -= math.log((counts[lead] + PRIOR).sum())
    out[~lead] -= math.log(more)
    return out, math.log((words + PRIOR) / more)


def fit(words: DataFrame, path: str, rounds: int = 2) -> tuple[list[bytes], np.ndarray, float]:
    """Piece weights by expectation-maximisation over all distinct training words."""
    start = vocabulary(path)
    pieces = [p for p, _ in start]
    first = np.array([w for _, w in start])
    weights, stop = _normal(first * 1e4, pieces, float(first.sum() * 1e4) * 0.3)
    context = words.sparkSession.sparkContext
    seen = words.where("c > 0").select("word")
    for _ in range(rounds):
        shared = context.broadcast((pieces, weights, stop))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, total, n = Lattice(*shared.value), np.zeros(len(shared.value[0])), 0
            for batch in batches:
                found = batch.column(0).to_pylist()
                n += len(found)
                for at in _by_length(found):
                    total += lattice.expected([found[i] for i in at], np.ones(len(at)))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *used], pa.int32()), pa.array([n, *total[used]], pa.float64())], ["piece", "uses"])

        # At most one row a piece of the vocabulary; rounded, so that reruns agree whatever the order of the sums.
        sums = seen.mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.round(F.sum("uses"), 3).alias("uses")).toPandas()
        counts, n = np.zeros(len(pieces)), 0.0
        for piece, uses in zip(sums["piece"], sums["uses"], strict=True):
            if piece < 0:
                n = float(uses)
            else:
                counts[piece] = uses
        shared.unpersist()
        if not n:
            break
        weights, stop = _normal(counts, pieces, n)
    return pieces, weights, stop


class _Rows:
    """Columns of rows that are sent on: the place of the row in its batch, then `parts` of score()."""

    def __init__(self):
        self.at, self.columns = [], [[] for _ in range(7)]

    def add(self, at: int, *values) -> None:
        self.at.append(at)
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)

    def batch(self, of: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
        at = pa.array(self.at, pa.int64())
        kinds = [pa.int64()] * 3 + [pa.float64()] * 3 + [pa.binary()]
        return pa.RecordBatch.from_arrays([*[of.column(k).take(at) for k in range(3)], *[pa.array(x, kind) for x, kind in zip(self.columns, kinds, strict=True)]], names)


def score(docs: DataFrame, train: Column, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = 100_000, rounds: int = 2) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and lattice_score of every row."""
    spark = docs.sparkSession
    train = F.coalesce(train, F.lit(False))
    counts = cut(word_counts(docs, train, text_col))
    of_counts = cut(counts.groupBy("c").agg(F.count("*").alias("n")))
    sums = of_counts.where("c > 0").agg(F.coalesce(F.sum(F.col("c") * F.col("n")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    by_count = {r.c: r.n for r in of_counts.where("c in (1, 2)").collect()}
    ends = docs.where(train).count()
    total, types = sums[0] + ends, sums[1] + (ends > 0)
    n1, n2 = by_count.get(1, 0), by_count.get(2, 0)
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    rest = d * types / total if total else 0.5
    end = ((ends - d) / total) if ends else 0.5
    pieces, weights, stop = fit(counts, path, rounds)
    shared = spark.sparkContext.broadcast((pieces, weights, stop))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            found, c = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float)
            out = np.zeros(len(found))
            for at in _by_length(found):
                out[at] = lattice.score([found[i] for i in at])
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(0, c - d) / max(total, 1))
            both = np.logaddexp(whole, out + math.log(rest)) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(both), pa.array(out / math.log(10))], ["word", "c", "logp", "pieces"])

    known = cut(counts.mapInArrow(named, "word binary, c long, logp double, pieces double"))

    # The least count at which the words at or above it are few enough: found on the counts of counts.
    least, many = None, 0
    for r in of_counts.where("c > 0").orderBy(F.desc("c")).toLocalIterator():
        many += r.n
        if many > frequent:
            break
        least = r.c
    key = F.when(F.octet_length("word") <= SHORT, F.col("word")).otherwise(F.unhex(F.sha2("word", 256)))
    top = known.where(F.col("c") >= least).select(key.alias("word"), "c", "logp", "pieces").toPandas() if least else None
    top = zip(*(top[x] for x in ("word", "c", "logp", "pieces")), strict=True) if least else ()
    common = {bytes(w): (math.log10(c + 1), logp, pieces) for w, c, logp, pieces in top}
    common = spark.sparkContext.broadcast(common)
    least_log = math.log10(total + types + 1)

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), (~train).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    head = list(rows.schema)[:3]
    parts = [("copies", T.LongType()), ("n", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("logp", T.DoubleType()), ("pieces", T.DoubleType()), ("word", T.BinaryType())]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with the sums of its frequent words, and one for each other word of it."""
        table = common.value
        for batch in batches:
            out = _Rows()
            for i, text in enumerate(batch.column(3)):
                found = tokens(text.as_py())
                hits = [x for x in map(table.get, map(held_key, found)) if x]
                out.add(i, 1, len(found), len(hits), *(math.fsum(x[k] for x in hits) for k in range(3)), None)
                if len(hits) < len(found):
                    for w, times in Counter(w for w in found if held_key(w) not in table).items():
                        out.add(i, 0, times, 0, 0.0, 0.0, 0.0, w)
                        if len(out.at) > 200_000:
                            yield out.batch(batch, names)
                            out = _Rows()
            yield out.batch(batch, names)

    names = [f.name for f in head] + [x for x, _ in parts]
    split = cut(rows.mapInArrow(looked_up, T.StructType([*head, *(T.StructField(x, t) for x, t in parts)])))
    keys = ["id", "mark", "held_out"]
    seen = known.select("word", "c", F.col("logp").alias("_logp"), F.col("pieces").alias("_pieces"))
    others = split.where("word is not null").join(seen, "word").select(
        *keys, F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("n"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"),
        (F.col("n") * F.log10(F.col("c") + 1.0)).alias("base"), (F.col("n") * F.col("_logp")).alias("logp"), (F.col("n") * F.col("_pieces")).alias("pieces"),
    )
    # Of equal rows, the words were taken once a row; so were their tokens.
    whole = split.where("word is null").drop("word").unionByName(others)
    add = [F.sum(c).alias(c) for c in ("copies", "n", "known", "base", "logp", "pieces")]
    each = whole.groupBy(*keys).agg(*add).withColumn("_one", F.explode(F.expr("sequence(1L, copies)")))
    n_tokens = F.expr("n div copies") + 1
    base = F.col("base") / F.col("copies") + math.log10(ends + 1) - n_tokens * least_log
    return each.select(
        F.col("id").alias(id_col), "held_out", n_tokens.alias("n_tokens"), (F.expr("known div copies") + int(ends > 0)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("logp") / F.col("copies") + math.log10(end)).alias("score"),
        (F.col("pieces") / F.col("copies") + math.log10(end)).alias("lattice_score"),
    )
