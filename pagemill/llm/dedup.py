"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Sketch. In round i every shingle is thrown into a bin with a value; a bin keeps the least (round, value) it ever gets.
Rounds 0 to t-1 throw at random, rounds t to 2t-1 throw everything into bin i - t, so after 2t rounds each of the t
coordinates is filled, whatever the set's size; rounds end as soon as all are. Two sketches agree in a coordinate with
probability equal to the Jaccard similarity, and the number of agreements is concentrated at least as well as for t
independent MinHash values.

Threshold. The similarity from which pairs are linked is a parameter, in percent; a Banding holds what follows from it: the
number of bands, the length of the sketches and the bound of the sketch test. Verification and size filters use the percent.

Candidates. A sketch is banded (bands of ROWS coordinates each). Documents with equal shingle sets are one class from the
start. In each bucket, all classes are compared with one centre (the first of its classes by hash, so that the bands of a
large group agree on few centres), never all with all. Verified links make components. Buckets that still hold classes
of different components are compared with further centres, in CENTRES rounds at most, each a class from outside the bucket's
largest component. What is then left of different components are the classes outside the largest one (the minority), which
are to be compared with all. A bucket of more than HOT classes is first split by a second band, as a similar pair shares two. Then minority and
classes are dealt over block pairs, of bounded numbers of classes and shingles; each pair of classes of different components
is looked at in the first bands that it shares, and passes on if its sketches agree often enough (a bound that a pair at the
threshold misses with a probability of about 1e-8). What passes is verified on the full sets; a block pair in which more
pairs than rows pass is verified within its task, by one product of its sets' matrices, and returns only the links that join
components. So no bucket is capped. Rows of the block pairs of a bucket are its classes times its minority over BLOCK: as
many as its classes as long as the minority fills one block, but more where a large bucket holds many components, whatever
its two bands, whose members no centre has linked.

A pair at the threshold s shares fewer than two of the bands with probability MISS at most: 34 bands at 0.85, 49 at 0.80.

Hot buckets. A bucket of more than a 50,000th of all banded rows is hot; there are fewer than 50,000 of these, whatever the
data, so they are broadcast to the rows; all others are joined by bucket, none of them with more rows than that.

Components are found by repeated least-neighbour propagation with shortcuts over the verified links, each round written to the
shared folder; nothing about documents is collected on the driver but row counts.

Defined results: a null or blank text has an empty set and is linked with nothing; with fewer than 5 words the whole
sequence is the one shingle; repeated rows are one class; a document whose id is null is returned alone, kept and without
component; equal ids are one document for the purpose of component_id; a very long text is hashed whole in its task (a
batch of texts is bounded by Spark's spark.sql.execution.arrow.maxBytesPerBatch) and counts with its shingles in a block; an
empty table gives an empty result. near_duplicates() returns its own columns, deduplicate() those of docs, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import BROADCAST_ROWS, WORD, Renamed, cut, drop, joined

SHINGLE = 5
#: Coordinates of a band, and the largest probability that a pair at the threshold shares fewer than two bands.
ROWS, MISS = 5, 1e-7
#: Rows, and shingles, of one side of a block pair, about; classes of a bucket beyond which a second band splits it.
BLOCK, BLOCK_SHINGLES, HOT = 1024, 1 << 19, 4096
#: Columns of the matrices of a block pair at a time.
COLUMNS = 2048
#: Rounds of centres in buckets of several components, the last one without a new centre.
CENTRES = 2
#: The threshold unless another is given; links hold at 100 * intersection >= percent * union.
PERCENT = 85


@dataclass(frozen=True)
class Banding:
    """What follows from a threshold."""

    percent: int
    bands: int
    coordinates: int
    #: Fewest agreeing coordinates of a pair that is verified: 6 standard deviations below the mean at the threshold.
    agree: int


def banding(percent: int) -> Banding:
    s, bands = percent / 100, 1
    p = s**ROWS
    while (1 - p) ** bands + bands * p * (1 - p) ** (bands - 1) > MISS:
        bands += 1
    t = bands * ROWS
    return Banding(percent, bands, t, int(t * s - 6 * (t * s * (1 - s)) ** 0.5))


COORDINATES, AGREE = banding(PERCENT).coordinates, banding(PERCENT).agree

_U = np.uint64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_ROUND = _U(0xA24BAED4963EE407)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        value = xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= 100_000:
                self.clear()
            self[word] = value
        return value


_HASHES = _WordHashes()


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        return _mixed((h * _FACTORS[: len(h)]).sum(keepdims=True, dtype=np.uint64) + _U(len(h)))
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += h[i : i + n] * _FACTORS[i]
    return np.unique(_mixed(total))


def sketch(shingles: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The t coordinates of a set that isn't empty."""
    bins = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    done, n = 0, len(shingles)
    while done < 2 * t:
        # So many rounds at once that bins are likely to fill: later rounds never beat earlier ones, as the round leads.
        rounds = np.arange(done, min(2 * t, done + max(1, 3 * t // n)), dtype=np.uint64)
        done += len(rounds)
        z = _mixed(shingles[None, :] + (rounds * _ROUND)[:, None])
        at = ((z >> _U(32)) * _U(t) >> _U(32)).astype(np.int64)
        at = np.where((rounds >= t)[:, None], (rounds.astype(np.int64) - t)[:, None], at)
        np.minimum.at(bins, at.ravel(), ((rounds << _U(32))[:, None] | (z & _U(0xFFFFFFFF))).ravel())
        if bins.max() < np.iinfo(np.uint64).max:
            break
    return bins


def _signatures(how: Banding) -> Callable:
    """(id, text bytes, text mark) to (id, text mark, n, class key, sketch of 16 bits a coordinate, band keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, marks, bands = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py() or b"")
                n.append(len(s))
                if not len(s):
                    keys.append(None), marks.append(None), bands.append(None)
                    continue
                c = sketch(s, how.coordinates)
                keys.append(_key(s))
                marks.append(_mixed(c).astype(np.uint16).tobytes())
                bands.append(_mixed((c.reshape(how.bands, ROWS) * _FACTORS[:ROWS]).sum(1, dtype=np.uint64) + np.arange(how.bands, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["id", "mark", "n", "key", "marks", "bands"],
            )

    return run


def _verified(percent: int) -> Callable:
    """(a, b, set of a, set of b) to the linked (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = batch.columns
            keep = []
            for i in range(batch.num_rows):
                one, two = (np.frombuffer(x[i].as_buffer(), np.uint64) for x in (left, right))
                common = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * common >= percent * (len(one) + len(two) - common):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(keep), b.take(keep)], ["a", "b"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of class keys whose full sets are similar enough; `sets` has the set of each class key."""
    left = sets.select(F.col("key").alias("a"), F.col("members").alias("_left"))
    right = sets.select(F.col("key").alias("b"), F.col("members").alias("_right"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "_left", "_right")
    return both.mapInArrow(_verified(percent), "a binary, b binary")


def _agreeing(how: Banding) -> Callable:
    """Candidate pairs whose sketches agree in how.agree coordinates at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, how.coordinates) for c in ("ma", "mb"))
            keep = pa.array(np.flatnonzero((one == two).sum(1) >= how.agree))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    return run


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, key) to (key, set), if the text has that class: an id may stand for several texts."""
    for batch in batches:
        keys, sets = [], []
        for text, key in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            members = shingle_set(text.as_py())
            if _key(members) == key:
                keys.append(key)
                sets.append(members.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "members"])


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(key, label): for each key of a link, a label that is equal within a component and differs between components.

    Links are undirected; labels of an earlier call may be given as a start. Each round gives a key the least label among
    its own, its neighbours' and its label's label, until none changes; star-like components take two or three rounds.
    """
    if labels is not None:
        # What is linked are the components found so far; their labels stand for them.
        one = labels.select(F.col("key").alias("a"), F.col("label").alias("_a"))
        two = labels.select(F.col("key").alias("b"), F.col("label").alias("_b"))
        links = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = cut(links.select("a", "b").union(links.select("b", "a")).groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        # Each link carries the labels of its ends; the least goes to both ends and to both labels (a hook and a shortcut).
        one = state.select(F.col("key").alias("a"), F.col("label").alias("_a"))
        two = state.select(F.col("key").alias("b"), F.col("label").alias("_b"))
        seen = links.join(one, "a").join(two, "b").select("a", "b", "_a", "_b", F.least("_a", "_b").alias("least")).where("_a <> _b")
        told = seen.select(F.explode(F.array("a", "b", "_a", "_b")).alias("key"), "least").groupBy("key").agg(F.min("least").alias("least"))
        better = state.join(told, "key", "left").select("key", F.least("label", "least").alias("label"))
        up = better.select(F.col("key").alias("label"), F.col("label").alias("_up"))
        shorter = better.join(up, "label", "left").select("key", F.least("label", "_up").alias("label"))
        after = cut(shorter.join(state.select("key", F.col("label").alias("_before")), "key"))
        changed = after.where("label <> _before").limit(1).count()
        drop(state)
        state = after.select("key", "label")
        state.cut_path = after.cut_path
        if not changed:
            break
    drop(links)
    if labels is None:
        return state
    up = state.select(F.col("key").alias("label"), F.col("label").alias("_up"))
    old = labels.join(up, "label", "left").select("key", F.coalesce("_up", "label").alias("label"))
    new = state.join(labels.select("key"), "key", "left_anti").select("key", "label")
    return cut(old.unionByName(new))


_BUCKET = ["band", "value", "band2", "value2"]
_PAIR = [*_BUCKET, "i", "j"]
#: _PAIR with types; band2 is -1 in buckets that a second band doesn't split.
_PAIR_TYPES = "band int, value long, band2 int, value2 long, i int, j int"


def _across(how: Banding) -> Callable:
    """Rows sorted by block pair to the pairs of different components that are worth verifying.

    A block pair with more of these than rows gives one row without a pair: it is verified as a whole. A block pair has a
    bounded number of rows; those of the last one of a batch wait for the next batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(rows):
                at = _starts(rows)
                held = rows.iloc[at[-1] :]
                yield _candidates(rows.iloc[: at[-1]], at, how)
        if held is not None:
            yield _candidates(held, np.array([0, len(held)]), how)

    return run


def _starts(rows: pd.DataFrame) -> np.ndarray:
    """Where block pairs begin in sorted rows."""
    keys = rows[_PAIR].to_numpy(np.int64)
    return np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1])


def _candidates(rows: pd.DataFrame, starts: np.ndarray, how: Banding) -> pd.DataFrame:
    """starts: of the block pairs in rows, their end included."""
    out: list[tuple] = []
    if len(rows):
        marks = np.frombuffer(b"".join(rows["marks"]), np.uint16).reshape(-1, how.coordinates)
        bands, n, key = np.stack(list(rows["bands"])), rows["n"].to_numpy(np.int64), rows["key"].to_numpy(object)
        label, order = pd.factorize(rows["label"])[0], rows["order"].to_numpy(np.int64)
        minor, asks, asked = (rows[c].to_numpy(bool) for c in ("minor", "asks", "asked"))
        places = rows[_PAIR].to_numpy(np.int64)
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            place, found = tuple(places[lo]), []
            band, second = place[0], place[2]
            ones, twos = lo + np.flatnonzero(asks[lo:hi]), lo + np.flatnonzero(asked[lo:hi])
            for p in ones:
                # Two classes of the minority meet twice: the one that is first in order asks.
                at = twos[(label[twos] != label[p]) & (~minor[twos] | (order[twos] > order[p])) & (100 * np.minimum(n[p], n[twos]) >= how.percent * np.maximum(n[p], n[twos]))]
                if len(at):
                    at = at[(marks[at] == marks[p]).sum(1) >= how.agree]
                if len(at) and band:
                    at = at[~(bands[at, :band] == bands[p, :band]).any(1)]
                if len(at) and second > band + 1:
                    at = at[~(bands[at, band + 1 : second] == bands[p, band + 1 : second]).any(1)]
                found += [(key[p], key[q], *place) for q in at]
                if len(found) > hi - lo:
                    found = [(None, None, *place)]
                    break
            out += found
    return pd.DataFrame(out, columns=["a", "b", *_PAIR]).astype({"a": object, "b": object})


def _dense(percent: int) -> Callable:
    """Rows (key, label, asks, asked, members) of one block pair to links that join all components that its linked pairs do.

    Intersections of all pairs of sets are a product of 0/1 matrices over the shingles that occur twice, some columns at
    a time; the results are whole numbers.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key, asks, asked = rows["key"].to_numpy(object), rows["asks"].to_numpy(bool), rows["asked"].to_numpy(bool)
        sets = [np.frombuffer(m, np.uint64) for m in rows["members"]]
        n = np.array([len(x) for x in sets])
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, twice = np.repeat(np.arange(len(sets)), n), times > 1
        place = np.cumsum(twice) - 1
        row, column = row[twice[column]], place[column[twice[column]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        one, two = np.flatnonzero(asks), np.flatnonzero(asked)
        common = np.zeros((len(one), len(two)))
        for at in range(0, int(twice.sum()), COLUMNS):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS])
            part = np.zeros((len(sets), COLUMNS), np.float32)
            part[row[lo:hi], column[lo:hi] - at] = 1
            common += part[one] @ part[two].T
        linked = 100 * common >= percent * (n[one][:, None] + n[two][None, :] - common)
        label = pd.factorize(rows["label"])[0]
        up = np.arange(label.max() + 1)

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for p, q in np.argwhere(linked):
            a, b = root(label[one[p]]), root(label[two[q]])
            if a != b:
                up[b] = a
                out.append((key[one[p]], key[two[q]]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    return run


def _mixed_buckets(member: DataFrame, place: list[str]) -> DataFrame:
    """(place, major, n_major) of buckets with more than one label: the largest one and its classes."""
    labels = member.groupBy(*place, "label").agg(F.count("*").alias("m"))
    most = labels.groupBy(*place).agg(F.max(F.struct("m", "label")).alias("x"), F.count("*").alias("labels")).where("labels > 1")
    return most.select(*place, F.col("x.label").alias("major"), F.col("x.m").alias("n_major"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id and kept of every row, and text_mark, a 64-bit hash of its text; links are pairs at `percent` or more."""
    how = banding(percent)
    text = F.col(text_col)
    plain = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("mark"))
    kind = plain.schema["id"].dataType.simpleString()
    signed = cut(plain.mapInArrow(_signatures(how), f"id {kind}, mark long, n long, key binary, marks binary, bands array<long>"))
    linkable = signed.where("key is not null and id is not null")
    firsts = [F.first(c).alias(c) for c in ("n", "marks", "bands")]
    classes = cut(linkable.groupBy("key").agg(F.min(F.struct("id", "mark")).alias("one"), *firsts).select("key", "one.id", "one.mark", "n", "marks", "bands"))

    banded = classes.select("key", "n", F.posexplode("bands").alias("band", "value"))
    order = F.xxhash64("key")
    buckets = banded.groupBy("band", "value").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min(F.struct(order.alias("o"), F.col("key").alias("centre"))).alias("c"))
    buckets = cut(buckets.where("size > 1").select("band", "value", "size", "shingles", "c.centre"))
    total = buckets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    hot = F.broadcast(buckets.where(F.col("size") > max(HOT, total // BROADCAST_ROWS)))
    cold = buckets.where(F.col("size") <= max(HOT, total // BROADCAST_ROWS))
    place = ["band", "value"]
    crowded = cut(banded.join(hot, place).unionByName(banded.join(hot.select(*place), place, "left_anti").join(cold, place)))
    side = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("marks").alias(f"m{x}"))
    ends = F.explode(F.array("a", "b")).alias("key")

    # The sets of all classes that share a bucket, made once: texts are moved here and nowhere else.
    one = classes.join(crowded.select("key").distinct(), "key", "left_semi").select("key", "id", "mark")
    pool = cut(plain.join(one, ["id", "mark"]).select("text", "key").mapInArrow(_sets, "key binary, members binary").dropDuplicates(["key"]))

    def sets(keys: DataFrame) -> DataFrame:
        return pool.join(keys.distinct(), "key", "left_semi")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of pairs (key, centre) those whose sketches, then whose sets are alike."""
        pairs = pairs.where("key <> centre").select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()
        near = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        likely = cut(near.select("a", "b", "ma", "mb").mapInArrow(_agreeing(how), "a binary, b binary"))
        return cut(verify(likely, sets(likely.select(ends)), percent))

    state = components(linked(crowded.select("key", "centre")))
    member, member_of = None, crowded
    for turn in range(CENTRES):
        # Buckets that hold more than one component: a class of the minority, another one each turn, is the next centre.
        member_of = member_of.select(*place, "key", "n", "size", "shingles").join(state, "key", "left").withColumn("label", F.coalesce("label", "key"))
        mixed = cut(_mixed_buckets(member_of, place))
        member_of = cut(joined(member_of, mixed, place, order))
        drop(mixed, member)
        member = member_of
        if turn == CENTRES - 1:
            break
        seeded = F.struct(F.xxhash64("key", F.lit(turn)).alias("o"), F.col("key").alias("centre"), F.col("label").alias("own"))
        centres = cut(member.where("label <> major").groupBy(*place).agg(F.min(seeded).alias("c")).select(*place, "c.centre", "c.own"))
        late = linked(joined(member, centres, place, order).where("label <> own").select("key", "centre"))
        if not late.limit(1).count():
            break
        state = components(late, state)
    unsplit = member.where(F.col("size") <= HOT).select("*", F.lit(-1).alias("band2"), F.lit(0).cast("long").alias("value2"))
    split = member.where(F.col("size") > HOT).select(*place, "key", "n", "label").join(classes.select("key", "bands"), "key")
    split = split.select(*place, "key", "n", "label", F.posexplode("bands").alias("band2", "value2")).where("band2 > band")
    halves = cut(_mixed_buckets(split, _BUCKET).join(split.groupBy(*_BUCKET).agg(F.count("*").alias("size"), F.sum("n").alias("shingles")), _BUCKET))
    split = joined(split, halves, _BUCKET, order)
    rest = unsplit.unionByName(split.select(*unsplit.columns)).withColumn("minor", F.col("label") != F.col("major"))
    # The minority is dealt over blocks i, all classes over blocks j; each goes to all blocks of the other side.
    blocks = lambda many: F.ceil(F.greatest(many / BLOCK, F.col("shingles") / BLOCK_SHINGLES * many / F.col("size"))).cast("int")
    rest = rest.withColumn("n_i", blocks(F.col("size") - F.col("n_major"))).withColumn("n_j", blocks(F.col("size")))
    own, every = (lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(n)).cast("int")), (lambda n: F.sequence(F.lit(0), F.col(n) - 1))
    one_block = F.expr("n_i = 1 and n_j = 1")
    asking = rest.where(F.col("minor") & ~one_block).select(*_BUCKET, "key", "label", "minor", F.lit(True).alias("asks"), F.lit(False).alias("asked"), own("n_i", 1).alias("i"), F.explode(every("n_j")).alias("j"))
    asked = rest.select(*_BUCKET, "key", "label", "minor", (F.col("minor") & one_block).alias("asks"), F.lit(True).alias("asked"), F.explode(every("n_i")).alias("i"), own("n_j", 2).alias("j"))
    rest = cut(asking.unionByName(asked))
    # Most block pairs are a few rows: they are read from sorted partitions, as a call for each would cost more than its work.
    across = rest.join(classes.select("key", "n", "marks", "bands"), "key").withColumn("order", order).repartition(*_PAIR).sortWithinPartitions(*_PAIR)
    across = cut(across.mapInPandas(_across(how), f"a binary, b binary, {_PAIR_TYPES}"))
    few = cut(across.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    dense = rest.join(across.where("a is null").select(*_PAIR), _PAIR, "left_semi")
    dense = dense.join(sets(dense.select("key")), "key").groupBy(*_PAIR).applyInPandas(_dense(percent), "a binary, b binary")
    late = cut(verify(few, sets(few.select(ends)), percent).unionByName(dense))
    state = components(late, state)

    named = classes.select("key", "id").join(state, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = named.join(least, "label").select("key", "component_id")
    out = signed.select("id", "mark", "n", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    own = F.coalesce(F.col("component_id"), F.col("id"))
    kept = F.coalesce(F.col("id") == own, F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), kept.alias("kept"), F.col("mark").alias("text_mark"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component; all columns stay, and so do all rows without a word or without an id.

    Rows are chosen by id and a hash of the text; texts are moved once, to meet what was chosen. Of rows equal in both, one is
    taken: only these, if there are any, are moved again.
    """
    judged = near_duplicates(docs, id_col, text_col, percent).where(F.col("kept") & F.col(id_col).isNotNull() & (F.col("n_shingles") > 0))
    chosen = judged.groupBy(F.col(id_col).alias("id")).agg(F.min("text_mark").alias("mark"), F.count("*").alias("rows"))
    chosen = cut(chosen.select("id", "mark", (F.col("rows") > 1).alias("more")))
    own = Renamed(docs, id=F.col(id_col), mark=F.xxhash64(text_col), linkable=F.coalesce(F.col(text_col).rlike(WORD), F.lit(False)) & F.col(id_col).isNotNull())
    rows = own.rows.where("linkable").join(chosen, ["id", "mark"])
    out = rows.where("not more")
    if chosen.where("more").limit(1).count():
        out = out.unionByName(rows.where("more").dropDuplicates(["id", "mark"]))
    return own.back(out).unionByName(own.back(own.rows.where("not linkable")))
