"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word budget: its weight's share of all words, at most `max_epochs` times its own words, the excess
reshared among the others (water filling, in closed form over the sources sorted by cap per weight). A budget of e whole
epochs and a rest takes every document e times; for the rest, each document draws the key u^(1/w), u uniform from a seeded
hash of its id and w its quality weight, and documents are taken in order of descending keys while their prefix sum
reaches the rest. The document that the rest ends in is taken if that comes nearer to it.

Prefix sums go in two levels: sums over key buckets of each source find the bucket that the rest ends in, and only that
bucket's rows - about a `buckets`-th of a source, by default so many buckets that a source of all rows has ROWS_A_BUCKET in
one - are sorted and summed one by one. What comes of it is one place in the order of each source: a row is taken once more
if it stands before. That place, and all else that is known of a source, comes to the rows by common.joined(): broadcast
where sources are few, else with hot sources dealt over salts. So neither mix() nor repeat() moves a text. Buckets are scaled
by the source's mean weight, so that rows of any weight spread over them. Budgets are made from one row a source, in one
task: a few numbers for each, so that a million sources still are some 50 MB there.

Defined results: null is a source of its own, the last; a null or blank text has size 0 and takes nothing; a source
without words has target 0; null, negative or missing quality weights count as the least weight; rows with equal ids draw
equal keys and are ordered by size; of rows equal in id and size at the place where a source ends, some are taken and some
aren't, by the hash of their texts (only such rows are ranked with their columns); a text of any length is counted whole; an
empty table gives an empty result. mix() returns its own columns, repeat() those of docs, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import Renamed, cut, joined, power_of_two, words_of
from pagemill.llm.sharding import stratum

LEAST_WEIGHT = 0.05
#: Rows that the hottest source may have in one bucket of keys.
ROWS_A_BUCKET = 200_000


def quality_weight(text: Column) -> Column:
    """Share of a text that isn't digits or signs, between LEAST_WEIGHT and 1."""
    signs = "0123456789#*$%&|<>!@^_~={}[]\\/+"
    share = F.length(F.translate(text, signs, "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(share, F.lit(0.0)))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """sizes (stratum, source_size) with each source's target. Works on one row a source."""
    by_code = Window.orderBy("stratum")
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_code) - 1) % n + 1).cast("int"))
    cap = F.col("source_size") * float(max_epochs)
    one = sizes.withColumn("_w", weight).withColumn("_cap", cap)
    # In order of cap per weight: the level at which water stands if exactly the sources before this one are full.
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "stratum")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    levels = one.withColumn("_ratio", F.col("_cap") / F.col("_w")).withColumn("_level", level)
    # The first source that isn't full at its own level stands at the final one, and so do all after it.
    first = F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "stratum", "_level"))
    final = F.min(first).over(Window.partitionBy(F.lit(0)))["_level"]
    given = F.least(F.col("_cap"), F.coalesce(final, F.lit(0.0)) * F.col("_w"))
    return levels.select("stratum", "source_size", given.alias("target"), *[c for c in sizes.columns if c not in ("stratum", "source_size")])


def _inputs(text: Column, source: Column, id_: Column, weight: Column | None) -> dict[str, Column]:
    """What the draw of a row is made of."""
    weight = quality_weight(text) if weight is None else F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(weight.cast("double"), F.lit(0.0)))
    return {"id": F.coalesce(id_.cast("string"), F.lit("")), "stratum": stratum(source), "size": words_of(text), "weight": weight, "mark": F.xxhash64(text)}


class Plan:
    """The budgets of the sources of rows (stratum, id, size, weight), and the place at which each ends: a row a source."""

    def __init__(self, rows: DataFrame, weights: tuple[float, ...], max_epochs: int, seed: int, buckets: int | None):
        self.seed, self.buckets = seed, buckets or power_of_two(rows.count(), ROWS_A_BUCKET, 1024)
        sizes = rows.groupBy("stratum").agg(F.sum("size").alias("source_size"), F.avg("weight").alias("mean"))
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        shares = targets(sizes, weights, max_epochs).withColumn("epochs", whole)
        shares = cut(shares.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
        keyed = self._keyed(rows, shares)
        sums = keyed.groupBy("stratum", "bucket").agg(F.sum("size").alias("in"), F.first("rest").alias("rest"))
        before = F.sum("in").over(Window.partitionBy("stratum").orderBy("bucket")) - F.col("in")
        last = sums.withColumn("before", before).where(F.col("before") + F.col("in") > F.col("rest"))
        last = cut(last.groupBy("stratum").agg(F.min(F.struct("bucket", "before")).alias("last")).select("stratum", F.col("last.bucket").alias("end"), "last.before"))
        one_by_one = Window.partitionBy("stratum").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        inside = joined(keyed, last, ["stratum"], self._draw()).where("bucket = end")
        reached = F.col("before") + F.coalesce(F.sum("size").over(one_by_one), F.lit(0))
        ranked = inside.select("stratum", "key", (reached + F.col("size") / 2 <= F.col("rest")).alias("more"))
        ties = ranked.groupBy("stratum", "key").agg(F.count_if("more").alias("taken"), F.count("*").alias("alike")).where("taken > 0")
        places = ties.groupBy("stratum").agg(F.max(F.struct("key", "taken", "alike")).alias("place"))
        places = last.join(places, "stratum", "left").select("stratum", "end", "place")
        self.table = cut(shares.join(places, "stratum", "left").withColumn("end", F.coalesce("end", F.lit(self.buckets))))
        self.split = bool(self.table.where("place.taken < place.alike").limit(1).count())

    def _draw(self) -> Column:
        """52 bits of a hash that other engines have too."""
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(self.seed)), "id").cast("binary")), 1, 13), 16, 10).cast("long")

    def _keyed(self, rows: DataFrame, shares: DataFrame) -> DataFrame:
        # Ascending where u^(1/w) descends.
        arrival = -F.log((self._draw() + 0.5) / float(1 << 52)) / F.col("weight")
        rows = joined(rows.withColumn("arrival", arrival), shares, ["stratum"], self._draw())
        bucket = F.least(F.lit(self.buckets - 1), F.floor((1 - F.exp(-F.col("arrival") * F.col("mean"))) * self.buckets)).cast("int")
        return rows.withColumn("bucket", bucket).withColumn("key", F.struct("arrival", "id", "size"))

    def times(self, rows: DataFrame) -> DataFrame:
        """rows (stratum, id, size, weight, mark and others) with source_size, target and times."""
        keyed = self._keyed(rows, self.table)
        at = F.col("place.key")
        more = (F.col("bucket") < F.col("end")) | F.coalesce((F.col("bucket") == F.col("end")) & (F.col("key") <= at), F.lit(False))
        tied = F.coalesce((F.col("key") == at) & (F.col("place.taken") < F.col("place.alike")), F.lit(False))
        out = keyed.withColumn("times", F.col("epochs") + more.cast("long"))
        if not self.split:
            return out
        turn = F.row_number().over(Window.partitionBy("stratum").orderBy("mark"))
        tied_rows = keyed.where(tied).withColumn("times", F.col("epochs") + (turn <= F.col("place.taken")).cast("long"))
        return out.where(~tied).unionByName(tied_rows)


def _planned(docs: DataFrame, weights, max_epochs, seed, buckets, id_col, text_col, source_col, weight_col) -> tuple[DataFrame, Plan, dict[str, Column]]:
    parts = _inputs(F.col(text_col), F.col(source_col), F.col(id_col), F.col(weight_col) if weight_col else None)
    rows = cut(docs.select(F.col(id_col).alias("own_id"), *[c.alias(k) for k, c in parts.items()]))
    return rows, Plan(rows, weights, max_epochs, seed, buckets), parts


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 8, buckets: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None,
) -> DataFrame:
    """id, stratum, size, source_size, target, times (how often the document is taken) and taken (words) of every row."""
    rows, plan, _ = _planned(docs, weights, max_epochs, seed, buckets, id_col, text_col, source_col, weight_col)
    taken = plan.times(rows)
    return taken.select(F.col("own_id").alias(id_col), "stratum", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def repeat(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 8, buckets: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None,
) -> DataFrame:
    """docs with each row as often as mix() takes it; all columns stay. Rows without a word aren't taken."""
    _, plan, parts = _planned(docs, weights, max_epochs, seed, buckets, id_col, text_col, source_col, weight_col)
    own = Renamed(docs, **parts)
    taken = plan.times(own.rows).where("size > 0 and times > 0")
    return own.back(taken.withColumn("copy", F.explode(F.expr("sequence(1L, times)"))))
