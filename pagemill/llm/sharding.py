"""Proportional stratified interleaving: every shard has the mixture of all.

Rows are put in a seeded random order within their source, by 60 bits of md5 of seed and id, which gives each a rank r of the
source's n rows. Sorted by the fractional rank (2r - 1) / 2n, the sources mix evenly at every place of the order, so equal
cuts of it are shards with the mixture of the whole. Both rankings are done in two levels - sums over buckets, then a window
within each bucket - so that neither a hot source nor the whole order ever meets in one task: hash bits deal a source's rows
evenly over its buckets, and fractional ranks deal all rows evenly over theirs. There are so many buckets that a source of all
rows has ROWS_A_BUCKET in one; only rows of one id can't be dealt, and meet in a bucket without their texts.

The law that holds is `rows`: shards hold numbers of rows at most one apart.

Defined results: a null text has no bytes and crc32 0; null is a source of its own; rows with equal ids are ordered by
crc32 and size, and equal rows are interchangeable; a null id is hashed as an empty one; a very long text only adds to its
row's size; an empty table gives an empty result. Other columns, whatever their names, play no part in interleave();
write_shards() writes them all, and one named `shard` gives way to the shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import Renamed, cut, power_of_two

#: Bytes counted for a row besides its text.
ROW_BYTES = 16
#: Rows that a source of all rows has in a bucket; rows that a task writes.
ROWS_A_BUCKET, ROWS_A_TASK = 200_000, 1_000_000


def stratum(source: Column) -> Column:
    """A key that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def interleave(
    docs: DataFrame, n_shards: int = 40, seed: int = 20, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """id, source stratum, size, text_crc32, position in the interleaved order, shard and slot of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    of_id = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keyed = cut(docs.select(
        F.col(id_col).alias("_id"),
        stratum(F.col(source_col)).alias("stratum"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(of_id.cast("binary")), 1, 15), 16, 10).cast("long").alias("_h"),
    ))
    buckets = buckets or power_of_two(keyed.count(), ROWS_A_BUCKET, 1024)
    bits = max(1, (buckets - 1).bit_length())
    keyed = keyed.withColumn("_bucket", F.shiftright("_h", 60 - bits).cast("int"))
    in_order = Window.partitionBy("stratum").orderBy("_bucket")
    starts = (
        keyed.groupBy("stratum", "_bucket").count()
        .withColumn("_n", F.sum("count").over(Window.partitionBy("stratum")))
        .withColumn("_start", F.sum("count").over(in_order) - F.col("count"))
        .drop("count")
    )
    within = Window.partitionBy("stratum", "_bucket").orderBy("_h", "text_crc32", "size")
    rank = F.col("_start") + F.row_number().over(within)
    ranked = keyed.join(starts, ["stratum", "_bucket"]).select("_id", "stratum", "size", "text_crc32", rank.alias("rank"), "_n")
    odd = F.col("rank") * 2 - 1
    ranked = cut(ranked.select("*", F.expr(f"int((rank * 2 - 1) * {buckets} div (_n * 2))").alias("_cut"), (odd / (F.col("_n") * 2)).alias("fraction")))

    # At most `buckets` rows from here on until the join.
    all_cuts = ranked.groupBy("_cut").agg(F.count("*").alias("_rows"))
    cuts = all_cuts.select(
        "_cut",
        (F.sum("_rows").over(Window.orderBy("_cut")) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(F.lit(0))).alias("_total"),
    )
    place = F.row_number().over(Window.partitionBy("_cut").orderBy("fraction", "stratum", "rank")) - 1
    placed = ranked.withColumn("_place", place).join(F.broadcast(cuts), "_cut").withColumn("position", F.col("_before") + F.col("_place"))
    shard = F.expr(f"int(position * {n_shards} div _total)")
    placed = placed.withColumn("shard", shard)
    slot = F.expr(f"position - (bigint(shard) * _total + {n_shards} - 1) div {n_shards}")
    return placed.select(F.col("_id").alias(id_col), "stratum", "size", "text_crc32", "position", "shard", slot.alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes each row of docs in its shard's folder. Ids must be unique.

    Rows are dealt by ranges of shard and slot, so that a large shard is written by many tasks, a file each, in slot order;
    names of files follow that order.
    """
    own = Renamed(docs, id=F.col(id_col))
    rows = own.rows.join(placed.select(F.col(id_col).alias("id"), F.col("shard").alias("shard"), F.col("slot").alias("slot")), "id")
    tasks = max(placed.agg(F.countDistinct("shard")).first()[0], -(-placed.count() // ROWS_A_TASK), 1)
    ordered = rows.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot")
    own.back(ordered, shard=F.col("shard")).write.partitionBy("shard").parquet(path)
