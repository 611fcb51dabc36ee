"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.storage import cut, drop, release, scratch, shared_folder

__all__ = ["BROADCAST_ROWS", "WORD", "Renamed", "crc_fold", "cut", "drop", "joined", "power_of_two", "release", "scratch", "shared_folder", "words_of"]

#: Words are runs of bytes other than ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a counted side up to which it is broadcast; the rows are a few numbers and a key each.
BROADCAST_ROWS = 50_000
#: Copies of the smaller side, one a salt, where it is too large to be broadcast.
SALTS = 16


def words_of(text: Column) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of an id written as text, modulo folds; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)) % folds


def power_of_two(rows: int, each: int, least: int) -> int:
    """The least power of two, `least` at least, at which `rows` rows come to about `each` in a part."""
    parts = least
    while parts * each < rows:
        parts *= 2
    return parts


class Renamed:
    """A frame whose columns bear names c0, c1, ... while an operator works, so that no working column can clash with one
    of the caller's; back() gives the caller's names again. Expressions on the caller's columns are taken in as `added`;
    `carry` names the columns that are wanted, if not all."""

    def __init__(self, docs: DataFrame, carry: list[str] | None = None, **added: Column):
        self.names = list(docs.columns if carry is None else carry)
        self.own = [f"c{i}" for i in range(len(self.names))]
        named = [c.alias(f"added{i}") for i, c in enumerate(added.values())]
        wanted = ["*"] if carry is None else [F.col(f"`{c}`") for c in carry]
        self.rows = docs.select(*wanted, *named).toDF(*self.own, *added)

    def __call__(self, name: str) -> str:
        """The working name of a column of the caller's."""
        return self.own[self.names.index(name)]

    def back(self, df: DataFrame, replaced: dict[str, Column] | None = None, **results: Column) -> DataFrame:
        """The caller's columns, some replaced, then the results; a result takes the place of a column of its name."""
        taken, replaced = {r.lower() for r in results}, replaced or {}
        kept = [replaced.get(n, F.col(c)).alias(n) for n, c in zip(self.names, self.own, strict=True) if n.lower() not in taken]
        return df.select(*kept, *[c.alias(n) for n, c in results.items()])


def joined(rows: DataFrame, keyed: DataFrame, keys: list[str], spread: Column, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined with `keyed`, one row a key, where a few keys may hold most rows.

    `keyed` is a table, counted first. Up to `most` rows it is broadcast, and rows aren't moved. A larger one is copied
    SALTS times, and `spread`, a hash of rows, deals those of a hot key over the copies.
    """
    if keyed.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(keyed), keys, how)
    salted = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")
