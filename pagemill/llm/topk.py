"""Exact top-k search by inner product as a Voronoi kNN join.

Every vector belongs to the cell of its nearest pivot; the queries of a cell form a group. Two kinds of summaries tell what
a cell's vectors can score at most with a query q: its radius r about the pivot p, by q.p + |q| r; and the interval [lo, hi]
of its vectors along the pivot's direction u with the longest part w across it, by max(q.u lo, q.u hi) + |q across u| w. The
lesser of the two holds. For a group, the first is taken with the group's own radius. A first pass solves each group within
its own cell; its k-th best scores are exact lower bounds. The second pass sends a group's queries only to the other cells
whose bound reaches the lowest of them, a query only where its own bound does, and each query keeps only scores that reach
its own. A last top-k merges both passes. The result's attribute `sent` tells how many pairs of a query and another cell
there are, and how many were sent: where vectors spread evenly over many dimensions, no such bound can leave any out.

Pivots come from a bounded sample of the data (`n_pivots` rows, chosen by hash; by default one for `block` rows, from 16 to
1024) and are the only thing broadcast, besides n_pivots summaries. A cell's data is dealt over blocks of about `block` rows,
the queries sent to it over slices of the same size, by counts; a task gets one block and one slice, so a hot cell or hot
vector is many tasks. Each block is replicated over the slices of its cell, each slice over the blocks. All scores are
integers; bounds are in doubles with a margin, and only ever widen what is compared.

Defined results: vectors null, or holding null or non-finite components, take no part; shorter vectors count as
padded with zeros, an empty one as all zeros; components beyond the 64-bit range stand at its ends, products are exact
whatever their size, and a score beyond the 64-bit range stands at its end; null ids take no part as queries and none as
candidates; rows with equal ids are all candidates, but never of a query with that id; fewer than k candidates give fewer
rows; an empty table none. Only the two columns named are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import cut

SCALE = 64
#: Below this, sums of products are exact in doubles.
EXACT = float(1 << 52)
#: No score is less, so no bound need be.
LEAST_SCORE = -float(1 << 63)


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null, NaN or infinite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def whole(vector: Column) -> Column:
    """floor(SCALE * x) of each component, x taken as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(SCALE)).cast("long"))


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products: by doubles where those are exact, by 64-bit integers where these are, else by integers of any size,
    brought into 64 bits at the end."""
    largest = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(data.astype(np.float64)).max(initial=0)) * queries.shape[1]
    if largest < EXACT:
        return (queries.astype(np.float64) @ data.T.astype(np.float64)).astype(np.int64)
    if largest < float(1 << 62):
        return queries @ data.T
    whole = queries.astype(object) @ data.T.astype(object)
    ends = np.iinfo(np.int64)
    return np.clip(whole, int(ends.min) + 1, int(ends.max)).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, the at most k best scores that reach its floor, ties to smaller ids."""
    least = np.iinfo(np.int64).min
    mine = np.isin(own, ids)
    if len(ids) > k:
        spare = min(k + int(np.unique(ids, return_counts=True)[1].max()), len(ids)) if mine.any() else k
        kth = np.partition(scores, len(ids) - spare, axis=1)[:, len(ids) - spare]
        floor = np.maximum(floor, kth)
    for i, reach in enumerate(floor):
        at = np.flatnonzero(scores[i] >= reach if reach > least else np.ones(len(ids), bool))
        if mine[i]:
            at = at[ids[at] != own[i]]
        if len(at):
            at = at[np.lexsort((ids[at], -scores[i][at]))[:k]]
            yield i, ids[at], scores[i][at]


def _solve(k: int, dim: int, slice_rows: int):
    """A block of data rows and the queries sent to it, as (query, candidate, score)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            data, ids = _matrix(left["v"], dim), left["id"].to_numpy(np.int64)
            for at in range(0, len(right), slice_rows):
                part = right.iloc[at : at + slice_rows]
                own, floor = part["id"].to_numpy(np.int64), part["floor"].to_numpy(np.int64)
                for i, near, score in _best(_scores(_matrix(part["v"], dim), data), ids, own, floor, k):
                    out.append((np.full(len(near), own[i]), near, score))
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        q, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    return run


def top_k(
    vectors: DataFrame, queries: Column, k: int = 20, n_pivots: int | None = None, block: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row for which `queries` holds."""
    spark = vectors.sparkSession
    taking = usable(F.col(vector_col)) & F.col(id_col).isNotNull()
    plain = vectors.where(taking).select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col)).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    plain = cut(plain)
    dim, n = plain.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    schema = "query_id long, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, n_pivots = max(dim, 1), n_pivots or min(1024, max(16, n // block))
    sample = plain.orderBy(F.xxhash64("id"), "id").limit(n_pivots).toPandas()
    pivots = np.unique(_matrix(sample["v"], dim), axis=0).astype(np.float64)
    norms = np.sqrt((pivots**2).sum(1))
    along = pivots / np.where(norms > 0, norms, 1)[:, None]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            x = _matrix(rows["v"], dim).astype(np.float64)
            far = (x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)
            cell = far.argmin(1)
            radius = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            height = (x * along[cell]).sum(1)
            across = np.sqrt(np.maximum(0, (x**2).sum(1) - height**2))
            yield rows.assign(cell=cell.astype(np.int32), radius=radius, length=np.sqrt((x**2).sum(1)), height=height, across=across)

    # The lot deals queries over slices, those with equal ids or vectors too; it is fixed as the table is written.
    placed = plain.mapInPandas(assign, "id long, v array<long>, asks boolean, cell int, radius double, length double, height double, across double")
    placed = cut(placed.withColumn("lot", F.xxhash64(F.monotonically_increasing_id())))
    extent = [F.min("height").alias("lo"), F.max("height").alias("hi"), F.max("across").alias("w"), F.count_if("asks").alias("queries")]
    about = placed.groupBy("cell").agg(F.count("*").alias("n"), *extent, F.max("radius").alias("r"), F.max(F.when(F.col("asks"), F.col("radius"))).alias("R"), F.max(F.when(F.col("asks"), F.col("length"))).alias("Q"))
    about = {r.cell: r for r in about.collect()}  # one row a pivot at most
    blocks = {c: max(1, -(-r.n // block)) for c, r in about.items()}
    dealt = F.create_map(*[F.lit(x) for c, b in blocks.items() for x in (c, b)])
    data = placed.select(F.col("cell"), F.pmod(F.xxhash64("id"), F.element_at(dealt, F.col("cell"))).cast("int").alias("part"), "id", "v")
    asked = placed.where("asks").select("id", "v", "lot", F.col("cell").alias("group"))
    least = F.lit(int(np.iinfo(np.int64).min)).cast("long")

    def joined(sent: DataFrame) -> DataFrame:
        """sent: id, v, lot, floor and the cell to search. Each query goes to every block of that cell."""
        counts = {r.cell: r["count"] for r in sent.groupBy("cell").count().collect()}  # one row a pivot at most
        if not counts:
            return spark.createDataFrame([], schema)
        n_slices = F.element_at(F.create_map(*[F.lit(x) for c, m in counts.items() for x in (c, -(-m // block))]), F.col("cell"))
        parts = F.explode(F.sequence(F.lit(0), F.element_at(dealt, F.col("cell")) - 1)).alias("part")
        to = sent.select("cell", parts, F.pmod("lot", n_slices).cast("int").alias("slice"), "id", "v", "floor")
        # A cell to which nothing is sent has no slices, and its data stays out.
        copies = data.select("cell", "part", F.explode(F.sequence(F.lit(0), n_slices - 1)).alias("slice"), "id", "v")
        key = ["cell", "part", "slice"]
        return copies.groupBy(*key).cogroup(to.groupBy(*key)).applyInPandas(_solve(k, dim, 1024), schema)

    def merged(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    first = cut(merged(joined(asked.select(F.col("group").alias("cell"), "id", "v", "lot", least.alias("floor")))))
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    asked = cut(asked.join(floors.groupBy("id").agg(F.max("floor").alias("floor")), "id", "left").withColumn("floor", F.coalesce("floor", least)))
    lows = {r.group: r.low for r in asked.groupBy("group").agg(F.min("floor").alias("low")).collect()}

    total, sent_pairs = sum(r.queries for r in about.values()), 0
    groups, cells = np.array(sorted(lows), np.int64), np.array(sorted(about), np.int64)
    of_groups, of_cells = [about[g] for g in groups], [about[c] for c in cells]
    most = pivots[groups] @ pivots[cells].T + np.outer([x.R for x in of_groups], norms[cells]) + np.outer([x.Q for x in of_groups], [x.r for x in of_cells])
    reach = np.maximum(most * (1 + 1e-9) + 1, LEAST_SCORE) >= np.array([lows[g] for g in groups], np.float64)[:, None]
    g, c = np.nonzero(reach & (groups[:, None] != cells[None, :]))
    if len(g):
        # At most n_pivots squared rows of two numbers, and n_pivots rows with a pivot.
        routes = F.broadcast(spark.createDataFrame(pd.DataFrame({"group": groups[g], "cell": cells[c]}), "group int, cell int"))
        told = [(int(j), float(r.r), float(norms[j]), float(r.lo), float(r.hi), float(r.w), [float(x) for x in pivots[j]]) for j, r in zip(cells, of_cells, strict=True)]
        told = F.broadcast(spark.createDataFrame(told, "cell int, r double, norm double, lo double, hi double, w double, pivot array<double>"))
        # The bounds for one query instead of its group; the margins are for the rounding of doubles.
        dot = F.aggregate(F.zip_with("v", "pivot", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        near = asked.join(routes, "group").join(told, "cell").withColumn("dot", dot).withColumn("square", square)
        up = F.when(F.col("norm") > 0, F.col("dot") / F.col("norm")).otherwise(F.lit(0.0))
        by_radius = F.col("dot") + F.sqrt("square") * F.col("r")
        by_extent = F.greatest(up * F.col("lo"), up * F.col("hi")) + F.sqrt(F.greatest(F.lit(0.0), F.col("square") - up * up)) * F.col("w")
        margin = 1 + F.sqrt("square") * (F.col("r") + F.col("norm")) * 1e-9
        sent = cut(near.where(F.greatest(F.least(by_radius, by_extent) + margin, F.lit(LEAST_SCORE)) >= F.col("floor")).select("cell", "id", "v", "lot", "floor"))
        sent_pairs = sent.count()
        first = first.select("query_id", "vec_id", "score").unionByName(joined(sent))
    out = merged(first).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    out.sent = (total * (len(about) - 1), sent_pairs)
    return out
