"""Vector search, relevance and chat context."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows of a collection, and queries to it, that one task compares; queries that it compares at once.
BLOCK, AT_ONCE = 4096, 256
#: More than rounding can move a cosine by.
MARGIN = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is all zeros."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _matrix(lists: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists as rows, padded with zeros."""
    out = np.zeros((len(lists), dim))
    out[np.arange(dim) < pc.list_value_length(lists).to_numpy()[:, None]] = pc.list_flatten(lists).to_numpy()
    return out


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray | slice = slice(None), j: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Products of rows i of one matrix with rows j of the other, summed from the first component on, as SQL sums them."""
    out = 0.0
    for x, y in zip(a.T, b.T, strict=True):
        out = out + x[i] * y[j]
    return out


def _best(k: int, distance: bool):
    """A block of rows and the queries sent to it, as (query_id, id, score) of the k best rows of each query, ties to smaller ids.

    Products of unit vectors tell which rows can be among the k best; the scores of those are then taken as SQL takes them.
    Vectors whose squares doubles can't hold well are always among them. All zeros, and other lengths, have no score.
    """

    def unit(x: np.ndarray, square: np.ndarray) -> np.ndarray:
        return np.where((square > 1e-280) & (square < 1e280), x.T / np.sqrt(square), np.nan).T

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left, sort_keys=[("id", "ascending")], null_placement="at_start"))
        length, asked_length = (pc.list_value_length(x["v"]).to_numpy() for x in (left, right))
        dim = max(length.max(initial=1), asked_length.max(initial=1))
        rows, asked = np.asfortranarray(_matrix(left["v"], dim)), np.asfortranarray(_matrix(right["v"], dim))
        q, v, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        with np.errstate(all="ignore"):
            square, asked_square = _dots(rows, rows), _dots(asked, asked)
            units, asked_units = unit(rows, square), unit(asked, asked_square)
            for at in range(0, len(asked) if len(rows) else 0, AT_ONCE):
                part = slice(at, at + AT_ONCE)
                near = asked_units[part] @ units.T
                odd = np.isnan(near)
                may = (asked_length[part, None] == length) & (asked_square[part, None] != 0) & (square != 0)
                near[odd | ~may] = -np.inf
                if len(rows) > k:
                    may &= odd | (near >= np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k, None] - MARGIN)
                i, j = np.nonzero(may)
                both = asked_square[part][i] * square[j]
                norm = np.where((both > 0) & (both < np.inf), np.sqrt(both), np.sqrt(asked_square[part][i]) * np.sqrt(square[j]))
                score = np.clip(_dots(asked[part], rows, i, j) / norm, -1, 1)
                score = 1 - score if distance else score
                order = np.lexsort((j, np.nan_to_num(score if distance else -score, nan=np.inf if distance else -np.inf), i))
                order = order[np.arange(len(order)) - np.searchsorted(i, i, "left") < k]  # i is in order already
                q.append(i[order] + at)
                v.append(j[order])
                s.append(score[order])
        q, v, s = (pa.array(np.concatenate(x)) for x in (q, v, s))
        return pa.table({"query_id": right["query_id"].take(q), "id": left["id"].take(v), "score": s})

    return run


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, distance: bool = False) -> DataFrame:
    """(query_id, id, score, rank) of the k best rows of vectors (id, c, v) for each of queries (query_id, c, v), among those of
    the same c: by cosine, or by the distance 1 - cosine. Ties go to smaller ids.

    The rows of a c are dealt over blocks and its queries over slices; a task gets one block and one slice, and sends k rows of
    a query on.
    """

    def usable(df: DataFrame) -> DataFrame:
        whole = F.col("c").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
        return df.where(whole).withColumn("v", F.col("v").cast("array<double>"))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        """Of each c that has more rows than a block; any other is one. So they are few."""
        return F.broadcast(df.groupBy("c").count().where(F.col("count") > BLOCK).select("c", F.ceil(F.col("count") / BLOCK).cast("int").alias(name)))

    queries, vectors = usable(queries), usable(vectors)
    n_parts, n_slices = blocks(vectors, "parts"), blocks(queries, "slices")
    sized = lambda df: df.join(n_parts, "c", "left").join(n_slices, "c", "left").fillna(1, ["parts", "slices"])
    one = lambda name, n: F.pmod(F.xxhash64(name, "v"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = sized(vectors).select("c", one("id", "parts").alias("part"), each("slices").alias("slice"), "id", "v")
    asked = sized(queries).select("c", each("parts").alias("part"), one("query_id", "slices").alias("slice"), "query_id", "v")
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("id", vectors.schema["id"].dataType), StructField("score", DoubleType())])
    key = ["c", "part", "slice"]
    found = data.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_best(k, distance), schema)
    best = Window.partitionBy("query_id").orderBy(F.asc("score") if distance else F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(vectors: DataFrame, query: list[float], k: int = 3, floor: float = 0.65, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k most similar rows to one query, best first; those at the floor if there are any, else all k.

    One scan and a bounded top-k: each task sends k rows on.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.select(id_col, cosine(F.col(vector_col), q).alias("score")).where("score is not null").orderBy(F.desc("score"), id_col).limit(k)
    top = F.max("score").over(Window.partitionBy(F.lit(0)))
    return best.withColumn("_top", top).where((F.col("score") >= floor) | (F.col("_top") < floor)).drop("_top")


def search_many(queries: DataFrame, vectors: DataFrame, k: int = 3, floor: float = 0.65, good: float = 0.7, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_id, id, score, tier) of the k most similar rows to each query, best first.

    strict: rows at the floor, if the best one is good. exact: all k rows, where the best is below that, or nothing reaches the
    floor. As the scan is exact, every laxer floor would give a part of the same k rows.

    Rows and queries are compared in blocks, all pairs of them; each block sends k rows of a query on.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.lit(0).alias("c"), F.col(query_vector).alias("v"))
    top = _nearest(asked, vectors.select(F.col(id_col).alias("id"), F.lit(0).alias("c"), F.col(vector_col).alias("v")), k)
    top = top.select(F.col("query_id").alias(query_id), F.col("id").alias(id_col), "score")
    most = F.max("score").over(Window.partitionBy(query_id))
    top = top.withColumn("tier", F.when(most >= good, "strict").otherwise("exact"))
    return top.where((F.col("tier") == "exact") | (F.col("score") >= floor))


def in_collection(queries: DataFrame, vectors: DataFrame, n: int = 5, floor: float = 0.8, collection: str = "collection_id", id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_id, id, rank, relevance) of the n nearest rows of each query's own collection, those of enough relevance.

    rank is by distance, ties to smaller ids; relevance is rounded, so it doesn't tell near rows apart.
    Relevance is 1 - d / max(d) over the n rows found, d the cosine distance. Rows that aren't relevant aren't filled in,
    however few are left.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(collection).cast(vectors.schema[collection].dataType).alias("c"), F.col(query_vector).alias("v"))
    near = _nearest(asked, vectors.select(F.col(id_col).alias("id"), F.col(collection).alias("c"), F.col(vector_col).alias("v")), n, distance=True)
    found = near.select(F.col("query_id").alias(query_id), F.col("id").alias(id_col), "rank", F.col("score").alias("distance"))
    return relevant(found, query_id, floor).drop("distance")


def relevant(distances: DataFrame, query_col: str = "query_id", floor: float = 0.8) -> DataFrame:
    """Relevance 1 - d / max(d) within a query, rounded to 3; rows at the floor stay. All distances 0: relevance 1."""
    most = F.max("distance").over(Window.partitionBy(query_col))
    score = F.coalesce(1 - F.col("distance") / F.nullif(most, F.lit(0.0)), F.lit(1.0))
    return distances.withColumn("relevance", score).where(F.col("relevance") >= floor).withColumn("relevance", F.round("relevance", 3))


def last_turns(chat: DataFrame, n: int = 5, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, context): the last n turns of each conversation as `role: text` lines in order."""
    tail = chat.withColumn("_rn", F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))).where(F.col("_rn") <= n)
    said = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.concat_ws(": ", role, text).alias("said"))))
    return tail.groupBy(conv).agg(F.count("*").alias("n_turns"), F.array_join(F.transform(said, lambda x: x["said"]), "\n").alias("context"))


def context(chunks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, context): numbered passages joined by an empty line."""
    found = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return chunks.groupBy(key).agg(F.array_join(F.transform(found, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["t"])), "\n\n").alias("context"))


def prompt(system: Column, history: Column, question: Column) -> Column:
    """System, history and question as the messages of one call; a blank question has no prompt."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.when(F.trim(question) != "", F.concat(F.array(message("system", system)), history, F.array(message("user", question))))


def answer_prompt(questions: DataFrame, passages: DataFrame, chat: DataFrame, system: str, query_id: str = "query_id", conv: str = "conv_id", turns: int = 5) -> DataFrame:
    """(query_id, context, messages): what a model is to be asked for each question (query_id, conv, question).

    passages (query_id, rank, text, and url, title where they are known) become the context, numbered, or with the address
    that each is from; the last turns of the question's conversation (conv, turn, role, text) become the history.
    """
    sourced = F.when(F.col("url").isNotNull(), F.concat(F.lit("From "), F.col("url"), F.lit(" ("), F.coalesce("title", F.lit("")), F.lit("):\n"), F.col("text")))
    texts = passages.select(query_id, "rank", F.coalesce(sourced, F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text"))).alias("t"))
    found = F.array_sort(F.collect_list(F.struct("rank", "t")))
    contexts = texts.groupBy(query_id).agg(F.array_join(F.transform(found, lambda x: x["t"]), "\n\n").alias("context"))
    tail = chat.withColumn("_rn", F.row_number().over(Window.partitionBy(conv).orderBy(F.desc("turn")))).where(F.col("_rn") <= turns)
    said = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    histories = tail.groupBy(conv).agg(F.transform(said, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("history"))
    asked = questions.join(contexts, query_id, "left").join(histories, conv, "left")
    told = F.concat(F.lit(system + "\n\n"), F.coalesce("context", F.lit("")))
    history = F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>"))
    return asked.select(query_id, "context", prompt(told, history, F.col("question")).alias("messages")).where("messages is not null")


def flat_prompt(messages: Column) -> Column:
    """Messages as `role: content` lines, for models that take one text."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


#: How a text becomes a vector, by name; remote models are added by their users as functions of a column.
EMBEDDERS = {"hashed": lambda text: hashed_embedding(text)}


def embedder(name: str = "hashed"):
    """The function of a name; names that nothing was added for are an error."""
    if name not in EMBEDDERS:
        raise ValueError(f"no embedder {name!r}; there are {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[name]


def _counts(codes: np.ndarray | None, dim: int) -> list | np.ndarray:
    if codes is None:
        return [None] * dim
    up, down = np.bincount(np.asarray(codes, np.int64), minlength=2 * dim).reshape(dim, 2).T
    signed = up - down
    return (signed if signed.any() else up + down).astype(np.float64)


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """An offline stand-in for a remote embedding: signed counts of hashed words. Where they cancel out to nothing, the counts
    have no signs: only a text without words is all zeros."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    code = lambda w: (F.pmod(F.xxhash64(w), F.lit(dim)) * 2 + F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2))).cast("int")  # noqa: E731  odd: counts down

    @F.pandas_udf("array<double>")
    def counted(codes: pd.Series) -> pd.Series:
        return pd.Series([_counts(x, dim) for x in codes], dtype=object)

    return counted(F.transform(words, code))
