"""Quality classification by hierarchical empirical Bayes.

A logistic model of a document's own measures gives its evidence. The measures are shares of kinds of characters and
words, and the mean log-odds of the text's words, hashed to BUCKETS: these are learned from one half of the labelled rows,
the logistic weights from the other, so that no document vouches for its own words. Documents of one site (host) and of
one path of a site share a quality, whose posterior is a Beta mean: the path's soft counts, shrunk towards the host's,
which are shrunk towards the global prior. The strength of each shrinkage is estimated from the variance between the
groups (method of moments), so sparse sites fall back on what is known of all. A document's odds are its own, with the
labelled base rate replaced by the posterior of its path, from which its own count is taken out.

The model is fitted on at most MOST_LABELS labelled rows, chosen by a hash of their ids: so many ids are broadcast to find
their texts before anything is measured. Only sums over them (BUCKETS counts, a few hundred numbers a step, four numbers on the
groups) come to the driver. All documents are measured once and written with their
evidence; group sums are pre-aggregated over hosts and paths, and come back to the rows by common.joined(), which moves no
text where sites are few and salts hot sites where they are many.

Defined results: a null or blank text has all measures 0; null hosts and paths are groups of their own; without labels,
or with labels of one kind only, the evidence is neutral or nearly so and clean documents stay; labels of unknown
documents, null labels and repeated labels are ignored, ignored and all counted; repeated rows are judged alike, each
counting for its site; a text of any length is measured whole, and in constant memory beside it; an empty table gives an
empty result. Columns of any name are carried; one that bears a result's name gives way in judge(), and stays in keep().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import WORD, Renamed, crc_fold, cut, joined
from pagemill.llm.sharding import stratum

#: A document whose quality is below this is rejected.
LEAST_QUALITY = 0.3
RIDGE, STEPS = 0.1, 10
#: Bounds of the strength of a prior, in documents.
WEAKEST, STRONGEST = 2.0, 1000.0
#: Buckets of hashed words, and the count added to each side of a bucket's odds.
BUCKETS, SMOOTH = 4096, 4.0
#: Number of measures; labelled rows that the model is fitted on, at most (a third more by chance).
MEASURES, MOST_LABELS = 10, 60_000


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _split(text: Column) -> Column:
    return F.split(F.lower(text), r"[\x20\x09-\x0D]+")


def _literal(values: np.ndarray) -> Column:
    """An array of numbers as one literal: the text is parsed when the plan is optimised."""
    return F.expr(f"from_json('[{','.join(f'{v:.4f}' for v in values)}]', 'array<double>')")


def measures(docs: DataFrame, text_col: str, odds: np.ndarray, name: str) -> DataFrame:
    """docs with one more column: numbers of about -1 to 1.

    Counts are taken in a select of their own, once a row. The callers write the result before they filter by it, so the
    counts aren't taken again for a condition.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    of = lambda signs: F.regexp_count(text, F.lit(f"[{signs}]"))  # noqa: E731  translate() would make a string of each character
    counts = {
        "chars": F.greatest(F.length(text), F.lit(1)), "words": F.greatest(F.regexp_count(text, F.lit(WORD)), F.lit(1)),
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")), "bangs": of("!?"), "signs": of("#*$%&<>"), "bars": of("|»·•"),
        "digits": of("0-9"), "stops": of(".,;:"), "split": _split(text),
    }
    own = [F.col(c) for c in docs.columns]
    counted = docs.select(*own, *[c.alias(f"count_{k}") for k, c in counts.items()])
    n = {k: F.col(f"count_{k}") for k in counts}
    share = lambda x, y: F.least(F.lit(1.0), x / y)
    told = F.aggregate(n["split"], F.lit(0.0), lambda a, w: a + F.get(_literal(odds), _bucket(w)))
    x = F.array(
        share(n["upper"], n["chars"]), share(n["bangs"], n["words"]), share(n["signs"], n["words"]), share(n["bars"], n["words"]), share(n["digits"], n["chars"]),
        n["stops"] / n["words"], F.log1p(n["words"]) / 10, share(F.size(F.array_distinct(n["split"])), n["words"]), share(n["chars"] / n["words"], F.lit(20)),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), told / n["words"])),
    )
    return counted.select(*own, x.alias(name))


def _word_odds(rows: DataFrame) -> np.ndarray:
    """The log-odds of each bucket, centred: labels (good of n) of rows (text, good, n) that hold a word of it."""
    words = rows.select("good", "n", F.explode(F.array_distinct(F.transform(_split(F.col("text")), _bucket))).alias("k"))
    sums = words.groupBy("k").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    good, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    good[sums["k"]], bad[sums["k"]] = sums["good"], sums["n"] - sums["good"]
    odds = np.log((good + SMOOTH) / (bad + SMOOTH)) - np.log((good.sum() + SMOOTH) / (bad.sum() + SMOOTH))
    return np.round(np.where(good + bad > 0, odds, 0.0), 4)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELS) -> tuple[np.ndarray, list[float], float]:
    """(log-odds of the buckets, weights with the constant last, labelled base rate) from `most` labelled rows."""
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("double").alias("y"))
    y = y.groupBy("id").agg(F.sum("y").alias("good"), F.count("*").alias("n"))
    many = y.count()
    if many > most:
        y = y.where(F.pmod(F.xxhash64(F.lit("label"), "id"), F.lit(1 << 40)) < (most << 40) // many)
    known = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = cut(known.join(F.broadcast(y), "id").select("text", "good", "n", (crc_fold("id", 2) == 0).alias("half")))
    odds = _word_odds(known.where("half"))
    rows = cut(measures(known.where("not half"), "text", odds, "x").select("x", "good", "n"))
    d = MEASURES + 1
    weights, rate = np.zeros(d), 0.5
    for _ in range(STEPS):
        now = weights.copy()

        def run(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total = np.zeros(d * d + d + 2)
            for b in batches:
                if len(b):
                    a = np.column_stack([np.stack(list(b["x"])), np.ones(len(b))])
                    p, n, good = 1 / (1 + np.exp(-a @ now)), b["n"].to_numpy(float), b["good"].to_numpy(float)
                    total += np.concatenate([(a.T * (n * p * (1 - p)) @ a).ravel(), a.T @ (good - n * p), [n.sum(), good.sum()]])
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

        sums = rows.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")["v"].to_numpy()
        if not len(sums) or not sums[-2]:
            break
        rate = float(np.clip(sums[-1] / sums[-2], 0.01, 0.99))
        step = np.linalg.solve(sums[: d * d].reshape(d, d) + RIDGE * np.eye(d), sums[d * d : d * d + d] - RIDGE * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-4:
            break
    # Rounded, so that reruns agree whatever the order of the sums.
    return odds, [round(float(w), 6) for w in weights], round(rate, 6)


def _logit(p: Column) -> Column:
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, n: str, s: str, q: str) -> tuple[float, float]:
    """(mean, prior strength in documents) of groups with n rows, sum s and sum of squares q of their scores."""
    rows = groups.agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(q).alias("q")).first()
    if not rows["n"]:
        return 0.5, STRONGEST
    mean = rows["s"] / rows["n"]
    between = F.col(n) * F.pow(F.col(s) / F.col(n) - mean, 2)
    k, spread, within = groups.agg(F.count("*"), F.sum(between), F.sum(F.col(q) - F.col(s) * F.col(s) / F.col(n))).first()
    noise = max(0.0, within) / max(1, rows["n"] - k)
    variance = max(0.0, (spread - (k - 1) * noise) / rows["n"])
    strength = mean * (1 - mean) / variance - 1 if variance > 1e-9 else STRONGEST
    return round(mean, 6), round(float(np.clip(strength, WEAKEST, STRONGEST)), 3)


def _judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str, text_col: str, carry: list[str] | None) -> tuple[Renamed, DataFrame]:
    odds, weights, rate = fit(docs, labels, id_col, text_col)
    own = Renamed(docs, carry, host=stratum(host), path=stratum(path), body=F.col(text_col))
    score = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        score = score + F.col("x")[i] * w
    placed = measures(own.rows, "body", odds, "x")
    e = F.col("e")
    placed = cut(placed.select(*own.own, "host", "path", (1 / (1 + F.exp(-score))).alias("e")))
    paths = cut(placed.groupBy("host", "path").agg(F.count("*").alias("pn"), F.round(F.sum(e), 4).alias("ps"), F.round(F.sum(e * e), 4).alias("pq")))
    hosts = cut(paths.groupBy("host").agg(F.sum("pn").alias("hn"), F.sum("ps").alias("hs"), F.sum("pq").alias("hq")))
    mean, of_hosts = _strength(hosts, "hn", "hs", "hq")
    _, of_paths = _strength(paths, "pn", "ps", "pq")
    sites = cut(joined(paths, hosts, ["host"], F.xxhash64("path")).select("host", "path", "pn", "ps", "hn", "hs"))
    judged = joined(placed, sites, ["host", "path"], F.xxhash64("e", *own.own[:1]))
    host_quality = (F.col("hs") - e + mean * of_hosts) / (F.col("hn") - 1 + of_hosts)
    judged = judged.withColumn("host_quality", host_quality)
    judged = judged.withColumn("path_quality", (F.col("ps") - e + F.col("host_quality") * of_paths) / (F.col("pn") - 1 + of_paths))
    total = _logit(e) + _logit(F.col("path_quality")) - _logit(F.lit(rate))
    return own, judged.withColumn("quality", 1 / (1 + F.exp(-total)))


RESULTS = ("evidence", "host_quality", "path_quality", "quality", "kept")


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The columns `carry` of docs (all, if None) with evidence (the document's own), host_quality, path_quality, quality and
    kept, named with the prefix."""
    own, judged = _judged(docs, labels, host, path, id_col, text_col, carry)
    values = (F.col("e"), F.col("host_quality"), F.col("path_quality"), F.col("quality"), F.col("quality") >= LEAST_QUALITY)
    return own.back(judged, **{prefix + k: v for k, v in zip(RESULTS, values, strict=True)})


def keep(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs whose quality isn't too low, with their own columns only."""
    own, judged = _judged(docs, labels, host, path, id_col, text_col, None)
    return own.back(judged.where(F.col("quality") >= LEAST_QUALITY))
