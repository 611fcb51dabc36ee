import random

import pytest
from pyspark.sql import functions as F

from pagemill.llm import mixing


def filled(sizes, weights=(1, 2, 3), top=3):
    """Water filling by repeated resharing."""
    names = sorted(sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        full = {s for s in free if share[s] > top * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = float(top * sizes[s])
            left -= target[s]
        free -= full
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"0s{i}": rnd.choice([0, 1, 10, 500, 9000]) for i in range(rnd.randint(1, 9))} | {"1": 40}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "stratum string, source_size long")).collect()
    want = filled(sizes)
    assert {r.stratum: pytest.approx(r.target) for r in got} == want


def test_mix(spark):
    rnd = random.Random(5)
    rows = [(i, "wort " * rnd.randint(0, 60), rnd.choice(["a", "a", "a", "b", None, "ü"]), i) for i in range(900)]
    rows += [(3, "wort wort", "a", 1), (3, "wort wort", "a", 1), (None, "x y", "b", 0), (901, None, None, 0), (902, "", "leer", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    one = mixing.mix(docs).collect()
    two = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    assert len(one) == len(rows)
    largest = 60
    for s in {r.stratum for r in one}:
        mine = [r for r in one if r.stratum == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= largest
        assert len({r.times for r in mine if r["size"]}) <= 2
        assert sum(r["size"] for r in mine) == mine[0].source_size
    assert all(r.taken <= 3 * r["size"] and r.taken >= 0 for r in one)


def test_weights_prefer_quality(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("wort " * 10).alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"),
        F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.3).alias("q"),
    )
    out = mixing.mix(docs, weight_col="q").where("stratum = '0a'").groupBy(F.col("doc_id") % 2).agg(F.sum("times")).collect()
    n = {r[0]: r[1] for r in out}
    assert n[0] > 1.5 * n[1]


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
