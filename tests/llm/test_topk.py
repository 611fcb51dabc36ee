import random

import pytest
from pyspark.sql import functions as F

from pagemill.llm import topk


def brute(rows, k):
    import math

    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % 20:
            continue
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize(("n", "block"), [(900, 64), (12, 8192)])
def test_equals_brute_force(spark, n, block):
    rnd = random.Random(n)
    middles = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [m + rnd.gauss(0, 0.1) for m in rnd.choice(middles)]) for i in range(n)]
    rows += [(n + 20 - n % 20, [1.0] * 8), (n + 40 - n % 20, None), (7001, [None] * 8), (7002, [float("nan")] * 8), (7020, []), (7040, [0.5]), (None, [1.0] * 8)]
    rows += [(8000 + i, [1.0] * 8) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=5, n_pivots=6, block=block).collect()
    assert {tuple(r) for r in got} == brute(rows, 5)
    assert len(got) == len(brute(rows, 5))


def test_large_numbers_and_empty(spark):
    rows = [(i, [1e6 * i, 3.0, -1e6]) for i in range(25)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=3, n_pivots=3).collect()} == brute(rows, 3)
    assert topk.top_k(vectors.where("false"), F.lit(True)).collect() == []
    assert topk.top_k(vectors, F.lit(False), n_pivots=3).collect() == []


def test_products_beyond_64_bits(spark):
    rows = [(0, [3e9] * 64), (1, [3e9] * 64), (2, [-3e9] * 64), (3, [1e30] * 64), (4, [1.0] * 64), (20, [2e16] + [0.0] * 63)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("cell"), F.lit(2).alias("id"), F.lit(3).alias("v"))
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(vectors, F.col("vec_id") % 20 == 0, n_pivots=3).collect()}
    most = (1 << 63) - 1
    into = lambda x: max(-most, min(most, x))
    v = {i: [into(int(64 * x)) for x in row] for i, row in rows}
    assert got == {(q, i): into(sum(a * b for a, b in zip(v[q], v[i]))) for q in (0, 20) for i in v if i != q}
    assert got[0, 1] == most and got[0, 2] == -most and got[0, 4] == 3 * 10**9 * 64 * 64 * 64


def test_bounds_leave_cells_out(spark):
    """Where the data has clusters, queries go to few cells; the result stays that of brute force."""
    rnd = random.Random(12)
    middles = [[rnd.gauss(0, 4) for _ in range(16)] for _ in range(30)]
    rows = [(i, [m + rnd.gauss(0, 0.15) for m in rnd.choice(middles)]) for i in range(1500)]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5, n_pivots=64, block=256)
    assert {tuple(r) for r in out.collect()} == brute(rows, 5)
    total, sent = out.sent
    print(f"sent {sent} of {total} pairs of a query and another cell")
    assert sent < 0.2 * total


def test_a_task_holds_one_slice(spark, monkeypatch):
    solve = topk._solve

    def watched(k, dim, slice_rows):
        run = solve(k, dim, slice_rows)

        def bounded(left, right):
            assert len(left) <= 128 and len(right) <= 128, (len(left), len(right))
            return run(left, right)

        return bounded

    monkeypatch.setattr(topk, "_solve", watched)
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(vectors, F.lit(True), k=3, n_pivots=2, block=64).collect()
    assert len(got) == 1800 and {tuple(r) for r in got if r.query_id % 20 == 0} == brute(rows, 3)
