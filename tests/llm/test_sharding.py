import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from pagemill.llm import sharding


def make(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["ab", "é" * 9, "", None, "lang " * 99]), rnd.choice(["a"] * 5 + ["b", "c", None]), i) for i in range(1500)]
    rows += [(7, "ab", "a", 0)] * 3 + [(None, "x", "b", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, shard long")


def test_shards(spark):
    rows, docs = make(spark)
    got = sharding.interleave(docs, n_shards=11, buckets=32).collect()
    again = sharding.interleave(docs.repartition(5), n_shards=11, buckets=64).collect()
    assert len(got) == len(rows)
    assert sorted(r.position for r in got) == list(range(len(rows)))
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    counts = [len(x) for x in by.values()]
    assert len(by) == 11 and max(counts) - min(counts) <= 1
    for x in by.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    total = Counter(r.stratum for r in got)
    for s, n in total.items():
        for x in by.values():
            assert abs(sum(r.stratum == s for r in x) - n / 11) <= 2.01
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert Counter((r.doc_id, r.position) for r in got) == Counter((r.doc_id, r.position) for r in again)


def test_write(spark, tmp_path):
    docs = spark.range(50).selectExpr("id doc_id", "'t' text", "cast(id % 3 as string) source", "7 slot", "8 id", "9 _shard", "10 size")
    placed = sharding.interleave(docs, n_shards=4)
    sharding.write_shards(docs, placed, str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["count"] for r in out.groupBy("shard").count().collect()) == [12, 12, 13, 13]
    assert sorted(out.columns) == sorted([*docs.columns, "shard"]) and {r.slot for r in out.collect()} == {7}
    for shard in range(4):
        want = [r.doc_id for r in placed.where(f"shard = {shard}").orderBy("slot").collect()]
        files = sorted((tmp_path / "out" / f"shard={shard}").glob("*.parquet"))
        assert [i for f in files for i in pq.read_table(f, partitioning=None)["doc_id"].to_pylist()] == want


def test_ranks_one_by_one(spark):
    """Positions, worked out on one machine."""
    rows, docs = make(spark)
    h = lambda i: int(hashlib.md5(f"20:{'' if i is None else i}".encode()).hexdigest()[:15], 16)
    by = defaultdict(list)
    for i, t, s, _ in rows:
        data = (t or "").encode()
        by["1" if s is None else "0" + s].append((h(i), zlib.crc32(data), len(data) + 16, i))
    order = []
    for s, x in by.items():
        order += [((2 * r + 1) / (2 * len(x)), s, r, i) for r, (*_, i) in enumerate(sorted(x, key=lambda y: y[:3]))]
    want = [i for *_, i in sorted(order, key=lambda x: x[:3])]
    got = [r.doc_id for r in sharding.interleave(docs, n_shards=11).orderBy("position").collect()]
    assert got == want


def test_empty_and_few(spark):
    assert sharding.interleave(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    got = sharding.interleave(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, source string")).collect()
    assert [(r.shard, r.slot) for r in got] == [(0, 0)]
