import math
import os
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from pagemill.llm import quality_classifier as qc


def corpus(rnd, n=400):
    rows, labels = [], []
    for i in range(n):
        host = rnd.choice(["good"] * 4 + ["bad", None])
        low = rnd.random() < {"good": 0.03, "bad": 0.9, None: 0.3}[host]
        words = [f"word{rnd.randint(0, 500)}" for _ in range(rnd.randint(8, 60))]
        text = " ".join(w.upper() + "!!" for w in words) if low else " ".join(words) + "."
        rows.append((i, text, host, rnd.choice(["en", "de", None]), 1))
        if rnd.random() < 0.5:
            labels.append((i, int(not low), 0))
    return rows, labels


def sites(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r.evidence)
    return out


def strength(groups):
    """Mean and prior strength by the method of moments, over lists of scores."""
    n = sum(map(len, groups))
    mean = sum(map(sum, groups)) / n
    within = sum(sum(x * x for x in g) - sum(g) ** 2 / len(g) for g in groups)
    spread = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups)
    noise = max(0, within) / max(1, n - len(groups))
    variance = max(0, (spread - (len(groups) - 1) * noise) / n)
    at = mean * (1 - mean) / variance - 1 if variance > 1e-9 else qc.STRONGEST
    return mean, min(qc.STRONGEST, max(qc.WEAKEST, at))


def test_separates_and_shrinks(spark):
    rows, labels = corpus(random.Random(5))
    rows += [(9000, None, "good", "en", 1), (9001, "", "new", "x", 1), (9002, "word1 word2 word3 word4 ends here.", "rare", "en", 1), (9002, "word1 word2 word3 word4 ends here.", "rare", "en", 1)]
    rows += [(9003, "word7 " * 200_000, "good", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n int")
    known = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0), (77777, 0, 0)], "doc_id long, quality int, toxic int")
    got = qc.judge(docs, known, F.col("source"), F.col("lang")).collect()
    assert len(got) == len(rows)
    low = {i for i, t, *_ in rows if t and "!!" in t}
    assert sum(r.kept == (r.doc_id not in low) for r in got if r.doc_id < 9000) >= 0.98 * 400
    by = {r.source: r.host_quality for r in got}
    assert by["bad"] < by[None] < by["good"] and by["bad"] < by["rare"] < by["good"]
    again = qc.judge(docs.repartition(7), known.repartition(3), F.col("source"), F.col("lang")).collect()
    assert sorted((r.doc_id, round(r.quality, 9)) for r in got) == sorted((r.doc_id, round(r.quality, 9)) for r in again)
    # The posteriors, worked out one by one from the evidence.
    hosts, paths = sites(got, lambda r: r.source), sites(got, lambda r: (r.source, r.lang))
    mean, of_hosts = strength(list(hosts.values()))
    _, of_paths = strength(list(paths.values()))
    _, _, rate = qc.fit(docs, known)
    logit = lambda p: math.log(p / (1 - p))
    for r in got:
        h, p = hosts[r.source], paths[r.source, r.lang]
        host = (sum(h) - r.evidence + mean * of_hosts) / (len(h) - 1 + of_hosts)
        path = (sum(p) - r.evidence + host * of_paths) / (len(p) - 1 + of_paths)
        total = logit(min(1 - 1e-6, max(1e-6, r.evidence))) + logit(min(1 - 1e-6, max(1e-6, path))) - logit(rate)
        assert abs(r.host_quality - host) < 1e-3 and abs(r.path_quality - path) < 1e-3 and abs(r.quality - 1 / (1 + math.exp(-total))) < 1e-3


def test_held_out(spark):
    """Labels of three quarters of the ids; the others are ranked by evidence and by quality."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(os.path.join(sf, f"{t}.parquet")) for t in ("documents", "labels"))
    held = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 3}
    assert len(held) > 500
    got = qc.judge(docs, labels.where(~F.col("doc_id").isin(list(held))), F.col("source"), F.col("lang"), carry=["doc_id"]).collect()
    for name in ("evidence", "quality"):
        good, bad = ([r[name] for r in got if held.get(r.doc_id) == k] for k in (1, 0))
        area = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
        print(f"held-out AUC of {name}: {area:.4f} on {len(good)} good and {len(bad)} bad documents")
        assert area > 0.95


def test_clashing_columns_and_many_sites(spark, monkeypatch):
    rows, labels = corpus(random.Random(6), 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality int")
    names = ["_x", "_host", "_evidence", "x", "e", "host", "path", "body", "kept", "pn", "_salt", "c0", "added0"]
    docs = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = qc.keep(docs, known, F.col("source"), F.col("lang"))
    assert out.columns == docs.columns
    few = {tuple(r) for r in out.collect()}
    assert few <= {tuple(r) for r in docs.collect()} and 0 < len(few) < 120
    judged = qc.judge(docs, known, F.col("source"), F.col("lang"))
    assert sorted(judged.columns) == sorted({*docs.columns, *qc.RESULTS}) and {r.doc_id for r in judged.where("kept").collect()} == {r[0] for r in few}
    # Sites beyond the bound of a broadcast are joined salted, with equal results.
    plain = qc.joined
    monkeypatch.setattr(qc, "joined", lambda *a, **k: plain(*a, **k | {"most": 0}))
    assert {tuple(r) for r in qc.keep(docs, known, F.col("source"), F.col("lang")).collect()} == few


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "en"), (2, None, None, None)], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept for r in qc.judge(docs, none, F.col("source"), F.col("lang")).collect())
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(r.kept for r in qc.judge(docs, one, F.col("source"), F.col("lang")).collect())
    assert qc.keep(docs.where("false"), one, F.col("source"), F.col("lang")).collect() == []
