import hashlib
import math
import os
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import mixing, quality_rules
from pagemill.llm.common import words_of
from pagemill.llm.queries import word_vocabulary
from pagemill.storage import release

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        ids, before = (x.select("doc_id").distinct() for x in (out, docs))
        assert ids.join(before, "doc_id", "left_anti").count() == 0
        if name == "bpe":
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == docs.count()
        else:
            assert out.columns == columns
        if name == "near_dedup":
            assert out.count() == ids.count()
        if name == "mixing":
            words, taken = (x.agg(F.sum(words_of(F.col("text")))).first()[0] for x in (docs, out))
            assert abs(taken - words) < 0.2 * words
        docs = out


def test_repeat_gives_what_mix_takes(spark):
    rows = [(i, "w " * (i % 9), ["a", "b", None][i % 3], 5) for i in range(60)] + [(3, "w w w", "a", 6), (3, "w w w", "a", 6), (None, "w w", "b", 0), (None, "v v", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    want = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    assert out.agg(F.sum(words_of(F.col("text")))).first()[0] == want


def test_odd_rows(spark, tmp_path):
    text = "\n".join(f"Here word{i} says other{i} and more{i} about thing{i}, then yet{i} ends{i}." for i in range(6))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (None, text, "en", "b", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {1, None} and out
    empty = tmp_path / "none"
    spark.read.parquet(str(tmp_path / "documents.parquet")).where("false").write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).where("false").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).collect() == []


def test_near_dedup_links_from_080(spark):
    # One changed word makes (n - 5) / (n + 5) of n shingles: 45 gives 0.80, 61 gives 0.848, 44 gives 0.796.
    rnd = random.Random(8)
    rows, groups = [], {n: 6 for n in (44, 45, 46, 48, 50, 53, 56, 59, 61, 70)}
    for n, times in groups.items():
        for _ in range(times):
            base = [f"w{rnd.randint(0, 10**6)}" for _ in range(n + 4)]
            copy = list(base)
            copy[rnd.randint(10, n - 8)] = f"x{len(rows)}"
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(rows)) for j in range(i)}
    assert sum(0.8 <= x < 0.85 for x in alike.values()) == 48 and sum(0.75 < x < 0.8 for x in alike.values()) == 6
    gone = {i for (i, _), x in alike.items() if x >= 0.8}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert sorted(kept) == sorted({i for i, _ in rows} - gone)


CLASHING = ["_id", "_mark", "_kept", "_windows", "_lines", "_x", "_host", "_evidence", "_take", "_times", "_copy", "id", "mark", "key", "times", "stratum", "c0", "added0", "body", "kept", "quality", "n", "rows"]


def prose(k, n=6):
    return "\n".join(f"Here word{k}x{i} says other{i * k} and more{i} about thing{i}, then yet{i} ends." for i in range(n))


def test_stages_on_odd_rows(spark, tmp_path):
    """Each stage by itself: nulls in every column, empty and very long texts, repeated rows, and columns of all working names."""
    long_text = "\n".join(f"Line{i} w{i * 7} x{i * 3} y{i} z{i * 11} ends{i}." for i in range(40_000))
    rows = [(1, prose(1), "en", "a", 1), (1, prose(1), "en", "a", 1), (2, prose(1), None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, long_text, "de", "b", 9), (None, prose(2), "en", "b", 9), (None, None, None, None, None), (6, prose(3), "en", "a", 1), (6, prose(4), "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(f"v{c}").alias(c) for c in CLASHING])
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (None, 1, None), (6, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = {"quality_rules": {1, 2, 5, 6, None}, "quality_classifier": {1, 2, 3, 4, 5, 6, None}, "near_dedup": {1, 3, 4, 5, 6, None}, "mixing": {1, 2, 5, 6, None}}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name == "bpe":
            assert len(got) == len(rows) and out.columns[0] == "doc_id"
            continue
        assert out.columns == docs.columns
        assert {r.doc_id for r in got} <= want[name] and (name == "mixing" or {r.doc_id for r in got} == want[name]), name
        assert all(r[c] == f"v{c}" for r in got for c in CLASHING)
        if name in ("quality_classifier", "near_dedup"):
            assert {(r.doc_id, r.text) for r in got} <= {(i, t) for i, t, *_ in rows}
        assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []
    release()


def test_rules_one_by_one(spark):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.rules(spark, docs, SF).collect()}
    rows = docs.collect()
    company = defaultdict(lambda: (Counter(), Counter()))
    for r in rows:
        lines = [x for x in (r.text or "").split("\n") if x.split()]
        for i, x in enumerate(lines):
            before, after = (lines[i - 1] if i else None), (lines[i + 1] if i + 1 < len(lines) else None)
            company[x.strip(" ").lower()][0][before or after] += 1
            company[x.strip(" ").lower()][1][after or before] += 1
    common = {k for k, (b, a) in company.items() if len(k.split()) <= 25 and min(len(b), len(a)) >= max(20, 0.2 * sum(b.values()))}

    def bad(line):
        n = len(line.split())
        many = lambda signs: sum(c in signs for c in line)
        end = line.rstrip(" ")[-8:].rstrip().rstrip("'\"”»’)]")
        return (
            many("#*$%&|<>") * 2 > n or (many("!?") * 2 > n and n >= 3) or (8 <= n <= 40 and not end.endswith(tuple(".!?:;…"))) or (many("|»›·•") >= 2 and many("|»›·•") * 4 >= n)
            or (n >= 3 and not any(c.islower() for c in line) and any(a.isupper() and b.isupper() for a, b in zip(line, line[1:]))) or (n <= 25 and line.strip(" ").lower() in common)
        )

    for r in rows:
        words = (r.text or "").split()
        windows = defaultdict(list)
        for i in range(len(words) - 4):
            windows[tuple(words[i : i + 5])].append(i)
        again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
        clean = [x for x in (r.text or "").split("\n") if not x.split() or not bad(x)]
        kept = len(words) >= 10 and 100 * len(again) <= 20 * len(words) and sum(len(x.split()) for x in clean) >= quality_rules.LEAST_KEPT * len(words)
        assert (r.doc_id in out) == kept, r.doc_id
        if kept:
            assert out[r.doc_id].text == "\n".join(clean) and out[r.doc_id].n_chars == len("\n".join(clean))


def test_mixture_one_by_one(spark):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    got = Counter(r.doc_id for r in corpus_pipeline.mixture(spark, docs, SF).collect())
    by, sizes = defaultdict(list), {}
    for r in docs.collect():
        n = len((r.text or "").split())
        u = (int(hashlib.md5(f"8:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        odd = sum(c in "0123456789#*$%&|<>!@^_~={}[]\\/+" for c in r.text or "")
        w = max(0.05, (len(r.text) - odd) / max(1, len(r.text))) if r.text is not None else 0.05
        by["1" if r.source is None else "0" + r.source].append((-math.log(u) / w, str(r.doc_id), n, r.doc_id))
    sizes = {s: sum(x[2] for x in rows) for s, rows in by.items()}
    targets = {r.stratum: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "stratum string, source_size long")).collect()}
    want = Counter()
    for s, rows in by.items():
        epochs = int(targets[s] // sizes[s]) if sizes[s] else 0
        rest, reached = targets[s] - epochs * sizes[s], 0
        for _, _, n, i in sorted(rows):
            if n and epochs + (reached + n / 2 <= rest):
                want[i] += epochs + (reached + n / 2 <= rest)
            reached += n
    assert got == want


def test_tokens_one_by_one(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_vocabulary())
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in corpus_pipeline.tokens(spark, docs, SF).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_leaves_one_table(spark):
    from pagemill import storage

    before = sum(map(len, storage._SCOPES))
    out = corpus_pipeline.run(spark, SF)
    assert sum(map(len, storage._SCOPES)) == before + 1 and out.count() > 0
    release()
    assert not any(storage._SCOPES)
