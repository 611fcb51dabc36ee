import random
from collections import defaultdict

import numpy as np

from pagemill.llm import dedup


def brute(rows):
    """Sets, and components of documents by exact similarity of all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n=150):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 4000)}"
    rows, at = [], 0
    for _ in range(n // 6):
        base = [word() for _ in range(rnd.choice([1, 3, 5, 9, 60, 200]))]
        for k in range(rnd.choice([1, 2, 4, 12])):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 60)) if k else 0):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((at := at + rnd.randint(1, 3), rnd.choice([" ", "\n", "  "]).join(copy).replace("w", rnd.choice("wW"))))
    rnd.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus(1) + [(9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "One  two"), (9006, "one two three")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = dedup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = dedup.deduplicate(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in got if r.kept)
    assert kept[0].key == "x"


def test_chain_and_mixed_buckets(spark, monkeypatch):
    # A chain of copies whose ends aren't alike, in blocks of few rows.
    monkeypatch.setattr(dedup, "BLOCK", 4)
    rnd = random.Random(4)
    base = [f"w{rnd.randint(0, 9999)}" for _ in range(150)]
    rows = []
    for i in range(40):
        base = list(base)
        base[(i * 7) % 150] = f"x{i}"
        rows.append((i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(docs).collect()} == brute(rows)


def test_dense_group_near_the_threshold(spark):
    # Copies of one text that are all about as alike as the threshold: many pairs pass the sketches, some are links.
    rnd = random.Random(6)
    base = [f"w{rnd.randint(0, 9999)}" for _ in range(300)]
    rows = []
    for i in range(90):
        copy = list(base)
        for k in range(2 + i % 4):
            copy[rnd.randrange(300)] = f"x{i}y{k}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(docs).collect()} == want


def test_repeated_rows_and_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (3, text + " z"), (None, text), (7, "other words in here now"), (7, text), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in dedup.near_duplicates(docs).collect())
    assert got == sorted([("5", 36, "3", False)] * 2 + [("3", 37, "3", True), ("None", 36, "None", True), ("7", 1, "7", True), ("7", 36, "3", False), ("None", 0, "None", True)])
    kept = sorted((str(r.doc_id), str(r.text)[:5]) for r in dedup.deduplicate(docs).collect())
    assert kept == sorted([("3", "w0 w1"), ("None", "w0 w1"), ("7", "other"), ("None", "None")])
    assert dedup.near_duplicates(docs.where("false")).collect() == []


def test_sketch_fills_and_estimates():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 5, 50, 5000):
        s = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        assert dedup.sketch(s).max() < np.iinfo(np.uint64).max
    a, b, both = (rnd.integers(0, 2**63, n).astype(np.uint64) for n in (75, 75, 850))
    agree = (dedup.sketch(np.concatenate([a, both])) == dedup.sketch(np.concatenate([b, both]))).sum()
    assert dedup.AGREE < agree <= dedup.COORDINATES


def test_components_of_random_graphs(spark):
    rnd = random.Random(9)
    links = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b), near[b].add(a)
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in links], "a binary, b binary")
    state = dedup.components(dedup.cut(df.limit(1000).where("a < X'28'")))
    state = dedup.components(dedup.cut(df), state)
    got = {r.key[0]: r.label[0] for r in state.collect()}
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y), todo.append(y)
        if len(seen) > 1:
            assert {got[y] for y in seen} == {got[x]} and got[x] in seen
