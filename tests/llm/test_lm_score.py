import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import lm_score
from pagemill.llm.common import crc_fold
from pagemill.llm.queries import piece_vocabulary


def all_paths(word, pieces):
    """Probability of a word by listing all its segmentations."""
    text = b" " + word

    def tail(at):
        return 1.0 if at == len(text) else sum(math.exp(pieces[text[at:k]]) * tail(k) for k in range(at + 1, len(text) + 1) if text[at:k] in pieces)

    return tail(0)


def test_forward_and_expected():
    rnd = random.Random(1)
    pieces = sorted({b" ", b" a", b" ab", b"a", b"b", b"c", b"ab", b"bc", b"abc", b"cab", bytes([200])})
    weights = np.log([rnd.uniform(0.01, 0.2) for _ in pieces])
    lattice = lm_score.Lattice(pieces, weights, math.log(0.3))
    table = dict(zip(pieces, weights, strict=True))
    words = [b"abcab", b"aaaaa", b"cabab"]
    for w, got in zip(words, lattice.score(words), strict=True):
        assert got == pytest.approx(math.log(all_paths(w, table) * 0.3))
    one = lattice.expected([b"abcab"], np.ones(1))
    lengths = sum(len(p) * x for p, x in zip(pieces, one, strict=True))
    assert lengths == pytest.approx(6)
    bumped = {p: w + (1e-6 if p == b"ab" else 0) for p, w in table.items()}
    slope = (math.log(all_paths(b"abcab", bumped)) - math.log(all_paths(b"abcab", table))) / 1e-6
    assert one[pieces.index(b"ab")] == pytest.approx(slope, abs=1e-4)


@pytest.mark.parametrize("frequent", [100_000, 3])
def test_base_and_score(spark, frequent):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["The", "the", "of", "ñu", "x\xa0y", *[f"w{k}" for k in range(60)]])
    rows = [(i, rnd.choice([" ", "\n", "\x0b "]).join(word() for _ in range(rnd.randint(0, 40)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "z" * 300), (504, "z" * 300 + " " + "y" * 70), (505, "y" * 70), (3, rows[3][1]), (None, "the null")]
    docs = spark.createDataFrame([(i, t, 1.0, 1, 1) for i, t in rows], "doc_id long, text string, score double, word int, id int")
    got = lm_score.score(docs, crc_fold("doc_id", 7) != 2, piece_vocabulary(), frequent=frequent, rounds=1).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: (t or "").encode().lower().split()
    counts, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            counts.update(split(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = Counter()
    for i, t in rows:
        words = split(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        want[i, held(i), len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    # The scores, word by word, from the recursion that test_forward_and_expected holds against all paths.
    words = spark.createDataFrame([(w, counts[w]) for w in counts], "word binary, c long")
    lattice = lm_score.Lattice(*lm_score.fit(words, piece_vocabulary(), rounds=1))
    of_counts, types = Counter(counts.values()), len(counts) + 1
    n1, n2 = of_counts[1], of_counts[2]
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    pieces = {w: float(lattice.score([w])[0]) for _, t in rows for w in split(t)}
    whole = {w: math.log10(max(0, counts[w] - d) / n + d * types / n * math.exp(x)) for w, x in pieces.items()}
    end = math.log10((ends - d) / n)
    texts = {i: t for i, t in rows}
    for r in got:
        assert r.score == pytest.approx(end + sum(whole[w] for w in split(texts[r.doc_id])), rel=1e-9)
        assert r.lattice_score == pytest.approx(end + sum(pieces[w] / math.log(10) for w in split(texts[r.doc_id])), rel=1e-9)


def test_no_training_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm_score.score(docs, crc_fold("doc_id", 7) > 9, piece_vocabulary()).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}
    assert lm_score.score(docs.where("false"), crc_fold("doc_id", 7) != 2, piece_vocabulary()).collect() == []
