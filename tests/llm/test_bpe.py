import hashlib
import random

import pytest
from tokenizers import Tokenizer

from pagemill.llm import bpe
from pagemill.llm.queries import word_vocabulary

POOL = "abcDEfg'sxyz<|endoftext|> \t\n  日本語üéİßΣς1234½!?#$%́\x1c\x85👍🏽ﬁ한글²¼İǅñÿß­¡"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    made = ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    return [*made, "", None, " \n", "<|endoftext|>a<|startoftext|>", "x" * 5000, "ab" * 900 + "日" * 300, "It's The Théâtre's end, 12 34", *made[:3]]


def test_equals_library(spark, texts):
    library = Tokenizer.from_file(word_vocabulary())
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.digests(docs, word_vocabulary()).collect()}
    encoded = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, word_vocabulary()), word_vocabulary()).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (encoded[i].token_ids, encoded[i].decoded, encoded[i].n_tokens) == (ids, text, "x")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, repr(t)


def test_forced_boundaries_cut():
    one = bpe.ForcedBoundaryBPE(bpe.read_spec(word_vocabulary()))
    assert len(one.cuts("xqzzvkjq")) > 1
    assert "".join(one.cuts("thequickbrownxqzz")) == "thequickbrownxqzz"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(docs, word_vocabulary()).collect() == []
