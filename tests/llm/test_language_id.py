import random
import zlib

from pyspark.sql import functions as F

from pagemill.llm import language_id
from pagemill.llm.common import crc_fold

SYLLABLES = {"aa": "the ing and ous er tion".split(), "bb": "der sch ung ein keit über".split(), "cc": "que ción los mente ar ñas".split()}


def sentence(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy(spark):
    rnd = random.Random(3)
    rows = [(i, sentence(rnd, lang := rnd.choice("aa aa aa bb cc".split()), rnd.randint(4, 900)), lang, 1) for i in range(400)]
    odd = [(1000, None, "aa", 1), (1001, "", "bb", 1), (1002, "12 !!", "aa", 1), (1003, sentence(rnd, "bb", 30), None, 1), (None, sentence(rnd, "cc", 30), "cc", 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int")
    held = crc_fold("doc_id", 4) == 2
    learned = language_id.learn(docs, ~held, slots=32, excerpt=256)
    assert list(learned)[0] == "aa" and set(learned) == {"aa", "bb", "cc"}
    again = language_id.learn(docs.repartition(9), ~held, slots=32, excerpt=256)
    assert learned == again
    got = {r.doc_id: r for r in language_id.classify(docs, learned, reject=False).collect()}
    tested = [(i, lang) for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(tested) > 60
    assert sum(got[i].lang_pred == lang for i, lang in tested) >= 0.98 * len(tested)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "bb" and got[None].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_learned_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert language_id.classify(docs, {}).first().lang_pred == "und"
    none = docs.where("false").withColumn("lang", F.lit(None).cast("string"))
    assert language_id.learn(none, F.lit(True)) == {}
    assert language_id.classify(none, {"aa": b"x"}).collect() == []


def test_every_language_is_learned(spark):
    rnd = random.Random(5)
    names = [f"l{i:02}" for i in range(70)]
    words = {x: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for x in names}
    rows = [(i, " ".join(rnd.choice(words[x]) for _ in range(60)), x) for i, x in enumerate(names * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.learn(docs, F.col("doc_id") < 140)
    assert set(learned) == set(names)
    got = language_id.classify(docs.where("doc_id >= 140"), learned, reject=False).collect()
    assert len(got) == 70 and all(r.lang_pred == r.lang for r in got)


def test_whole_texts_are_compressed(spark):
    """Sizes, worked out text by text: blocks of 2048 bytes that end at a blank of their second half, level 6."""
    import zstandard as z

    rnd = random.Random(8)
    rows = [(i, " ".join(sentence(rnd, rnd.choice("aa bb cc".split()), n) for _ in range(3)), rnd.choice("aa bb cc".split())) for i, n in enumerate([1, 5, 60, 400, 3000] * 4)]
    rows += [(90, "ä" * 9000, "aa"), (91, "Über " * 4000, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.learn(docs, F.lit(True), slots=8, excerpt=200)

    def sizes(text):
        data, out = text.lower().encode(), []
        blocks = []
        while data:
            end = 2048 if len(data) <= 2048 or (k := data.rfind(b" ", 1024, 2048)) <= 0 else k
            blocks.append(data[:end])
            data = data[end:]
        for content in learned.values():
            pack = z.ZstdCompressor(level=6, dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            out.append(sum(len(pack.compress(b)) for b in blocks))
        return out, sum(map(len, blocks))

    for r in language_id.classify(docs.select("doc_id", "text"), learned).collect():
        found, n = sizes(r.text)
        least = min(found)
        second = sorted(found)[1]
        close = (second - least) / n < language_id.NARROW
        assert r.rejected == close
        assert r.lang_pred == ("und" if close else list(learned)[found.index(least)])
