import random
import re

from pyspark.sql import functions as F

from pagemill.llm import quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeat = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            repeat |= {p + k for p in places for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeat) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat), failed


def test_measures(spark):
    rnd = random.Random(3)
    texts = [rnd.choice(["", " ", "\n"]).join(rnd.choice(["a", "b", "cé", "d|", "\n", " e\x0b", "f#", "\xa0"]) for _ in range(rnd.randint(0, 90))) for _ in range(200)]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    texts += [None, "", " ", "\n\n", "one", "x " * 50, "a b c d e f g h i j\n" * 2, "w%d " * 3000 % tuple(range(3000))]
    clashing = ["kept", "_kept", "_windows", "_lines", "windows", "hits", "hashes", "body", "clean", "mark", "c0"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").select("*", *[F.lit(7).alias(c) for c in clashing])
    for r in quality_rules.assess(docs).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(texts[r.doc_id]), repr(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    assert quality_rules.clean(docs).columns == docs.columns
    assert all(r.kept == r._windows == r.clean == 7 for r in quality_rules.clean(docs).collect())


def page(rnd, k):
    return [f"Here word{k}x{i} says {rnd.randint(0, 10**9)} and more{i} about thing{i}, then yet{i} ends." for i in range(6)]


def test_lines(spark):
    rnd = random.Random(4)
    body = page(rnd, 0)
    rows = [
        (1, "\n".join([*body, "Home | News | Contact | About"]), "keep"),
        (2, "\n".join(f"BUY!! NOW{i}!! CHEAP{i}!! GREAT!! OFFER{i}!! TODAY!!" for i in range(9)), "x"),
        (3, "\n".join([*body, "a list of eight words with no end"]), "keep"),
        (4, None, None),
        (5, "\n".join([*body, "WE SHOUT AT YOU"]), "keep"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in quality_rules.clean(docs).collect()}
    assert set(got) == {1, 3, 5}
    assert all(r.text == "\n".join(body) and r.n_words == "keep" for r in got.values())
    assert quality_rules.clean(docs.where("false")).collect() == []


def corpus(rnd):
    """Pages of which many bear one of three lines of furniture, among other lines; and one page copied 300 times."""
    furniture = ["All of this is free to copy.", "Alle Rechte bleiben bei uns.", "Hier geht es weiter."]
    rows = []
    for k in range(400):
        lines = page(rnd, k)
        if k % 2:
            lines.insert(rnd.randint(1, 5), rnd.choice(furniture))
        rows.append("\n".join(lines))
    copied = ["Gern gesehen wird dieser Satz.", *page(rnd, 1000)]
    return furniture, rows + ["\n".join(copied)] * 300, copied


def test_boilerplate_is_what_recurs_in_changing_company(spark):
    furniture, texts, copied = corpus(random.Random(9))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = {r[0] for r in spark.createDataFrame([(x,) for x in furniture], "x string").select(quality_rules.line_key(F.col("x"))).collect()}
    assert {r.key for r in quality_rules.recurring(docs).collect()} == wanted
    want = {i: "\n".join(x for x in t.split("\n") if x not in furniture) for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in quality_rules.clean(docs).collect()} == want
    # Beyond the bound of the set in the plan, lines are joined by text, with equal results.
    assert {r.doc_id: r.text for r in quality_rules.clean(docs, most=1).collect()} == want


def test_boilerplate_of_the_tables(spark):
    """Precision and recall on the license lines of the tables, which are known by their words."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = [r.key for r in quality_rules.recurring(docs).collect()]
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("length(trim(line)) > 0").withColumn("hit", quality_rules.line_key(F.col("line")).isin(found))
    license = lines.where(F.col("line").rlike("(?i)^(licensed under|released under|this work is licensed|all rights reserved)"))
    total, hit = license.count(), license.where("hit").count()
    longest = lines.where("hit").agg(F.max(F.size(F.split("line", " ")))).first()[0]
    print(f"{len(found)} boilerplate lines; license lines {hit} of {total}; longest {longest} words")
    assert hit >= 0.95 * total and longest <= quality_rules.SHORT
