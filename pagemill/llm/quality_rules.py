"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text goes with them.

Lines. A line with words fails for its punctuation (signs in place of it; or 8 to 40 words that end in no mark), for
shouting, as navigation (separators), or as boilerplate. Boilerplate is not a list of phrases: it is learned from the corpus,
in whatever language, as the lines that recur in changing company. A line of at most SHORT words is boilerplate if it was
found after NEIGHBOURS different lines and before as many, and if each comes to CHANGING of its occurrences; the first and
last line of a document have one neighbour, which counts on both sides. So a line of a document that was copied a thousand
times, which always stands between the same two, isn't.

All of it is column expressions: no Python. Company is counted over all documents, pre-aggregated by line and neighbour, so
that a frequent line is dealt over its neighbours; at most one row a line and side goes on. The lines found are few, as each
needs 2 * NEIGHBOURS neighbours of its own; up to `most` of them are held as a set of 64-bit hashes in the plan, more are
joined by text. The rest is one row at a time. Windows of five words that occur twice are found by sorting a document's
window hashes (64 bits of xxhash64), which costs n log n in its length.

Defined results: a null text has no words and no lines, so it fails the base rule; a blank line is neither judged nor
removed; repeated rows are judged alike, and each counts for the company of its lines; a very long text is judged whole; an
empty table gives an empty result. Columns of any name are carried; one that bears a result's name gives way in assess(), and
stays in clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import BROADCAST_ROWS, WORD, Renamed, cut, joined

SYMBOLS = "#*$%&|<>"
#: Bounds of a boilerplate line: its words, different lines on each side, and their share of its occurrences.
SHORT, NEIGHBOURS, CHANGING = 25, 20, 0.2
#: Lines of so many words end in a mark: what it may be, and what may follow it in the last LAST characters.
ENDING, MARKS, LAST = (8, 40), r"""[.!?:;…。！？।؟]['"”»’)\]]*\s*$""", 8
#: Characters of which a line must have one for a rule of counts to be looked at.
SIGNS = "[#*$%&|<>!?»›·•]"
#: A document goes if it keeps less than this share of its words.
LEAST_KEPT = 0.3


def line_fails(line: Column, words: Column) -> Column:
    """Whether a line of so many words, one at least, fails a rule that needs no other line."""
    count = lambda signs: F.regexp_count(line, F.lit(f"[{signs}]"))
    bars = count("|»›·•")
    punctuation = (count(SYMBOLS) * 2 > words) | (count("!?") * 2 > words) & (words >= 3)
    navigation = (bars >= 2) & (bars * 4 >= words)
    endless = words.between(*ENDING) & ~F.right(F.rtrim(line), F.lit(LAST)).rlike(MARKS)
    shouting = (words >= 3) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}{2}")
    return endless | shouting | line.rlike(SIGNS) & (punctuation | navigation)


def line_key(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(line)))


def _worded(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))


def recurring(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key) of the boilerplate lines of docs."""
    # The keys are named by a select of their own: they are shifted and zipped there, not hashed anew for each use.
    keyed = docs.select(_worded(F.col(text_col)).alias("lines"))
    short = lambda x: (F.length(x) < 40 * SHORT) & (F.regexp_count(x, F.lit(WORD)) <= SHORT)
    keyed = keyed.select(F.transform("lines", lambda x: F.struct(line_key(x).alias("k"), short(x).alias("short"))).alias("all"))
    keyed = keyed.where(F.size("all") > 0).select("all", F.transform("all", lambda x: x["k"]).alias("keys"))
    # At a document's edge the neighbour of the other side stands for the one that is missing: a footer has changing company.
    many, none = F.size("keys"), F.lit(0).cast("long")
    first, last = F.array(F.coalesce(F.get("keys", F.lit(1)), none)), F.array(F.coalesce(F.get("keys", many - 2), none))
    before, after = F.concat(first, F.slice("keys", F.lit(1), many - 1)), F.concat(F.slice("keys", F.lit(2), many - 1), last)
    company = F.zip_with("all", F.arrays_zip(before.alias("b"), after.alias("a")), lambda x, n: F.struct(x["k"].alias("key"), x["short"].alias("short"), n["b"].alias("b"), n["a"].alias("a")))
    lines = keyed.select(F.inline(company)).where("short")
    sides = lines.select("key", F.posexplode(F.array("b", "a")).alias("side", "other"))
    pairs = sides.groupBy("key", "side", "other").agg(F.count("*").alias("n"))
    each = pairs.groupBy("key", "side").agg(F.count("*").alias("others"), F.sum("n").alias("n")).where(f"others >= {NEIGHBOURS} and others >= {CHANGING} * n")
    return each.groupBy("key").agg(F.count("*").alias("n_sides")).where("n_sides = 2").select("key")


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_words", "clean")


def _assessed(docs: DataFrame, text_col: str, carry: list[str] | None, most: int) -> tuple[Renamed, DataFrame]:
    own = Renamed(docs, carry, body=F.coalesce(F.col(text_col), F.lit("")))
    known = cut(recurring(docs, text_col))
    found = [r.key for r in known.limit(most + 1).collect()]
    rows = own.rows
    if len(found) <= most:
        boilerplate = lambda x: line_key(x).isin(found) if found else F.lit(False)
        rows = rows.withColumn("hits", F.lit(None).cast("array<bigint>"))
    else:
        # More than the plan should hold: the lines of each distinct text that are among them, joined to the rows by text.
        rows = rows.withColumn("mark", F.xxhash64("body"))
        held = rows.select("mark", F.explode(F.array_distinct(F.transform(_worded(F.col("body")), line_key))).alias("key")).distinct()
        hits = cut(held.join(known, "key").groupBy("mark").agg(F.collect_set("key").alias("hits")))
        rows = joined(rows, hits, ["mark"], F.xxhash64(*own.own[:1], "mark"), "left", most=0)
        boilerplate = lambda x: F.coalesce(F.array_contains("hits", line_key(x)), F.lit(False))
    text = F.col("body")
    kept = [F.col(c) for c in own.own]
    fails = lambda x: line_fails(x["line"], x["w"]) | (x["w"] <= SHORT) & boilerplate(x["line"])
    # What is used twice or more is named by a select of its own, and so computed once a row, not once a use or an element.
    base = rows.select(
        *kept, "hits", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"), F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("w"))).alias("lines"),
    )
    base = base.select(
        *kept, "n_symbols", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.transform(F.filter("lines", lambda x: x["w"] > 0), lambda x: x["line"]).alias("worded"), F.filter("lines", lambda x: (x["w"] == 0) | ~fails(x)).alias("passed"),
    )
    n, h = F.size("hashes"), F.col("hashes")
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4]))).otherwise(
        F.array().cast("array<bigint>")
    )
    plain = [*kept, F.col("word_chars"), F.col("n_symbols")]
    step = base.select(
        *plain,
        n.cast("long").alias("n_words"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.array_join(F.transform("passed", lambda x: x["line"]), "\n").alias("clean"),
        F.aggregate("passed", F.lit(0), lambda a, x: a + x["w"]).cast("long").alias("clean_words"),
        windows.alias("windows"),
    )
    has_twice = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(has_twice, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    plain = [*plain, F.col("n_words"), F.col("n_dup_lines"), F.col("clean"), F.col("clean_words")]
    step = step.select(*plain, ordered.alias("ordered"))
    z = F.col("ordered")
    last = F.size(z) - 1
    twice = F.filter(z, lambda x, i: (i > 0) & (z[F.greatest(i - 1, F.lit(0))]["h"] == x["h"]) | (i < last) & (z[F.least(i + 1, last)]["h"] == x["h"]))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-5).alias("p"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(5), p - a["p"])).alias("n")),
        lambda a: a["n"],
    )
    step = step.select(*plain, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    step = step.select("*", failed.alias("base_failed"))
    return own, step.select("*", (~F.col("base_failed") & (F.col("clean_words") >= F.col("n_words") * LEAST_KEPT)).alias("kept"))


def assess(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, prefix: str = "", most: int = BROADCAST_ROWS) -> DataFrame:
    """The columns `carry` of docs (all, if None) with RESULTS, named with the prefix; `clean` is the text of the lines that
    pass, `kept` the verdict."""
    own, judged = _assessed(docs, text_col, carry, most)
    return own.back(judged, **{prefix + c: F.col(c) for c in RESULTS})


def clean(docs: DataFrame, text_col: str = "text", most: int = BROADCAST_ROWS) -> DataFrame:
    """docs that pass, with the text of their passing lines; all columns stay.

    What was judged and kept is observed under the name quality_rules. Filters don't pass an observation, so the verdict is
    worked out once a row.
    """
    own, judged = _assessed(docs, text_col, None, most)
    counts = [F.count("*").alias("documents"), F.count_if("kept").alias("kept"), F.sum("n_words").alias("words"), F.sum("clean_words").alias("clean_words")]
    judged = judged.observe("quality_rules", *counts).where("kept")
    return own.back(judged, {text_col: F.col("clean")})
