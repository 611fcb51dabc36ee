import gzip

from pyspark.sql import functions as F

from pagemill.llm import warc


def indexed(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, file string, offset string")
    records = df.select("page_id", "file", warc.record(F.col("url"), F.col("html"), F.col("page_id")).alias("record"))
    return records, warc.index(records, "file", "page_id", "record")


def rows(n=300):
    return [(i, f"http://h/{i}", f"<p>é{i}</p>" * (i % 90), ["a", "b", None][i % 3] if i > 20 else "a", "x") for i in range(n)] + [(900, None, None, "b", "x")]


def test_audit_finds_what_differs(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 1024)
    monkeypatch.setattr(warc, "FANOUT", 4)
    records, primary = indexed(spark, rows())
    primary = primary.cache()
    assert len(warc.tree(primary)) >= 3
    assert warc.audit(primary, primary).collect() == []
    bad = F.when(F.col("key").isin(7, 130), F.lit("0" * 64)).otherwise(F.col("digest"))
    extra = primary.limit(1).selectExpr("file", "9999L key", "10000000L offset", "5L length", "'f' digest")
    replica = primary.where("key <> 200").withColumn("digest", bad).unionByName(extra.select(primary.columns))
    got = {(r.key, r.status) for r in warc.audit(primary, replica).collect()}
    assert got == {(7, "corrupt"), (130, "corrupt"), (200, "missing"), (9999, "extra")}
    assert warc.audit(primary.where("false"), primary).groupBy("status").count().collect()[0][1] == primary.count()
    assert warc.audit(primary.where("false"), primary.where("false")).collect() == []


def test_only_mismatching_branches_are_read(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 1024)
    monkeypatch.setattr(warc, "FANOUT", 4)
    _, primary = indexed(spark, rows())
    primary = primary.cache()
    replica = primary.withColumn("digest", F.when(F.col("key") == 100, "z").otherwise(F.col("digest")))
    one, two = warc.tree(primary), warc.tree(replica)
    within = None
    for a, b in zip(reversed(one), reversed(two), strict=True):
        within = warc._differing(a, b, within)
        assert within.count() == 1


def test_read_back(spark, tmp_path):
    records, primary = indexed(spark, rows(60))
    want = {}
    for file in ("a", "b"):
        data = b"".join(bytes(r.record) for r in records.where(F.col("file") == file).orderBy("page_id").collect())
        (tmp_path / f"{file}.warc.gz").write_bytes(gzip.compress(data))
        want[file] = sorted((r.offset, r.length) for r in primary.where(F.col("file") == file).collect())
    (tmp_path / "cut.warc").write_bytes(data[:-3])
    got = warc.read_records(spark, str(tmp_path)).collect()
    for file, places in want.items():
        assert sorted((r.offset, r.length) for r in got if f"/{file}.warc" in r.file) == places
    assert [r.complete for r in got if "cut" in r.file].count(False) == 1
    by_url = {r.url: bytes(r.body).decode() for r in got}
    assert by_url["http://h/9"] == "<p>é9</p>" * 9


def test_query_on_null_and_repeated_ids(spark, tmp_path):
    """Equal to the SQL form with null ids, repeated ids (equal and different records), nulls in all columns and a clashing column."""
    from compare import compare, connect
    from pagemill.llm import queries

    made = [(i, f"http://h/{i}", "<p>x</p>" * (i % 50), "c") for i in range(400)]
    made += [(5, "http://h/5", "<p>x</p>" * 5, "c"), (5, "http://other", "y", "c"), (9, None, None, None), (9, None, None, None), (218, "http://h/218", "z", None)]
    made += [(None, "http://n", "n", None), (None, None, None, None), (None, None, None, None), (7, "http://h/7", "long " * 300_000, "c")]
    spark.createDataFrame(made, "page_id long, url string, html string, digest string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    for t in ("region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations").split():
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    db = connect(str(tmp_path))
    assert compare(spark, db, "op2", queries.op2_warc_audit, queries.ORACLES["op2_warc_audit"], str(tmp_path)) is None
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert queries.op2_warc_audit(spark, str(tmp_path / "none")).collect() == []


def test_index_in_ranges(spark):
    """Offsets of one file whose records are dealt over several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, found = indexed(spark, [(i, "u", "b" * (i % 13), "a", "x") for i in range(500)])
        at = 0
        for r in found.orderBy("key").collect():
            assert r.offset == at
            at += r.length
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
