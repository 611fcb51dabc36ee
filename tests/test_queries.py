import re

import duckdb
import pytest

import __spark_entry__ as entry
from compare import compare, connect
from pagemill.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    if name in catalogue.ORACLES:
        assert compare(spark, db, name, catalogue.QUERIES[name], catalogue.ORACLES[name], SF) is None
    else:
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_response_clean_keeps_blank_lines_and_nulls(spark, tmp_path):
    rows = [(1, 0, "user", "one\n \n\ntwo"), (1, 1, "assistant", None), (2, 0, "user", " three\nfour "), (2, 6, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {tuple(r) for r in catalogue.QUERIES["response_clean"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0, "one\n\ntwo\n\nend"), (1, 1, None), (2, 0, "three\nfour \n\nend"), (2, 6, "<analysis>a\nb</analysis>x\n\nend")}


def test_prompts_rank_by_distance(spark, tmp_path):
    """rows whose relevance is equal once it is rounded stand in the order of their distances, not of their ids."""
    near = [(3, [1.0, 0.0]), (1, [1.0, 0.0102]), (2, [1.0, 0.0101]), (4, [1.0, 0.0100]), (5, [0.0, 1.0]), (6, [0.0, 1.1])]
    near = [(13 if i == 3 else i, v) for i, v in near]
    spark.createDataFrame([(i, 1, v) for i, v in near], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(13, 1, "user", "hi")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalogue.QUERIES["answer_prompts"](spark, str(tmp_path)).collect()
    assert [r.query_id for r in got] == [13]
    assert re.findall(r"passage (\d+)", got[0].context) == ["13", "4", "2", "1"]
    db = duckdb.connect()
    for t in ("embeddings", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert compare(spark, db, "answer_prompts", catalogue.QUERIES["answer_prompts"], catalogue.ORACLES["answer_prompts"], str(tmp_path)) is None
