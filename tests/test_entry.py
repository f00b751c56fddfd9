from hashlib import sha256
from pathlib import Path

import pytest

import __spark_entry__ as entry
from differential import check

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n.startswith("q_")]
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    assert [r.model for r in entry.entry(spark).orderBy("model_idx").collect()] == ["lexicon", "charset"]


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert entry.queries()[name](spark, DATA).count() > 0
    else:
        check(spark, entry.queries()[name], sql, DATA)


def test_retry_takes_short_texts_whole(spark, tmp_path):
    texts = {1: "short", 2: None, 10: "x" * 60 + " end", 13: " \n ", 20: "y" * 60}
    spark.createDataFrame([(i, "en", t) for i, t in texts.items()], "doc_id bigint, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.text_sha, r.text_length) for r in entry.queries()["q_retry_upsert"](spark, str(tmp_path)).collect()}
    want = texts | {1: "retried short", 2: "retried ", 13: "retried  \n "}
    assert got == {i: (sha256(t.encode()).hexdigest(), len(t)) for i, t in want.items()}
