"""Registered queries and the pipeline on the smallest tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from differential import check

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def test_all_are_registered():
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()


@needs_data
@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_sql(spark, name):
    check(spark, entry.queries()[name], entry.oracle_sql()[name], DATA)


def test_pipeline(spark, tmp_path):
    words = [f"w{i}" for i in range(300)]
    a, b, passage = " ".join(words[:80]), " ".join(words[100:180]), " ".join(words[200:260])
    alone = " ".join(f"x{i}" for i in range(40))
    rows = [
        (0, a, "en", "s", len(a)),
        (1, a + " extra", "en", "s", 0),
        (2, b + " " + passage, "en", "s", 0),
        (3, alone + " " + passage + " end", "en", "s", 0),
        (4, passage, "en", "s", 0),
        (5, None, None, None, None),
        (6, "123", "en", None, 3),
        (7, "short text", "en", "t", 10),
        (None, "no id", "en", "t", 5),
    ]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r.text for r in docs.collect()})
    assert set(seen[0]) == {0, 1, 2, 3, 4, 7, None}
    assert set(seen[1]) == {0, 2, 3, 4, 7, None}
    assert set(seen[2]) == {0, 2, 3, 7, None} and seen[2][3] == alone + " end" and seen[2][2] == b + " " + passage and seen[2][None] == "no id"
    assert docs.where("doc_id = 3").where(F.length("text") == F.col("n_chars")).count() == 1
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(seen[2])


def test_language_stage_without_labels(spark):
    rows = [(0, "some words", None), (1, "été", None), (2, "12 !", None), (3, "", None), (4, None, None), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for labelled in (docs, docs.withColumn("lang", F.when(F.col("doc_id") == 2, "en")), docs.withColumn("lang", F.lit("en"))):
        assert {r.doc_id for r in corpus_pipeline.language_stage(spark, labelled, "").collect()} == {0, 1, None}


def test_jaccard_stage_repeated_rows(spark):
    a, b = " ".join(f"w{i}" for i in range(30)), " ".join(f"x{i}" for i in range(30))
    rows = [(1, a, "fr", "t"), (1, a, "en", "s"), (1, a, "en", None), (1, b, "en", "s"), (2, a, "de", "s"), (3, "alone", "en", "s"), (3, "alone", "en", "s"), (4, None, "en", "s"), (4, None, "en", "s"), (None, "no id", "en", "s"), (None, "no id", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    got = sorted((tuple(r) for r in corpus_pipeline.jaccard_stage(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, a, "en", None), (1, b, "en", "s"), (3, "alone", "en", "s"), (4, None, "en", "s"), (None, "no id", "en", "s"), (None, "no id", "en", "s")], key=str)


def test_jaccard_stage_texts_under_one_id(spark):
    """A text goes only if it is linked itself; another one under the same id stays."""
    x, alone = [f"x{i}" for i in range(40)], " ".join(f"a{i}" for i in range(40))
    near, other = " ".join([*x, "more"]), " ".join(f"o{i}" for i in range(40))
    docs = spark.createDataFrame([(1, " ".join(x)), (5, near), (5, other), (6, alone), (6, other)], "doc_id bigint, text string").repartition(3)
    got = {(r.doc_id, r.text) for r in corpus_pipeline.jaccard_stage(spark, docs, "").collect()}
    assert got == {(1, " ".join(x)), (5, other), (6, alone)}


def test_stages_keep_columns_of_any_name(spark):
    """Clashing names keep their values and types through every stage."""
    texts = {i: " ".join(f"{c}{i}" for c in "abcdefghijkl") + f" w{i}" * 3 for i in range(6)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    more = {"score": F.lit(5), "lang_pred": F.lit(7.5), "_origin": F.lit("o"), "origin": F.lit(True), "Origin_": F.lit(1), "first": F.lit("f"), "n_words": F.lit(2), "kept": F.array(F.lit(1)), "component_id": F.lit("c"), "dotted.name": F.lit("d"), "r": F.lit(3), "count": F.lit(4)}
    docs = docs.withColumns(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.union(docs)):
            out = stage(spark, rows, "")
            assert out.schema.names == docs.schema.names and [f.dataType.simpleString() for f in out.schema] == [f.dataType.simpleString() for f in docs.schema], name
            assert {tuple(map(str, r)) for r in out.collect()} == {tuple(map(str, r)) for r in docs.collect()}, name
    assert {r.doc_id for r in corpus_pipeline.packing_stage(spark, docs, "").collect()} == set(texts)


def test_substring_stage_repeated_rows(spark):
    """Rows that share an id keep their own columns; also those that share the text as well, long texts and null ones."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    long = " ".join(f"l{i}" for i in range(20_000))
    rows = [(1, a, "en", "s1"), (1, c, "fr", "s2"), (2, b, "en", "s1"), (2, b, "de", "s2"), (2, a + " more", "es", "s3"), (3, None, "en", "s"), (4, long, "en", "s"), (5, "x " + long, "en", "s"), (6, a, "en", "s"), (None, a, "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("_extra", F.col("source")).repartition(3)
    out = corpus_pipeline.substring_stage(spark, docs, "")
    assert out.columns == docs.columns
    want = [(1, a, "en", "s1"), (1, c, "fr", "s2"), (2, b, "en", "s1"), (2, b, "de", "s2"), (2, "more", "es", "s3"), (3, None, "en", "s"), (4, long, "en", "s"), (5, "x", "en", "s"), (None, a, "en", "s")]
    assert sorted((tuple(r)[:4] for r in out.collect()), key=str) == sorted(want, key=str)
    assert out.where("text is not null and n_chars <> length(text) or _extra <> source").count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
