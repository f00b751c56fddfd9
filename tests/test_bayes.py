"""Naive Bayes tables against plain sums, and confusion counts by test set and model."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.operators import bayes, metrics

CLASSES = ["a", "b"]


@pytest.mark.parametrize("frequent", [0, 3, 20_000])
def test_scores_are_the_plain_ones(spark, monkeypatch, frequent):
    monkeypatch.setattr(bayes, "FREQUENT", frequent)
    rng = random.Random(2)
    train = [(i, rng.choice(["a", "b", "b", "zz", None]), " ".join(rng.choice("ab cd EF gh ij kl mn".split()) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    asked = [(100, "ab cd AB new"), (101, ""), (102, None), (103, "ab " * 2000), (104, "only unseen words"), (105, "ab cd")]
    frame = spark.createDataFrame(train, "id int, label string, text string")
    model = bayes.fit(bayes.word_features(frame, "id", "text", "label"), "label", frame, CLASSES)
    words = {c: Counter(w for _, y, t in train if y == c for w in t.lower().split()) for c in CLASSES}
    vocabulary = len(set(words["a"]) | set(words["b"]))
    n = Counter(y for _, y, _ in train)
    want = {k: [math.log((n[c] + 1) / (n["a"] + n["b"] + 2)) + sum(math.log((words[c][w] + 1) / (sum(words[c].values()) + vocabulary)) for w in (t or "").lower().split()) for c in CLASSES] for k, t in asked}
    got = {r.id: r.scores for r in bayes.scores(bayes.word_features(spark.createDataFrame(asked, "id int, text string"), "id", "text"), "id", model).collect()}
    assert set(got) == set(want) and all(abs(x - y) < 1e-6 for k in want for x, y in zip(got[k], want[k], strict=True))


@pytest.mark.parametrize("frequent", [0, 3, 20_000])
def test_lists_score_as_rows_do(spark, monkeypatch, frequent):
    """Lists of features, counted and summed in Arrow batches, against rows of one feature."""
    monkeypatch.setattr(bayes, "FREQUENT", frequent)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab cd EF gh ij kl mn \u00e9t\u00e9".split()) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    frame = spark.createDataFrame([(i, rng.choice(["a", "b", "zz", None]), t or None) for i, t in enumerate(texts)], "id int, label string, text string").repartition(3)
    found = []
    for cut in (bayes.word_features, bayes.word_lists):
        model = bayes.fit(cut(frame, "id", "text", "label"), "label", frame, CLASSES)
        assert model.table.groupBy("feature").count().where("count > 1").count() == 0
        found.append({r.id: r.scores for r in bayes.scores(cut(frame, "id", "text"), "id", model).collect()})
    assert len(found[1]) == 60 and all(abs(x - y) < 1e-9 for k in found[0] for x, y in zip(found[0][k], found[1][k], strict=True))


def test_a_row_goes_to_a_shuffle_for_each_seldom_word_alone(spark):
    """What scoring sends on: one row for each document and one for each of its words beyond the frequent ones; before, one for each word."""
    frame = spark.createDataFrame([(i, "ab"[i % 2], "common words " * 200) for i in range(50)], "id int, label string, text string")
    model = bayes.fit(bayes.word_lists(frame, "id", "text", "label"), "label", frame, CLASSES)
    out = bayes.scores(bayes.word_lists(frame, "id", "text"), "id", model)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and out.count() == 50


def test_grid_lists_are_the_grid_features(spark):
    from foliant.functions import nested
    from foliant.plans import catalogue

    df = spark.createDataFrame([(1, "en", "The CAT sat. a \u00c9T\u00c9 \u65e5\u672c \u0391\u03a3 x" * 90), (2, "fr", None), (3, None, "Z " + "y" * 300)], "doc_id int, lang string, text string")
    words = df.select("doc_id", F.posexplode(nested.tokens(F.col("text"), None)).alias("position", "word"))
    cell = bayes.grid_feature(F.col("word"), *catalogue.word_box(F.col("position"), F.col("word")))
    want = {}
    for r in words.select("doc_id", "position", cell.alias("f")).orderBy("doc_id", "position").collect():
        want.setdefault(r.doc_id, []).append(r.f)
    got = {r.doc_id: (r.lang, r.feature) for r in catalogue.grid_lists(df).collect()}
    assert got == {1: ("en", want[1]), 2: ("fr", []), 3: (None, want[3])}


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "id int, label string, text string")
    model = bayes.fit(bayes.word_features(none, "id", "text", "label"), "label", none, CLASSES)
    assert model.start == [math.log(0.5)] * 2
    assert bayes.scores(bayes.word_features(none, "id", "text"), "id", model).count() == 0
    one = spark.createDataFrame([(1, "x")], "id int, text string")
    assert bayes.scores(bayes.word_features(one, "id", "text"), "id", model).first().scores == [math.log(0.5)] * 2


def test_moving_boxes_alone_moves_the_prediction(spark):
    """The same words at the top in one class and at the bottom in the other."""
    cell = bayes.grid_feature(F.col("w"), F.col("x"), F.col("y"), F.col("x") + 50, F.col("y") + 20)
    rows = [(i, "ab"[i % 2], w, 100 * j, 60 if i % 2 else 900) for i in range(20) for j, w in enumerate("total sum page date".split())]
    df = spark.createDataFrame(rows, "id int, label string, w string, x int, y int")
    model = bayes.fit(df.select("label", cell.alias("feature")), "label", df.select("id", "label").distinct(), CLASSES)
    asked = spark.createDataFrame([(k, w, 100 * j, y) for k, y in ((1, 60), (2, 900), (3, 940)) for j, w in enumerate("total sum page date".split())], "id int, w string, x int, y int")
    got = {r.id: r.scores for r in bayes.scores(asked.select("id", cell.alias("feature")), "id", model).collect()}
    assert got[1][1] > got[1][0] and got[2][0] > got[2][1] and got[2] == got[3]


def test_confusion_by_set_and_model(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["internal", "external"]), rng.choice(["m", "n"]), rng.choice(["a", "b", "odd"]), rng.choice(["a", "b", None]), rng.choice(["success", "success", "failed"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "test_set string, model string, true_label string, predicted_label string, status string")
    out = metrics.confusion_by_set(df, CLASSES)
    got = {(r.test_set, r.model, r.true_label): (r.a, r.b) for r in out.collect()}
    for s in ("internal", "external", None):
        for m in ("m", "n", None):
            for t in CLASSES:
                own = [p for a, b, y, p, ok in rows if ok == "success" and y == t and s in (None, a) and m in (None, b)]
                assert got[s, m, t] == (own.count("a"), own.count("b"))
    assert len(got) == 18
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Scan ExistingRDD") == 1 and metrics.confusion_by_set(df.where("false"), CLASSES).count() == 0
