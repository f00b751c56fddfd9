import pytest
from pyspark.sql import functions as F

from foliant.operators import dedup, metrics, quality, scoring, split, training
from foliant.operators.tables import HISTORY, dimension, literal_table, require_columns
from foliant.plans import dashboard

CLASSES = ["invoice", "cv", "contract", "email", "scientific"]
#: Confusion matrices with their accuracy and macro precision, recall and F1.
GOLDEN = {
    "image": ([[3, 1, 0, 1, 0], [0, 4, 0, 0, 1], [1, 3, 0, 0, 1], [2, 2, 1, 0, 0], [0, 4, 1, 0, 0]], 0.28, 0.15714285714285714, 0.27999999999999997, 0.19330143540669856),
    "text": ([[4, 0, 1, 0, 0], [0, 5, 0, 0, 0], [0, 0, 5, 0, 0], [0, 0, 0, 5, 0], [0, 5, 0, 0, 0]], 0.76, 0.6666666666666667, 0.76, 0.692929292929293),
    "layout": ([[4, 0, 1, 0, 0], [0, 5, 0, 0, 0], [0, 0, 5, 0, 0], [0, 1, 4, 0, 0], [0, 5, 0, 0, 0]], 0.56, 0.39090909090909093, 0.5599999999999999, 0.43611111111111106),
    "inner": ([[30, 0, 0, 0, 0], [1, 26, 0, 1, 2], [0, 2, 25, 3, 0], [0, 0, 3, 27, 0], [0, 0, 4, 0, 26]], 0.8933333333333333, 0.8954205069124426, 0.8933333333333333, 0.8936815040390963),
}


def records(spark, cells, failed=0):
    rows, n = [], 0
    for model, (matrix, *_) in cells.items():
        for i, line in enumerate(matrix):
            for j, c in enumerate(line):
                for _ in range(c):
                    rows.append((model, n, CLASSES[i], CLASSES[j], 0.5, "success"))
                    n += 1
        rows += [(model, n + k, CLASSES[0], None, None, "failed") for k in range(failed)]
    return spark.createDataFrame(rows, "model string, document int, true_label string, predicted_label string, prediction_time_seconds double, status string")


def test_golden_metrics(spark):
    r = records(spark, GOLDEN, failed=2)
    got = {x.model: x for x in metrics.macro_metrics(r, CLASSES, list(GOLDEN)).collect()}
    for model, (matrix, accuracy, p, rec, f1) in GOLDEN.items():
        x = got[model]
        assert (x.accuracy, x.macro_precision, x.macro_recall, x.macro_f1) == (accuracy, p, rec, f1)
        n = sum(map(sum, matrix))
        assert (x.documents_processed, x.documents_failed, x.documents_total) == (n, 2, n + 2) and x.seconds_per_document == 0.5
    cm = metrics.confusion_matrix(metrics.pair_counts(r), CLASSES, list(GOLDEN)).orderBy("model", "class_idx").collect()
    for model, (matrix, *_) in GOLDEN.items():
        assert [[x[c] for c in CLASSES] for x in cm if x.model == model] == matrix
    cells = metrics.heatmap_cells(metrics.confusion_matrix(metrics.pair_counts(r), CLASSES, ["text"]), CLASSES).where("model = 'text'").collect()
    assert {(x.red, x.green, x.blue, x.text_colour) for x in cells if x.value == 5} == {(85, 85, 255, "white")}


def test_metrics_of_nothing(spark):
    empty = records(spark, {"m": ([[0] * 5] * 5,)}, failed=3)
    x = metrics.macro_metrics(empty, CLASSES, ["m"]).first()
    assert (x.accuracy, x.macro_f1, x.documents_failed, x.seconds_per_document) == (0.0, 0.0, 3, 0.0)
    none = metrics.macro_metrics(empty.where("false"), CLASSES, ["m"]).first()
    assert (none.accuracy, none.documents_total) == (0.0, 0)


def test_unknown_labels_count_nowhere(spark):
    r = spark.createDataFrame([("m", "cv", "cv", "success"), ("m", "other", "cv", "success"), ("m", "cv", "other", "success")], "model string, true_label string, predicted_label string, status string")
    cm = metrics.confusion_matrix(metrics.pair_counts(r), CLASSES, ["m"]).collect()
    assert sum(x[c] for x in cm for c in CLASSES) == 1


def test_split_sizes(spark):
    for n, sizes in {3: (1, 1, 1), 4: (2, 1, 1), 90: (62, 13, 15), 200: (140, 30, 30)}.items():
        df = spark.range(n).select("id", F.lit("a").alias("label"))
        out = split.stratified_split(df, "label", "id")
        got = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
        assert (got["train"], got["validation"], got["test"]) == sizes and out.select("id").distinct().count() == n
    with pytest.raises(ValueError):
        split.stratified_split(spark.range(2).select("id", F.lit("a").alias("label")), "label", "id")


def test_limits(spark):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("label"))
    assert split.limit_per_class(df, None, "label", [F.col("id")]).count() == 10
    assert sorted(r.id for r in split.limit_per_class(df, 2, "label", [F.col("id")]).collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        split.limit_per_class(df, 0, "label", [F.col("id")])
    assert split.sample_per_class(df, 3, "label", "id").collect() == split.sample_per_class(df, 3, "label", "id").collect()


def test_dedup(spark):
    e = dedup.with_hash(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id int, t string"), "t")
    i = dedup.with_hash(spark.createDataFrame([(10, "b"), (9, "b"), (8, "z")], "id int, t string"), "t")
    assert sorted(r.id for r in dedup.exclude(e, i).collect()) == [1, 4]
    out = dedup.excluded(e, i, "id").collect()
    assert {(r.id, r.matching_raw_paths) for r in out} == {(2, "9 | 10"), (3, "9 | 10")}


def test_quality(spark):
    df = spark.createDataFrame([("a", "x" * 19), ("a", "x" * 20), ("b", None), ("c", " \t")], "label string, text string")
    got = {(r.label, r.text_length): r.issue for r in quality.with_quality(df).collect()}
    assert got == {("a", 19): "short", ("a", 20): None, ("b", 0): "empty", ("c", 0): "empty"}
    s = {r.label: (r.documents, r.short_texts, r.mean_length) for r in quality.summary_by_label(df, ["a", "z"]).collect()}
    assert s == {"a": (2, 1, 19.5), "z": (0, 0, 0.0)}
    assert quality.check_labels(df, ["a"]).count() == 2
    with pytest.raises(ValueError):
        quality.check_labels(df, ["a"], policy="raise")
    with pytest.raises(ValueError):
        quality.require_classes(df, ["a"], least=3)
    with pytest.raises(ValueError):
        require_columns(df, ["nope"])


def test_records_and_failures(spark):
    df = spark.range(6).select("id", F.lit("cv").alias("label"))

    def load():
        def score(x):
            if x == 3:
                raise RuntimeError("bad")
            return [0.0, 0.0, 1.0] if x != 4 else [1.0]

        return score

    def broken():
        raise OSError("gone")

    out = {r.document: r for r in scoring.score_provider(df, scoring.Provider("m", load), "id", "label", "id", CLASSES[:3]).collect()}
    assert out[3].status == "failed" and out[3].error_message == "RuntimeError: bad" and out[3].predicted_label is None and out[3].prob_cv is None
    assert out[4].status == "failed" and out[0].predicted_label == "contract" and abs(sum(out[0][f"prob_{c}"] for c in CLASSES[:3]) - 1) < 1e-9
    gone = scoring.score_provider(df, scoring.Provider("m", broken), "id", "label", "id", CLASSES[:3])
    assert gone.where("status = 'failed' and error_message = 'OSError: gone'").count() == 6
    ranks = scoring.ranked(scoring.score_provider(df, scoring.Provider("m", load), "id", "label", "id", CLASSES[:3]), CLASSES[:3]).where("document = 0").orderBy("rank").collect()
    assert [r["class"] for r in ranks] == ["contract", "invoice", "cv"]
    p = spark.range(1).select(scoring.canonical_probabilities(F.array(F.struct(F.lit("cv").alias("class"), F.lit(0.4).alias("probability")), F.struct(F.lit("odd").alias("class"), F.lit(0.6).alias("probability"))), CLASSES[:3])).first()[0]
    assert p == [0.0, 0.4, 0.0]


def test_history(spark):
    h = literal_table(spark, [{"epoch": i + 1, "validation_macro_f1": f} for i, f in enumerate((0.5, 0.6, 0.6, 0.55, 0.9))], HISTORY)
    assert [r.improved for r in training.best_epochs(h).orderBy("epoch").collect()] == [True, True, False, False, True]
    assert [r.epoch for r in training.early_stop(h).orderBy("epoch").collect()] == [1, 2, 3, 4]


def test_training_round_trip(spark, tmp_path):
    rows = [(i, "ab"[i % 2], "the cat sat" if i % 2 else "le chat est") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, label string, text string")
    model = training.train_text(df, ["a", "b"], "label", "text", features=256, rounds=5)
    out = training.predict(model, df, "mlr", "id", "label", ["a", "b"])
    assert metrics.macro_metrics(out, ["a", "b"], ["mlr"]).first().accuracy == 1.0
    training.save_checkpoint(model, str(tmp_path / "c"), 3, ["a", "b"], 1.0)
    assert training.load_checkpoint(spark, str(tmp_path / "c"), ["a", "b"]).stages[-1].numClasses == 2
    with pytest.raises(ValueError):
        training.load_checkpoint(spark, str(tmp_path / "c"), ["b", "a"])
    model.write().save(str(tmp_path / "bare"))
    _, about = training.inspect_checkpoint(spark, str(tmp_path / "c"))
    assert (about["type"], about["epoch"], about["outputs"], about["weight_shape"][1]) == ("training_checkpoint", 3, 2, 256)
    assert training.inspect_checkpoint(spark, str(tmp_path / "bare"))[1]["type"] == "bare_model"
    assert training.load_checkpoint(spark, str(tmp_path / "bare"), ["a", "b"]).stages[-1].numClasses == 2
    with pytest.raises(ValueError):
        training.load_checkpoint(spark, str(tmp_path / "bare"), ["a"])
    layout = training.train_layout(df.withColumn("n", F.lit(1.0)), ["a", "b"], "label", "text", ["n"], features=64, rounds=3)
    assert layout.stages[-1].numClasses == 2
    vec = df.withColumn("v", F.when(F.col("label") == "a", F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))))
    assert training.train_vectors(vec, ["a", "b"], "label", "v", 5).stages[-1].numClasses == 2


def test_dashboard(spark):
    m = spark.createDataFrame([("a", 0.5, 0.5, 1.0), ("b", 0.7, 0.5, 2.0)], "model string, accuracy double, macro_f1 double, seconds_per_document double")
    assert [(r.model, r.tag) for r in dashboard.model_comparison(m, ["a", "b"]).orderBy("model_idx").collect()] == [("a", "best macro F1"), ("b", "")]
    e = m.withColumn("macro_f1", F.when(F.col("model") == "a", 0.1).otherwise(0.4))
    c = dashboard.final_comparison(m, e, ["a", "b"])
    assert {r.model: r.tags for r in c.collect()} == {"a": "best internal", "b": "best external, smallest drop"}
    facts = dashboard.narrative_facts(c).first()
    assert (facts.best_internal, facts.best_external, facts.smallest_drop, facts.largest_drops) == ("a", "b", "b", "a and b") and "a and b" in facts.summary
    files = spark.createDataFrame([("config.json",), ("model.bin",)], "path string")
    got = {r.model: r.available for r in dashboard.availability(files, {"x": [["config.json"], ["model.bin", "model.safetensors"]], "y": [["nope"]]}).collect()}
    assert got == {"x": True, "y": False}
    assert [r.label for r in dimension(spark, ["q", "p"]).orderBy("class_idx").collect()] == ["q", "p"]
    assert dashboard.numeric(spark.createDataFrame([("x",), ("2",)], "v string"), ["v"]).agg(F.sum("v")).first()[0] == 2.0


def test_two_models_fill_missing_classes(spark):
    side = lambda rows: spark.createDataFrame(rows, "class string, probability double")
    got = {r["class"]: (r["first"], r["second"]) for r in metrics.compare_two(side([("a", 0.25), ("b", 0.75)]), side([("b", 0.5), ("c", 0.5)])).collect()}
    assert got == {"a": (0.25, 0.0), "b": (0.75, 0.5), "c": (0.0, 0.5)}


def test_shares_from_one_pass(spark):
    rows = [("m", "a", "success"), ("m", "a", "success"), ("m", "b", "success"), ("m", "c", "failed"), ("n", "b", "success"), ("other", "z", "success")]
    out = metrics.compare_shares(spark.createDataFrame(rows, "model string, predicted_label string, status string"), "m", "n")
    assert {r["class"]: (round(r["first"], 6), r["second"]) for r in out.collect()} == {"a": (0.666667, 0.0), "b": (0.333333, 1.0)}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Scan ExistingRDD") == 1
