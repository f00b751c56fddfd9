"""Classification metrics over evaluation records, dense on the class axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.num import heat, safe_ratio, total
from foliant.operators.tables import dimension


def pair_counts(records: DataFrame) -> DataFrame:
    """(model, true_label, predicted_label, n) of the successful records."""
    return records.where(F.col("status") == "success").groupBy("model", "true_label", "predicted_label").agg(F.count("*").alias("n"))


def _axis(counts: DataFrame, classes: list[str], models: list[str] | None) -> DataFrame:
    spark = counts.sparkSession
    names = dimension(spark, models, "model", "model_idx").select("model") if models else counts.select("model").distinct()
    return names.crossJoin(F.broadcast(dimension(spark, classes)))


def class_counts(counts: DataFrame, classes: list[str], models: list[str] | None = None) -> DataFrame:
    """True positives, predictions and support for every model and class, zeros included. Unknown labels count nowhere."""
    hit = F.col("true_label") == F.col("predicted_label")
    events = counts.select("model", F.inline(F.array(F.struct(F.col("true_label").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("predicted"), F.col("n").alias("support")), F.struct(F.col("predicted_label").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("support")))))
    sums = events.groupBy("model", "label").agg(*(F.sum(c).alias(c) for c in ("tp", "predicted", "support")))
    return _axis(counts, classes, models).join(sums, ["model", "label"], "left").na.fill(0, ["tp", "predicted", "support"])


def class_metrics(counts: DataFrame, classes: list[str], models: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support by model and class; ratios with a zero denominator are 0."""
    p, r = safe_ratio(F.col("tp"), F.col("predicted")), safe_ratio(F.col("tp"), F.col("support"))
    out = class_counts(counts, classes, models).withColumns({"precision": p, "recall": r})
    f1 = safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1).select("model", "class_idx", "label", "precision", "recall", "f1", "support")


def evaluation(records: DataFrame, classes: list[str], models: list[str] | None = None) -> DataFrame:
    """One row by model, from one grouped pass over the records: accuracy over successes, macro averages over the whole class list in
    its order, times, record counts, and per_class (class_idx, label, precision, recall, f1, support).

    The sums are conditional, three for each class, so the class list is a short one. Unknown labels count in no class.
    """
    true, predicted, ok = F.col("true_label"), F.col("predicted_label"), F.coalesce(F.col("status") == "success", F.lit(False))
    count = lambda what: F.count(F.when(what, 1))
    sums = [x for i, c in enumerate(classes) for x in (count(ok & (true == c) & (predicted == c)).alias(f"_hit{i}"), count(ok & (predicted == c)).alias(f"_said{i}"), count(ok & (true == c)).alias(f"_true{i}"))]
    plain = [count(ok & (true == predicted)).alias("_hits"), count(ok).alias("documents_processed"), count(~ok).alias("documents_failed"), F.count("*").alias("documents_total")]
    one = records.groupBy("model").agg(*plain, F.coalesce(F.sum(F.when(ok, F.col("prediction_time_seconds"))), F.lit(0.0)).alias("prediction_time_seconds"), *sums)
    if models:
        one = dimension(records.sparkSession, models, "model", "model_idx").select("model").join(one, "model", "left").na.fill(0)
    cells = F.array(*(F.struct(F.lit(i + 1).alias("class_idx"), F.lit(c).alias("label"), safe_ratio(F.col(f"_hit{i}"), F.col(f"_said{i}")).alias("p"), safe_ratio(F.col(f"_hit{i}"), F.col(f"_true{i}")).alias("r"), F.col(f"_true{i}").alias("n")) for i, c in enumerate(classes)))
    f1 = lambda x: safe_ratio(2 * x["p"] * x["r"], x["p"] + x["r"])
    out = one.withColumn("_cells", cells).withColumn("per_class", F.transform("_cells", lambda x: F.struct(x["class_idx"], x["label"], x["p"].alias("precision"), x["r"].alias("recall"), f1(x).alias("f1"), x["n"].alias("support"))))
    mean = lambda f: total(F.transform("per_class", lambda x: x[f])) / F.lit(float(len(classes)))
    return out.select(
        "model",
        safe_ratio(F.col("_hits"), F.col("documents_processed")).alias("accuracy"),
        *(mean(f).alias(f"macro_{f}") for f in ("precision", "recall", "f1")),
        "prediction_time_seconds",
        safe_ratio(F.col("prediction_time_seconds"), F.col("documents_processed")).alias("seconds_per_document"),
        "documents_processed",
        "documents_failed",
        "documents_total",
        "per_class",
    )


def macro_metrics(records: DataFrame, classes: list[str], models: list[str] | None = None) -> DataFrame:
    """evaluation() without the classes."""
    return evaluation(records, classes, models).drop("per_class")


def confusion_by_set(records: DataFrame, classes: list[str], test_set: str = "test_set") -> DataFrame:
    """Confusion counts for each test set and model, each set over all models, each model over all sets, and all together: null stands for all.

    (test set, model, class_idx, true_label, a column for each predicted class), from one pass over the records; pairs without any successful
    record have no rows, and unknown labels are left out.
    """
    own = records.where((F.col("status") == "success") & F.col("true_label").isin(*classes))
    cells = own.groupingSets([[test_set, "model", "true_label"], [test_set, "true_label"], ["model", "true_label"], ["true_label"]], test_set, "model", "true_label").agg(*(F.count(F.when(F.col("predicted_label") == c, 1)).alias(c) for c in classes))
    # the classes of a pair in one row, so that those without records come back as zeros
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("true_label")).cast("int")
    rows = cells.groupBy(test_set, "model").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("i"), F.array(*classes).alias("n")))).alias("by"))
    zeros = F.array(*(F.lit(0).cast("bigint") for _ in classes))
    axis = F.array(*(F.struct(F.lit(i + 1).alias("class_idx"), F.lit(c).alias("true_label")) for i, c in enumerate(classes)))
    out = rows.select(test_set, "model", "by", F.inline(axis)).withColumn("n", F.coalesce(F.try_element_at("by", F.col("class_idx")), zeros))
    return out.select(test_set, "model", "class_idx", "true_label", *(F.col("n")[i].alias(c) for i, c in enumerate(classes)))


def confusion_matrix(counts: DataFrame, classes: list[str], models: list[str] | None = None) -> DataFrame:
    """A row for every model and true class, a column for every predicted class; unknown labels are left out."""
    wide = counts.groupBy("model", "true_label").pivot("predicted_label", classes).agg(F.sum("n"))
    axis = _axis(counts, classes, models).withColumnRenamed("label", "true_label")
    return axis.join(wide, ["model", "true_label"], "left").na.fill(0, classes).select("model", "class_idx", "true_label", *classes)


def heatmap_cells(matrix: DataFrame, classes: list[str]) -> DataFrame:
    """Every cell of the matrices with its colours; intensity is relative to the model's largest cell."""
    cells = matrix.select("model", "true_label", F.inline(F.array(*(F.struct(F.lit(c).alias("predicted_label"), F.col(c).cast("bigint").alias("value")) for c in classes))))
    most = F.max("value").over(Window.partitionBy("model"))
    return cells.withColumns(heat(F.col("value"), most))


def log_loss(records: DataFrame, classes: list[str]) -> DataFrame:
    """Mean cross-entropy of the true class by model."""
    p = F.lit(None).cast("double")
    for c in classes:
        p = F.when(F.col("true_label") == c, F.col(f"prob_{c}")).otherwise(p)
    return records.where(F.col("status") == "success").select("model", (-F.log(p)).alias("loss")).groupBy("model").agg(F.avg("loss").alias("loss"), F.count("loss").alias("documents"))


def agreement(records: DataFrame) -> DataFrame:
    """For each document the number of different predictions, and whether all models agree. Failed records have no say."""
    own = records.where(F.col("status") == "success").groupBy("document").agg(F.count_distinct("predicted_label").alias("answers"), F.count("*").alias("models"))
    return own.withColumn("agree", F.col("answers") == 1)


def probability_matrix(records: DataFrame, classes: list[str], models: list[str]) -> DataFrame:
    """A row for every document and class, a column for every model; 0 where a model has none."""
    own = records.where(F.col("status") == "success")
    long = own.select("document", "model", F.inline(F.array(*(F.struct(F.lit(i + 1).alias("class_idx"), F.lit(c).alias("class"), F.col(f"prob_{c}").alias("p")) for i, c in enumerate(classes)))))
    return long.groupBy("document", "class_idx", "class").pivot("model", models).agg(F.max("p")).na.fill(0.0, models)


def compare_two(first: DataFrame, second: DataFrame) -> DataFrame:
    """Full outer join by class of two (class, probability) tables; 0 on the side that lacks a class."""
    a, b = first.select("class", F.col("probability").alias("first")), second.select("class", F.col("probability").alias("second"))
    return a.join(b, "class", "full_outer").na.fill(0.0, ["first", "second"])


def compare_shares(records: DataFrame, first: str, second: str) -> DataFrame:
    """Each class that either model predicts with its share of the model's successful predictions, 0 for a model that never does: the outer join of
    both models' shares, taken from one grouped count of the records."""
    counts = records.where(F.col("status") == "success").groupBy("model", F.col("predicted_label").alias("class")).agg(F.count("*").alias("n"))
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("model")))
    of = lambda m: F.coalesce(F.max(F.when(F.col("model") == m, F.col("p"))), F.lit(0.0))
    return share.where(F.col("model").isin(first, second)).groupBy("class").agg(of(first).alias("first"), of(second).alias("second"))


def metrics_json(evaluated: DataFrame) -> DataFrame:
    """One JSON document by model of evaluation(): scalars and a map from class to its metrics."""
    per = F.map_from_entries(F.transform("per_class", lambda x: F.struct(x["label"], F.struct(x["precision"], x["recall"], x["f1"], x["support"]))))
    out = evaluated.withColumn("per_class", per)
    return out.select("model", F.to_json(F.struct(*(c for c in out.columns if c != "model"))).alias("json"))


def report_text(evaluated: DataFrame) -> DataFrame:
    """A text block by model of evaluation(): a line for each class, a blank one, accuracy and the macro averages (a fixed format)."""
    line = lambda x: F.format_string("%s,%.6f,%.6f,%.6f,%d", x["label"], x["precision"], x["recall"], x["f1"], x["support"])
    rest = (F.format_string(f"{c},%.6f", c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1"))
    return evaluated.select("model", F.concat_ws("\n", F.lit("label,precision,recall,f1,support"), F.array_join(F.transform("per_class", line), "\n"), F.lit(""), *rest).alias("report"))


def best_tags(df: DataFrame, tags: list[tuple[str, Column, str]], order: str) -> Column:
    """Names of the criteria by which a row is the first of the best, joined. tags: (name, value, asc or desc)."""
    every = []
    for name, value, way in tags:
        first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(value.desc() if way == "desc" else value.asc(), order)) == 1
        every.append(F.when(first, name))
    return F.concat_ws(", ", *every)


def internal_vs_external(internal: DataFrame, external: DataFrame) -> DataFrame:
    """Accuracy, macro F1 and seconds of both sets by model, and the drops (internal minus external)."""
    names = ("accuracy", "macro_f1", "seconds_per_document")
    a = internal.select("model", *(F.col(n).alias(f"internal_{n}") for n in names))
    b = external.select("model", *(F.col(n).alias(f"external_{n}") for n in names))
    return a.join(b, "model").withColumns({f"{n}_drop": F.col(f"internal_{n}") - F.col(f"external_{n}") for n in names[:2]})
