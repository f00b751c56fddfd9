"""The views of the results dashboard as DataFrames; formatting is left to whoever shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.num import lenient_double
from foliant.operators.metrics import best_tags, internal_vs_external
from foliant.operators.tables import dimension


def numeric(df: DataFrame, columns: list[str], fill: float | None = 0.0) -> DataFrame:
    """Columns as doubles; what isn't a number becomes the fill value, or null."""
    return df.withColumns({c: lenient_double(F.col(c), fill) for c in columns if c in df.columns})


def internal_table(metrics: DataFrame, models: list[str]) -> DataFrame:
    """Every model of the list with its metrics, null where it has none."""
    return dimension(metrics.sparkSession, models, "model", "model_idx").join(metrics, "model", "left")


def class_detail(by_class: DataFrame, model: str) -> DataFrame:
    out = by_class.where(F.col("model") == model)
    return out.withColumns({f"{c}_percent": F.col(c) * 100 for c in ("precision", "recall", "f1")})


def model_comparison(metrics: DataFrame, models: list[str]) -> DataFrame:
    """Metrics with the place of each model and a tag on the first of the best by macro F1."""
    out = dimension(metrics.sparkSession, models, "model", "model_idx").join(metrics, "model")
    return out.withColumn("tag", best_tags(out, [("best macro F1", F.col("macro_f1"), "desc")], "model_idx"))


def final_comparison(internal: DataFrame, external: DataFrame, models: list[str]) -> DataFrame:
    """Internal against external metrics with the tags of the best and of the smallest drop."""
    out = dimension(internal.sparkSession, models, "model", "model_idx").join(internal_vs_external(internal, external), "model")
    tags = [("best internal", F.col("internal_macro_f1"), "desc"), ("best external", F.col("external_macro_f1"), "desc"), ("smallest drop", F.col("macro_f1_drop"), "asc")]
    return out.withColumn("tags", best_tags(out, tags, "model_idx"))


def narrative_facts(comparison: DataFrame) -> DataFrame:
    """One row: the best models, the smallest drop, the two largest drops, and a sentence of them. The first of ties counts."""
    rows = F.collect_list(F.struct("model_idx", "model", "internal_macro_f1", "external_macro_f1", "macro_f1_drop"))
    one = comparison.agg(rows.alias("r"))
    by = lambda c, sign: F.transform(F.array_sort(F.transform("r", lambda x: F.struct((x[c] * sign).alias("v"), x["model_idx"].alias("i"), x["model"].alias("m")))), lambda x: x["m"])
    best_in, best_out, least, most = (F.get(by(c, s), F.lit(0)) for c, s in (("internal_macro_f1", -1), ("external_macro_f1", -1), ("macro_f1_drop", 1), ("macro_f1_drop", -1)))
    out = one.select(best_in.alias("best_internal"), best_out.alias("best_external"), least.alias("smallest_drop"), F.array_join(F.slice(by("macro_f1_drop", -1), 1, 2), " and ").alias("largest_drops"))
    return out.withColumn("summary", F.format_string("Best on the internal set: %s. Best on the external set: %s. Smallest drop of macro F1: %s. Most sensitive to new sources: %s.", "best_internal", "best_external", "smallest_drop", "largest_drops"))


def browse(records: DataFrame, names: dict[str, str], model: str | None = None, labels: list[str] | None = None, only_success: bool = True, only_wrong: bool = False) -> DataFrame:
    """Filtered predictions with shown model names. A failed record has no prediction and so counts as wrong."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    shown = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("model")), F.col("model")) if pairs else F.col("model")
    out = records.withColumns({"shown": shown, "predicted": F.coalesce("predicted_label", F.lit(""))})
    if model is not None:
        out = out.where(F.col("shown") == model)
    if labels is not None:
        out = out.where(F.col("true_label").isin(*labels))
    if only_success:
        out = out.where(F.col("status") == "success")
    if only_wrong:
        out = out.where(F.col("true_label") != F.col("predicted"))
    return out


def menu(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def chart_rows(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """(model, measure, percent) for a bar chart."""
    return metrics.select("model", F.inline(F.array(*(F.struct(F.lit(c).alias("measure"), (F.col(c) * 100).alias("percent")) for c in columns))))


def availability(files: DataFrame, models: dict[str, list[list[str]]]) -> DataFrame:
    """(model, available): every group of a model has one of its files, from one aggregation for all. files: a column path, relative to the model folder."""
    groups = [(model, i, g) for model, own in models.items() for i, g in enumerate(own)]
    one = files.agg(*(F.coalesce(F.max(F.col("path").isin(*g)), F.lit(False)).alias(f"{m}/{i}") for m, i, g in groups))
    all_of = lambda model: F.forall(F.array(F.lit(True), *(F.col(f"`{m}/{i}`") for m, i, _ in groups if m == model)), lambda x: x)
    return one.select(F.inline(F.array(*(F.struct(F.lit(m).alias("model"), all_of(m).alias("available")) for m in models))))
