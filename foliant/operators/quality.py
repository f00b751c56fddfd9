"""Data-quality operators: lengths, short texts, issues, invalid labels, missing artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.num import safe_ratio
from foliant.functions.text import MIN_CHARS, clean_length, joined_length
from foliant.operators.tables import dimension


def with_quality(df: DataFrame, text: str = "text", least: int = MIN_CHARS) -> DataFrame:
    """Adds text_length (of the cleaned text) and issue: empty, short, or null. No row is dropped."""
    n = clean_length(F.col(text))
    return df.withColumn("text_length", n).withColumn("issue", F.when(F.col("text_length") == 0, "empty").when(F.col("text_length") < least, "short"))


def failed_extraction(df: DataFrame, text: str = "text", least: int = MIN_CHARS) -> DataFrame:
    """Rows whose text is too short to use, with its length."""
    return df.withColumn("text_length", clean_length(F.col(text))).where(F.col("text_length") < least)


def summary_by_label(df: DataFrame, labels: list[str], label: str = "label", text: str = "text", least: int = MIN_CHARS) -> DataFrame:
    """For every label of the list, present or not: rows, short texts, mean length (0.0 without rows)."""
    n = clean_length(F.col(text))
    found = df.select(F.col(label).alias("label"), n.alias("n")).groupBy("label").agg(F.count("*").alias("c"), F.sum(F.when(F.col("n") < least, 1).otherwise(0)).alias("s"), F.sum("n").alias("t"))
    out = dimension(df.sparkSession, labels).join(found, "label", "left")
    return out.select("class_idx", "label", F.coalesce("c", F.lit(0)).alias("documents"), F.coalesce("s", F.lit(0)).alias("short_texts"), safe_ratio(F.col("t"), F.col("c")).alias("mean_length"))


def check_labels(df: DataFrame, labels: list[str], label: str = "label", policy: str = "drop", examples: int = 10) -> DataFrame:
    """Rows whose label is in the list. policy: drop the others, or raise with some examples."""
    dim = F.broadcast(dimension(df.sparkSession, labels, label).select(label))
    if policy == "raise":
        bad = [r[0] for r in df.join(dim, label, "left_anti").select(label).limit(examples).collect()]
        if bad:
            raise ValueError(f"unknown labels: {bad}")
    elif policy != "drop":
        raise ValueError("policy must be drop or raise")
    return df.join(dim, label, "left_semi")


def invalid_labels(df: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    return df.join(F.broadcast(dimension(df.sparkSession, labels, label).select(label)), label, "left_anti")


def missing_artifacts(df: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Rows whose artifact isn't among the files (a column of the same name)."""
    return df.join(files.select(path), path, "left_anti")


def require_classes(df: DataFrame, labels: list[str], label: str = "label", least: int = 3) -> DataFrame:
    """Raises unless every label has so many rows; only the counts by label reach the driver."""
    found = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    poor = [x for x in labels if found.get(x, 0) < least]
    if poor:
        raise ValueError(f"classes with fewer than {least} rows: {poor}")
    return df


def issues(df: DataFrame, labels: list[str], key: str, label: str, text: str, present: Column, least: int = MIN_CHARS) -> DataFrame:
    """One row for each document with an issue: invalid_label, missing_file, empty, short; the first that holds, in this order."""
    n = clean_length(F.col(text))
    kind = F.when(~F.coalesce(F.col(label).isin(*labels), F.lit(False)), "invalid_label").when(~present, "missing_file").when(n == 0, "empty").when(n < least, "short")
    return df.select(F.col(key), F.col(label), n.alias("text_length"), kind.alias("issue")).where(F.col("issue").isNotNull())


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("issue").agg(F.count("*").alias("documents"))


def prepared_rows(df: DataFrame, labels: list[str], key: str, label: str, text: str) -> DataFrame:
    """id, label, label_id (from 0), the text as it is, and its length with white space collapsed; unknown labels dropped."""
    dim = F.broadcast(dimension(df.sparkSession, labels))
    own = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(text).alias("text"))
    return own.join(dim, "label").select("id", "label", (F.col("class_idx") - 1).alias("label_id"), "text", joined_length(F.col("text")).alias("text_length"))


def retry(df: DataFrame, refreshed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Upsert: a row's columns come from the refreshed table where it has them."""
    new = refreshed.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    out = df.join(new, key, "left")
    return out.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns))
