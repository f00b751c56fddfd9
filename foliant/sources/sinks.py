"""Where results go. A report of a few rows is one file; tables are written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With a header; nulls as empty fields, white space as it is. single: one file, for reports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_splits(df: DataFrame, path: str) -> None:
    """A folder for each split; what exists is never replaced, so a smoke run can't overwrite shared splits."""
    df.write.mode("errorifexists").partitionBy("split").parquet(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Extracted texts, payloads and images as one table."""
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str, column: str = "json", by: str = "model") -> None:
    """One JSON text for each key."""
    df.select(by, F.col(column).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def write_text(df: DataFrame, path: str, column: str, by: str = "model") -> None:
    df.select(by, F.col(column).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def write_comparison(metrics: DataFrame, path: str) -> None:
    """The comparison in model order, one file; its columns are a fixed format."""
    names = ["model", "accuracy", "macro_precision", "macro_recall", "macro_f1", "seconds_per_document", "documents_processed", "documents_failed"]
    write_csv(metrics.orderBy("model_idx").select(*names), path, single=True)


def write_labels(classes: list[str], path: str, spark) -> None:
    """Class names and both mappings as JSON; the keys are a fixed format."""
    names = F.array(*map(F.lit, classes))
    places = F.array(*(F.lit(i) for i in range(len(classes))))
    row = spark.range(1).select(F.to_json(F.struct(names.alias("class_names"), F.map_from_arrays(names, places).alias("label_to_index"), F.map_from_arrays(F.transform(places, lambda p: p.cast("string")), names).alias("index_to_label"))).alias("value"))
    row.write.mode("overwrite").text(path)

