"""Schemas, dimension tables and column guards."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "id string, label string, raw_path string, image_path string, text_path string, ocr_path string"
HISTORY = "epoch int, train_loss double, train_accuracy double, validation_loss double, validation_accuracy double, validation_macro_precision double, validation_macro_recall double, validation_macro_f1 double"


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from Python values, planned as an expression."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def dimension(spark: SparkSession, values: list[str], name: str = "label", index: str = "class_idx") -> DataFrame:
    """The values with their places from 1. Their order is the order of reports and of ties."""
    if len(set(values)) != len(values):
        raise ValueError("repeated values in a dimension")
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, values)))).select((F.col("pos") + 1).alias(index), F.col("col").alias(name))
