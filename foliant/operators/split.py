"""Numbering, limits, samples and stratified splits by label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import surrogate_id
from foliant.operators.ranking import hashed_buckets, sampled_buckets, with_rank


def seeded_order(key: Column, seed: int) -> Column:
    """A shuffle that any engine can repeat: by the md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def number_by_label(df: DataFrame, label: str, order: list[Column]) -> DataFrame:
    """Adds sequence (from 1 within the label) and id. Number before extraction, so that failures use up a number."""
    out = with_rank(df, label, order, sampled_buckets(df, order), "sequence", "_rows").drop("_rows")
    return out.withColumn("id", surrogate_id(F.col(label), F.col("sequence")))


def limit_per_class(df: DataFrame, limit: int | None, label: str, order: list[Column]) -> DataFrame:
    """The first rows of each label in the given order. None: all rows."""
    if limit is None:
        return df
    if limit < 1:
        raise ValueError("the limit must be a positive integer")
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def sample_per_class(df: DataFrame, size: int, label: str, key: str, seed: int = 42) -> DataFrame:
    return limit_per_class(df, size, label, [seeded_order(F.col(key), seed), F.col(key)])


def stratified_split(df: DataFrame, label: str, key: str, seed: int = 42, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Adds split: train, validation or test. Of n rows of a label max(1, floor(train * n)) train and max(1, floor(validation * n))
    validate, the rest tests; where nothing would be left, one validates and one tests. Labels with fewer than three rows raise.

    Fractions are doubles, as floor(0.7 * 90) = 62 shows. A label's rows are ranked in buckets of their shuffled order.
    """
    poor = [r[0] for r in df.groupBy(label).agg(F.count("*").alias("n")).where("n < 3").select(label).limit(10).collect()]
    if poor:
        raise ValueError(f"classes with fewer than 3 rows: {poor}")
    order = seeded_order(F.col(key), seed)
    out = with_rank(df, label, [order, F.col(key)], hashed_buckets(order), "_n", "_rows")
    part = lambda f: F.greatest(F.lit(1), F.floor(F.col("_rows") * F.lit(float(f))).cast("bigint"))
    full = part(train) + part(validation) >= F.col("_rows")
    out = out.withColumns({"_train": F.when(full, F.col("_rows") - 2).otherwise(part(train)), "_validation": F.when(full, 1).otherwise(part(validation))})
    split = F.when(F.col("_n") <= F.col("_train"), "train").when(F.col("_n") <= F.col("_train") + F.col("_validation"), "validation").otherwise("test")
    return out.withColumn("split", split).select(*df.columns, "split")


def split_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows by label, one column for each split."""
    return df.groupBy(label).pivot("split", ["train", "validation", "test"]).agg(F.count(F.lit(1))).na.fill(0)
