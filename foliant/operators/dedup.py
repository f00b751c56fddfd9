"""Exact duplicates of one collection in another, by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_hash(df: DataFrame, content: str, name: str = "sha256") -> DataFrame:
    return df.withColumn(name, F.sha2(F.col(content), 256))


def hash_index(df: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """sha256 and its paths in path order."""
    place = F.col(key) if order is None else order
    return df.groupBy("sha256").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("o"), F.col(key).alias("p")))), lambda x: x["p"]).alias("paths"))


def exclude(external: DataFrame, internal: DataFrame) -> DataFrame:
    """External documents that aren't in the internal collection. Duplicates among the external ones stay.

    The hashes alone are joined; the plan broadcasts them only when they are small.
    """
    return external.join(internal.select("sha256").distinct(), "sha256", "left_anti")


def excluded(external: DataFrame, internal: DataFrame, key: str, separator: str = " | ") -> DataFrame:
    """The other external documents with the internal paths of the same content."""
    hashes = external.select("sha256").distinct()
    index = hash_index(internal.join(hashes, "sha256", "left_semi"), key)
    return external.join(index, "sha256").withColumn("matching_raw_paths", F.array_join(F.transform("paths", lambda p: p.cast("string")), separator)).drop("paths")
