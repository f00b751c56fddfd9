"""A multinomial naive Bayes model whose log likelihoods are a table, scored by a join on features and a sum; over words, or over words in a grid."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import clean_text
from foliant.session import shared_dir, ship

#: Rows of the most frequent features, which are broadcast: a bound whatever the vocabulary's size.
FREQUENT = 100_000


def word_features(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """(key, more, feature) for each word of the cleaned whole text in lower case; a text without words has one row whose feature is null."""
    clean = F.lower(clean_text(F.col(text)))
    words = F.when(clean != "", F.split(clean, " "))
    return df.select(key, *more, F.explode_outer(words).alias("feature"))


def word_lists(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """(key, more, feature): the words of ``word_features`` as one list for each text, empty for a text without words."""
    own = df.select(key, *more, F.lower(clean_text(F.col(text))).alias("_clean"))
    return own.select(key, *more, F.when(F.col("_clean") != "", F.split("_clean", " ")).otherwise(F.array().cast("array<string>")).alias("feature"))


def grid_feature(word: Column, x1: Column, y1: Column, x2: Column, y2: Column, grid: int = 4) -> Column:
    """A word's end in the cell of a grid that holds the middle of its box (corners from 0 to 1000): column, row, last two letters."""
    at = lambda a, b: F.floor((a + b) * grid / F.lit(2002)).cast("int").cast("string")
    return F.concat_ws(":", at(x1, x2), at(y1, y2), F.lower(F.substring(word, -2, 2)))


@dataclass(frozen=True)
class Bayes:
    """table: (feature, n, logs), with the log likelihoods of the classes as an array in their order; start: the log priors; unseen: the
    log likelihoods of a feature that training didn't see."""

    table: DataFrame
    classes: list[str]
    start: list[float]
    unseen: list[float]


def _lists(features: DataFrame) -> Column:
    """The features of a row as a list, be it one feature or a list; empty for a null list."""
    one = F.col("feature")
    return F.coalesce(one, F.array().cast("array<string>")) if features.schema["feature"].dataType.typeName() == "array" else F.array(one)


def _coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, features): the row of each element of the lists that isn't null and its place among the batch's distinct features."""
    row, flat = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()
    if flat.null_count:
        row, flat = row[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
    coded = flat.dictionary_encode()
    return row, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _class_counts(k: int):
    """Of each batch of (class, list): how often each feature occurs in each class."""
    names = ["feature", *(f"_{i}" for i in range(k))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, code, found = _coded(b.column(1))
            n = np.bincount(b.column(0).to_numpy()[row] * len(found) + code, minlength=k * len(found)).reshape(k, -1)
            yield pa.RecordBatch.from_arrays([found.cast(pa.string()), *map(pa.array, n)], names)

    return run


def fit(features: DataFrame, label: str, documents: DataFrame, classes: list[str], alpha: float = 1.0, folder: str | None = None) -> Bayes:
    """From (label, feature) rows of the training documents, feature being one or a list, and one row of ``documents`` for each document's label.

    P(feature | class) = (n + alpha) / (N + alpha * V) with n of the class's N features and V distinct features in all; a class's prior is its share of
    the documents, with alpha more for each class. Unknown labels and null features go. Only a row for each class reaches the driver.
    Arrow batches count their features, so that only a row for each batch and feature is shuffled.
    The counts are written once, to ``folder`` or the shared folder, as the totals and every scoring read them.
    """
    spark, place = features.sparkSession, folder or f"{shared_dir(features.sparkSession)}/bayes-{uuid.uuid4().hex}"
    ship(spark)
    y = F.array_position(F.array(*map(F.lit, classes)), F.col(label)).cast("int") - 1
    counts = [f"_{i}" for i in range(len(classes))]
    own = features.where(F.col(label).isin(*classes)).select(y.alias("y"), _lists(features).alias("feature"))
    each = own.mapInArrow(_class_counts(len(classes)), "feature string, " + ", ".join(f"{c} bigint" for c in counts))
    sums = each.groupBy("feature").agg(*(F.sum(c).alias(c) for c in counts))
    sums = sums.select("feature", sum((F.col(c) for c in counts[1:]), F.col(counts[0])).alias("n"), *counts)
    sums.write.parquet(place)
    sums = spark.read.schema(sums.schema).parquet(place)
    totals = sums.agg(F.count("*"), *(F.coalesce(F.sum(f"_{i}"), F.lit(0)) for i in range(len(classes)))).first()
    found = {r[0]: r[1] for r in documents.where(F.col(label).isin(*classes)).groupBy(label).count().collect()}
    start = F.array(*(F.log(F.lit((found.get(c, 0) + alpha) / (sum(found.values()) + alpha * len(classes)))) for c in classes))
    below = [float(totals[i + 1]) + alpha * float(totals[0]) for i in range(len(classes))]
    logs = F.array(*(F.log((F.col(f"_{i}") + F.lit(float(alpha))) / F.lit(b)) for i, b in enumerate(below)))
    unseen = F.array(*(F.log(F.lit(alpha / b if b else 1.0)) for b in below))
    one = spark.range(1).select(start.alias("s"), unseen.alias("u")).first()
    return Bayes(sums.select("feature", "n", logs.alias("logs")), classes, list(one.s), list(one.u))


def _near(shared):
    """Of each batch of (key, list): the sums of the frequent features' log likelihoods in a row, and the others with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, logs = shared.value
        known = pa.array(often, pa.string())
        for b in batches:
            row, code, found = _coded(b.column(1))
            place = pc.index_in(found.cast(pa.string()), known).fill_null(-1).to_numpy(zero_copy_only=False)[code]
            near = place >= 0
            sums = [np.bincount(row[near], v[place[near]], len(b)).astype(float) for v in logs]
            pairs, k = np.unique(row[~near] * max(1, len(found)) + code[~near], return_counts=True)
            far = pa.StructArray.from_arrays([found.take(pa.array(pairs % max(1, len(found)))).cast(pa.string()), pa.array(k)], ["feature", "k"])
            offsets = pa.array(np.searchsorted(pairs // max(1, len(found)), np.arange(len(b) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, sums), pa.ListArray.from_arrays(offsets, far)], ["key", *(f"s{i}" for i in range(len(logs))), "far"])

    return run


def scores(features: DataFrame, key: str, model: Bayes, folder: str | None = None) -> DataFrame:
    """(key, scores): log prior plus the sum of log likelihoods of a document's features, in class order. A row's feature may be a list.

    The most frequent features, whose rows would pile up in few tasks of a join, come from a broadcast table of a fixed bound: Arrow batches sum
    theirs by row. That pass over the features is written, to ``folder`` or the shared folder, as the sums and the other features are read from it; only
    the others, counted by row, are shuffled and joined with the rest of the table. A document without features has its priors.
    """
    spark, place = features.sparkSession, folder or f"{shared_dir(features.sparkSession)}/bayes-{uuid.uuid4().hex}"
    ship(spark)
    k = len(model.classes)
    often = model.table.orderBy(F.desc("n"), "feature").limit(FREQUENT).select("feature", *(F.col("logs")[i].alias(f"_{i}") for i in range(k))).toArrow()
    shared = spark.sparkContext.broadcast((often["feature"].to_pylist(), [often[f"_{i}"].to_numpy() for i in range(k)]))
    kind = features.schema[key].dataType.simpleString()
    columns = f"key {kind}, " + "".join(f"s{i} double, " for i in range(k)) + "far array<struct<feature:string,k:bigint>>"
    features.select(F.col(key).alias("key"), _lists(features).alias("feature")).mapInArrow(_near(shared), columns).write.parquet(place)
    done = spark.read.schema(columns).parquet(place)
    far = done.select("key", F.inline("far"))
    rest = model.table.select("feature", *(F.col("logs")[i].alias(f"_{i}") for i in range(k)))
    far = far.join(rest, "feature", "left").select("key", *((F.col("k") * F.coalesce(F.col(f"_{i}"), F.lit(u))).alias(f"s{i}") for i, u in enumerate(model.unseen)))
    both = done.drop("far").unionByName(far).groupBy("key").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(k)))
    return both.select(F.col("key").alias(key), F.array(*(F.col(f"s{i}") + F.lit(s) for i, s in enumerate(model.start))).alias("scores"))
