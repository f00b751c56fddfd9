"""Corpus preparation in four stages: language ID, Jaccard join, substring dedup, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.jaccard_join import jaccard_components
from foliant.llm.language_id import BUCKETS, held_out, predict, train
from foliant.llm.packing import pack_documents
from foliant.llm.scratch import Scratch
from foliant.llm.substring_dedup import dedup_substrings, origin_of
from foliant.session import ship


def _free(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names like the given ones that no column of docs has, whatever the case of its letters."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: their text is null or empty or has no letter. All others stay as they are, columns of any name included,
    also where nothing could be learned because no row outside the held-out ones is labelled."""
    ship(spark)
    model = train(docs.where(~held_out(F.col("doc_id"))))
    if not model[0]:  # one language without preferences takes all texts with letters
        model = ["any"], np.zeros((1, BUCKETS))
    found, score = _free(docs, "lang_pred", "score")
    return predict(docs, model, into=(found, score)).where(F.col(found) != "und").select(*_columns(docs))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the one with the smallest id stays, and of rows with the same id and text the one whose other
    columns come first. Texts that share an id are told apart by their hash: each goes only if it is linked itself. Rows with a null id stay."""
    ship(spark)
    (origin,) = _free(docs, "origin")
    own = docs.withColumn(origin, origin_of(F.col("text")))
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        rest = [f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")]
        twice = own.join(repeated, "doc_id", "left_semi")
        single = twice.groupBy("doc_id", "text", origin).agg(F.min(F.struct(*rest) if rest else F.lit(0)).alias("r")).select("doc_id", "text", origin, *(["r.*"] if rest else []))
        own = Scratch(spark, "jaccard-stage").put(own.join(repeated, "doc_id", "left_anti").select(*_columns(own)).unionByName(single), "single")
    linked = jaccard_components(own.select("doc_id", "text"), "doc_id").where("not first").select("doc_id", F.col("origin").alias(origin))
    return own.join(linked, ["doc_id", origin], "left_anti").select(*_columns(docs))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; the kept words are joined by one space, and n_chars follows. Texts without such words stay as
    they are; a document of which nothing is left goes. Rows with a null id or text stay. Rows that share an id are each judged alone
    and keep their own columns, whatever their names."""
    ship(spark)
    (origin,) = _free(docs, "origin")
    own = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).withColumn(origin, origin_of(F.col("text")))
    kept = dedup_substrings(own.select("doc_id", "text"), "doc_id").where("n_words = 0 or n_removed < n_words").withColumnRenamed("origin", origin)
    twice = own.groupBy("doc_id", origin).count().where("count > 1").select("doc_id", origin)
    if not twice.isEmpty():
        kept = kept.join(twice, ["doc_id", origin], "left_anti").unionByName(kept.join(twice, ["doc_id", origin], "left_semi").dropDuplicates(["doc_id", origin]))
    out = kept.select("doc_id", origin, F.col("kept").alias("text"), F.length("kept").cast("bigint").alias("n_chars")).join(own.drop("text", "n_chars"), ["doc_id", origin])
    return out.select(*_columns(docs)).unionByName(docs.where(F.col("doc_id").isNull() | F.col("text").isNull()))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    ship(spark)
    return pack_documents(docs.select("doc_id", "text"), "doc_id")


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", jaccard_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: SQL can't express the tokens of the last stage nor the inferred languages; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
