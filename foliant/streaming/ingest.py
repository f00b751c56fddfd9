"""Incremental ingest: the same text and quality functions over a stream of new documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.functions.text import clean_text
from foliant.operators.quality import with_quality


def stream_documents(spark: SparkSession, path: str, schema: str, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def prepared(stream: DataFrame, text: str = "text") -> DataFrame:
    """Cleaned text with hash, length and issue; a map, so it needs no state."""
    out = with_quality(stream.withColumn(text, clean_text(F.col(text))), text)
    return out.withColumn("sha256", F.sha2(text, 256))


def first_copies(stream: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """Only the first document of each content within the watermark; older state is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["sha256"])


def quality_counts(stream: DataFrame, time: str, label: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Documents and short texts by window and label."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), label).agg(F.count("*").alias("documents"), F.sum(F.when(F.col("issue").isNotNull(), 1).otherwise(0)).alias("short_texts"))


def write_stream(stream: DataFrame, path: str, checkpoint: str, now: bool = True) -> StreamingQuery:
    """Appends to a Parquet table; each file once, as the checkpoint remembers."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if now else writer).start(path)
