"""A hash index that is kept: the internal collection's content hashes in buckets, built once and probed by any external collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a bucket, about; and bits of a hash that make its place in the filter: 2 ** 24 places, 2 MB of bitmaps, however many hashes there are.
BUCKET_ROWS, HEX_DIGITS = 2_000_000, 6


def _place(sha: Column) -> Column:
    return F.conv(F.substring(sha, 1, HEX_DIGITS), 16, 10).cast("bigint")


class KeptIndex:
    """(sha256, path) in a table bucketed and sorted by sha256.

    A join reads the buckets as they lie: only the external side is shuffled, to the buckets, and an internal document is hashed and shuffled once in the
    index's life. Before the join a Bloom filter of the external side leaves out internal rows: bitmaps over the first 24 bits of its hashes, one row for
    32768 places, at most 512 rows, which are broadcast whatever the size of either side.
    """

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table

    def build(self, internal: DataFrame, key: str, folder: str, buckets: int | None = None) -> KeptIndex:
        """Writes the index of (key, sha256) rows to a folder of its own; without hashes (null) a row is no entry."""
        own = internal.where(F.col("sha256").isNotNull()).select("sha256", F.col(key).alias("path"))
        n = buckets or max(1, -(-own.count() // BUCKET_ROWS))
        own.repartition(n, "sha256").write.mode("overwrite").option("path", folder).bucketBy(n, "sha256").sortBy("sha256").saveAsTable(self.table)
        return self

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def near(self, external: DataFrame) -> DataFrame:
        """Entries that the filter can't rule out: all whose hash is among the external ones, and few others."""
        place = _place(F.col("sha256"))
        bits = external.where(F.col("sha256").isNotNull()).select(place.alias("p")).groupBy(F.floor(F.col("p") / 32768).cast("int").alias("_group")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(32768))).alias("_bits"))
        own = self.entries().withColumns({"_group": F.floor(place / 32768).cast("int"), "_at": F.pmod(place, F.lit(32768)).cast("int")})
        byte = F.conv(F.hex(F.expr("substring(_bits, _at div 8 + 1, 1)")), 16, 10).cast("int")
        found = own.join(F.broadcast(bits), "_group")
        return found.where(byte.bitwiseAND(F.expr("shiftleft(1, _at % 8)")) != 0).select("sha256", "path")

    def exclude(self, external: DataFrame) -> DataFrame:
        """External rows whose content isn't in the collection; rows without a hash stay, duplicates among them stay."""
        return external.join(self.near(external), "sha256", "left_anti")

    def excluded(self, external: DataFrame, separator: str = " | ") -> DataFrame:
        """The other external rows with the internal paths of the same content, in path order."""
        paths = self.near(external).groupBy("sha256").agg(F.array_sort(F.collect_list("path")).alias("paths"))
        return external.join(paths, "sha256").withColumn("matching_raw_paths", F.array_join(F.transform("paths", lambda p: p.cast("string")), separator)).drop("paths")
