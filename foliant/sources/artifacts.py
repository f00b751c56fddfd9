"""Stored artifacts in hash partitions, with upserts in place, and listings of files joined by path."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import shared_dir

PART = "_part"


class ArtifactStore:
    """A table of artifacts under a folder, one row for each key, in folders by a hash of the key.

    An upsert reads and rewrites the folders of the keys that change; the files of all others stay untouched. Merged rows are written to the
    shared folder first, so that whatever fails on the way there (a lost source, a raising expression) leaves the old rows; the
    last step copies finished rows, and Spark's committer puts each folder in place when its tasks have ended. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, parts: int = 64):
        self.spark, self.root, self.key, self.parts = spark, root.rstrip("/"), key, parts

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.parts)).cast("int").alias(PART)

    def _unique(self, df: DataFrame) -> DataFrame:
        bad = df.where(F.col(self.key).isNull()).select(F.col(self.key)).limit(1).union(df.groupBy(self.key).count().where("count > 1").select(self.key).limit(1)).first()
        if bad is not None:
            raise ValueError(f"null or repeated key: {bad[0]}")
        return df

    def _write(self, df: DataFrame, overwrite: bool) -> None:
        # a folder's rows meet in one task a write, so that it gets one file
        rows = df.repartition(PART).write.partitionBy(PART)
        if overwrite:
            rows = rows.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        rows.parquet(self.root)

    def create(self, df: DataFrame) -> None:
        """Writes the first rows. Null and repeated keys raise ValueError; a folder that is there already raises."""
        self._write(self._unique(df).select("*", self._part()), overwrite=False)

    def read(self, parts: list[int] | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.root)
        if parts is not None:
            df = df.where(F.col(PART).isin(*parts))
        return df.drop(PART)

    def upsert(self, changes: DataFrame) -> int:
        """Rows of known keys take the changes' columns where those aren't null, rows of new keys are added; the number of folders rewritten.

        Columns that the changes lack stay. Null and repeated keys raise ValueError before anything is written; unknown columns raise too. Only
        the numbers of the touched folders reach the driver, at most ``parts``.
        """
        names = [c for c in self.spark.read.parquet(self.root).columns if c != PART]
        if extra := sorted(set(changes.columns) - set(names)):
            raise ValueError(f"unknown columns: {', '.join(extra)}")
        stage = f"{shared_dir(self.spark)}/upsert-{uuid.uuid4().hex}"
        changes.select("*", self._part()).write.parquet(f"{stage}/changes")
        new = self.spark.read.parquet(f"{stage}/changes")
        self._unique(new)
        touched = sorted(r[0] for r in new.select(PART).distinct().collect())
        if touched:
            renamed = new.select(F.col(self.key), *(F.col(f"`{c}`").alias(f"_new_{c}") for c in changes.columns if c != self.key))
            merged = self.read(touched).join(renamed, self.key, "full_outer")
            values = [F.col(c) if c == self.key or c not in changes.columns else F.coalesce(f"_new_{c}", c).alias(c) for c in names]
            merged.select(*values).select("*", self._part()).write.parquet(f"{stage}/merged")
            self._write(self.spark.read.parquet(f"{stage}/merged"), overwrite=True)
        _drop(self.spark, stage)
        return len(touched)


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, relative, length, modified) of every file below the root, from the file system's entries: no file is opened.

    relative is the path below the root, with / between its parts. A missing root has no rows.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return spark.createDataFrame([], "path string, relative string, length bigint, modified timestamp")
    base = fs.makeQualified(p).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.substring("path", len(base) + 2, 1 << 20).alias("relative"), "length", F.col("modificationTime").alias("modified"))


def with_artifacts(df: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Adds length and modified of the row's artifact, by the path that its column ``path`` names below the root; null where there is none."""
    own = files.select(F.col("relative").alias(path), F.col("length").alias("artifact_length"), F.col("modified").alias("artifact_modified"))
    return df.join(own, path, "left")


def without_artifact(df: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Rows whose artifact isn't below the root; a null path has none."""
    return df.join(files.select(F.col("relative").alias(path)), path, "left_anti")


def without_row(files: DataFrame, df: DataFrame, path: str) -> DataFrame:
    """Files that no row names."""
    return files.join(df.select(F.col(path).alias("relative")), "relative", "left_anti")
