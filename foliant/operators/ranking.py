"""Row numbers within groups of any size: no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed_buckets(order: Column) -> Column:
    """256 buckets in the order of a hexadecimal digest, by its first two digits."""
    return F.coalesce(F.substring(order, 1, 2), F.lit(""))


def sampled_buckets(df: DataFrame, order: list[Column], buckets: int = 64, sample: int = 4096) -> Column:
    """Buckets in the order of any expressions, cut at quantiles of a bounded sample (by hash, so that every run cuts alike).

    The cuts only spread the work; ranks don't depend on them. Nulls sort first, as in the window.
    """
    o = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    kind = df.select(o.alias("o")).schema["o"].dataType
    share = int(min(1.0, sample / max(df.count(), 1)) * 1_000_000)
    own = df.select(o.alias("o")).where(F.pmod(F.xxhash64("o"), F.lit(1_000_000)) < share).distinct()
    found = [r["o"] for r in own.orderBy("o").collect()]
    cuts = [found[len(found) * i // buckets] for i in range(1, buckets)] if found else []
    literals = [F.struct(*(F.lit(v).alias(f"o{i}") for i, v in enumerate(c))).cast(kind) for c in dict.fromkeys(cuts)] if found and not any(isinstance(v, list) for v in found[0]) else []
    place = F.lit(0)
    for c in literals:
        place = place + (o >= c).cast("int")
    return place


def with_rank(df: DataFrame, by: str, order: list[Column], bucket: Column, name: str = "_rank", total: str = "_rows") -> DataFrame:
    """Adds the rank (from 1) within the group and the group's rows.

    bucket must not fall as the order rises. Rows rank within (group, bucket) by a window; the rows of earlier buckets, a table of groups
    times buckets, are added by a join on the same keys.
    """
    own = df.withColumn("_bucket", bucket)
    sizes = own.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    every = Window.partitionBy(by)
    before = F.coalesce(F.sum("_n").over(every.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(by).alias("_by"), F.col("_bucket").alias("_at"), before.alias("_before"), F.sum("_n").over(every).alias(total))
    local = own.withColumn("_local", F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)))
    out = local.join(sizes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bucket") == F.col("_at")))
    return out.withColumn(name, F.col("_local") + F.col("_before")).drop("_by", "_at", "_before", "_local", "_bucket")
