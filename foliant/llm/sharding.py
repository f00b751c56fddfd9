"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only)."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ring(shards: int, vnodes: int, slices: int) -> list[tuple[int, int]]:
    """(slice, shard) of every virtual node, clockwise. Each has a slice of its own; a taken slice passes it on clockwise."""
    if shards < 1 or vnodes < 1 or shards * vnodes > slices:
        raise ValueError("the ring needs a slice for each virtual node")
    taken: dict[int, int] = {}
    for v in range(vnodes):
        for s in range(shards):
            at = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % slices
            while at in taken:
                at = (at + 1) % slices
            taken[at] = s
    return sorted(taken.items())


def bounded_plan(counts: dict[int, int], shards: int, vnodes: int, slices: int) -> list[dict]:
    """Which ranks of each slice go to which shard, and their first slot there.

    Quotas differ by one at most and sum to the rows. A slice's keys go to the next virtual node clockwise; keys that overflow a
    full shard continue clockwise to the next with room. The plan has at most slices + shards * vnodes parts.
    """
    total = sum(counts.values())
    nodes = ring(shards, vnodes, slices)
    places = [p for p, _ in nodes]
    room = [total // shards + (s < total % shards) for s in range(shards)]
    quota, out = list(room), []
    for at in sorted(counts):
        left, rank, j = counts[at], 0, bisect_left(places, at)
        while left:
            s = nodes[j % len(nodes)][1]
            if take := min(left, room[s]):
                out.append({"p_slice": at, "p_from": rank, "p_to": rank + take, "p_shard": s, "p_slot": quota[s] - room[s]})
                room[s], left, rank = room[s] - take, left - take, rank + take
            j += 1
    return out


def shard_rows(df: DataFrame, key: str, tie: list[str], shards: int = 24, vnodes: int = 64, slices: int = 4096) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in its shard) to every row.

    The ring has equal slices of the key's hash; a null key hashes like a constant. Only the rows per slice reach the driver (at
    most ``slices`` numbers), and the plan that comes back is as small, so that it is broadcast whatever the table's size. Rows
    rank in their slice by hash, key and the columns ``tie``, so equal rows get neighbouring slots; all rows of one key (null is one)
    share a slice, and a slice is sorted in one task. An empty table stays empty. Columns of the names shard and slot are replaced;
    all other names are free.
    """
    spark = df.sparkSession
    bits = slices.bit_length() - 1
    if 1 << bits != slices:
        raise ValueError("slices must be a power of two")
    names = [c for c in df.columns if c not in ("shard", "slot")]
    row = lambda name: F.col("row").getField(name)
    held = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.xxhash64(F.col(f"`{key}`")).alias("place"))
    held = held.withColumn("slice", F.shiftrightunsigned("place", 64 - bits).cast("int"))
    counts = {r[0]: r[1] for r in held.groupBy("slice").count().collect()}
    plan = json.dumps(bounded_plan(counts, shards, vnodes, slices))
    parts = spark.range(1).select(F.inline(F.from_json(F.lit(plan), "array<struct<p_slice int, p_from bigint, p_to bigint, p_shard int, p_slot bigint>>")))
    rank = F.row_number().over(Window.partitionBy("slice").orderBy("place", row(key), *map(row, tie))) - 1
    ranked = held.withColumn("rank", rank.cast("long"))
    on = (F.col("slice") == F.col("p_slice")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to"))
    return ranked.join(F.broadcast(parts), on).select("row.*", F.col("p_shard").alias("shard"), (F.col("p_slot") + F.col("rank") - F.col("p_from")).alias("slot"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law of rows. Null text: 0 bytes plus 8, the crc32 of nothing."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_rows(docs, "doc_id", ["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
