"""Exact top-k search by inner product: three phases with a uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch

#: Components of the queries that are broadcast at a time, at most about (8 bytes each); vectors and queries that meet in one product.
BLOCK_VALUES, ROWS, QUERIES = 1 << 22, 8192, 256


def valid(vector: Column) -> Column:
    """Not null, and no component is null or not finite."""
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))), F.lit(True))


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False) if column.num_chunks else np.zeros(0, np.int64)
    return flat.reshape(len(column), dim)


def _edges(dim: int, lists: int) -> list[int]:
    return [dim * j // lists for j in range(lists + 1)]


def _segment(vector: str, j: int, lists: int) -> Column:
    """Components j * dim / lists up to (j + 1) * dim / lists: what list j scores."""
    low, high = (F.floor(F.size(vector) * F.lit(i) / F.lit(lists)).cast("int") for i in (j, j + 1))
    return F.slice(vector, low + 1, high - low)


def _best(rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each row, ties to the smaller column."""
    order = np.lexsort((columns, -scores, rows))
    rank = np.arange(len(order)) - np.searchsorted(rows[order], rows[order], "left")
    return order[rank < k]


class Block:
    """Queries that are broadcast together: for each dimension their ids, one matrix for each list, and their cutoffs."""

    def __init__(self, table: pa.Table, lists: int, kind: type):
        self.lists, self.kind, self.ids, self.parts, self.cutoffs = lists, kind, {}, {}, {}
        dims = table["dim"].to_numpy()
        for dim in np.unique(dims).tolist():
            own = table.filter(pa.array(dims == dim)).sort_by("id")
            x = _matrix(own["x"], dim).astype(kind)
            self.ids[dim] = own["id"].to_numpy()
            self.parts[dim] = [np.ascontiguousarray(x[:, a:b]) for a, b in zip(_edges(dim, lists)[:-1], _edges(dim, lists)[1:], strict=True)]

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """(dim, ids, one matrix for each column behind id and dim) of runs of vectors of one dimension that a query has."""
        held, n = [], 0

        def cut() -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
            table = pa.Table.from_batches(held)
            dims = table["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                if dim in self.ids:
                    own = table if (dims == dim).all() else table.filter(pa.array(dims == dim))
                    yield dim, own["id"].to_numpy(), [_matrix(c, pc.list_value_length(c)[0].as_py()).astype(self.kind) for c in own.columns[2:]]

        for b in batches:
            held.append(b)
            n += len(b)
            if n >= ROWS:
                yield from cut()
                held, n = [], 0
        if n:
            yield from cut()


def _gather(shared, j: int, k: int):
    """Phase 1 at list j: its k largest entries for each query among the vectors of a task. The other lists' columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim, ids, (x,) in block.chunks(batches):
            q = block.ids[dim]
            if dim not in held:
                held[dim] = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
            score, who = held[dim]
            for at in range(0, len(q), QUERIES):
                own = slice(at, at + QUERIES)
                p = (block.parts[dim][j][own] @ x.T).astype(np.float64)
                p[q[own, None] == ids[None, :]] = -np.inf
                n = min(k, len(ids))
                c = np.argpartition(-p, n - 1, axis=1)[:, :n]
                both = np.concatenate((score[own], np.take_along_axis(p, c, 1)), axis=1)
                names = np.concatenate((who[own], ids[c]), axis=1)
                c = np.argpartition(-both, k - 1, axis=1)[:, :k]
                score[own], who[own] = np.take_along_axis(both, c, 1), np.take_along_axis(names, c, 1)
        for dim, (score, who) in held.items():
            r, c = np.nonzero(score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[dim][r]), pa.array(who[r, c]), pa.array(score[r, c])], ["query_id", "vec_id", "part"])

    return run


def _look_up(shared, pairs):
    """The whole scores of given (dim, query's place, vector): the parts of each list are summed for these alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for dim, ids, x in block.chunks(batches):
            place, who = pairs.value[dim]  # by vector
            low, high = np.searchsorted(who, ids, "left"), np.searchsorted(who, ids, "right")
            c = np.repeat(np.arange(len(ids)), high - low)
            if len(c):
                at = np.arange(len(c)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[c]
                score = sum(np.einsum("ij,ij->i", q[place[at]], part[c]) for q, part in zip(block.parts[dim], x, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(block.ids[dim][place[at]]), pa.array(score.astype(np.int64))], ["query_id", "score"])

    return run


def _send(shared, j: int, meter):
    """Phase 2 at list j, from its own column: the entries that reach cutoff / lists; a score at or above the cutoff has one in some list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for dim, ids, (x,) in block.chunks(batches):
            q, cutoff = block.ids[dim], block.cutoffs[dim]
            for at in range(0, len(q), QUERIES):
                own = slice(at, at + QUERIES)
                part = block.parts[dim][j][own] @ x.T
                r, c = np.nonzero((part * block.lists >= cutoff[own, None]) & (q[own, None] != ids[None, :]))
                if meter is not None:
                    meter[0].add(part.size)
                    meter[1].add(len(r))
                yield pa.RecordBatch.from_arrays([pa.array(q[at + r]), pa.array(ids[c]), pa.array(part[r, c].astype(np.int64)), pa.array(cutoff[at + r].astype(np.int64))], ["query_id", "vec_id", "part", "cutoff"])

    return run


def _resolve(shared, meter):
    """Phase 3 for pairs whose vectors have been joined: the whole scores, where they reach the cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for b in batches:
            dims, asks = b.column("dim").to_numpy(), b.column("query_id").to_numpy()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                place = np.searchsorted(block.ids[dim], asks[own])
                score = 0
                for j, q in enumerate(block.parts[dim]):
                    x = b.column(f"x{j}").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1).astype(block.kind)
                    score = score + np.einsum("ij,ij->i", q[place], x)
                keep = score >= block.cutoffs[dim][place]
                if meter is not None:
                    meter[2].add(len(own))
                yield pa.RecordBatch.from_arrays([pa.array(asks[own][keep]), b.column("vec_id").take(pa.array(own[keep])), pa.array(score[keep].astype(np.int64))], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, key: str, vector: str, k: int = 5, lists: int = 2, scale: int = 256, meter: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with all vectors but its own.

    Components become floor(scale * x) as long. Vectors that are null or hold null or non-finite components take no part, as
    query or candidate; vectors of different lengths aren't compared. Ties go to the smaller id. Rows of one id count once, with
    its smallest vector; null ids take no part. Fewer candidates than k: all of them; an empty table: no rows. Products that
    might leave a long raise ValueError.

    The components are dealt into ``lists`` segments, columns of their own; list j knows the partial scores of segment j. Queries
    go out in blocks of a bounded size, and each block's phases scan the vectors where they are: no vector is shuffled for a query.
    Phase 1: each list, which reads its column alone, gives its k largest entries for each query; as parts may be negative, sums
    of parts bound nothing from below, so the whole scores of these few are looked up, and the k-th best is the cutoff. Phase 2:
    the cutoff is broadcast, and each list, again from its column alone, sends its entries of at least cutoff / lists, which are summed by query and
    vector; a part that wasn't sent is below cutoff / lists, which bounds the score. Phase 3: sums of all parts are scores; of the others those whose
    bound reaches the cutoff are joined with their vectors and resolved exactly.
    Of equal vectors the k + 1 smallest ids are candidates; no other can be among the k best of any query, so many copies cost nothing.
    meter: three accumulators that get the numbers of entries, of entries sent, and of scores resolved.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    own = vectors.where(F.col(key).isNotNull() & valid(F.col(vector))).select(F.col(key).cast("bigint").alias("id"), quantised(F.col(vector), scale).alias("x"), is_query.alias("ask"))
    own = scratch.put(own.groupBy("id").agg(F.min("x").alias("x"), F.max("ask").alias("ask")).withColumn("dim", F.size("x")), "vectors")
    largest = F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))
    top, dim, values, asked = own.agg(F.coalesce(largest, F.lit(0)), F.coalesce(F.max("dim"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("ask"), F.col("dim") + 1)), F.lit(0)), F.count(F.when(F.col("ask"), 1))).first()
    reach = top * top * max(dim, 1) * lists
    if reach >= 2**62:
        raise ValueError("inner products might leave a long")
    kind = np.float64 if reach < 2**53 else np.int64  # doubles where they are exact
    rank = F.row_number().over(Window.partitionBy(F.xxhash64("x"), "x").orderBy("id"))
    names = [f"x{j}" for j in range(lists)]
    x = own.withColumn("rank", rank).where(F.col("rank") <= k + 1).select("id", "dim", *(_segment("x", j, lists).alias(n) for j, n in enumerate(names)))
    x = scratch.put(x, "lists")
    blocks = max(1, -(-int(values) // BLOCK_VALUES))
    out = None
    for b in range(blocks if asked else 0):
        asked_here = own.where("ask").where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)) == b).select("id", "dim", "x").toArrow()
        if not len(asked_here):
            continue
        block = Block(asked_here, lists, kind)
        shared = spark.sparkContext.broadcast(block)
        local = [x.select("id", "dim", n).mapInArrow(_gather(shared, j, k), "query_id bigint, vec_id bigint, part double").withColumn("list", F.lit(j)) for j, n in enumerate(names)]
        every = local[0]
        for more in local[1:]:
            every = every.unionByName(more)
        first = F.row_number().over(Window.partitionBy("query_id", "list").orderBy(F.desc("part"), "vec_id"))
        named = every.withColumn("n", first).where(F.col("n") <= k).select("query_id", "vec_id").distinct().toArrow()  # k * lists for a query at most
        pairs = {}
        for d, q in block.ids.items():
            at = np.searchsorted(q, named["query_id"].to_numpy())
            ours = np.flatnonzero(q[np.minimum(at, len(q) - 1)] == named["query_id"].to_numpy())
            who = named["vec_id"].to_numpy()[ours]
            order = np.argsort(who, kind="stable")
            pairs[d] = at[ours][order], who[order]
        whole = x.mapInArrow(_look_up(shared, spark.sparkContext.broadcast(pairs)), "query_id bigint, score bigint").toArrow()
        asks, scores = whole["query_id"].to_numpy(), whole["score"].to_numpy()
        order = np.lexsort((-scores, asks))
        asks, scores = asks[order], scores[order]
        for d, q in block.ids.items():
            last = np.searchsorted(asks, q) + k - 1
            full = last < np.searchsorted(asks, q, "right")
            block.cutoffs[d] = np.full(len(q), -int(top) * int(top) * max(dim, 1), kind)  # no score is below that
            block.cutoffs[d][full] = scores[last[full]]
        shared = spark.sparkContext.broadcast(block)
        form = "query_id bigint, vec_id bigint, part bigint, cutoff bigint"
        sent = None
        for j, n in enumerate(names):
            more = x.select("id", "dim", n).mapInArrow(_send(shared, j, meter), form)
            sent = more if sent is None else sent.unionByName(more)
        sums = sent.groupBy("query_id", "vec_id").agg(F.sum("part").alias("known"), F.count("*").alias("n"), F.first("cutoff").alias("cutoff"))
        may = F.col("known") * lists + (F.lit(lists) - F.col("n")) * F.col("cutoff") >= F.col("cutoff") * lists
        sums = scratch.put(sums.where(may), f"sums-{b}")
        whole = sums.where(F.col("n") == lists).select("query_id", "vec_id", F.col("known").alias("score"))
        rest = sums.where(F.col("n") < lists).select("query_id", "vec_id").join(x, F.col("vec_id") == F.col("id"))
        found = scratch.put(whole.unionByName(rest.mapInArrow(_resolve(shared, meter), "query_id bigint, vec_id bigint, score bigint")), f"found-{b}")
        scratch.drop(f"sums-{b}")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, F.pmod("vec_id", F.lit(50)) == 0, "vec_id", "embedding")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
