"""Centroid clustering by ball-tree filtering over trees that are local to a partition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch
from foliant.llm.topk import valid

#: Vectors of one tree, at most, and of a leaf whose vectors differ.
BLOCK, LEAF = 2048, 16

#: A block's row: ids, whole-number vectors in the tree's order, and the nodes, parents first.
FORM = "ids binary, nulls binary, vectors binary, nodes binary, sums binary, radius binary, rows int, top bigint"


def _far(x: np.ndarray) -> np.ndarray:
    """Projection on the line through a vector far from the mean and the one farthest from it."""
    a = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    b = x[((x - a) ** 2).sum(axis=1).argmax()]
    return x @ (b - a)


class BallTree:
    """Balls over runs of whole-number vectors: each node has its run, its children, the exact sum of its vectors and a radius about their mean.

    Runs are halved along the line between two far vectors until they have LEAF vectors or all are equal, so a group of copies is
    one ball of radius 0, whatever its size.
    """

    def __init__(self, vectors: np.ndarray, nodes: np.ndarray, sums: np.ndarray, radius: np.ndarray):
        self.vectors, self.nodes, self.sums, self.radius = vectors, nodes, sums, radius

    @classmethod
    def grow(cls, x: np.ndarray) -> tuple[BallTree, np.ndarray]:
        """The tree, and the places of its vectors in x."""
        order, wide = np.arange(len(x)), x.astype(np.float64)
        nodes, sums, radius, work = [], [], [], [(0, len(x), -1)]
        while work:
            a, b, parent = work.pop()
            own = order[a:b]
            total = x[own].sum(axis=0, dtype=np.int64)
            r = float(np.sqrt(((wide[own] - total / (b - a)) ** 2).sum(axis=1).max())) if (x[own] != x[own[0]]).any() else 0.0
            if parent >= 0:
                nodes[parent][2 if nodes[parent][2] < 0 else 3] = len(nodes)
            nodes.append([a, b, -1, -1])
            sums.append(total)
            radius.append(r)
            if r and b - a > LEAF:
                half = (b - a) // 2
                order[a:b] = own[np.argpartition(_far(wide[own]), half)]
                work += [(a, a + half, len(nodes) - 1), (a + half, b, len(nodes) - 1)]
        return cls(x[order], np.array(nodes, np.int32), np.array(sums), np.array(radius)), order

    def filter(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes whose ball is nearest to one centroid as a whole, that centroid, vectors of the leaves that no bound decides).

        By the triangle inequality a vector of a ball is between d - r and d + r from a centroid at d from its centre. A centroid whose
        d - r exceeds the least d + r is nearest to none of them and goes; children try those that are left. Bounds are in floating
        point with a margin far above its error, so a tie is never taken for a decision.
        """
        far = z.astype(np.float64)
        at, open_ = np.zeros(1, np.int64), np.zeros((1, len(z)), bool)
        open_[0, np.unique(z, axis=0, return_index=True)[1]] = True  # of equal centroids only the first takes any
        whole, who, rest = [], [], [np.zeros(0, np.int64)]
        while len(at):
            count = self.nodes[at, 1] - self.nodes[at, 0]
            centre = self.sums[at] / count[:, None]
            d = np.sqrt(((centre[:, None, :] - far[None, :, :]) ** 2).sum(axis=2))
            r = self.radius[at][:, None]
            low, high = d - r, np.where(open_, d + r, np.inf).min(axis=1, keepdims=True)
            open_ &= low <= high + (high + r) * 1e-9 + 1e-9
            one = open_.sum(axis=1) == 1
            whole.append(at[one])
            who.append(open_[one].argmax(axis=1))
            leaf = self.nodes[at, 2] < 0
            for k in at[~one & leaf].tolist():
                rest.append(np.arange(*self.nodes[k, :2]))
            inner = ~one & ~leaf
            at, open_ = self.nodes[at[inner], 2:].ravel().astype(np.int64), np.repeat(open_[inner], 2, axis=0)
        return np.concatenate(whole), np.concatenate(who), np.concatenate(rest)


def exact_distances(x: np.ndarray, z: np.ndarray, narrow: bool) -> np.ndarray:
    """Squared distances of whole-number vectors and centroids; narrow: doubles hold every sum of products exactly."""
    if narrow:
        a, b = x.astype(np.float64), z.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    x = x.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in z.astype(np.int64)], axis=1)


def _trees(scale: int, dim: int):
    """Blocks of a partition's vectors with their trees."""

    def block(ids: list[pa.Array], vectors: list[np.ndarray]) -> pa.RecordBatch:
        key = pa.chunked_array(ids).combine_chunks()
        x = np.floor(np.concatenate(vectors) * scale)
        top = float(np.abs(x).max())
        if top >= 2**62:
            raise ValueError("components might leave a long")
        x = x.astype(np.int64)
        tree, order = BallTree.grow(x)
        small = np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64
        arrays = (key.fill_null(0).to_numpy()[order], key.is_null().to_numpy(zero_copy_only=False)[order], tree.vectors.astype(small), tree.nodes, tree.sums, tree.radius)
        return pa.RecordBatch.from_arrays([*(pa.array([a.tobytes()], pa.binary()) for a in arrays), pa.array([len(x)], pa.int32()), pa.array([int(top)], pa.int64())], [f.split()[0] for f in FORM.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0
        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.slice(at, BLOCK)
                ids.append(part.column(0))
                held.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), dim))
                n += len(part)
                if n >= BLOCK:
                    yield block(ids, held)
                    ids, held, n = [], [], 0
        if n:
            yield block(ids, held)

    return run


def _read(b: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, BallTree]]:
    for ids, nulls, vectors, nodes, sums, radius, n, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
        kind = np.dtype(f"i{len(vectors) // (n * dim)}")
        tree = BallTree(np.frombuffer(vectors, kind).reshape(n, dim), np.frombuffer(nodes, np.int32).reshape(-1, 4), np.frombuffer(sums, np.int64).reshape(-1, dim), np.frombuffer(radius, np.float64))
        yield np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool), tree


def _sums(z: np.ndarray, narrow: bool):
    """A round in one task: the number and the sum of the vectors that each centroid takes, and how many came in whole balls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = z.shape
        total, count, balls = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for b in batches:
            for _, _, tree in _read(b, dim):
                node, who, rest = tree.filter(z)
                np.add.at(total, who, tree.sums[node])
                np.add.at(balls, who, tree.nodes[node, 1] - tree.nodes[node, 0])
                x = tree.vectors[rest]
                near = exact_distances(x, z, narrow).argmin(axis=1)
                np.add.at(total, near, x.astype(np.int64))
                count += np.bincount(near, minlength=k)
        some = np.flatnonzero(count + balls)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array((count + balls)[some]), pa.array(balls[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "balls", "total"])

    return run


def _nearest(z: np.ndarray, narrow: bool):
    """(id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = z.shape
        for b in batches:
            for ids, nulls, tree in _read(b, dim):
                node, who, rest = tree.filter(z)
                cluster, distance = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64)
                for i, c in zip(node.tolist(), who.tolist(), strict=True):
                    cluster[tree.nodes[i, 0] : tree.nodes[i, 1]] = c
                taken = np.ones(len(ids), bool)
                taken[rest] = False
                for c in range(k):
                    own = np.flatnonzero(taken & (cluster == c))
                    distance[own] = exact_distances(tree.vectors[own], z[c : c + 1], narrow)[:, 0]
                d = exact_distances(tree.vectors[rest], z, narrow)
                cluster[rest] = d.argmin(axis=1)
                distance[rest] = d.min(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    return run


class Clustering:
    """What ``cluster`` returns: rows (key, cluster, distance), the final centroids, and how many vectors of each round came in whole balls."""

    def __init__(self, rows: DataFrame, centroids: list[list[int]], whole: list[int]):
        self.rows, self.centroids, self.whole = rows, centroids, whole


def cluster(df: DataFrame, key: str, vector: str, seed: Column, k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64) -> Clustering:
    """Lloyd's rounds in whole numbers from the ``k`` vectors with the smallest ``seed``.

    Vectors of exactly ``dim`` components, none null or non-finite, take part; component x becomes floor(scale * x). A round assigns
    each vector to the nearest centroid (squared Euclidean distance, ties to the smaller number) and replaces each that took some by the
    componentwise floor of the exact mean; then all are assigned once more. Repeated rows count as often as they occur; rows of a null key take
    part; a null seed starts no centroid; equal seeds go by vector. Fewer vectors than k: as many centroids; none: no rows. Whatever might leave a
    long raises ValueError.

    The vectors are written once, in blocks with a ball tree each, where they lie: none is shuffled. A round reads the blocks, sends k sums a task, and
    only k rows reach the driver. Balls are taken whole where the triangle inequality allows it, else leaves are compared exactly.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "centroids")
    own = df.where(valid(F.col(vector)) & (F.size(vector) == dim)).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), seed.alias("seed"))
    first = own.where("seed is not null").orderBy("seed", "v").limit(k).select("v").collect()
    blocks = scratch.put(own.select("id", "v").mapInArrow(_trees(scale, dim), FORM), "blocks")
    top, n = blocks.agg(F.coalesce(F.max("top"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    reach = dim * (2 * (int(top) + 1)) ** 2
    if reach >= 2**63 or int(n) * (int(top) + 1) >= 2**63:
        raise ValueError("distances or sums might leave a long")
    z = np.array([np.floor(np.array(r.v) * scale) for r in first]).reshape(-1, dim).astype(np.int64)
    whole = []
    if not len(z):
        return Clustering(spark.createDataFrame([], f"`{key}` bigint, cluster int, distance bigint"), [], whole)
    narrow = reach < 2**53
    for _ in range(rounds):
        parts = blocks.mapInArrow(_sums(z, narrow), "cluster int, n bigint, balls bigint, total array<bigint>")
        taken = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("balls").alias("balls"), F.array(*(F.sum(F.col("total")[i]) for i in range(dim))).alias("total")).collect()
        for r in taken:
            z[r.cluster] = [t // r.n for t in r.total]
        whole.append(sum(r.balls for r in taken))
    rows = scratch.put(blocks.mapInArrow(_nearest(z, narrow), "id bigint, cluster int, distance bigint"), "rows")
    scratch.drop("blocks")
    return Clustering(rows.withColumnRenamed("id", key), z.tolist(), whole)


def with_inertia(found: Clustering) -> DataFrame:
    """The rows with the sums of the distances over their cluster and over all, and the SHA-256 of their centroid as decimal numbers.
    The sums are one row a centroid, so that they come back as literals. An inertia that leaves a long raises."""
    sums = {r.cluster: r.s for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    if sum(sums.values()) >= 2**63:
        raise ValueError("the inertia leaves a long")
    k = range(len(found.centroids))
    by = lambda values, kind: F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>")[F.col("cluster")]
    digest = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in found.centroids]
    return found.rows.withColumns({"cluster_inertia": by([sums.get(i, 0) for i in k], "bigint"), "inertia": F.lit(sum(sums.values())).cast("bigint"), "centroid_sha256": by(digest, "string")})


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors of 64 components, from the smallest hashes of ``3:<vec_id>``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    seed = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    return with_inertia(cluster(vectors, "vec_id", "embedding", seed))


_ROUND = """, c{i} AS MATERIALIZED (
  SELECT c, coalesce(m, z) AS z FROM c{h} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS m FROM (
      SELECT c, p, sum(x[p]) AS s, count(*) AS n FROM (SELECT c, x FROM (SELECT x, arg_min(c, (d, c)) AS c FROM (SELECT v.i, x, c, list_sum(list_transform(list_zip(x, z), lambda e: (e[1] - e[2]) * (e[1] - e[2]))) AS d FROM v, c{h}) GROUP BY i, x)), range(1, 65) AS r(p) GROUP BY c, p
    ) GROUP BY c
  ) USING (c)
)"""
OP13_SQL = (
    """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS INTEGER) AS c, x AS z FROM v WHERE vec_id IS NOT NULL QUALIFY c < 8
)"""
    + "".join(_ROUND.format(i=i, h=i - 1) for i in range(1, 11))
    + """, near AS MATERIALIZED (
  SELECT vec_id, min((d, c)) AS m FROM (SELECT i, vec_id, c, CAST(list_sum(list_transform(list_zip(x, z), lambda e: (e[1] - e[2]) * (e[1] - e[2]))) AS BIGINT) AS d FROM v, c10) GROUP BY i, vec_id
)
SELECT vec_id, near.m[2] AS cluster, near.m[1] AS distance, CAST(sum(near.m[1]) OVER (PARTITION BY near.m[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(near.m[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
FROM near JOIN c10 ON near.m[2] = c10.c
"""
)
