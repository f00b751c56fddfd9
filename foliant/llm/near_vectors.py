"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 points, neighbouring cells probed, cosines verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.hashing import U, mix
from foliant.llm.scratch import Scratch, components
from foliant.llm.topk import _matrix, valid

#: Members of a cell that meet in one task, at most about; larger cells are cut into blocks that meet in pairs.
CELL_ROWS = 2048
#: Neighbouring cells that are probed in each table, and the share of pairs at the least cosine that the tables have to find.
PROBES, RECALL = 4, 0.985
#: Sizes of cells, from coarse to fine: lattices whose points make a cell, cells to the unit; and, measured in 64 dimensions with four
#: probes, the share of pairs at a cosine of 0.9 that one table finds and the share of pairs of random vectors whose homes are one cell.
CELLS = ((2, 3.5, 0.40, 1.5e-4), (2, 4.0, 0.29, 1.5e-5), (2, 4.5, 0.20, 2.6e-6), (3, 4.0, 0.09, 5.8e-8), (3, 4.5, 0.048, 4.2e-9), (3, 5.0, 0.025, 4.8e-10))
#: Random vectors that a vector may meet in all tables, about; and key rows of a vector that go out in one round, and of all vectors.
MEETINGS, ROUND_KEYS, ROUND_ROWS = 1000, 15, 4_000_000
#: A pair at the least cosine differs in more bits of its sketches once in ten million times.
SKETCH_BITS, DEVIATIONS = 128, 5.2


def settings_for(rows: int) -> tuple[int, int, float, int]:
    """(tables, probes, scale, lattices) for so many vectors: the coarsest cells in which a vector meets few random ones, and as many
    tables as keep the recall at RECALL. Finer cells have more tables, so a pair's chance is the same at every size."""
    for lattices, scale, found, same in CELLS:
        tables = int(np.ceil(np.log(1 - RECALL) / np.log(1 - found)))
        if rows * same * (1 + 2 * PROBES) * tables <= MEETINGS:
            break
    return tables, PROBES, scale, lattices


@cache
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all entries +-1/2 with an even number of minus signs."""
    out = []
    for (i, j), (a, b) in product(combinations(range(8), 2), product((-1, 1), repeat=2)):
        v = np.zeros(8)
        v[i], v[j] = a, b
        out.append(v)
    out += [np.array(s) / 2 for s in product((-1, 1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    r = np.rint(x)
    gap = x - r
    worst = np.abs(gap).argmax(axis=1)
    rows = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    w = worst[rows]
    r[rows, w] += np.where(gap[rows, w] >= 0, 1, -1)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of D8 and D8 + 1/2."""
    a, b = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    far = ((x - a) ** 2).sum(axis=1) > ((x - b) ** 2).sum(axis=1)
    return np.where(far[:, None], b, a)


@cache
def projection(dim: int, table: int, lattices: int) -> np.ndarray:
    """Orthonormal directions for one table, times sqrt(dim): lattices * 8 of them, in several bases where dim is smaller."""
    rng = np.random.Generator(np.random.PCG64([dim, table, 77]))
    out, need = [], 8 * lattices
    while need > 0:
        q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q[:, : min(need, dim)])
        need -= out[-1].shape[1]
    return np.concatenate(out, axis=1) * np.sqrt(dim)


def _hash(points: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit key of lattice points (doubled, so that they are integers)."""
    h = np.full(len(points), seed, np.uint64)
    for column in np.rint(points * 2).astype(np.int64).T:
        h = mix(h ^ column.view(np.uint64) * U(0x9E3779B97F4A7C15))
    return h.view(np.int64)


def cell_keys(unit: np.ndarray, tables: int | range, probes: int, scale: float, lattices: int) -> np.ndarray:
    """Keys [vector, table, 1 + probes] of unit vectors: the own cell, then the neighbouring cells nearest to the vector.

    A cell is a tuple of E8 points, one for each group of eight directions. A neighbour differs from it by a shortest lattice
    vector in one of them; those come first on which the vector's residual projects furthest. Vectors and directions are rounded
    to whole numbers whose products are exact in doubles, so a vector's keys are the same to the bit whatever it is computed with.
    """
    n, dim = unit.shape
    tables = range(tables) if isinstance(tables, int) else tables
    out = np.empty((n, len(tables), 1 + probes), np.int64)
    short, whole = minimal_vectors(), np.rint(unit * 2.0**22)
    for at, t in enumerate(tables):
        y = whole @ np.rint(projection(dim, t, lattices) * (scale / 8 * 2.0**20)) * 2.0**-42
        point = np.concatenate([decode_e8(y[:, 8 * g : 8 * g + 8]) for g in range(lattices)], axis=1)
        out[:, at, 0] = _hash(point, 1000 + t)
        if probes:
            lean = np.concatenate([(y - point)[:, 8 * g : 8 * g + 8] @ short.T for g in range(lattices)], axis=1)
            first = np.argpartition(-lean, probes - 1, axis=1)[:, :probes]
            for p in range(probes):
                g, m = np.divmod(first[:, p], len(short))
                near = point.reshape(n, lattices, 8).copy()
                near[np.arange(n), g] += short[m]
                out[:, at, 1 + p] = _hash(near.reshape(n, -1), 1000 + t)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sketches(unit: np.ndarray) -> np.ndarray:
    """SKETCH_BITS signs of random projections of each unit vector, as two longs."""
    rng = np.random.Generator(np.random.PCG64([unit.shape[1], 99]))
    return np.packbits(unit @ rng.standard_normal((unit.shape[1], SKETCH_BITS)) > 0, axis=1).view(np.int64)


def most_bits(least: float) -> int:
    """So many bits of two sketches may differ where the cosine is ``least`` or more."""
    p = np.arccos(least) / np.pi
    return int(np.ceil(SKETCH_BITS * p + DEVIATIONS * np.sqrt(SKETCH_BITS * p * (1 - p))))


def _keys(settings: tuple, tables: range):
    """The keys of the given tables: (key, tab, probe, id, s0, s1), one row for each."""
    _, probes, scale, lattices = settings

    def run(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                part = b.take(pa.array(own))
                unit = _unit(_matrix(pa.chunked_array([part.column(1)]), int(dim)))
                keys = cell_keys(unit, tables, probes, scale, lattices)
                n, each = len(own), len(tables) * (1 + probes)
                who = np.repeat(np.arange(n), each)
                table = np.tile(np.repeat(np.array(tables, dtype=np.int32), 1 + probes), n)
                probe = np.tile(np.arange(1 + probes) > 0, n * len(tables))
                key = mix(keys.reshape(-1).view(np.uint64) + U(int(dim))).view(np.int64)
                short = sketches(unit)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(table), pa.array(probe), part.column(0).take(pa.array(who)), pa.array(short[who, 0]), pa.array(short[who, 1])], ["key", "tab", "probe", "id", "s0", "s1"])

    return run


def _pairs_of(size: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of members of cells of at most 64 members that begin at the given places; cells of one size together."""
    for n in np.unique(size[(size > 1) & (size <= 64)]).tolist():
        i, j = np.triu_indices(n, 1)
        every = start[size == n]
        step = max(1, 100_000 // len(i))
        for low in range(0, len(every), step):
            at = every[low : low + step, None]
            yield (at + i).ravel(), (at + j).ravel()


def _sketched(most: int):
    """Of the cells of a group: the members whose sketch is near that of another one."""

    def run(table: pa.Table) -> pa.Table:
        key = table["key"].to_numpy()
        order = np.argsort(key, kind="stable")
        table, key = table.take(pa.array(order)), key[order]
        probe, ids = table["probe"].to_numpy(), table["id"].to_numpy()
        s0, s1 = (table[c].to_numpy().view(np.uint64) for c in ("s0", "s1"))  # bits of negative numbers count otherwise
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        start, size = cuts[:-1], np.diff(cuts)
        keep = np.zeros(len(key), bool)

        def mark(a: np.ndarray, b: np.ndarray) -> None:
            near = np.bitwise_count(s0[a] ^ s0[b]).astype(np.int16) + np.bitwise_count(s1[a] ^ s1[b]) <= most
            near &= ~(probe[a] & probe[b]) & (ids[a] != ids[b])
            keep[a[near]] = True
            keep[b[near]] = True

        for a, b in _pairs_of(size, start):
            mark(a, b)
        for at, n in zip(start[size > 64].tolist(), size[size > 64].tolist(), strict=True):
            for low in range(at, at + n, 256):
                a, b = np.meshgrid(np.arange(low, min(low + 256, at + n)), np.arange(at, at + n), indexing="ij")
                mark(a.ravel(), b.ravel())
        return table.select(["key", "tab", "probe", "id"]).filter(pa.array(keep))

    return run


def _first_event(ka: np.ndarray, kb: np.ndarray) -> np.ndarray:
    """The first of the events in which a pair meets: table by table, both at home, then a probes b's home, then b probes a's."""
    home = ka[:, :, 0] == kb[:, :, 0]
    ab = (ka[:, :, 1:] == kb[:, :, :1]).any(axis=2)
    ba = (kb[:, :, 1:] == ka[:, :, :1]).any(axis=2)
    events = np.stack([home, ab, ba], axis=2).reshape(len(ka), -1)
    return events.argmax(axis=1)


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        now = root.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _verify(settings: tuple, least: float):
    """Links among the members of each cell of a group. A row: vector, its links that meet here first, the smallest id it reaches here.

    A pair may meet in several tables; it is counted at its first event only, which both vectors tell.
    """

    def run(table: pa.Table) -> pa.Table:
        key, part = table["key"].to_numpy(), table["pair"].to_numpy()
        order = np.lexsort((table["id"].to_numpy(), part, key))
        table = table.take(pa.array(order))
        dims = table["dim"].to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        for dim in np.unique(dims):
            own = table.filter(pa.array(dims == dim))
            for column, x in zip(out, _links(own, int(dim), settings, least), strict=True):
                column.append(x)
        return pa.table({n: pa.array(np.concatenate(x) if x else [], pa.int64()) for n, x in zip(("id", "n", "root"), out, strict=True)})

    return run


def _links(table: pa.Table, dim: int, settings: tuple, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of cells in order, with their members by id: ids that have links, the links that meet here first, and the smallest id reached."""
    key, part, ids, tab, probe, side = (table[c].to_numpy() for c in ("key", "pair", "id", "tab", "probe", "side"))
    unit = _unit(_matrix(table["x"], dim))
    cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]), [True])))
    start, size = cuts[:-1], np.diff(cuts)
    across = np.maximum.reduceat(side, start) > 0 if len(start) else np.zeros(0, bool)
    cell = np.repeat(np.arange(len(start)), size)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ~(probe[a] & probe[b]) & (ids[a] != ids[b]) & (~across[cell[a]] | (side[a] != side[b]))

    for a, b in _pairs_of(size, start):
        fit = fits(a, b)
        a, b = a[fit], b[fit]
        close = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
        found.append((a[close], b[close]))
    for at, n in zip(start[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        for low in range(at, at + n, 512):
            a, b = np.nonzero(unit[low : min(low + 512, at + n)] @ unit[at : at + n].T >= least)
            a, b = a + low, b + at
            up = a < b
            a, b = a[up], b[up]
            fit = fits(a, b)
            found.append((a[fit], b[fit]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    if not len(a):
        return (np.zeros(0, np.int64),) * 3
    # one place for each id that is linked here; the smaller id of a pair is a
    linked, place = np.unique(ids[np.concatenate((a, b))], return_inverse=True)
    row = np.zeros(len(linked), np.int64)
    row[place] = np.concatenate((a, b))
    keys, x, y = cell_keys(unit[row], *settings), place[: len(a)], place[len(a) :]
    event, count = 3 * tab[a] + np.where(probe[a], 1, np.where(probe[b], 2, 0)), np.zeros(len(linked), np.int64)
    for low in range(0, len(a), 50_000):
        part_of = slice(low, low + 50_000)
        first = _first_event(keys[x[part_of]], keys[y[part_of]]) == event[part_of]
        np.add.at(count, x[part_of][first], 1)
        np.add.at(count, y[part_of][first], 1)
    return linked, count, linked[_local_roots(len(linked), x, y)]


def near_duplicates(df: DataFrame, key: str, vector: str, least: float = 0.9, settings: tuple[int, int, float, int] | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) for each id: the vectors linked directly, the smallest id reached, and whether that is its own.

    Links are pairs with a cosine (in doubles) of at least ``least`` that share a cell, or of which one's home is a neighbouring
    cell that the other probes, in one of the tables; none below it is linked. Vectors that are null, zero or hold null or
    non-finite components, and vectors of different lengths, aren't linked. Rows of one id count once, with the smallest vector;
    null ids are left out; an empty table has no rows. settings: (tables, probes, scale, lattices); by default settings_for() the
    number of vectors, at every size with the same recall.

    The tables go out in rounds of some key rows a vector. A key row has the vector's sketch; in cells of at most about CELL_ROWS
    members those rows go on that have a sketch near another's, and vectors are fetched for them alone. Larger cells are cut into
    blocks, and all pairs of blocks are compared, so that no task holds a whole hot cell. Pairs are counted at their first meeting
    in all tables and never written out.
    """
    scratch = Scratch(df.sparkSession, "near-vectors")
    every = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("x")).groupBy("id").agg(F.min("x").alias("x"))
    sound = every.where(valid(F.col("x")) & (F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) > 0)).select("id", "x", F.size("x").alias("dim"))
    sound = scratch.put(sound, "vectors")
    n = sound.count()
    settings = settings_for(n) if settings is None else settings
    tables, each = settings[0], 1 + settings[1]
    step = max(1, max(ROUND_ROWS // max(n, 1), ROUND_KEYS) // each)
    found = None
    for low in range(0, tables, step):
        links = _round(scratch, sound, settings, range(low, min(low + step, tables)), least)
        found = links if found is None else found.unionByName(links)
    links = scratch.put(found.groupBy("id").agg(F.sum("n").alias("n_links")), "links")
    groups_of = components(scratch, found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    out = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id")).distinct().join(links, "id", "left").join(groups_of.withColumnRenamed("node", "id"), "id", "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key) == F.col("component_id"))


def _round(scratch: Scratch, sound: DataFrame, settings: tuple, tables: range, least: float) -> DataFrame:
    """(id, n, root) of the links that are met in the cells of some tables."""
    at = tables.start
    rows = scratch.put(sound.mapInArrow(_keys(settings, tables), "key bigint, tab int, probe boolean, id bigint, s0 bigint, s1 bigint"), f"keys-{at}")
    # a cell without a second member, or with probes alone, can't link anything
    sizes = scratch.put(rows.groupBy("key").agg(F.count("*").alias("rows"), F.count(F.when(~F.col("probe"), 1)).alias("homes")).where("rows > 1 and homes > 0").select("key", "rows"), f"sizes-{at}")
    total, most = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    met = rows.join(sizes, "key")
    groups = max(64, int(total) // 50_000)
    small = met.where(F.col("rows") <= CELL_ROWS).select("key", "tab", "probe", "id", "s0", "s1", F.pmod(F.xxhash64("key"), F.lit(groups)).alias("g"))
    live = small.groupBy("g").applyInArrow(_sketched(most_bits(least)), "key bigint, tab int, probe boolean, id bigint").withColumn("blocks", F.lit(1))
    if most > CELL_ROWS:
        live = live.unionByName(met.where(F.col("rows") > CELL_ROWS).select("key", "tab", "probe", "id", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("blocks")))
    live = scratch.put(live, f"live-{at}")
    scratch.drop(f"keys-{at}", f"sizes-{at}")
    block = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")
    # block i meets block j once, in the pair (low, high)
    met = live.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    met = met.withColumn("pair", (low * F.col("blocks") + high).cast("int")).withColumn("side", F.when(F.col("block") > F.col("other"), 1).otherwise(0))
    groups = max(256, int(live.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]) // 20_000)
    met = met.join(sound, "id").select("key", "tab", "probe", "id", "x", "dim", "pair", "side", F.pmod(F.xxhash64("key", "pair"), F.lit(groups)).alias("g"))
    found = scratch.put(met.groupBy("g").applyInArrow(_verify(settings, least), "id bigint, n bigint, root bigint"), f"found-{at}")
    scratch.drop(f"live-{at}")
    return found


def op5_near_vectors(spark, sf_dir: str) -> DataFrame:
    """All embeddings, whatever their labels."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id", "embedding")
