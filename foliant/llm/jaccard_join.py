"""Jaccard join of documents on word shingles by signature trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.hashing import U, Words, distinct, mix, text_slices
from foliant.llm.packed import pack_arrays, runs_of, unpack_arrays
from foliant.llm.scratch import Scratch, components
from foliant.llm.substring_dedup import origin_of

#: Bits of a signature, children of a tree's node, members of a block that meet in one task at most.
BITS, FAN, BLOCK = 4096, 8, 1024
#: A prefix is longer than one shared shingle needs, by one in SPARE of its set.
SPARE = 4
#: Sets in one row of a list, at most; longer lists have several rows.
ROW = 1 << 16
#: Bytes of text that a bucket of shingles stands for, about; buckets at least.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 64
#: Bytes of sets that a group of blocks gets, about.
GROUP_BYTES = 8 << 20
#: Documents of the sample that names the frequent shingles, about, and how many of its texts make one frequent.
SAMPLE, FREQUENT = 20_000, 3


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text. Fewer words than a shingle has: all of them as one; none: empty."""
    whole = words.windows(size)
    for n, first in zip(words.count.tolist(), words.first.tolist(), strict=False):
        if n >= size:
            yield distinct(whole[first : first + n - size + 1])
        elif n:
            # a base of its own for each length, so that a short text never equals a shingle
            h = words.hash[first : first + n]
            yield mix(np.array([np.bitwise_xor.reduce(mix(h * U(2) + np.arange(n, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(n)))], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    """A fingerprint of the whole set, so that equal sets have one id."""
    return int(mix(np.array([mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + U(len(s))], np.uint64)).view(np.int64)[0])


class Similarity:
    """100 * intersection >= percent * union, and what follows from it."""

    def __init__(self, percent: int):
        self.percent = percent

    def least(self, a, b):
        """The smallest intersection that links sets of a and b members."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def prefix(self, n: int) -> int:
        """So many first members, in any common order, of which at least 1 + n // SPARE are in a linked set."""
        return n - -(-self.percent * n // 100) + 1 + n // SPARE if n else 0

    def shared(self, n):
        """So many of the first members of a set of n, at least, are also among those of any set that it is linked with: 1 + m // SPARE
        for the smallest such set's size m."""
        return -(-self.percent * n // 100) // SPARE + 1


def signatures(sets: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """A bitmap of each set: a member sets the bit of its lowest digits."""
    out = np.zeros((len(sets), bits), np.uint8)
    if sets:
        out[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), (np.concatenate(sets) & U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


class SignatureTree:
    """Nodes over blocks of FAN neighbours hold the OR of their members' bitmaps, the range of their sizes, the largest excess (members
    that share a bit with another), and the ranges of their members' components and sides.

    Two members of nodes A and B share at most popcount(A & B) + min(excess A, excess B) shingles, and no more than the smaller has.
    """

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, side: np.ndarray | None = None):
        excess = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        side = np.zeros(len(sizes), np.int64) if side is None else side
        self.across = side.max(initial=0) > 0
        self.levels = [(maps, sizes, sizes, excess, side, side)]
        while len(self.levels[-1][0]) > 1:
            m, low, high, e, s0, s1 = self.levels[-1]
            at = np.arange(0, len(m), FAN)
            self.levels.append((np.bitwise_or.reduceat(m, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(e, at), np.minimum.reduceat(s0, at), np.maximum.reduceat(s1, at)))
        self.regroup(np.arange(len(sizes)))

    def regroup(self, group: np.ndarray) -> None:
        """The components of the members, as far as they are known now."""
        self.groups = [(group, group)]
        for level in self.levels[:-1]:
            at = np.arange(0, len(level[0]), FAN)
            low, high = self.groups[-1]
            self.groups.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def _live(self, level: int, a: np.ndarray, b: np.ndarray, similar: Similarity) -> np.ndarray:
        maps, low, high, excess, s0, s1 = self.levels[level]
        g0, g1 = self.groups[level]
        live = np.minimum(high[a], high[b]) * 100 >= similar.percent * np.maximum(low[a], low[b])
        # all members of both already in one component, or on one side: nothing to find
        live &= ~((g0[a] == g1[a]) & (g0[b] == g1[b]) & (g0[a] == g0[b]))
        if self.across:
            live &= ~((s0[a] == s1[a]) & (s0[b] == s1[b]) & (s0[a] == s0[b]))
        at = np.flatnonzero(live)
        for k in range(0, len(at), 8192):
            i = at[k : k + 8192]
            common = np.bitwise_count(maps[a[i]] & maps[b[i]]).sum(axis=1, dtype=np.int64) + np.minimum(excess[a[i]], excess[b[i]])
            common = np.minimum(common, np.minimum(high[a[i]], high[b[i]]))
            live[i] = common >= similar.least(low[a[i]], low[b[i]])
        return live

    def pairs(self, similar: Similarity) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members that no node rules out, by dual traversal from the root. A node meets itself before its neighbours, and
        the work list goes depth first in chunks, so that what is united between two chunks rules out later ones."""
        top = len(self.levels) - 1
        work = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        steps = np.arange(FAN)
        while work:
            level, a, b = work.pop()
            live = self._live(level, a, b, similar) if level or top else np.ones(len(a), bool)
            a, b = a[live], b[live]
            if not level:
                if len(a):
                    yield a, b
                continue
            n = len(self.levels[level - 1][0])
            for k in range(0, len(a), 256):
                x = (a[k : k + 256, None, None] * FAN + steps[None, :, None] + np.zeros((1, 1, FAN), np.int64)).ravel()
                y = (b[k : k + 256, None, None] * FAN + steps[None, None, :] + np.zeros((1, FAN, 1), np.int64)).ravel()
                fit = (x < n) & (y < n) & ((x < y) if level == 1 else (x <= y))
                for part in (fit & (x != y), fit & (x == y)):
                    if part.any():
                        work.append((level - 1, x[part], y[part]))


def _find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def join_block(sets: list[np.ndarray], similar: Similarity, side: np.ndarray) -> np.ndarray:
    """The component of each set of a block, as the place of one member.

    The signature tree's dual traversal names the pairs that its bounds can't rule out; those whose sets aren't in one component yet are
    verified on the sets. As components grow, the nodes learn of them, and pairs of nodes that are one component are left out.
    side: where it has two values, only pairs across are tried.
    """
    n = len(sets)
    root = list(range(n))
    # sizes in classes of 4 : 3, and likes together within each (by their smallest shingles), keep the bounds of a node tight
    sizes = np.array([len(s) for s in sets])
    heads = np.array([np.resize(s, 4) if len(s) else np.zeros(4, np.uint64) for s in sets], np.uint64).reshape(n, 4)
    order = np.lexsort((*heads.T[::-1], np.floor(np.log(np.maximum(sizes, 1)) / np.log(4 / 3))))
    tree = SignatureTree(signatures([sets[i] for i in order]), sizes[order], side[order])
    united = known = 0
    for a, b in tree.pairs(similar):
        for x, y in zip(order[a].tolist(), order[b].tolist(), strict=True):
            if tree.across and side[x] == side[y]:
                continue
            i, j = _find(root, x), _find(root, y)
            if i != j and min(sizes[x], sizes[y]) * 100 >= similar.percent * max(sizes[x], sizes[y]) and overlap(sets[x], sets[y]) >= similar.least(sizes[x], sizes[y]):
                root[max(i, j)] = min(i, j)
                united += 1
        if united > known + n // 64:
            known = united
            tree.regroup(np.array([_find(root, i) for i in order]))
    return np.array([_find(root, i) for i in range(n)])


class Shingles:
    """The passes over the texts and the buckets, as functions on Arrow data."""

    def __init__(self, size: int, similar: Similarity, buckets: int):
        self.size, self.similar = size, similar
        self.bits = buckets.bit_length() - 1
        self.buckets = 1 << self.bits

    def _sets(self, b: pa.RecordBatch) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        for at, end, data, offsets in text_slices(b.column(1)):
            yield at, end, list(shingle_sets(Words(data, offsets, lower=True), self.size))

    def sampled(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles of a sample's texts that can stand in a prefix (the lower two fifths of all fingerprints), equal sets once."""
        seen: set[int] = set()
        for b in batches:
            for _, _, sets in self._sets(b):
                found = [np.zeros(0, np.uint64)]
                for s in sets:
                    if (k := set_id(s)) not in seen:
                        seen.add(k)
                        found.append(s[: np.searchsorted(s, U(2**64 * 2 // 5))])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["token"])

    def prefixes(self, frequent):
        """For each document its number of shingles and its set's id (bucket -1), with the hash of its text; for each bucket the prefix shingles of the sets.

        Frequent shingles come last in the order, so that they stand in few prefixes. Equal sets of one task go once.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hot, seen = frequent.value, set()
            for b in batches:
                ids, origins = b.column(0).to_numpy(), b.column(2).to_numpy()
                for at, end, sets in self._sets(b):
                    sids = [set_id(s) if len(s) else None for s in sets]
                    n = end - at
                    yield pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int32()), pa.array(ids[at:end]), pa.array([len(s) for s in sets], pa.int64()), pa.array(sids, pa.int64()), pa.array(origins[at:end]), pa.array([None] * n, pa.binary())], ["bucket", "id", "n", "sid", "origin", "payload"])
                    tokens, owners = [], []
                    for s, k in zip(sets, sids, strict=True):
                        if k is None or k in seen:
                            continue
                        seen.add(k)
                        p = self.similar.prefix(len(s))
                        if len(hot):
                            place = np.searchsorted(hot, s)
                            place[place == len(hot)] = 0
                            often = hot[place] == s
                            s = np.concatenate((s[~often], s[often]))
                        tokens.append(s[:p])
                        owners.append(np.full(p, k, np.int64))
                    if not tokens:
                        continue
                    t, o = np.concatenate(tokens), np.concatenate(owners)
                    # the order above is by the highest digits; buckets and marks come from other digits
                    m = mix(t)
                    bucket = (m >> U(64 - self.bits)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    bucket, mark, o = bucket[order], (m[order] << U(self.bits) >> U(32)).astype("<u4"), o[order]
                    keys, blobs = [], []
                    for k, part in runs_of(bucket, self.buckets):
                        own = o[part]
                        cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                        keys.append(k)
                        blobs.append(pack_arrays(own[cut], np.diff(np.append(cut, len(own))).astype("<u4"), mark[part]))
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array([None] * n, pa.int64()) for _ in range(4)), pa.array(blobs, pa.binary())], ["bucket", "id", "n", "sid", "origin", "payload"])

        return run

    def blocks(self, table: pa.Table) -> pa.Table:
        """Of one bucket: the lists of sets that share a prefix shingle, equal lists once with the number of their shingles.
        """
        parts = [unpack_arrays(x, "<i8", "<u4", "<u4") for x in table["payload"].to_pylist()]
        sids = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        marks = np.concatenate([p[2] for p in parts])
        order = np.lexsort((sids, marks))
        sids, marks = sids[order], marks[order]
        once = np.concatenate(([True], (marks[1:] != marks[:-1]) | (sids[1:] != sids[:-1])))
        sids, marks = sids[once], marks[once]
        start = np.flatnonzero(np.concatenate(([True], marks[1:] != marks[:-1])))
        size = np.diff(np.append(start, len(marks)))
        name = np.add.reduceat(mix(sids.view(np.uint64)), start) + size.astype(np.uint64)
        many = np.flatnonzero(size > 1)
        _, first, times = np.unique(name[many], return_index=True, return_counts=True)
        keep = many[first]
        out: list[list] = [[], [], [], []]
        for k, n in zip(keep.tolist(), times.tolist(), strict=True):
            for part in range(0, int(size[k]), ROW):
                own = sids[start[k] + part : start[k] + min(part + ROW, int(size[k]))]
                for column, x in zip(out, (int(name[k : k + 1].view(np.int64)[0]), part, n, own.tobytes()), strict=True):
                    column.append(x)
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("list", "part", "shared", "sids"), out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)})

    def sets(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(sid, places, members) of documents that come with their set's id and its clusters."""
        for b in batches:
            for at, end, sets in self._sets(b):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), b.column(2).slice(at, end - at), pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "places", "members"])

    def members(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(list, shared, sid) of lists."""
        for b in batches:
            sids = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(sids)), [len(x) for x in sids]))
            if len(at):
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(sids))], ["list", "shared", "sid"])

    def join(self, table: pa.Table) -> pa.Table:
        """Of the blocks of one group: each set that is linked with others there, and one of its component."""
        block = table["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        sids, side, sets = table["sid"].to_numpy()[order], table["side"].to_numpy()[order], table["members"].take(pa.array(order)).to_pylist()
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(block[order]) != 0, [True])))
        none = np.zeros(0, np.int64)
        a, b = [none], [none]
        for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if end - at > 1:
                first = join_block([np.frombuffer(x, np.uint64) for x in sets[at:end]], self.similar, side[at:end])
                linked = np.flatnonzero(first != np.arange(end - at))
                a.append(sids[at + linked])
                b.append(sids[at + first[linked]])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})


def jaccard_components(df: DataFrame, key: str, text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id, origin, first): distinct shingles of ``size`` words, and the smallest key reachable by links, for every row.

    A-Z are lower-cased; words are runs of characters other than ASCII white space. Fewer words than a shingle: the whole sequence
    is the one shingle; null text or none: the set is empty and linked with nothing. Two texts link when 100 * intersection >=
    percent * union. Keys are whole numbers; rows of one key are in one component only if linked, and origin (a hash of the text) tells them
    apart; null keys are left out; an empty table has no rows. first: the row has the smallest key and then origin of its component, as equal rows
    all have. Fingerprints have 64 bits.

    Linked sets share one of the first shingles of each, in any common order, and so are in one of the lists of sets by
    shingle. The first shingles are some more than one shared one needs, so that linked sets share
    many, and sets that share fewer with all others are left out. Equal sets count as one.
    A set follows the one that is first in most of its lists (by shingles); a list is in the cluster of the set that most of its members
    follow, and a cluster has all members of its lists. So near copies are in one cluster mostly, linked sets always
    share one, and clusters don't chain. A cluster is dealt into pieces of about ``BLOCK`` sets, and
    every pair of pieces (and every piece with itself) is a block, in which trees name the pairs that their bounds can't rule
    out, and these are verified on the sets at once. No task holds more than two pieces of a cluster at a time, and a block writes no more than a forest of its links. The sample of
    about ``SAMPLE`` documents only orders the shingles; it decides no result.
    """
    spark = df.sparkSession
    scratch, similar = Scratch(spark, "jaccard-join"), Similarity(percent)
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), origin_of(F.col(text)).alias("origin"))
    rows, volume = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    work = Shingles(size, similar, 1 << max(LEAST_BUCKETS.bit_length() - 1, (int(volume) // BUCKET_BYTES).bit_length()))

    share = min(1.0, SAMPLE / max(rows, 1))
    sample = docs.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000))
    often = sample.select("id", "text").mapInArrow(work.sampled, "token bigint").groupBy("token").count().where(F.col("count") >= FREQUENT).select("token").toPandas()["token"].to_numpy(np.int64)
    frequent = spark.sparkContext.broadcast(np.sort(often.view(np.uint64)))
    one = scratch.put(docs.select("id", "text", "origin").mapInArrow(work.prefixes(frequent), "bucket int, id bigint, n bigint, sid bigint, origin bigint, payload binary"), "prefixes")
    classes = scratch.put(one.where("bucket = -1").select("id", "n", "sid", "origin"), "classes")
    lists = one.where("bucket >= 0").select("bucket", "payload").groupBy("bucket").applyInArrow(lambda t: work.blocks(t), "list bigint, part bigint, shared bigint, sids binary")
    lists = lists.groupBy("list", "part").agg(F.sum("shared").alias("shared"), F.first("sids").alias("sids")).select("list", "shared", "sids")
    member = scratch.put(lists.mapInArrow(work.members, "list bigint, shared bigint, sid bigint"), "met")
    scratch.drop("prefixes")

    # sets that share too few of their first shingles with any other have no link
    firsts = classes.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min(F.struct("id", "origin")).alias("row"), F.min("n").alias("n"))
    shares = member.groupBy("sid").agg(F.sum("shared").alias("shared"))
    active = scratch.put(firsts.join(shares, "sid").where(F.col("shared") >= F.floor(F.ceil(F.lit(percent) * F.col("n") / 100) / SPARE) + 1).select("sid", "row.*"), "active")
    member = scratch.put(member.join(active.select("sid"), "sid").select("list", "shared", "sid"), "members")
    scratch.drop("met")
    first = scratch.put(member.groupBy("list").agg(F.min("sid").alias("first"), F.count("*").alias("size")).where("size > 1").select("list", "first"), "first")
    follows = member.join(first, "list").groupBy("sid", "first").agg(F.sum("shared").alias("shared")).groupBy("sid").agg(F.max(F.struct("shared", "first")).alias("m"))
    leader = follows.select("sid", F.col("m.first").alias("leader"))
    votes = member.join(first.select("list"), "list").join(leader, "sid").groupBy("list", "leader").agg(F.count("*").alias("votes")).groupBy("list").agg(F.max(F.struct("votes", "leader")).alias("m"))
    placed = scratch.put(member.join(votes.select("list", F.col("m.leader").alias("cluster")), "list").select("cluster", "sid").distinct(), "placed")
    pieces = placed.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces"))
    places = placed.join(pieces, "cluster").groupBy("sid").agg(F.collect_list(F.struct("cluster", "pieces")).alias("places"))
    kind = "array<struct<cluster:bigint,pieces:int>>"
    shown = scratch.put(places.join(active, "sid").select("id", "origin", "sid", "places"), "shown")
    # one plan at every size: the texts are dealt by id to the few rows that name them, without a sort
    sets = docs.join(shown.hint("shuffle_hash"), ["id", "origin"]).select("sid", "text", "places").mapInArrow(work.sets, f"sid bigint, places {kind}, members binary")
    sets = scratch.put(sets, "sets")
    scratch.drop("members", "first", "active", "placed", "shown")
    # a set goes out once for each piece of its clusters: the groups follow what is sent
    sent = sets.agg(F.coalesce(F.sum(F.octet_length("members") * F.aggregate("places", F.lit(0).cast("bigint"), lambda n, p: n + p["pieces"])), F.lit(0))).first()[0]
    groups = max(work.buckets * 2, int(sent) // GROUP_BYTES)
    near = sets.select("sid", "members", F.inline("places"))
    piece = F.pmod(F.xxhash64("sid", F.lit(7)), F.col("pieces")).cast("int")
    near = near.withColumn("piece", piece).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    block = F.xxhash64("cluster", F.least("piece", "other"), F.greatest("piece", "other"))
    near = near.select(F.pmod(block, F.lit(groups)).alias("g"), block.alias("block"), "sid", F.when(F.col("piece") > F.col("other"), 1).otherwise(0).alias("side"), "members")
    links = scratch.put(near.groupBy("g").applyInArrow(lambda t: work.join(t), "a bigint, b bigint"), "links")
    scratch.drop("sets")
    label = components(scratch, links, "linked")

    named = classes.join(label, classes.sid == label.node, "left").select("id", "n", "origin", F.coalesce("component", "sid").alias("class"))
    named = scratch.put(named, "named")
    least = scratch.put(named.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(F.struct("id", "origin")).alias("least")), "least")
    out = named.join(least, "class", "left")
    first = F.coalesce((F.col("id") == F.col("least.id")) & (F.col("origin") == F.col("least.origin")), F.lit(True))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least.id", "id").alias("component_id"), "origin", first.alias("first"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by shingles of five words and a Jaccard similarity of 0.75 or more."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id").drop("origin", "first")
