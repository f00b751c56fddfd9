"""Substring dedup by fixed-block anchors: blocks of the texts are indexed, every rolling window probes them, hits are extended."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.hashing import U, Words, spark_hash, text_slices
from foliant.llm.packed import pack_arrays, runs_of, unpack_arrays
from foliant.llm.scratch import Scratch

#: Bytes of text that a bucket of anchors or a group of documents stands for, about; their numbers follow the input.
BUCKET_BYTES, GROUP_BYTES, LEAST_BUCKETS = 8 << 20, 4 << 20, 64
#: Bytes of marks that a task takes of one bucket, about; a bucket with more is dealt over several tasks.
BUCKET_LIMIT = 32 << 20


def _digest(data: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(data.tobytes(), digest_size=8).digest(), "little", signed=True)


def origin_of(text: Column) -> Column:
    """The hash by which a row's text is told from others of its key; in Python _origin()."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _origin(data: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(data.tobytes(), 42)  # Spark's seed
    return h - (h >> 63 << 64)


def _joined(data: np.ndarray) -> bytes:
    return b" ".join(data.tobytes().split())


def _groups_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """A document's group; in SQL pmod(xxhash64(id), groups)."""
    return spark_hash(ids) % groups


class Anchors:
    """The three parts of the search, as functions on Arrow tables. window: words that make a repeat; block: half of it at most."""

    def __init__(self, window: int, buckets: int, groups: int, output: str):
        self.window, self.block, self.groups, self.output = window, (window + 1) // 2, groups, output
        self.bits = buckets.bit_length() - 1
        self.buckets = 1 << self.bits

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def _mark(self, h: np.ndarray) -> np.ndarray:
        """31 bits of a fingerprint that follow the bucket's."""
        return (h << U(self.bits) >> U(33)).astype(np.uint32)

    def probes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each bucket the marks of all rolling blocks of a run of documents; the lowest bit says whether it is an indexed block.
        salt: a hash of the run, by which the rows of a large bucket are dealt.

        Of equal texts in a task only those go whose id is smaller than all before, so that the smallest of all does; the others
        are told by digest.
        """
        seen: dict[int, int] = {}
        for b in batches:
            ids_all = b.column(0).to_numpy()
            for at, end, data, offsets in text_slices(b.column(1)):
                words = Words(data, offsets)
                h = words.windows(self.block)
                ids = ids_all[at:end]
                digests = np.array([_digest(data[offsets[i] : offsets[i + 1]]) for i in range(end - at)], np.int64)
                fresh = np.zeros(end - at, bool)
                for i, d in enumerate(digests.tolist()):
                    if words.count[i] >= self.window and ids[i] < seen.get(d, 1 << 63):
                        seen[d] = int(ids[i])
                        fresh[i] = True
                number = np.arange(len(words.row)) - words.first[words.row]
                use = np.flatnonzero((fresh & (words.count >= self.window))[words.row] & (number + self.block <= words.count[words.row]))
                if not len(use):
                    continue
                own, row = h[use], words.row[use].astype(np.int64)
                bucket = self._bucket(own)
                marks = self._mark(own) << np.uint32(1) | (number[use] % self.block == 0)
                order = np.argsort(bucket, kind="stable")
                bucket, marks, row = bucket[order], marks[order].astype("<u4"), row[order]
                keys, blobs = [], []
                for k, part in runs_of(bucket, self.buckets):
                    docs, counts = np.unique(row[part], return_counts=True)
                    keys.append(k)
                    blobs.append(pack_arrays(ids[docs], digests[docs], counts.astype("<u4"), marks[part]))
                salt = int(spark_hash(ids[:1])[0] & 0x7FFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([salt] * len(keys), pa.int64()), pa.array([len(x) for x in blobs], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "salt", "bytes", "payload"])

    @staticmethod
    def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, digest, mark) of all payloads, by mark."""
        parts = [unpack_arrays(x, "<i8", "<i8", "<u4", "<u4") for x in table["payload"].to_pylist()]
        counts = np.concatenate([p[2] for p in parts])
        ids, digests, marks = np.repeat(np.concatenate([p[0] for p in parts]), counts), np.repeat(np.concatenate([p[1] for p in parts]), counts), np.concatenate([p[3] for p in parts])
        order = np.argsort(marks >> np.uint32(1))
        return ids[order], digests[order], marks[order]

    @staticmethod
    def _reduced(low: np.ndarray, high: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of entries by mark: where each mark begins, its smallest and largest digest, and the mark with the bit that any entry has."""
        plain = marks >> np.uint32(1)
        start = np.flatnonzero(np.concatenate(([True], plain[1:] != plain[:-1])))
        return start, np.minimum.reduceat(low, start), np.maximum.reduceat(high, start), np.bitwise_or.reduceat(marks, start)

    def summary(self, table: pa.Table) -> pa.Table:
        """Of a part of a large bucket: each mark once, with its smallest and largest digest."""
        _, digests, marks = self._entries(table)
        _, low, high, once = self._reduced(digests, digests, marks)
        return pa.table({"bucket": table["bucket"].slice(0, 1), "payload": pa.array([pack_arrays(once, low, high)], pa.binary())})

    def decide(self, table: pa.Table) -> pa.Table:
        """Of the summaries of a large bucket: the marks that are hit."""
        parts = [unpack_arrays(x, "<u4", "<i8", "<i8") for x in table["payload"].to_pylist()]
        marks, low, high = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(marks >> np.uint32(1))
        _, low, high, once = self._reduced(low[order], high[order], marks[order])
        hit = once[(once & np.uint32(1) == 1) & (low != high)] >> np.uint32(1)
        return pa.table({"bucket": table["bucket"].slice(0, 1), "hit": pa.array([hit.tobytes()], pa.binary())})

    def hits_of_part(self, table: pa.Table, decided: pa.Table) -> pa.Table:
        """As hits(), of a part of a large bucket whose marks are decided."""
        if not len(table) or not len(decided):
            return self._answer(0, np.zeros(0, np.int64), np.zeros(0, np.uint32))
        ids, _, marks = self._entries(table)
        hit = np.frombuffer(decided["hit"][0].as_py(), "<u4")
        plain = marks >> np.uint32(1)
        use = np.isin(plain, hit)
        return self._answer(table["bucket"][0].as_py(), ids[use], plain[use])

    def hits(self, table: pa.Table) -> pa.Table:
        """Of one bucket: the blocks that are indexed from one text and probed from another, for each group of documents that hold them."""
        ids, digests, marks = self._entries(table)
        start, low, high, once = self._reduced(digests, digests, marks)
        use = np.repeat((once & np.uint32(1) == 1) & (low != high), np.diff(np.append(start, len(marks))))
        return self._answer(table["bucket"][0].as_py(), ids[use], marks[use] >> np.uint32(1))

    def _answer(self, bucket: int, ids: np.ndarray, plain: np.ndarray) -> pa.Table:
        """For each group its documents and their marks that are hit."""
        group = _groups_of(ids, self.groups)
        order = np.lexsort((plain, ids, group))
        ids, plain, group = ids[order], plain[order], group[order]
        out = [[], []]
        for g, part in runs_of(group, self.groups):
            docs, n = np.unique(ids[part], return_counts=True)
            out[0].append(g)
            out[1].append(pack_arrays(docs, n.astype("<u4"), plain[part].astype("<u4")))
        return pa.table({"grp": pa.array(out[0], pa.int64()), "kind": pa.array([bucket] * len(out[0]), pa.int32()), "payload": pa.array(out[1], pa.binary())})

    def _documents(self, docs: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Words]]:
        docs = docs.combine_chunks()
        ids = docs["id"].to_numpy()
        for chunk in docs["text"].chunks:
            for at, end, data, offsets in text_slices(chunk):
                yield ids[at:end], data, offsets, Words(data, offsets)

    def _kept(self, data: np.ndarray, words: np.ndarray | None) -> str:
        """The output of a document: of the text as it is (words None), or of its kept words."""
        if self.output == "sha256":
            return hashlib.sha256(_joined(data) if words is None else b" ".join(words)).hexdigest()
        return (data.tobytes() if words is None else b" ".join(words)).decode("utf-8")

    def extend(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Of one group: the result of documents without hits and of copies; of the others the text, and the fingerprints of all
        windows around a hit with the smallest document of the group that has them, by bucket."""
        copies = [np.zeros((0, 2), np.int64)]
        hit_ids, hit_keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for kind, payload in zip(answers["kind"].to_pylist(), answers["payload"].to_pylist(), strict=True):
            if kind < 0:
                copies.append(np.frombuffer(payload, ">i8").astype(np.int64).reshape(-1, 2))
            else:
                d, n, marks = unpack_arrays(payload, "<i8", "<u4", "<u4")
                hit_ids.append(np.repeat(d, n))
                hit_keys.append(U(kind) << U(31) | marks.astype(np.uint64))
        copied = set(map(tuple, np.concatenate(copies).tolist()))
        hit_id, hit_key = np.concatenate(hit_ids), np.concatenate(hit_keys)
        order = np.argsort(hit_id, kind="stable")
        hit_id, hit_key = hit_id[order], hit_key[order]
        out: dict[str, list] = {n: [] for n in ("id", "origin", "n_words", "n_removed", "kept", "text", "bucket", "payload")}

        def row(**given: object) -> None:
            for n, column in out.items():
                column.append(given.get(n))

        found_h, found_id = [], []
        for ids, data, offsets, words in self._documents(docs):
            blocks = words.windows(self.block) >> U(64 - self.bits - 31)
            whole = words.windows(self.window)
            for i, doc in enumerate(ids.tolist()):
                own, n, first = data[offsets[i] : offsets[i + 1]], int(words.count[i]), int(words.first[i])
                a, b, origin = np.searchsorted(hit_id, doc, "left"), np.searchsorted(hit_id, doc, "right"), _origin(own)
                if n >= self.window and (doc, origin) in copied:
                    row(id=doc, origin=origin, n_words=n, n_removed=n, kept=self._kept(own, []))
                elif n < self.window or a == b:
                    row(id=doc, origin=origin, n_words=n, n_removed=0, kept=self._kept(own, None))
                else:
                    hits = np.isin(blocks[first : first + n - self.block + 1], hit_key[a:b])
                    near = np.concatenate(([0], np.cumsum(hits)))
                    reach = self.window - self.block + 1
                    at = np.flatnonzero(near[reach:] > near[:-reach])
                    found_h.append(whole[first + at])
                    found_id.append(np.full(len(at), doc, np.int64))
                    row(id=doc, n_words=n, text=own.tobytes().decode("utf-8"))
        if found_h:
            h, d = np.concatenate(found_h), np.concatenate(found_id)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            once = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
            h, d = h[once], d[once]
            for k, part in runs_of(self._bucket(h), self.buckets):
                who, place = np.unique(d[part], return_inverse=True)
                row(bucket=k, payload=pack_arrays(who, place.astype("<u4"), h[part]))
        grp = int(docs["grp"][0].as_py()) if len(docs) else int(answers["grp"][0].as_py())
        return pa.table({"grp": pa.array([grp] * len(out["id"]), pa.int64()), "id": pa.array(out["id"], pa.int64()), "origin": pa.array(out["origin"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept": pa.array(out["kept"], pa.string()), "text": pa.array(out["text"], pa.string()), "bucket": pa.array(out["bucket"], pa.int32()), "payload": pa.array(out["payload"], pa.binary())})

    def smallest(self, table: pa.Table) -> pa.Table:
        """Of one bucket: for each group its windows that a smaller document of another group has, with the smallest."""
        parts = [unpack_arrays(x, "<i8", "<u4", "<u8") for x in table["payload"].to_pylist()]
        groups = np.repeat(table["grp"].to_numpy(), [len(p[2]) for p in parts])
        ids, h = np.concatenate([p[0][p[1]] for p in parts]), np.concatenate([p[2] for p in parts])
        order = np.lexsort((ids, h))
        ids, h, groups = ids[order], h[order], groups[order]
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        least = np.repeat(ids[start], np.diff(np.append(start, len(h))))
        use = least < ids
        h, least, groups = h[use], least[use], groups[use]
        order = np.argsort(groups, kind="stable")
        h, least, groups = h[order], least[order], groups[order]
        out = [[], []]
        for g, part in runs_of(groups, self.groups):
            out[0].append(g)
            out[1].append(pack_arrays(h[part], least[part]))
        return pa.table({"grp": pa.array(out[0], pa.int64()), "payload": pa.array(out[1], pa.binary())})

    def remove(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Of one group: the result of the documents with hits. Runs of repeated windows are the maximal repeats."""
        parts = [unpack_arrays(x, "<u8", "<i8") for x in answers["payload"].to_pylist()]
        all_h, all_d, held = [p[0] for p in parts], [p[1] for p in parts], []
        for ids, data, offsets, words in self._documents(docs):
            whole, valid = words.windows(self.window), []
            for i, doc in enumerate(ids.tolist()):
                n, first = int(words.count[i]), int(words.first[i])
                own = whole[first : first + n - self.window + 1]
                valid.append(own)
                all_h.append(own)
                all_d.append(np.full(len(own), doc, np.int64))
            held.append((ids, data, offsets, words, valid))
        out: list[list] = [[], [], [], [], []]
        if held:
            h, d = np.concatenate(all_h), np.concatenate(all_d)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            once = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
            h, d = h[once], d[once]
            for ids, data, offsets, words, valid in held:
                for i, doc in enumerate(ids.tolist()):
                    n, first = int(words.count[i]), int(words.first[i])
                    again = d[np.searchsorted(h, valid[i])] < doc
                    edge = np.zeros(n + 1, np.int64)
                    at = np.flatnonzero(again)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + self.window, -1)
                    keep = np.cumsum(edge[:n]) == 0
                    s, e = words.start[first : first + n][keep], words.end[first : first + n][keep]
                    kept = [data[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist(), strict=True)]
                    whole_text = None if keep.all() else kept
                    own = data[offsets[i] : offsets[i + 1]]
                    for column, x in zip(out, (doc, _origin(own), n, int(n - keep.sum()), self._kept(own, whole_text)), strict=True):
                        column.append(x)
        return pa.table({n: pa.array(x, pa.string() if n == "kept" else pa.int64()) for n, x in zip(("id", "origin", "n_words", "n_removed", "kept"), out, strict=True)})


def dedup_substrings(df: DataFrame, key: str, text: str = "text", window: int = 50, output: str = "text") -> DataFrame:
    """(key, origin, n_words, n_removed, kept): every word goes that a window covers whose words also start in a document of a smaller key.

    Words are runs of characters other than ASCII white space, windows have ``window`` words (two at least) and are judged on the input. kept: the
    kept words joined by one space, or the text as it is where nothing goes (``output="text"``); or the sha256 of the kept words
    joined by one space (``output="sha256"``). Null text has no words. Keys are whole numbers; rows of one key are each judged alone
    against smaller keys, and origin (origin_of() of the text) tells them apart; null keys are left out; an empty table has no rows.

    Blocks of half a window, one after the other from each text's start, are the index. Every rolling block of every text probes
    it; any repeat of a whole window holds an indexed block of either text, so none is missed. Around hits, fingerprints of
    whole windows decide, each with its smallest document; runs of repeated windows are the maximal repeats. Marks, hits and
    fingerprints go through shuffles as packed arrays for each bucket. A passage that many documents hold sends its marks with each
    of them; a bucket of more than BUCKET_LIMIT bytes is dealt over tasks that send each mark once to be decided. A group of
    documents (dealt by a hash of the key) sends a window once however many of its documents hold it, so a bucket of windows grows
    with the number of groups, one entry for each 4 MB of text at most. Copies of a whole text are told by a digest and go to their
    smallest key. Fingerprints have 64 bits.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = 1 << max(LEAST_BUCKETS.bit_length() - 1, (int(size) // BUCKET_BYTES).bit_length())
    groups = max(LEAST_BUCKETS, int(size) // GROUP_BYTES)
    parts = Anchors(window, buckets, groups, output)
    grp = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("bigint")

    probes = scratch.put(docs.mapInArrow(parts.probes, "bucket int, salt bigint, bytes bigint, payload binary"), "probes")
    answer = "grp bigint, kind int, payload binary"
    large = probes.groupBy("bucket").agg(F.sum("bytes").alias("b")).where(F.col("b") > BUCKET_LIMIT).select("bucket", F.ceil(2 * F.col("b") / BUCKET_LIMIT).cast("bigint").alias("tasks"))
    large = scratch.put(large, "large")
    if large.isEmpty():
        hits = probes.groupBy("bucket").applyInArrow(lambda t: parts.hits(t), answer)
    else:
        hits = probes.join(large, "bucket", "left_anti").groupBy("bucket").applyInArrow(lambda t: parts.hits(t), answer)
        dealt = probes.join(large, "bucket").withColumn("task", F.pmod("salt", "tasks"))
        brief = dealt.groupBy("bucket", "task").applyInArrow(lambda t: parts.summary(t), "bucket int, payload binary")
        decided = brief.groupBy("bucket").applyInArrow(lambda t: parts.decide(t), "bucket int, hit binary")
        decided = decided.join(large, "bucket").withColumn("task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)))
        split = dealt.groupBy("bucket", "task").cogroup(decided.groupBy("bucket", "task")).applyInArrow(lambda t, d: parts.hits_of_part(t, d), answer)
        hits = hits.unionByName(split)
    hits = scratch.put(hits, "hits")
    scratch.drop("probes", "large")
    same = docs.select("id", origin_of(F.col("text")).alias("h"), F.sha2("text", 256).alias("sha")).where(F.col("sha").isNotNull())
    first = scratch.put(same.groupBy("h", "sha").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1"), "copied")
    copies = same.join(first, ["h", "sha"]).where("id > least").groupBy(grp.alias("grp")).agg(F.to_binary(F.array_join(F.transform(F.collect_list(F.struct("id", "h")), lambda r: F.concat(F.lpad(F.hex(r["id"]), 16, "0"), F.lpad(F.hex(r["h"]), 16, "0"))), ""), F.lit("hex")).alias("payload"))
    answers = hits.unionByName(copies.select("grp", F.lit(-1).alias("kind"), "payload"))
    schema = "grp bigint, id bigint, origin bigint, n_words bigint, n_removed bigint, kept string, text string, bucket int, payload binary"
    one = scratch.put(docs.withColumn("grp", grp).groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(lambda d, a: parts.extend(d, a), schema), "extended")
    scratch.drop("hits")
    windows = one.where(F.col("bucket").isNotNull()).select("bucket", "grp", "payload")
    least = scratch.put(windows.groupBy("bucket").applyInArrow(lambda t: parts.smallest(t), "grp bigint, payload binary"), "least")
    open_docs = one.where(F.col("text").isNotNull()).select("grp", "id", "text")
    two = open_docs.groupBy("grp").cogroup(least.groupBy("grp")).applyInArrow(lambda d, a: parts.remove(d, a), "id bigint, origin bigint, n_words bigint, n_removed bigint, kept string")
    done = one.where(F.col("kept").isNotNull()).select("id", "origin", "n_words", "n_removed", "kept")
    return done.unionByName(two).withColumnRenamed("id", key)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, with windows of 50 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, "doc_id", output="sha256").drop("origin").withColumnRenamed("kept", "kept_sha256")
