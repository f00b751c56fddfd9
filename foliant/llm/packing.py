"""Packing of tokenised documents into fixed windows by minimum bin slack."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm.hashing import text_slices
from foliant.llm.scratch import Scratch

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 1
REMEMBERED = 400_000
#: Bytes of text whose new runs are encoded together.
BLOCK_BYTES = 8 << 20


#: What a plain word is made of: letters whose lower case and normal form are single letters too, so it is one pre-token.
PLAIN, TAIL = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", ".,!?;:"


class WordEncoder:
    """Ids of whole texts, where each distinct run of characters between ASCII white space is encoded once.

    The vocabulary's pre-tokeniser drops white space and never joins what it parts, and no character composes with it, so the
    ids of a text are those of its runs in order. A run that is a plain word and a tail of stops is those two pre-tokens. New plain
    words are encoded many at a time, as one text; the ids that end a word part them again. All other runs go to the
    tokeniser one by one. The strings of its special tokens, which hold no white space, become those tokens inside texts too, as the library does
    by default.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 8192):
            part = words[at : at + 8192]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[w] = array("I", e.ids).tobytes()

    def _learn_plain(self, words: list[str]) -> None:
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                self._learn(part)
                continue
            packed, start = ids.tobytes(), 0
            for w, stop in zip(part, (4 * stops).tolist(), strict=True):
                self.known[w] = packed[start:stop]
                start = stop

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids begin and end. Null counts as empty."""
        runs = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = runs.flatten().dictionary_encode()
        words = coded.dictionary
        stems = pc.utf8_rtrim(words, characters=TAIL)
        plain = pc.match_substring_regex(stems, PLAIN)
        heads = pc.if_else(plain, pc.utf8_lower(stems), words).dictionary_encode()
        cut = np.flatnonzero(pc.and_(plain, pc.not_equal(pc.binary_length(stems), pc.binary_length(words))).to_numpy(zero_copy_only=False))
        tails = [w[n:].decode() for w, n in zip(words.take(pa.array(cut)).cast(pa.binary()).to_pylist(), pc.binary_length(stems.take(pa.array(cut))).to_pylist(), strict=True)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        keys = heads.dictionary.to_pylist()
        simple = pc.match_substring_regex(heads.dictionary, PLAIN).to_pylist()
        self._learn_plain([w for w, p in zip(keys, simple, strict=True) if p and w not in known])
        self._learn([w for w, p in zip(keys, simple, strict=True) if not p and w not in known])
        ends_of = {w: len(keys) + 1 + i for i, w in enumerate(dict.fromkeys(tails))}
        self._learn([w for w in ends_of if w not in known])
        packed = [*(known[w] for w in keys), b"", *(known[w] for w in ends_of)]
        table, n = np.frombuffer(b"".join(packed), "<u4"), np.array([len(x) // 4 for x in packed], np.int64)
        first = np.concatenate(([0], np.cumsum(n)))[:-1]
        # each run is its head and its tail; most tails are empty
        both = np.full((len(words), 2), len(keys), np.int64)
        both[:, 0] = heads.indices.to_numpy(zero_copy_only=False)
        both[cut, 1] = [ends_of[w] for w in tails]
        codes = both[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        long = n[codes]
        ends = np.concatenate(([0], np.cumsum(long)))
        ids = table[np.repeat(first[codes] - ends[:-1], long) + np.arange(ends[-1])]
        ends = ends[::2]
        return ids, ends[np.concatenate(([0], np.cumsum(pc.list_value_length(runs).to_numpy(zero_copy_only=False))))]


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths that fills the capacity as far as any does and holds the largest length there is.

    Sums that can be reached are the bits of an integer. A length that occurs c times enters as items of 1, 2, 4, ... and the rest
    of it, each with one shift; the bits before each item are kept, and from the highest bit the items are traced back.
    """
    largest = max(counts)
    room = capacity - largest
    mask, bits, seen = (1 << room + 1) - 1, 1, []
    for length in sorted(counts, reverse=True):
        most = min(counts[length] - (length == largest), room // length)
        step = 1
        while most > 0 and not bits >> room & 1:
            take = min(step, most)
            seen.append((length, take, bits))
            bits |= bits << length * take & mask
            most -= take
            step *= 2
        if bits >> room & 1:
            break
    at, out = bits.bit_length() - 1, {largest: 1}
    for length, take, without in reversed(seen):
        if not without >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """For each length the rules (first rank, first sequence, pieces a sequence, first offset), and the number of sequences.

    A pattern is used as often as the counts allow. Only the counts by length, at most ``capacity`` numbers, are needed.
    """
    left, used, rules, sequences = {k: v for k, v in counts.items() if v}, dict.fromkeys(counts, 0), {k: [] for k in counts}, 0
    if left.get(capacity):
        rules[capacity].append((0, 0, 1, 0))
        sequences = left.pop(capacity)
    while left:
        pattern = fill(left, capacity)
        times = min(left[k] // c for k, c in pattern.items())
        offset = 0
        for k, c in sorted(pattern.items(), reverse=True):
            rules[k].append((used[k], sequences, c, offset))
            offset += k * c
            used[k] += c * times
            left[k] -= c * times
            if not left[k]:
                del left[k]
        sequences += times
    return rules, sequences


def cut_documents(df: DataFrame, key: str, text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: whole windows from its start, then the rest. Null text has the end id alone.

    (key, start, length, ids_crc32, doc_tokens, part, number): part is the task, number counts its pieces of that length from 0.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, last = TaskContext.get().partitionId(), encoder(path), np.array([end_id], dtype="<u4").tobytes()
        numbers = [0] * (capacity + 1)
        for b in batches:
            for at, end, _, _ in text_slices(b.column(1), BLOCK_BYTES):
                rows = [[] for _ in range(6)]
                ids, edges = enc.encode(b.column(1).slice(at, end - at))
                for i in range(end - at):
                    packed = ids[edges[i] : edges[i + 1]].tobytes() + last
                    n = len(packed) // 4
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        for column, x in zip(rows, (at + i, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)]), n, numbers[length]), strict=True):
                            column.append(x)
                        numbers[length] += 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(x, pa.int64()) for x in rows[1:5]), pa.array([part] * len(rows[0]), pa.int32()), pa.array(rows[5], pa.int64())], ["key", "start", "length", "ids_crc32", "doc_tokens", "part", "number"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, number bigint").withColumnRenamed("key", key)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the pieces of cut_documents(), which must be a written table.

    A piece's rank among those of its length is its number plus the pieces of that length in the tasks before, so that no
    length's rows meet in one task. Only the counts by length (at most ``capacity`` numbers) reach the driver; the plan that
    goes back has a bound by the capacity too. An empty table stays empty.
    """
    at = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(at), F.lit(0)).alias("_before"))
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    rules, _ = plan(counts, capacity)
    table = {k: np.array(v, dtype=np.int64) for k, v in rules.items() if v}
    names = [f.name for f in pieces.schema]
    shared = pieces.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("number")).to_numpy() + b.column(b.schema.get_field_index("_before")).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for own in np.split(order, cuts[1:]) if len(order) else []:
                k = length[own[0]]
                r = rules[k]
                row = r[np.searchsorted(r[:, 0], rank[own], "right") - 1]
                sequence[own] = row[:, 1] + (rank[own] - row[:, 0]) // row[:, 2]
                offset[own] = row[:, 3] + (rank[own] - row[:, 0]) % row[:, 2] * k
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return pieces.join(before, ["length", "part"]).select(*names, "_before").mapInArrow(place, schema)


def pack_documents(df: DataFrame, key: str, text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset. Columns other than key and text play no part."""
    scratch = Scratch(df.sparkSession, "packing")
    pieces = scratch.put(cut_documents(df, key, text, path, capacity), "pieces")
    return pack(pieces, capacity).select(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
