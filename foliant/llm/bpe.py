"""Byte-level BPE encoding and decoding by merge replay over the distinct words of large blocks."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from foliant.llm.hashing import text_slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Words that a worker remembers between blocks; then it starts anew, so its memory doesn't grow with the corpus.
REMEMBERED = 400_000
#: Bytes of text whose new words are replayed together.
BLOCK_BYTES = 4 << 20


class MergeReplay:
    """Encodes whole sets of words at once.

    An inverted index goes from the rank of a token pair to the positions, over all words, at which that pair now stands. Ranks
    are applied in ascending order, each to all its positions from left to right; a merge touches only the two neighbours of the
    merged symbol, whose new pairs enter the index. Words don't interact, so each ends as if it had been merged alone.
    """

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, r in self.ranks.items():
            self.tokens[r] = token
        #: Rank of a pair of ids, by first id << shift | second id, from every way to cut a token in two tokens.
        shift = self.shift = len(self.tokens).bit_length()
        self.pairs: dict[int, int] = {}
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                x, y = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if x is not None and y is not None:
                    self.pairs[x << shift | y] = r
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        first, second = np.repeat(self.single, 256), np.tile(self.single, 256)
        self.byte_pairs = np.array([self.pairs.get(k, -1) for k in (first << shift | second).tolist()], dtype=np.int64)
        self.words: dict[str, bytes] = {}

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        whole, shift, out = self.ranks, self.shift, [b""] * len(words)
        parts, places = [], []
        for k, w in enumerate(words):
            r = whole.get(w)
            if r is None:
                parts.append(w)
                places.append(k)
            else:
                out[k] = r.to_bytes(4, "little")
        if not parts:
            return out
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) for w in parts])
        n = len(data)
        inner = np.ones(n, bool)  # symbols with a next one in their word
        inner[ends[ends > 0] - 1] = False
        rank = np.full(n, -1, np.int64)
        rank[:-1] = self.byte_pairs[data[:-1] << 8 | data[1:]]
        rank[~inner] = -1
        at = np.flatnonzero(rank >= 0)
        order = at[np.argsort(rank[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[order], prepend=-1))
        index = {int(rank[own[0]]): own.tolist() for own in np.split(order, cuts[1:]) if len(own)}
        ids, now = self.single[data].tolist(), rank.tolist()  # now: the rank of the pair that begins at a symbol
        after = np.where(inner, np.arange(1, n + 1), -1).tolist()
        before = np.full(n, -1, np.int64)
        before[1:][inner[:-1]] = np.flatnonzero(inner[:-1])
        before = before.tolist()
        pairs, find, heap, push = self.pairs.get, index.get, list(index), heapq.heappush
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            own = index.pop(r)
            if len(own) > 1:
                own.sort()
            top = r << shift
            for i in own:
                if now[i] != r:
                    continue
                j = after[i]
                k = after[j]
                ids[i], ids[j], now[j], after[i] = r, -1, -1, k
                if k >= 0:
                    before[k] = i
                    q = now[i] = pairs(top | ids[k], -1)
                    if q >= 0:
                        found = find(q)
                        if found is None:
                            index[q] = [i]
                            push(heap, q)
                        else:
                            found.append(i)
                else:
                    now[i] = -1
                h = before[i]
                if h >= 0:
                    q = now[h] = pairs(ids[h] << shift | r, -1)
                    if q >= 0:
                        found = find(q)
                        if found is None:
                            index[q] = [h]
                            push(heap, q)
                        else:
                            found.append(h)
        left = np.array(ids, dtype=np.int64)
        packed = left[left >= 0].astype("<u4").tobytes()
        stops = (np.concatenate(([0], np.cumsum(left >= 0)))[ends] * 4).tolist()
        start = 0
        for k, stop in zip(places, stops, strict=True):
            out[k] = packed[start:stop]
            start = stop
        return out

    def encode(self, texts: list[str], pattern: regex.Pattern) -> Iterator[bytes]:
        """The ids of each text, packed as above. Each match of the pattern is a word; the block's new words are replayed together."""
        found = [pattern.findall(t) for t in texts]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        known = self.words
        new = list(set().union(*found) - known.keys())
        for w, packed in zip(new, self.replay([w.encode("utf-8") for w in new]), strict=True):
            known[w] = packed
        for ws in found:
            yield b"".join([known[w] for w in ws])

    def decode(self, packed: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()])


@cache
def replayer(path: str) -> MergeReplay:
    """One for each worker process."""
    return MergeReplay(path)


@cache
def words_of(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def encode_texts(df: DataFrame, key: str, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids): the packed ids of every whole text, binary. Null text counts as empty and has no ids; repeated rows stay."""
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, words = replayer(path), words_of(pattern)
        for b in batches:
            for at, end, _, _ in text_slices(b.column(1), BLOCK_BYTES):
                texts = [t or "" for t in b.column(1).slice(at, end - at).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), pa.array(list(bpe.encode(texts, words)), pa.binary())], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, ids binary").withColumnRenamed("key", key)


def decode_ids(df: DataFrame, key: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, decoded): the bytes that the packed ids stand for. Null ids decode to nothing; ids outside the vocabulary raise."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = replayer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or b"") for x in b.column(1).to_pylist()], pa.binary())], ["key", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"key {kind}, decoded binary").withColumnRenamed("key", key)


def digest_texts(df: DataFrame, key: str, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, so that neither leaves the worker."""
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, words = replayer(path), words_of(pattern)
        for b in batches:
            for at, end, _, _ in text_slices(b.column(1), BLOCK_BYTES):
                texts = [t or "" for t in b.column(1).slice(at, end - at).to_pylist()]
                n, ids, back = [], [], []
                for packed in bpe.encode(texts, words):
                    n.append(len(packed) // 4)
                    ids.append(sha(packed))
                    back.append(sha(bpe.decode(packed)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole document, encoded and decoded."""
    return digest_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
