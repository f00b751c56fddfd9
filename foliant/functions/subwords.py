"""Subword tokens of cleaned texts: each distinct word of a batch is cut once, and model inputs are padded by batches of like length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import clean_text

#: Words that a worker remembers at most, and the longest input of a model, with its first and last token.
REMEMBERED, LONGEST = 400_000, 512
#: The vocabulary's mark of a word's start.
MARK = "\u2581"


class Pieces:
    """Ids of words by a vocabulary file of the sentencepiece library; a worker process loads it once.

    The vocabulary marks the start of a word and joins nothing across white space, so the ids of a text are those of its words in order. A text
    that holds the mark itself is cut whole.
    """

    _loaded: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, np.ndarray] = {}
        self.first, self.last, self.fill = self.model.bos_id(), self.model.eos_id(), max(self.model.pad_id(), 0)

    @classmethod
    def at(cls, path: str) -> Pieces:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def of(self, words: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for w, ids in zip(new, self.model.encode(new, num_threads=1) if new else [], strict=True):
            self.known[w] = np.array(ids, np.int32)
        return [self.known[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (words parted by single spaces), one after the other, and where each text's ids begin and end."""
        runs = pc.split_pattern(texts, " ")
        if pc.any(odd := pc.match_substring(texts, MARK)).as_py():
            runs = pa.array([[t] if o else r for t, o, r in zip(texts.to_pylist(), odd.to_pylist(), runs.to_pylist(), strict=True)], pa.list_(pa.string()))
        coded = runs.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids = [np.zeros(0, np.int32) if w == "" else x for w, x in zip(words, self.of(words), strict=True)]
        n, table = np.array([len(x) for x in ids], np.int64), np.concatenate([np.zeros(0, np.int32), *ids])
        first = np.concatenate(([0], np.cumsum(n)))[:-1]
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        long = n[codes]
        ends = np.concatenate(([0], np.cumsum(long)))
        out = table[np.repeat(first[codes] - ends[:-1], long) + np.arange(ends[-1])]
        return out, ends[np.concatenate(([0], np.cumsum(pc.list_value_length(runs).to_numpy(zero_copy_only=False))))]


def subword_tokens(df: DataFrame, path: str, text: str = "text", longest: int | None = LONGEST, into: str = "tokens") -> DataFrame:
    """Adds the ids of the cleaned whole text between the first and the last token; of more than ``longest`` the last ones before the end are cut
    (None: no cut). Null counts as empty, which has the two tokens alone. A column of the name ``into`` is replaced."""
    df = df.drop(into).withColumn(into, clean_text(F.col(text)))
    names, plain = df.columns, [f"c{i}" for i in range(len(df.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.at(path)
        for b in batches:
            ids, edges = pieces.encode(b.column(len(names) - 1))
            room = np.diff(edges) if longest is None else np.minimum(np.diff(edges), longest - 2)
            offsets = np.concatenate(([0], np.cumsum(room + 2))).astype(np.int32)
            out = np.empty(offsets[-1], np.int32)
            out[offsets[:-1]], out[offsets[1:] - 1] = pieces.first, pieces.last
            take = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
            out[take + np.repeat(offsets[:-1] + 1, room)] = ids[take + np.repeat(edges[:-1], room)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))], plain)

    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(plain, df.schema[:-1], strict=False)), f"{plain[-1]} array<int>"])
    return df.toDF(*plain).mapInArrow(run, schema).toDF(*names)


def padded(tokens: list[np.ndarray], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of a batch, as wide as its longest row."""
    wide = max((len(t) for t in tokens), default=0)
    ids, mask = np.full((len(tokens), wide), fill, np.int32), np.zeros((len(tokens), wide), np.int8)
    for i, t in enumerate(tokens):
        ids[i, : len(t)], mask[i, : len(t)] = t, 1
    return ids, mask


def by_length(rows: list, size: Callable[[object], int], most: int) -> Iterator[list[int]]:
    """Places of rows in batches of at most ``most``, of like size, longest first."""
    order = sorted(range(len(rows)), key=lambda i: -size(rows[i]))
    for k in range(0, len(order), most):
        yield order[k : k + most]
