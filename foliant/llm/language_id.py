"""Language identification as inference of multilingual mixtures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.hashing import _LOWER, text_slices

BUCKETS = 1 << 15
#: Documents of each language that the counts are fitted on, about; the only bounded sample here.
SAMPLE = 4000


def _grams(data: np.ndarray) -> np.ndarray:
    """Buckets of the byte trigrams of one text, with A-Z as a-z and a space at either end."""
    x = np.concatenate(([32], _LOWER[data], [32])).astype(np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(17)


def train(df: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages in order and the logarithms of their trigram likelihoods, with a pseudocount of 0.5.

    Fitted on about ``sample`` rows of each language, taken by a hash of the text, and the sums reach the driver as one row for
    each language and bucket (32768 buckets). Rows with null text or language are left out; so equal texts are in or out together.
    """
    own = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    sizes = {r[0]: r[1] for r in own.groupBy("l").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS))
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("l") == name, F.lit(min(1.0, sample / n))).otherwise(share)
    own = own.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names = b.column(1).to_pylist()
            for at, end, data, offsets in text_slices(b.column(0)):
                for i in range(end - at):
                    part = data[offsets[i] : offsets[i + 1]]
                    if len(part):
                        sums[names[at + i]] = sums.get(names[at + i], 0) + np.bincount(_grams(part), minlength=BUCKETS)
        for name, total in sums.items():
            g = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int32)), pa.array(total[g].astype(np.int64))], ["l", "g", "n"])

    rows = own.mapInArrow(count, "l string, g int, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(langs), BUCKETS), 0.5)
    counts[rows["l"].map(langs.index).to_numpy(dtype=np.int64), rows["g"].to_numpy(dtype=np.int64)] += rows["n"].to_numpy(dtype=np.float64)
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def mixtures(counts: np.ndarray, likelihood: np.ndarray, first: np.ndarray, shares: np.ndarray, rounds: int) -> np.ndarray:
    """Expectation-maximisation of the shares [document, language]; rows from first[i] on belong to document i."""
    total = np.add.reduceat(counts, first)[:, None]
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(counts))))
    for _ in range(rounds):
        w = shares[row] * likelihood
        w *= (counts / np.maximum(w.sum(axis=1), 1e-30))[:, None]
        shares = np.add.reduceat(w, first, axis=0) / total
    return shares


def infer(texts: list[tuple[np.ndarray, bool]], logs: np.ndarray, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, score) of each text that has letters, (-1, 0) else.

    The documents' trigrams and their counts run through the expectation-maximisation together. Then, for each k up to the number
    of languages, the k languages of the largest shares are refitted and their log likelihood is charged ``penalty`` * (k - 1) * log(trigrams); the best k is
    the document's language set. The largest share in it is the prediction, and that share the score.
    """
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    own = [i for i, (_, letters) in enumerate(texts) if letters]
    if not own or not len(logs):
        return best, score
    found, sums = [], []
    for i in own:  # the dense counts of one text at a time
        dense = np.bincount(_grams(texts[i][0]), minlength=BUCKETS)
        found.append(np.flatnonzero(dense))
        sums.append(dense[found[-1]].astype(np.float32))
    counts = np.concatenate(sums)
    first = np.concatenate(([0], np.cumsum([len(f) for f in found])))[:-1]
    own_logs = logs.T[np.concatenate(found)]
    top = own_logs.max(axis=1, keepdims=True)
    likelihood = np.exp(own_logs - top).astype(np.float32)
    base = np.add.reduceat(counts * top[:, 0], first)
    n, k = len(own), len(logs)
    total = np.add.reduceat(counts, first)
    row = np.repeat(np.arange(n), np.diff(np.append(first, len(counts))))
    shares = mixtures(counts, likelihood, first, np.full((n, k), 1 / k, np.float32), rounds)
    order = np.argsort(-shares, axis=1, kind="stable")
    chosen, value = shares, np.full(n, -np.inf)
    alone = np.stack([np.add.reduceat(counts * np.log(np.maximum(likelihood[:, j], 1e-30)), first) for j in range(k)], axis=1)
    single = np.zeros((n, k), np.float32)
    single[np.arange(n), alone.argmax(axis=1)] = 1
    chosen, value = single, base + alone.max(axis=1)
    for size in range(2, k + 1):
        keep = np.zeros((n, k), bool)
        np.put_along_axis(keep, order[:, :size], True, axis=1)
        s = np.where(keep, np.maximum(shares, 1e-6), 0).astype(np.float32)
        s = mixtures(counts, likelihood, first, s / s.sum(axis=1, keepdims=True), 3)
        fit = base + np.add.reduceat(counts * np.log(np.maximum((s[row] * likelihood).sum(axis=1), 1e-30)), first) - penalty * (size - 1) * np.log(total + 1)
        better = fit > value
        chosen, value = np.where(better[:, None], s, chosen), np.where(better, fit, value)
    best[own], score[own] = chosen.argmax(axis=1), np.clip(chosen.max(axis=1), 0, 1)
    return best, score


def held_out(key: Column) -> Column:
    """Documents that are kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", rounds: int = 6, penalty: float = 5.0, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds lang_pred and score, or what ``into`` calls them, from the text alone.

    ``und`` with score 0: text that is null, empty or has no letter, or nothing was learned. Columns of these names are replaced;
    rows are neither added nor dropped.
    """
    langs, logs = model
    df = df.drop(*into)
    names = df.columns
    at_text, plain = names.index(text), [f"c{i}" for i in range(len(names))]
    shared = df.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for b in batches:
            for at, end, data, offsets in text_slices(b.column(at_text)):
                texts = []
                for i in range(end - at):
                    part = data[offsets[i] : offsets[i + 1]]
                    texts.append((part, any(map(str.isalpha, part.tobytes().decode("utf-8", "replace")))))
                best, score = infer(texts, logs, rounds, penalty)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at) for c in b.columns), pa.array([langs[x] if x >= 0 else "und" for x in best], pa.string()), pa.array(score, pa.float64())], [*plain, *into])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(plain, df.schema, strict=True)) + f", `{into[0]}` string, `{into[1]}` double"
    return df.toDF(*plain).mapInArrow(run, schema).toDF(*names, *into)


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Learns from the rows that aren't held out and adds held_out, lang_pred and score to every row."""
    df = df.withColumn("held_out", held_out(F.col(key)))
    return predict(df, train(df.where(~F.col("held_out")), text, lang, sample), text)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where(~F.col("held_out")))
    slim = predict(docs.select("doc_id", "held_out", "text"), model)
    return slim.select("doc_id", "held_out", "lang_pred", "score")
