"""A training loop over DataFrames: seeded mini-batches, accumulated and clipped gradients, AdamW, history, best checkpoint, early stop."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import clean_text
from foliant.operators.tables import HISTORY, literal_table
from foliant.session import shared_dir

#: Rows of sums beside the gradient's entries.
LOSS, HITS, SIZE = -1, -2, -3
FEATURES = "document bigint, y int, split string, at array<int>, x array<double>"


@dataclass(frozen=True)
class Settings:
    """batch: documents of a mini-batch, about; accumulation: batches whose gradients make one step; norm: the longest step gradient."""

    batch: int = 64
    accumulation: int = 2
    epochs: int = 6
    rate: float = 0.02
    decay: float = 0.01
    norm: float = 1.0
    patience: int = 2
    seed: int = 42
    dim: int = 1 << 12


def features(df: DataFrame, key: str, label: str, text: str, split: str, classes: list[str], dim: int) -> DataFrame:
    """(document, y, split, at, x): places and values of the hashed words of each whole text, log(1 + count) scaled to unit length.

    Words are cut from the cleaned text in lower case and hashed in the JVM; counts are taken in Arrow batches. Rows of unknown labels go; a
    text without words has no places.
    """
    words = F.split(F.lower(clean_text(F.col(text))), " ")
    buckets = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(dim)).cast("int"))
    own = df.select(F.col(key).cast("bigint").alias("document"), (F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1).cast("int").alias("y"), F.col(split).alias("split"), buckets.alias("at"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            row = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy(zero_copy_only=False))
            pairs, n = np.unique(row * dim + lists.flatten().to_numpy(), return_counts=True)
            row, x = pairs // dim, np.log1p(n)
            x /= np.sqrt(np.bincount(row, x * x, len(b)))[row]
            offsets = pa.array(np.searchsorted(row, np.arange(len(b) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(offsets, pa.array((pairs % dim).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(x))], ["document", "y", "split", "at", "x"])

    return own.where("y >= 0 and document is not null").mapInArrow(count, FEATURES)


def batch_of(settings: Settings, epoch: int, batches: int) -> Column:
    """The mini-batch of a document in an epoch, from 0: a hash of seed, epoch and document, so that every engine deals alike."""
    mark = F.md5(F.concat_ws(":", F.lit(str(settings.seed)), F.lit(str(epoch)), F.col("document").cast("string")))
    return F.pmod(F.conv(F.substring(mark, 1, 12), 16, 10).cast("bigint"), F.lit(batches)).cast("int")


#: A document's entries as bytes, as a step reads them: places and values side by side.
ENTRY = np.dtype([("at", "<i4"), ("x", "<f8")])
PACKED = "document bigint, y int, cells binary"


def packed(rows: DataFrame) -> DataFrame:
    """(document, y, cells) of feature rows: the lists as the bytes of ENTRY, which tables and tasks move whole and not number by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("at")
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            entries = np.empty(int(n.sum()), ENTRY)
            entries["at"], entries["x"] = lists.flatten().to_numpy(), b.column("x").flatten().to_numpy()
            offsets = np.concatenate(([0], np.cumsum(n) * ENTRY.itemsize)).astype(np.int32)
            cells = pa.BinaryArray.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("document"), b.column("y"), cells], ["document", "y", "cells"])

    return rows.select("document", "y", "at", "x").mapInArrow(run, PACKED)


def _entries(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of each entry of feature rows or packed ones."""
    if "cells" not in b.schema.names:
        lists = b.column("at")
        return np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(), b.column("x").flatten().to_numpy()
    cells = b.column("cells")
    ends = np.frombuffer(cells.buffers()[1], np.int32, len(b) + 1, cells.offset * 4)
    own = np.frombuffer(cells.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(ENTRY)
    return np.repeat(np.arange(len(b)), np.diff(ends) // ENTRY.itemsize), own["at"].astype(np.int64), np.ascontiguousarray(own["x"])


def _softmax(b: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y, probabilities, row, place and value of each entry); the last weight of a class is its constant."""
    y, (row, at, x) = b.column("y").to_numpy(), _entries(b)
    scores = np.stack([np.bincount(row, x * w[at], len(b)) + w[-1] for w in weights], axis=1)
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return y, p / p.sum(axis=1, keepdims=True), row, at, x


def _gradients(shared):
    """Of one task: for each mini-batch the sums of the gradient's entries that aren't 0, of the loss, of the hits and of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        held: dict[int, tuple[np.ndarray, list[float]]] = {}
        for b in batches:
            y, p, row, at, x = _softmax(b, weights)
            loss, hit, number = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)), p.argmax(axis=1) == y, b.column("batch").to_numpy()
            p[np.arange(len(y)), y] -= 1
            for k in np.unique(number).tolist():
                grad, sums = held.setdefault(k, (np.zeros_like(weights), [0.0, 0.0, 0.0]))
                own = number == k
                entry = own[row]
                for c in range(len(weights)):
                    grad[c, :-1] += np.bincount(at[entry], x[entry] * p[row[entry], c], grad.shape[1] - 1)
                    grad[c, -1] += p[own, c].sum()
                for i, v in enumerate((loss[own].sum(), hit[own].sum(), own.sum())):
                    sums[i] += float(v)
        for k, (grad, sums) in held.items():
            place = np.flatnonzero(grad)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place) + 3, k, np.int32)), pa.array(np.concatenate((place, [LOSS, HITS, SIZE])).astype(np.int32)), pa.array(np.concatenate((grad.ravel()[place], sums)))], ["batch", "place", "value"])

    return run


def step_sums(rows: DataFrame, weights: np.ndarray) -> dict[int, tuple[np.ndarray, float, float, float]]:
    """For each mini-batch of the rows: gradient, loss, hits and size as sums over its documents.

    Tasks sum in place and send their entries, which are summed by batch and place; the driver gets at most as many as the step's batches have weights.
    """
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    sums = rows.mapInArrow(_gradients(shared), "batch int, place int, value double").groupBy("batch", "place").agg(F.sum("value").alias("value")).toArrow()
    batch, place, value = (sums[c].to_numpy() for c in ("batch", "place", "value"))
    out = {}
    for k in sorted(set(batch.tolist())):
        own = batch == k
        grad, at = np.zeros(weights.size), place[own] >= 0
        grad[place[own][at]] = value[own][at]
        rest = dict(zip(place[own][~at].tolist(), value[own][~at].tolist(), strict=True))
        out[k] = grad.reshape(weights.shape), rest[LOSS], rest[HITS], rest[SIZE]
    shared.destroy()
    return out


class AdamW:
    """Adam with decoupled decay and bias correction. The weights are the model's and so bounded; they live on the driver."""

    def __init__(self, shape: tuple[int, ...], rate: float, decay: float, one: float = 0.9, two: float = 0.999, least: float = 1e-8):
        self.rate, self.decay, self.one, self.two, self.least = rate, decay, one, two, least
        self.m, self.v, self.t = np.zeros(shape), np.zeros(shape), 0

    def step(self, weights: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = self.one * self.m + (1 - self.one) * grad
        self.v = self.two * self.v + (1 - self.two) * grad * grad
        m, v = self.m / (1 - self.one**self.t), self.v / (1 - self.two**self.t)
        return weights * (1 - self.rate * self.decay) - self.rate * m / (np.sqrt(v) + self.least)


def clipped(grad: np.ndarray, norm: float) -> np.ndarray:
    """The gradient, scaled down where its length exceeds norm."""
    long = float(np.sqrt((grad * grad).sum()))
    return grad * min(1.0, norm / (long + 1e-6))


def evaluate(rows: DataFrame, weights: np.ndarray) -> dict:
    """loss, accuracy, macro precision, recall and F1 over all rows (0.0 without rows); only the counts by true and predicted class reach the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shared.value)
        count, loss = np.zeros(k * k, np.int64), 0.0
        for b in batches:
            y, p, *_ = _softmax(b, shared.value)
            count += np.bincount(y * k + p.argmax(axis=1), minlength=k * k)
            loss += float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, k * k, dtype=np.int32)), pa.array(np.concatenate(([loss], count)))], ["cell", "n"])

    k = len(weights)
    cells = {r.cell: r.n for r in rows.mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    shared.destroy()
    table = np.array([cells.get(i, 0.0) for i in range(k * k)]).reshape(k, k)
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    hit, n = np.diag(table), table.sum()
    precision, recall = ratio(hit, table.sum(axis=0)), ratio(hit, table.sum(axis=1))
    f1 = ratio(2 * precision * recall, precision + recall)
    return {"loss": cells.get(-1, 0.0) / n if n else 0.0, "accuracy": float(hit.sum() / n) if n else 0.0, "macro_precision": float(precision.mean()), "macro_recall": float(recall.mean()), "macro_f1": float(f1.mean())}


def save_weights(spark: SparkSession, path: str, weights: np.ndarray, about: dict) -> None:
    """A checkpoint: a row for each class and place whose weight isn't 0, and a sidecar."""
    c, at = np.nonzero(weights)
    table = pa.table({"class_id": pa.array(c.astype(np.int32)), "place": pa.array(at.astype(np.int32)), "weight": pa.array(weights[c, at])})
    spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/weights")
    spark.range(1).select(F.lit(json.dumps(about | {"shape": list(weights.shape)})).alias("value")).write.mode("overwrite").text(f"{path}/about")


def load_weights(spark: SparkSession, path: str, classes: list[str]) -> tuple[np.ndarray, dict]:
    """The weights and what is known of them. The classes must be the given ones in their order."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    if about["classes"] != classes:
        raise ValueError(f"classes of the checkpoint: {about['classes']}")
    weights = np.zeros(about["shape"])
    t = spark.read.parquet(f"{path}/weights").toArrow()
    weights[t["class_id"].to_numpy(), t["place"].to_numpy()] = t["weight"].to_numpy()
    return weights, about


@dataclass
class Run:
    """A finished run: one row of history for each epoch that ran, the folder of the best checkpoint and its epoch."""

    history: list[dict]
    best: str
    best_epoch: int

    def table(self, spark: SparkSession) -> DataFrame:
        return literal_table(spark, self.history, HISTORY)


def train(rows: DataFrame, classes: list[str], settings: Settings = Settings(), path: str | None = None) -> Run:
    """Softmax regression on the rows of split train, judged on those of split validation after each epoch.

    rows: what ``features`` gives, as a written table; the rows of either split are packed and dealt evenly once. An epoch deals its documents by a seeded hash into
    n / batch mini-batches and writes them in folders by step, so that a step reads its own rows only; each task deals its rows where they are, without
    a shuffle, and a step has as many tasks as its files fill. The gradient of a step is the sum of its batches' mean gradients, each divided by
    accumulation (the last step of an epoch may have fewer batches), clipped, and given to AdamW. train_loss and train_accuracy are weighted by batch size,
    with each batch judged before the step that it is part of. An epoch whose macro F1 beats all before writes the checkpoint; after
    ``patience`` epochs in a row that don't, training ends. Tables and checkpoints lie in the shared folder, so a lost executor costs its tasks.
    Without training rows ValueError; without validation rows all its measures are 0.
    """
    spark = rows.sparkSession
    root = path or f"{shared_dir(spark)}/training-{uuid.uuid4().hex}"
    n = rows.where("split = 'train'").count()
    if not n:
        raise ValueError("no training rows")
    # Dealt evenly once, whatever the files of the given table; every epoch and step has as many tasks then.
    parts = max(1, n // 20_000, min(spark.sparkContext.defaultParallelism, n // 500))
    for part in ("train", "validation"):
        packed(rows.where(F.col("split") == part)).repartition(parts, F.xxhash64("document")).write.mode("overwrite").parquet(f"{root}/{part}")
    own, judged = (spark.read.schema(PACKED).parquet(f"{root}/{part}") for part in ("train", "validation"))
    batches = -(-n // settings.batch)
    steps = -(-batches // settings.accumulation)
    weights = np.zeros((len(classes), settings.dim + 1))
    optimiser = AdamW(weights.shape, settings.rate, settings.decay)
    history, best, best_epoch, stale = [], -1.0, 0, 0
    for epoch in range(1, settings.epochs + 1):
        batch = batch_of(settings, epoch, batches)
        dealt = own.select("y", "cells", batch.alias("batch")).withColumn("step", F.floor(F.col("batch") / settings.accumulation).cast("int"))
        dealt.write.mode("overwrite").partitionBy("step").parquet(f"{root}/epoch-{epoch}")
        written = spark.read.schema("y int, cells binary, batch int, step int").parquet(f"{root}/epoch-{epoch}")
        loss = hits = seen = 0.0
        for step in range(steps):
            sums = step_sums(written.where(F.col("step") == step), weights)
            if not sums:
                continue
            grad = sum(g / size for g, _, _, size in sums.values()) / settings.accumulation
            loss, hits, seen = (a + sum(s[i] for s in sums.values()) for a, i in ((loss, 1), (hits, 2), (seen, 3)))
            weights = optimiser.step(weights, clipped(grad, settings.norm))
        _remove(spark, f"{root}/epoch-{epoch}")
        found = evaluate(judged, weights)
        history.append({"epoch": epoch, "train_loss": loss / seen, "train_accuracy": hits / seen, **{f"validation_{k}": v for k, v in found.items()}})
        if found["macro_f1"] > best:
            best, best_epoch, stale = found["macro_f1"], epoch, 0
            save_weights(spark, f"{root}/best", weights, {"epoch": epoch, "classes": classes, "validation_macro_f1": best, "settings": asdict(settings)})
        else:
            stale += 1
            if stale >= settings.patience:
                break
    for part in ("train", "validation"):
        _remove(spark, f"{root}/{part}")
    return Run(history, f"{root}/best", best_epoch)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def predict(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """(document, y, scores): the logarithms of the class probabilities of feature rows."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, p, *_ = _softmax(b, shared.value)
            yield pa.RecordBatch.from_arrays([b.column("document"), b.column("y"), pa.array(list(np.log(np.maximum(p, 1e-300))), pa.list_(pa.float64()))], ["document", "y", "scores"])

    return rows.mapInArrow(run, "document bigint, y int, scores array<double>")
