"""Scorers and their records: probabilities, predictions, failures by row and by model."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.num import argmax, label_at, softmax, total
from foliant.functions.subwords import by_length
from foliant.functions.text import MIN_CHARS, clean_text

#: Word lists that stand in for a text model. Ties go to the first class.
LEXICON = {
    "en": "the and of to is on that by with for".split(),
    "fr": "le la des et un pour que dans du".split(),
    "de": "der die und das nicht sich ein für den auf".split(),
    "es": "el los las que en del una por con para".split(),
}
#: Letters that stand in for a layout model, by priority; else the first class.
CHARSET = (("de", "[äöüß]"), ("es", "[ñ¿¡áíóú]"), ("fr", "[çèêàé]"))
SHORT = "text is too short"


def lexicon_logits(words: Column, classes: list[str], lexicon: dict[str, list[str]] = LEXICON) -> Column:
    """Words of each class's list among the words of a text; give a column that holds them, so that they are cut once."""
    return F.array(*(F.size(F.filter(words, _among(lexicon[c]))).cast("double") for c in classes))


def _among(known: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(*known)


def charset_logits(text: Column, classes: list[str]) -> Column:
    """Two for the first class in priority order whose letters occur, zero for the others."""
    found = F.lit(classes[0])
    for name, letters in reversed(CHARSET):
        found = F.when(F.coalesce(text, F.lit("")).rlike(letters), name).otherwise(found)
    return F.transform(F.array(*map(F.lit, classes)), lambda c: F.when(c == found, 2.0).otherwise(0.0))


def records(df: DataFrame, model: str | Column, key: str, label: str, logits: Column, classes: list[str], error: Column | None = None, seconds: Column | None = None) -> DataFrame:
    """Evaluation records of one model. A row with an error is a failed record whose prediction is null; the others succeed."""
    failed = F.lit(None).cast("string") if error is None else error
    out = df.select((F.lit(model) if isinstance(model, str) else model).alias("model"), F.col(key).alias("document"), F.col(label).alias("true_label"), failed.alias("error_message"), logits.alias("_logits"), (F.lit(None).cast("double") if seconds is None else seconds).alias("_seconds"))
    out = out.withColumn("_p", F.when(F.col("error_message").isNull(), softmax(F.col("_logits"))))
    place = argmax(F.col("_p"))
    return out.select(
        "model",
        "document",
        "true_label",
        label_at(classes, place).alias("predicted_label"),
        F.array_max("_p").alias("confidence"),
        F.when(F.col("error_message").isNull(), F.col("_seconds")).alias("prediction_time_seconds"),
        F.when(F.col("error_message").isNull(), "success").otherwise("failed").alias("status"),
        "error_message",
        *(F.get("_p", F.lit(i)).alias(f"prob_{c}") for i, c in enumerate(classes)),
    )


def score_texts(df: DataFrame, key: str, label: str, text: str, classes: list[str], models: tuple[str, ...] = ("lexicon", "charset"), least: int = MIN_CHARS) -> DataFrame:
    """Records of the text models, all from one pass over the texts, which are cleaned once. A text that is too short fails."""
    own = df.select(key, label, F.col(text).alias("_text"), clean_text(F.col(text)).alias("_clean"))
    own = own.select(key, label, "_text", F.when(F.length("_clean") < least, SHORT).alias("_error"), F.when(F.col("_clean") == "", F.array().cast("array<string>")).otherwise(F.split(F.lower("_clean"), " ")).alias("_words"))
    logits = {"lexicon": lambda: lexicon_logits(F.col("_words"), classes), "charset": lambda: charset_logits(F.col("_text"), classes)}
    rows = own.select(key, label, "_error", F.inline(F.array(*(F.struct(F.lit(m).alias("_model"), logits[m]().alias("_scores")) for m in models))))
    return records(rows, F.col("_model"), key, label, F.col("_scores"), classes, F.col("_error"))


def score_lexicon(df: DataFrame, key: str, label: str, text: str, classes: list[str]) -> DataFrame:
    return score_texts(df, key, label, text, classes, ("lexicon",))


def score_charset(df: DataFrame, key: str, label: str, text: str, classes: list[str]) -> DataFrame:
    return score_texts(df, key, label, text, classes, ("charset",))


def centroids(df: DataFrame, vector: str, label: str, classes: list[str]) -> DataFrame:
    """Mean vector of each class, as one row with a list of lists in class order. As many numbers as classes times dimensions."""
    at = df.select(F.col(label).cast("string").alias("l"), F.posexplode(vector)).groupBy("l", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    rows = at.groupBy("l").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("c"))
    rows = rows.where(F.col("l").isin(*classes)).agg(F.map_from_entries(F.collect_list(F.struct("l", "c"))).alias("m"))
    return rows.select(F.array(*(F.try_element_at("m", F.lit(c)) for c in classes)).alias("centroids"))


def score_centroid(df: DataFrame, key: str, label: str, vector: str, classes: list[str], fitted: DataFrame | None = None) -> DataFrame:
    """The nearest class mean; logits are negative squared distances."""
    means = centroids(df, vector, label, classes) if fitted is None else fitted
    own = df.select(F.col(key).alias("_k"), F.col(label).cast("string").alias("_l"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("_v")).crossJoin(F.broadcast(means))
    logits = F.transform("centroids", lambda c: -total(F.zip_with(F.col("_v"), c, lambda a, b: (a - b) * (a - b))))
    return records(own, "centroid", "_k", "_l", logits, classes)


_LOADED: dict[str, Callable[[object], list[float]]] = {}


@dataclass(frozen=True)
class Provider:
    """A model outside the engine. load() gives a function from a text or other input to a list of class scores; with batch, from a list of up
    to so many inputs to their lists of scores."""

    name: str
    load: Callable[[], Callable] = field(compare=False)
    batch: int | None = None
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def model(self) -> Callable:
        """The loaded model; a worker process keeps it for its later tasks."""
        if self.token not in _LOADED:
            _LOADED[self.token] = self.load()
        return _LOADED[self.token]

    def judge(self, inputs: list, width: int) -> list[tuple[list[float] | None, str | None, float]]:
        """(scores, error, seconds) of each input. A batch that fails is halved until the failing inputs stand alone; a batch's time is dealt evenly."""
        began = time.perf_counter()
        try:
            found = [self.model()(inputs[0])] if self.batch is None else list(self.model()(inputs))
            if len(found) != len(inputs):
                raise ValueError(f"{len(found)} answers for {len(inputs)} inputs")
            found = [[float(v) for v in f] for f in found]
            if wrong := next((len(f) for f in found if len(f) != width), None):
                raise ValueError(f"{wrong} scores for {width} classes")
            took = (time.perf_counter() - began) / len(inputs)
            return [(f, None, took) for f in found]
        except Exception as e:
            if len(inputs) == 1:
                return [(None, f"{type(e).__name__}: {e}", time.perf_counter() - began)]
            half = len(inputs) // 2
            return self.judge(inputs[:half], width) + self.judge(inputs[half:], width)


def _size(x: object) -> int:
    return len(x) if hasattr(x, "__len__") else 0


def score_provider(df: DataFrame, provider: Provider, key: str, label: str, column: str, classes: list[str]) -> DataFrame:
    """Two levels of failure: an error on a row fails that row; an error on loading fails every row of the model.

    Loading is tried once on the driver, so that no part of a model's rows succeeds where another part could not load it. Workers
    load once for each process; the time is that of the scoring alone. A provider with batch gets the rows of an Arrow batch in lists of like length
    (longest first), so that it pads little.
    """
    try:
        provider.model()
    except Exception as e:
        return records(df, provider.name, key, label, F.array(*(F.lit(0.0) for _ in classes)), classes, F.lit(f"{type(e).__name__}: {e}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            inputs = b["x"].tolist()
            found: list = [None] * len(inputs)
            for places in by_length(inputs, _size, provider.batch or 1):
                for i, answer in zip(places, provider.judge([inputs[i] for i in places], len(classes)), strict=True):
                    found[i] = answer
            logits, errors, took = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
            yield pd.DataFrame({"k": b["k"], "l": b["l"], "logits": logits, "error": errors, "seconds": took})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, label)}
    scored = df.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(column).alias("x")).mapInPandas(run, f"k {kinds[key]}, l {kinds[label]}, logits array<double>, error string, seconds double")
    return records(scored, provider.name, "k", "l", F.col("logits"), classes, F.col("error"), F.col("seconds"))


def recorded(records_df: DataFrame, path: str) -> tuple[DataFrame, dict]:
    """Writes the records and returns them read back, with totals: documents, processed, failed, and seconds of prediction.

    The models run once: the totals are summed over two columns of the written table. (An observation on the plan would save that small scan, but
    a session with one can't run Spark ML afterwards, as its closures hold the session.)
    """
    records_df.write.parquet(path)
    back = records_df.sparkSession.read.schema(records_df.schema).parquet(path)
    ok = F.col("status") == "success"
    totals = back.agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(ok, 1)).alias("processed"), F.count(F.when(~ok, 1)).alias("failed"), F.coalesce(F.sum("prediction_time_seconds"), F.lit(0.0)).alias("seconds")).first()
    return back, totals.asDict()


def ranked(records_df: DataFrame, classes: list[str]) -> DataFrame:
    """One row for each record and class by falling probability; ties keep the class order."""
    pairs = F.array(*(F.struct((-F.col(f"prob_{c}")).alias("o"), F.lit(i).alias("i"), F.lit(c).alias("class"), F.col(f"prob_{c}").alias("p")) for i, c in enumerate(classes)))
    out = records_df.where(F.col("status") == "success").select("model", "document", F.posexplode(F.array_sort(pairs)))
    return out.select("model", "document", (F.col("pos") + 1).alias("rank"), F.col("col.class").alias("class"), F.col("col.p").alias("probability"))


def canonical_probabilities(found: Column, classes: list[str]) -> Column:
    """A list of (class, probability) on the class axis: missing classes 0, unknown ones dropped, the last of repeats counts."""
    own = lambda c: F.filter(found, lambda x: x["class"] == c)
    return F.array(*(F.coalesce(F.try_element_at(F.transform(own(c), lambda x: x["probability"].cast("double")), F.lit(-1)), F.lit(0.0)) for c in classes))
