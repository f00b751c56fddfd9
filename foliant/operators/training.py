"""Trained stand-ins on Spark ML, training history, checkpoints and early stopping."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators.scoring import records
from foliant.sources.files import exists


def text_pipeline(classes: list[str], label: str = "label", text: str = "text", features: int = 1 << 15, rounds: int = 20) -> Pipeline:
    """Words, hashed counts, inverse document frequencies, multinomial logistic regression. Class order is the given one."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+", toLowercase=True),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="features"),
            LogisticRegression(featuresCol="features", labelCol="class_id", maxIter=rounds, regParam=0.01, family="multinomial"),
        ]
    )


def with_class_id(df: DataFrame, classes: list[str], label: str) -> DataFrame:
    """Adds class_id (double, from 0); rows of unknown labels go."""
    return df.withColumn("class_id", (F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1).cast("double")).where("class_id >= 0")


def train_text(df: DataFrame, classes: list[str], label: str, text: str, **settings) -> PipelineModel:
    return text_pipeline(classes, label, text, **settings).fit(with_class_id(df.withColumn(text, F.coalesce(F.col(text), F.lit(""))), classes, label))


def train_vectors(df: DataFrame, classes: list[str], label: str, vector: str, rounds: int = 50) -> PipelineModel:
    """A linear head over fixed feature vectors."""
    own = with_class_id(df.withColumn(label, F.col(label).cast("string")), classes, label).withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return Pipeline(stages=[LogisticRegression(featuresCol="features", labelCol="class_id", maxIter=rounds, family="multinomial")]).fit(own)


def train_layout(df: DataFrame, classes: list[str], label: str, text: str, statistics: list[str], features: int = 1 << 14, rounds: int = 20) -> PipelineModel:
    """Text features and aggregated box statistics side by side."""
    stages = text_pipeline(classes, label, text, features, rounds).getStages()
    stages[2] = IDF(inputCol="_tf", outputCol="_idf")
    stages.insert(3, VectorAssembler(inputCols=["_idf", *statistics], outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages).fit(with_class_id(df.withColumn(text, F.coalesce(F.col(text), F.lit(""))), classes, label))


def predict(model: PipelineModel, df: DataFrame, name: str, key: str, label: str, classes: list[str]) -> DataFrame:
    """Evaluation records of a fitted pipeline; the class count is validated."""
    last = model.stages[-1]
    if last.numClasses > len(classes):
        raise ValueError(f"the model has {last.numClasses} classes, {len(classes)} are named")
    scored = model.transform(df).withColumn("_scores", F.transform(vector_to_array("probability"), lambda p: F.log(F.greatest(p, F.lit(1e-300)))))
    padded = F.concat("_scores", F.array_repeat(F.lit(-1e9), len(classes) - last.numClasses))
    return records(scored, name, key, label, padded, classes)


def save_checkpoint(model: PipelineModel, path: str, epoch: int, classes: list[str], f1: float) -> None:
    """The model with a sidecar table of epoch, classes and validation F1."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    spark.range(1).select(F.lit(json.dumps({"epoch": epoch, "classes": classes, "validation_macro_f1": f1})).alias("value")).write.mode("overwrite").text(f"{path}/about")


def inspect_checkpoint(spark, path: str) -> tuple[PipelineModel, dict]:
    """The model and what is known of it, for either layout: a model with its sidecar, or a bare saved model.

    The last stage must have a coefficient for each class and feature; else ValueError.
    """
    if exists(spark, f"{path}/about"):
        about = {"type": "training_checkpoint", **json.loads(spark.read.text(f"{path}/about").first()[0])}
        model = PipelineModel.load(f"{path}/model")
    else:
        about, model = {"type": "bare_model", "classes": None}, PipelineModel.load(path)
    last = model.stages[-1]
    if not hasattr(last, "coefficientMatrix"):
        raise ValueError("the checkpoint's last stage has no coefficients")
    weights = last.coefficientMatrix
    about |= {"outputs": last.numClasses, "inputs": last.numFeatures, "weight_shape": [weights.numRows, weights.numCols]}
    if about["classes"] is not None and len(about["classes"]) < last.numClasses:
        raise ValueError(f"{last.numClasses} outputs for {len(about['classes'])} classes")
    return model, about


def load_checkpoint(spark, path: str, classes: list[str]) -> PipelineModel:
    """The model of a checkpoint. Where it names its classes, they must be the given ones in their order; else their number must do."""
    model, about = inspect_checkpoint(spark, path)
    if about["classes"] is not None and about["classes"] != classes:
        raise ValueError(f"classes of the checkpoint: {about['classes']}")
    if about["outputs"] > len(classes):
        raise ValueError(f"the checkpoint has {about['outputs']} outputs, {len(classes)} classes are named")
    return model


def best_epochs(history: DataFrame, value: str = "validation_macro_f1") -> DataFrame:
    """Adds improved: the value beats all epochs before, -1 at first."""
    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("improved", F.col(value) > F.greatest(F.lit(-1.0), F.coalesce(F.max(value).over(before), F.lit(-1.0))))


def early_stop(history: DataFrame, value: str = "validation_macro_f1", patience: int = 2) -> DataFrame:
    """The epochs that run until so many in a row don't improve; the history is one row by epoch, so one window is enough."""
    upto = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    out = best_epochs(history, value).withColumn("_run", F.sum(F.col("improved").cast("int")).over(upto))
    out = out.withColumn("stale", F.sum((~F.col("improved")).cast("int")).over(Window.partitionBy("_run").orderBy("epoch")))
    stopped = F.max((F.col("stale") >= patience).cast("int")).over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("_over", F.coalesce(stopped, F.lit(0))).where("_over = 0").drop("_over", "_run")


def weighted_loss(batches: DataFrame) -> DataFrame:
    """Mean loss and accuracy by epoch over batches (epoch, loss, hits, size), weighted by size."""
    return batches.groupBy("epoch").agg((F.sum(F.col("loss") * F.col("size")) / F.sum("size")).alias("train_loss"), (F.sum("hits") / F.sum("size")).alias("train_accuracy"))
