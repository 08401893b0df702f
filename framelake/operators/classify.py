"""Phase classification with MLlib: features, training, prediction."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import date_from_name
from ..sources.shared import settled
from .joins import PHASES


def with_class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight = n / (classes * n of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"), F.count("*").alias("__k"))
    return rows.join(counts.crossJoin(F.broadcast(total)), label).withColumn("weight", F.col("__total") / (F.col("__k") * F.col("__n"))).drop("__n", "__total", "__k")


def training_rows(rows: DataFrame, label: str, vector: str, tags: str | None = None) -> DataFrame:
    """The rows that a forest meets, with weights and doubles in __v: worked out once, then one part for each core. Every
    part hands over counts of its own for every node that is split, so these grow with the parts and not with the rows."""
    spark = rows.sparkSession
    data = settled(with_class_weights(rows.select(label, vector, *([tags] if tags else [])), label))
    parts = data.repartition(spark.sparkContext.defaultParallelism)
    return parts.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def train(rows: DataFrame, label: str = "label", vector: str = "vector", tags: str | None = None, trees: int = 200, depth: int = 12, seed: int = 42) -> PipelineModel:
    """A forest over vectors and, if given, multi-hot tags; classes weigh alike. Every row keeps the node that it has reached
    in each tree: otherwise it walks down all trees again at every level, and their nodes fit no processor's cache. The
    trees are the same either way."""
    data = training_rows(rows, label, vector, tags)
    index = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc").fit(data)
    stages: list = [index]
    inputs = ["__v"]
    if tags:
        stages.append(CountVectorizer(inputCol=tags, outputCol="__tags", binary=True))
        inputs.append("__tags")
    stages += [VectorAssembler(inputCols=inputs, outputCol="features"), RandomForestClassifier(labelCol="__label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True), IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)]
    return Pipeline(stages=stages).fit(data)


def save_model(model: PipelineModel, path: str) -> None:
    """The fitted pipeline with its labels, in place of what the folder held."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, rows: DataFrame, vector: str = "vector", review_below: float = 0.85) -> DataFrame:
    """rows with predicted, confidence and needs_review."""
    data = rows.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    if "label" not in data.columns:
        data = data.withColumn("label", F.lit(None).cast("string"))
    steps = PipelineModel([s for s in model.stages if type(s).__name__ != "StringIndexerModel"])
    out = steps.transform(data).withColumn("confidence", F.array_max(vector_to_array("probability")))
    return out.withColumn("needs_review", F.col("confidence") < review_below).select(*rows.columns, "predicted", "confidence", "needs_review")


def prediction_scope(rows: DataFrame, path_text: str, first: str = PHASES[0][1], last: str = PHASES[-1][2]) -> DataFrame:
    """Rows under a path text whose file name carries a date among the phases, both ends included. Unlike in training no
    other date stands in for one that is missing."""
    day = date_from_name(F.col("file_path"))
    return rows.where(F.col("file_path").contains(path_text) & day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def apply_predictions(frames: DataFrame, predictions: DataFrame) -> DataFrame:
    """Old labels cleared everywhere, new ones set where there is a prediction."""
    new = predictions.select("id", F.col("predicted").alias("construction_phase"), F.round("confidence", 4).alias("phase_confidence"), F.col("needs_review").alias("phase_needs_review"))
    return frames.drop("construction_phase", "phase_confidence", "phase_needs_review").join(new, "id", "left")
