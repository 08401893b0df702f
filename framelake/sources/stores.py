"""Keyed changes of tables, pages of rows, and typed readers of side files. Store keeps a table that changes on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .keyed_store import KeyedStore as Store  # noqa: F401

SENSOR_SCHEMA = "timestamp timestamp, heart_rate_bpm double, activity_level string, stress_index double"
DETECTION_SCHEMA = "id string, yolo_labels array<string>, yolo_object_count int, yolo_model string"
QUESTION_SCHEMA = "id string, question string, ground_truth string, relevant_file_ids array<string>"


def read_sensor_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SENSOR_SCHEMA).option("header", True).csv(path)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DETECTION_SCHEMA).option("multiLine", True).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION_SCHEMA).option("multiLine", True).json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """base with the rows of changes in place of those that share their keys; of changes that share a key the first in
    the order stays. Columns that only one side has are null on the other."""
    newest = latest(changes, keys, order) if order else changes.dropDuplicates(keys)
    return base.join(newest.select(*keys), keys, "left_anti").unionByName(newest, allowMissingColumns=True)


def delete(base: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return base.join(keys.select(*on).distinct(), on, "left_anti")


def set_columns(base: DataFrame, condition: Column, **values: object) -> DataFrame:
    """The named columns set where the condition holds; None clears them. Other rows and columns stay."""
    hit = F.coalesce(condition, F.lit(False))
    return base.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def scroll(table: DataFrame, condition: Column, columns: list[str], offset: int | None = None, limit: int = 100, key: str = "id", vectors: str | None = None) -> tuple[DataFrame, int | None]:
    """One page of the rows that hold: the key, the named columns (and the vectors, if their column is named) of the first
    rows from the offset on, in the order of the key; and the key that the next page starts from, None at the end. The
    order is by key, so a page costs one filtered scan that keeps limit + 1 rows a task, wherever it stands."""
    wanted = table.where(condition if offset is None else condition & (F.col(key) >= offset))
    rows = wanted.select(key, *columns, *([vectors] if vectors else [])).orderBy(key)
    ends = rows.select(key).limit(limit + 1).agg(F.count("*").alias("n"), F.max(key).alias("last")).first()
    more = ends.n > limit
    return rows.limit(limit), (ends.last if more else None)


def lookup(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_semi")
