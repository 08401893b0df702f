"""The rows that a forest is trained on: one part for each core, worked out once."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from framelake.operators import classify as M


def test_parts_follow_the_cores(spark):
    """However many parts the rows come in, training meets as many as there are cores, with every row and its weight."""
    rows = spark.range(0, 600, 1, 97).select("id", F.concat(F.lit("g"), F.col("id") % 3 % 2).alias("label"), F.array(F.col("id").cast("float"), F.lit(1.5).cast("float")).alias("vector"))
    data = M.training_rows(rows, "label", "vector")
    assert data.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert "Join" not in data._jdf.queryExecution().optimizedPlan().toString()  # each pass reads rows that are worked out
    got = sorted((r.vector[0], r.label, r.weight, list(r["__v"])) for r in data.collect())
    assert got == [(float(i), f"g{i % 3 % 2}", 600 / (2 * (200 if i % 3 % 2 else 400)), [float(i), 1.5]) for i in range(600)]


def test_trees_split_alike_whatever_the_parts(spark):
    rows = spark.range(400).select("id", F.when(F.col("id") < 150, "low").otherwise("high").alias("label"), F.array(F.col("id").cast("float")).alias("vector"))
    for parts in (1, 40):
        said = M.predict(M.train(rows.repartition(parts, "id"), trees=10, depth=4), rows).select("id", "label", "predicted").collect()
        assert len(said) == 400 and sum(r.label == r.predicted for r in said) >= 395


def test_rows_keep_their_nodes(spark, monkeypatch):
    """Rows do not walk down the trees again at every level, through more passes than one checkpoint covers, and the trees
    are those of rows that do."""
    rows = spark.range(900).select(F.when(F.col("id") * 7919 % 101 < 40, "low").otherwise("high").alias("label"), F.array(F.col("id").cast("float"), (F.col("id") * 31 % 97).cast("float"), (F.col("id") * 17 % 89).cast("float")).alias("vector"))
    data = M.training_rows(rows, "label", "vector").cache()
    monkeypatch.setattr(M, "training_rows", lambda *_: data)
    model = M.train(rows, trees=12, depth=12)
    forest = model.stages[-2]
    assert forest.getCacheNodeIds()
    ready = data
    for stage in model.stages[:-2]:
        ready = stage.transform(ready)
    plain = RandomForestClassifier(labelCol="__label", featuresCol="features", weightCol="weight", numTrees=12, maxDepth=12, seed=42).fit(ready)
    assert max(t.depth for t in forest.trees) == 12 and forest.toDebugString.split("\n", 1)[1] == plain.toDebugString.split("\n", 1)[1]
