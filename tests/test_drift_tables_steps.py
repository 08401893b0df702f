"""Drift between stores, relational tables, observed steps, saved models."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import drift as V
from framelake.operators import enrich as K
from framelake.sources import relational as R
from framelake.sources.shared import settled


def test_drift_descends_where_sides_differ(spark):
    left = spark.range(20_000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    right = left.where("k not in (5, 77)").withColumn("v", F.when(F.col("k") == 9, "w").otherwise(F.col("v"))).unionByName(spark.createDataFrame([(30_000, "v"), (8, "v"), (None, "v")], "k long, v string"))
    found = V.compare(left, right, "k", ["v"], fanout_bits=6)
    assert sorted((tuple(r) for r in found.rows.collect()), key=repr) == sorted([(5, 1, 0), (77, 1, 0), (9, 1, 1), (30_000, 0, 1), (8, 1, 2), (None, 0, 1)], key=repr)
    assert found.levels[0][0] == 64 and found.levels[0][1] <= 6 and found.levels[1][1] <= 6 and found.levels[1][0] <= 6 * 64
    same = V.compare(left, left, "k", ["v"])
    assert same.rows.count() == 0 and len(same.levels) == 1 and same.levels[0][1] == 0
    assert V.compare(left.where("false"), left.where("false"), "k").rows.count() == 0


@pytest.mark.parametrize("opened", [0, 3, 10_000])
def test_drift_against_dictionaries(spark, monkeypatch, opened):
    monkeypatch.setattr(V, "OPENED", opened)
    rng = random.Random(opened)
    a, b = ([(rng.choice(["x", "y", None]) and f"k{rng.randint(0, 60)}", rng.randint(0, 2)) for _ in range(150)] for _ in range(2))
    count = lambda rows: {k: sorted(v for q, v in rows if q == k) for k in {q for q, _ in rows}}
    ca, cb = count(a), count(b)
    want = {(k, len(ca.get(k, [])), len(cb.get(k, []))) for k in ca.keys() | cb.keys() if ca.get(k) != cb.get(k)}
    frame = lambda rows: spark.createDataFrame(rows, "k string, v long")
    assert {tuple(r) for r in V.compare(frame(a), frame(b), "k", ["v"], fanout_bits=3).rows.collect()} == want


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_table_goes_in_and_comes_back_in_parallel(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(1_000).select(F.when(F.col("id") % 97 != 0, F.col("id") * 3 - 500).alias("ID"), F.concat(F.lit("file "), "id").alias("PATH"), (F.col("id") % 5).cast("int").alias("KIND"))
    R.write_table(rows, url, "MEDIA_FILES", **DERBY)
    back = R.read_table(spark, url, "MEDIA_FILES", "ID", 6, **DERBY)
    assert back.rdd.getNumPartitions() == 6
    sizes = back.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) == 6 and max(r["count"] for r in sizes) < 300
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    filtered = back.where("KIND = 3").select("PATH")
    plan = filtered._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(KIND), *EqualTo(KIND,3)]" in plan and "ReadSchema: struct<PATH:string>" in plan
    assert filtered.count() == 200
    R.write_table(rows.where("false"), url, "NOTHING", **DERBY)
    assert R.read_table(spark, url, "NOTHING", "ID", **DERBY).count() == 0


@pytest.mark.parametrize(("low", "high", "n"), [(0, 9, 3), (-7, 7, 4), (5, 5, 8), (0, 2, 10)])
def test_ranges_share_out_all_rows(spark, low, high, n):
    data = spark.createDataFrame([(x,) for x in [None, *range(low - 3, high + 4)]], "id long")
    hits = [[r.id for r in data.where(c).collect()] for c in R.ranges("id", low, high, n)]
    assert sorted(sum(hits, []), key=str) == sorted([r.id for r in data.collect()], key=str)


def test_steps_tell_of_themselves(spark):
    """Metrics equal separate counts, and every row is worked on once."""
    worked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def count(x):
        worked.add(1)
        return None if x % 4 else "bad"

    steps = [("one", lambda d: d.withColumn("error", count("id"))), ("two", lambda d: d.withColumn("error", F.when(F.col("id") % 5 == 0, "worse"))), ("three", lambda d: d.withColumn("done", F.lit(True)))]
    out, told = K.run_observed_steps(spark.range(100), steps, settled)
    assert worked.value == 100
    assert [(t.name, t.rows, t.failed) for t in told] == [("one", 100, 25), ("two", 75, 15), ("three", 60, 0)] and all(t.seconds > 0 for t in told)
    rows = {r.id: (r.error, r.done) for r in out.collect()}
    assert len(rows) == 100 and rows[4] == ("bad", None) and rows[5] == ("worse", None) and rows[1] == (None, True)
    assert K.backfill_summary(told, skipped=7) == {"total": 107, "processed": 60, "skipped": 7, "failed": 40}
    _, none = K.run_observed_steps(spark.range(0), steps, settled)
    assert [(t.rows, t.failed) for t in none] == [(0, 0)] * 3
