"""The index by cells: the exhaustive search's rows, from fewer cells where vectors cluster."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import cell_index as X
from framelake.operators import search as S


def rows(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in df.collect())


def clustered(spark, n=3_000, groups=40, d=16, seed=3, first=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, d))
    made = middles[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, d))
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(made)], "id long, vector array<float>")


def asked(frames, every):
    return frames.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))


def test_same_rows_from_few_cells(spark, tmp_path):
    frames = clustered(spark)
    index = X.CellIndex.build(frames, str(tmp_path / "i"), cells=48)
    for k, threshold in ((10, 0.3), (100, 0.9), (3, -1.0)):
        q = asked(frames, 100)
        found = index.search(q, k, threshold)
        assert rows(found.hits) == rows(S.cosine_topk(frames, q, k, threshold))
        share = found.visits.count() / (q.count() * found.cells)
        assert share < 0.5, (k, threshold, share)
    # The folders of cells that nobody visits are not opened.
    plan = index.rows([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell), ", "")


def test_insertion_without_a_fit(spark, tmp_path):
    frames, more = clustered(spark, 800), clustered(spark, 400, seed=9, first=10_000)
    index = X.CellIndex.build(frames, str(tmp_path / "i"), cells=16)
    before = index.centres()
    index.insert(more)
    moved = frames.where("id < 50").select("id", F.transform("vector", lambda x: -x).alias("vector"))
    index.insert(moved)
    assert np.array_equal(before, index.centres()) and len(index.batches()) == 3
    now = frames.where("id >= 50").unionByName(more).unionByName(moved)
    assert sorted(r.id for r in index.rows().collect()) == sorted(r.id for r in now.collect())
    assert sum(r.n for r in index.facts().collect()) == 1_250
    q = asked(now, 90)
    assert rows(index.search(q, 12, 0.1).hits) == rows(S.cosine_topk(now, q, 12, 0.1))


@pytest.mark.parametrize("threshold", [0.2, 0.0, -1.0])
def test_odd_vectors(spark, tmp_path, threshold):
    """Zero vectors, other dimensions, nulls and repeated queries, as the exhaustive search has them."""
    rng = np.random.default_rng(0)
    vector = lambda d: [float(x) for x in rng.normal(size=d)]
    data = [(i, vector(6)) for i in range(150)] + [(150 + i, vector(3)) for i in range(20)] + [(200, [0.0] * 6), (201, None), (202, []), (203, [0.0] * 3)]
    frames = spark.createDataFrame(data, "id long, vector array<float>")
    queries = [(1, vector(6)), (2, vector(3)), (3, None), (4, []), (5, vector(4)), (6, [0.0] * 6), (7, [0.0] * 3)]
    q = spark.createDataFrame(queries, "query_id long, query_vector array<float>")
    index = X.CellIndex.build(frames, str(tmp_path / "i"), cells=10)
    assert rows(index.search(q, 5, threshold).hits) == rows(S.cosine_topk(frames, q, 5, threshold))


def test_empty_index(spark, tmp_path):
    frames = clustered(spark, 60)
    index = X.CellIndex.build(frames.where("false"), str(tmp_path / "i"))
    assert index.search(asked(frames, 20)).hits.count() == 0
    index.insert(frames)
    q = asked(frames, 20)
    assert rows(index.search(q, 5, 0.0).hits) == rows(S.cosine_topk(frames, q, 5, 0.0))  # all in the odd cell, still exact
    assert index.search(q.where("false")).hits.count() == 0


def test_many_queries_stream_past_the_frames(spark, monkeypatch):
    """Above the broadcast bound, in several parts and turns, the rows are the same."""
    frames = clustered(spark, 700, d=8)
    q = asked(frames, 3)
    want = rows(S.cosine_topk(frames, q, 7, 0.2))
    monkeypatch.setattr(S, "BROADCAST_QUERIES", 10)
    monkeypatch.setattr(S, "PART_ROWS", 150)
    monkeypatch.setattr(S, "TURN_QUERIES", 100)
    monkeypatch.setattr(S, "CELLS", 5_000)
    assert rows(S.cosine_topk(frames, q, 7, 0.2)) == want


def test_projections_reach_their_recall(spark, sf):
    """From a cosine of 0.4 on, random projections find nine tenths of the exact search's rows; below their distance none."""
    from framelake.sources.tables import frames, query_vectors

    at = sf.replace("sf0.001", "sf0.01")
    f, q = frames(spark, at), query_vectors(spark, at)
    exact = {(r.query_id, r.id) for r in S.cosine_topk(f, q, 10, 0.4).collect()}
    near = {(r.query_id, r.id): r.score for r in S.lsh_candidates(f, q).collect()}
    assert exact and len(exact & near.keys()) >= 0.9 * len(exact)
    assert min(near.values()) >= 1 - 1.1**2 / 2 - 1e-6


def test_projections_give_the_rows_of_the_join(spark):
    """Blocks of pairs give what MLlib's join on buckets gives, zero vectors too, and no join makes rows of pairs."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    frames = clustered(spark, 400, groups=30, d=12).unionByName(spark.createDataFrame([(900, [0.0] * 12)], "id long, vector array<float>"))
    q = asked(frames, 9)
    vec = lambda c: array_to_vector(S.l2_normalise(F.col(c))).alias("features")
    for bucket, tables in ((0.6, 12), (0.2, 2)):
        left, right = frames.select("id", vec("vector")), q.select("query_id", vec("query_vector"))
        model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=7).fit(left)
        joined = model.approxSimilarityJoin(left, right, 1.1, distCol="d").collect()
        want = {(r.datasetB.query_id, r.datasetA.id): 1 - r.d**2 / 2 for r in joined}
        near = S.lsh_candidates(frames, q, bucket, tables)
        got = near.collect()
        assert len(got) == len(want) > 400 and all(abs(want[r.query_id, r.id] - r.score) < 1e-9 for r in got)
        assert "entry" not in near._jdf.queryExecution().optimizedPlan().toString()  # MLlib's column of buckets
    odd = frames.unionByName(spark.createDataFrame([(901, None), (902, [])], "id long, vector array<float>"))
    assert S.lsh_candidates(odd, q).count() == S.lsh_candidates(frames, q).count()


def test_a_task_holds_few_scores_at_once():
    """A part's frames meet a batch of queries in slices: what a task allocates does not follow the batch."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows = lambda n, asks: pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32))] * 3 + [pa.array(np.full(n, asks, np.int32)), pa.array(np.arange(n)), pa.array(list(rng.normal(size=(n, 8)).astype(np.float32)))], names=["block", "part", "turn", "asks", "id", "vector"])
    made = [rows(3_000, 0), rows(10_000, 1)]
    tracemalloc.start()
    found = sum(b.num_rows for b in S._streamed(iter(made), S._best_of_part(3, 0.0, 9)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found >= 30_000 and peak < 40e6, peak
