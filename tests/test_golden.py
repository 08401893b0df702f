"""Hand-made cases of the order-dependent operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framelake.operators import dedup as D
from framelake.operators import enrich as K
from framelake.operators import joins as J
from framelake.operators import ranking as G
from framelake.operators import search as S
from framelake.operators import stats as A

HIT = "query_id long, id long, score double, rank int, file_path string, ts double, audio_segment_index int"


def hits(spark, rows):
    """(score, path, ts, segment) of one query, in retrieval order."""
    return spark.createDataFrame([(1, i, float(s), i + 1, p, t, g) for i, (s, p, t, g) in enumerate(rows)], HIT)


def scores(df):
    return sorted((r.score for r in df.collect()), reverse=True)


@pytest.mark.parametrize(
    ("times", "kept"),
    [([(0.9, 1.0), (0.8, 2.5), (0.7, 4.9)], [0.9]), ([(0.9, 0.5), (0.8, 6.5), (0.7, 12.5)], [0.9, 0.8, 0.7]), ([(0.286, 748.0), (0.281, 744.0), (0.275, 750.0)], [0.286]), ([(0.9, None), (0.8, None)], [0.9, 0.8]), ([(0.9, 0.0), (0.8, 5.0)], [0.9, 0.8])],
)
def test_temporal_nms(spark, times, kept):
    assert scores(D.temporal_nms(hits(spark, [(s, "a.mp4", t, None) for s, t in times]))) == kept


def test_temporal_nms_property(spark, sf):
    from framelake.plans.search_queries import hits as found

    before = found(spark, sf).toPandas()
    after = D.temporal_nms(found(spark, sf)).toPandas()
    for (q, p), g in after.dropna(subset=["ts"]).groupby(["query_id", "file_path"]):
        t = sorted(g.ts)
        assert all(b - a >= 5 for a, b in zip(t, t[1:], strict=False))
        gone = before[(before.query_id == q) & (before.file_path == p) & ~before.id.isin(g.id)]
        for r in gone.itertuples():
            assert any(abs(r.ts - k.ts) < 5 and (k.score, -k.id) >= (r.score, -r.id) for k in g.itertuples())


def test_segment_dedup(spark):
    assert scores(D.segment_dedup(hits(spark, [(0.9, "a", 0.0, 0), (0.8, "a", 2.0, 0), (0.7, "a", 4.0, 0)]))) == [0.9]
    assert len(scores(D.segment_dedup(hits(spark, [(0.9, "a", 0.0, 0), (0.8, "a", 2.0, 1), (0.7, "a", 4.0, 2)])))) == 3
    assert len(scores(D.segment_dedup(hits(spark, [(0.9, "a", 0.0, 0), (0.8, "b", 0.0, 0)])))) == 2
    many = hits(spark, [(0.9 - i / 100, "a", 2.0 * i, 0) for i in range(15)])
    kept = D.segment_dedup(many)
    assert len(scores(kept)) == 1
    assert S.envelope(many, kept).first().scenes_collapsed == 14


def test_flood_cap(spark):
    images = lambda d, n: [(0.9 - i / 100, f"/{d}/{i}.jpg", None, None) for i in range(n)]
    assert scores(D.flood_cap(hits(spark, images("x", 5)))) == [0.9, 0.89]
    assert len(scores(D.flood_cap(hits(spark, images("x", 3))))) == 3
    assert len(scores(D.flood_cap(hits(spark, images("x", 5) + images("y", 5))))) == 4
    assert len(scores(D.flood_cap(hits(spark, [(0.9 - i / 100, "/x/v.mp4", 10.0 * i, None) for i in range(3)])))) == 3
    assert len(scores(D.flood_cap(hits(spark, images("x", 5)), 0))) == 5


def test_last_kept(spark):
    assert len(scores(D.last_kept_dedup(hits(spark, [(0.9, "a", 10.0, None), (0.8, "a", 12.0, None)])))) == 1
    assert len(scores(D.last_kept_dedup(hits(spark, [(0.9, "a", 0.0, None), (0.8, "a", 10.0, None)])))) == 2
    assert len(scores(D.last_kept_dedup(hits(spark, [(0.9, "a", 0.0, None), (0.8, "a", 5.0, None)])))) == 1


def test_gap_sessions(spark):
    def run(minutes):
        rows = spark.createDataFrame([(m,) for m in minutes], "m int").select(F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, m)").alias("ts"))
        return sorted((r.n for r in G.gap_sessions(rows, "ts").collect()), reverse=True)

    assert run([0, 1, 2, 3, 4]) == [5]
    assert run([0, 1, 2, 20, 21]) == [3, 2]
    assert run([0, 10]) == [2]
    assert run([0, 11]) == [1, 1]


def test_segment_join(spark):
    frames = spark.createDataFrame([(1, "a", 6.0), (2, "a", 13.5), (3, "a", 99.0), (4, "b", 1.0), (5, "a", None), (6, "a", 12.0)], "id long, file_path string, ts double")
    segments = spark.createDataFrame([("a", 0, 0.0, 6.0), ("a", 1, 6.0, 11.0), ("a", 2, 15.0, 18.0)], "file_path string, segment_index int, start_sec double, end_sec double")
    got = {r.id: r.segment_index for r in J.segment_for_frame(frames, segments).collect()}
    assert got == {1: 0, 2: 2, 3: 2, 4: None, 5: None, 6: 1}


def test_window_readings_edges(spark):
    points = spark.createDataFrame([(1, 7, 100), (2, 7, 1000)], "id long, source long, t long")
    readings = spark.createDataFrame([(7, 70, 0, 60.0, "a", 0.1), (7, 130, 1, 80.0, "b", 0.3), (7, 131, 2, 200.0, "c", 1.0)], "source long, t long, seq long, rate double, activity string, stress double")
    got = {r.id: r for r in J.window_readings(points, readings).collect()}
    assert (got[1].n, got[1].avg_rate, got[1].max_rate, got[1].activity, got[1].avg_stress) == (2, 70.0, 80.0, "b", 0.2)
    assert got[2].n is None


def test_merge_intervals(spark):
    i = spark.createDataFrame([("a", 0.0, 5.0), ("a", 1.0, 3.0), ("a", 5.0, 6.0), ("a", 8.1, 8.5), ("b", 0.0, 0.4)], "file_path string, start_sec double, end_sec double")
    files = spark.createDataFrame([("a", 60.0), ("b", 30.0), ("c", 20.0)], "file_path string, duration double")
    got = sorted(tuple(r) for r in G.merge_intervals(i, files).collect())
    assert got == [("a", 0.0, 6.0, "segment"), ("b", 0.0, 30.0, "whole"), ("c", 0.0, 20.0, "silence")]


def test_greedy_fill_skips_then_fits(spark):
    items = spark.createDataFrame([("x", 0, "a", 6.0), ("x", 1, "b", 5.0), ("x", 2, "c", 4.0)], "list string, pos int, key string, size double")
    assert sorted(r.key for r in G.greedy_fill(items, "list", 10, 5).collect()) == ["a", "c"]


def test_trim_crossing_object(spark):
    rows = spark.createDataFrame([(k, 4, f"2024-01-0{k}") for k in range(1, 5)], "key int, size long, d string").withColumn("last_modified", F.to_timestamp("d"))
    got = {r.key: r["delete"] for r in G.trim_to_budget(rows, 9).collect()}
    assert got == {4: True, 3: True, 2: False, 1: False}


def test_retrieval_metrics_edges(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    h = spark.createDataFrame([(1, 0.5), (1, 0.5)], "query_id long, score double")
    got = {r.query_id: r for r in A.retrieval_metrics(q, h, 0.22).collect()}
    assert got[2].n == 0 and got[2].mean == 0.0
    assert got[1].std == 0.0 and got[1].snr == 500000.0 and got[1].exact == 2


def test_ingest_actions(spark):
    found = spark.createDataFrame([("p1", "h1", None), ("p2", "h2", None), ("p3", "h3", None), ("p4", "h4", None), ("p5", "h5", None), ("p6", "h6", "cannot_stat_file"), ("p7", "h7", None), ("p8", "h7", None)], "file_path string, file_hash string, reason string")
    known = spark.createDataFrame([("p1", "x", "done"), ("p2", "x2", "pending"), ("old3", "h3", "done"), ("old4", "h4", "done"), ("p5", "h5", "error")], "file_path string, file_hash string, status string")
    there = spark.createDataFrame([("old3",)], "file_path string")
    got = {r.file_path: r.action for r in D.ingest_decisions(found, known, there).collect()}
    assert got == {"p1": "already_ingested", "p2": "redispatched", "p3": "duplicate_copy", "p4": "relocated", "p5": "duplicate_hash", "p6": "cannot_stat_file", "p7": "inserted", "p8": "duplicate_copy"}
    assert {r.action for r in D.ingest_decisions(found.where("file_path = 'p3'"), known, there, object_store=True).collect()} == {"relocated"}


def test_search_matches_brute_force(spark, sf):
    import numpy as np

    from framelake.sources.tables import frames, query_vectors

    f = frames(spark, sf).toPandas()
    v = np.array(f.vector.tolist(), np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in range(0, len(f), 50):
        s = np.round(v @ v[q], 9)
        order = sorted((i for i in range(len(f)) if s[i] >= 0.2), key=lambda i: (-s[i], f.id[i]))[:7]
        want |= {(int(f.id[q]), int(f.id[i])) for i in order}
    for limit in (2000, 3):  # both ways for queries to meet frames
        S.BROADCAST_QUERIES, before = limit, S.BROADCAST_QUERIES
        try:
            got = {(r.query_id, r.id) for r in S.cosine_topk(frames(spark, sf), query_vectors(spark, sf), 7, 0.2).collect()}
        finally:
            S.BROADCAST_QUERIES = before
        assert got == want


def test_encode_leaves_out_unreadable(spark):
    rows = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "b")], "k long, content string")
    assert sorted(r.k for r in K.batch_encode(rows, "k", "content", K.hash_encoder).collect()) == [1, 4]


def test_browse_needs_something(spark, sf):
    from framelake.sources.tables import frames

    with pytest.raises(ValueError, match="filter"):
        S.browse(frames(spark, sf), None)


def test_ingest_decisions_hold_no_group_of_copies(spark):
    """Many copies of one content: right actions, and no array or window over all paths of a content."""
    found = spark.createDataFrame([(f"n{i:03}", "new", None) for i in range(50)] + [("n000", "new", None)] + [(f"k{i:03}", "old", None) for i in range(60)], "file_path string, file_hash string, reason string")
    known = spark.createDataFrame([(f"k{i:03}", "old", "error") for i in range(50)] * 2, "file_path string, file_hash string, status string")
    df = D.ingest_decisions(found, known, found.select("file_path"))
    got = sorted((r.file_path, r.action) for r in df.collect())
    want = [("n000", "inserted")] + [("n000", "duplicate_copy")] + [(f"n{i:03}", "duplicate_copy") for i in range(1, 50)] + [(f"k{i:03}", "duplicate_hash" if i < 50 else "duplicate_copy") for i in range(60)]
    assert got == sorted(want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan


def test_sessions_without_a_key_are_not_sorted_in_one_task(spark):
    """Sessions over midnight, a chain over several days, and days between; the lone partition sees days, not rows."""
    import random
    from datetime import datetime, timedelta

    rng, at, times = random.Random(2), datetime(2024, 1, 1), []
    for _ in range(600):
        at += timedelta(minutes=rng.choice([1, 5, 10, 11, 200, 3000]))
        times += [at] * rng.randint(1, 2)
    at += timedelta(days=2)
    times += [at + timedelta(minutes=9 * i) for i in range(800)]  # five days in one session
    for by in (None, ["k"]):
        df = spark.createDataFrame([(i % 3, t) for i, t in enumerate(times)], "k int, ts timestamp")
        made = G.gap_sessions(df, "ts", 10, by)
        want = []
        for k in range(3) if by else [None]:
            own = sorted(t for i, t in enumerate(times) if k is None or i % 3 == k)
            runs = [[own[0]]]
            for t in own[1:]:
                runs[-1].append(t) if t - runs[-1][-1] <= timedelta(minutes=10) else runs.append([t])
            want += [(*([k] if by else []), r[0], r[-1], len(r)) for r in runs]
        assert sorted(tuple(r) for r in made.drop("minutes").collect()) == sorted(want)
    plan = G.gap_sessions(df, "ts")._jdf.queryExecution().executedPlan().toString()
    lone = [x for x in plan.splitlines() if "SinglePartition" in x]
    assert len(lone) == 1 and "session" not in plan.split("SinglePartition")[0].split("Window")[-1]
    below = plan[plan.index("SinglePartition") :]
    assert below.index("explode") < below.index("session_window")  # what is sorted alone are the days' ends


def test_holdouts_fall_back(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], f"/x/{'DJI' if i % 2 else 'PXL'}{i}") for i in range(40)], "id int, label string, path string")
    other = G.stratified_holdout(rows, "label", "id")
    assert G.with_fallback(G.source_holdout(rows, "path", "DJI"), other, "label", least_train=10)[1]  # a class is missing
    mixed = rows.withColumn("label", F.lit("a"))
    assert not G.with_fallback(G.source_holdout(mixed, "path", "DJI"), other, "label", least_train=10)[1]
    assert G.with_fallback(G.source_holdout(mixed, "path", "DJI3"), other, "label", least=6)[1] is False
    assert G.with_fallback(G.source_holdout(mixed, "path", "DJI39"), other, "label")[0] is other
    assert G.with_fallback(G.source_holdout(mixed, "path", "X"), other, "label", least=0, least_train=50)[1]
    assert G.with_fallback(rows.where("false").withColumn("part", F.lit("test")), other, "label")[1]


def test_topic_tags(spark):
    labels = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "label_index long, label_vector array<float>")
    rows = spark.createDataFrame([(i, [float(i % 3 == j) for j in range(4)]) for i in range(30)], "id long, vector array<float>")
    import hashlib

    order = sorted(range(30), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    met = list(dict.fromkeys(i % 3 for i in order))
    assert [(r.place, r.label_index, r.n) for r in J.topic_tags(rows, labels).orderBy("place").collect()] == [(k + 1, x, 10) for k, x in enumerate(met)]
    some = order[:7]
    counts = {x: sum(i % 3 == x for i in some) for x in range(3)}
    want = sorted((x for x in counts if counts[x]), key=lambda x: (-counts[x], [i % 3 for i in some].index(x)))
    assert [r.label_index for r in J.topic_tags(rows, labels, sample=7).orderBy("place").collect()] == want
    assert [(r.label_index, r.n) for r in J.topic_tags(rows.where("false"), labels, k=2).orderBy("place").collect()] == [(0, 0), (1, 0)]


@pytest.mark.parametrize("sent", [2_000, 3])
def test_cosine_paths_agree(spark, monkeypatch, sent):
    """Sent or shuffled queries: mixed dimensions, null and empty vectors on both sides."""
    import numpy as np

    rng = np.random.default_rng(4)
    vector = lambda d: [float(x) for x in rng.normal(size=d)]
    frames = [(i, vector(8 if i % 3 else 5)) for i in range(300)] + [(300, None), (301, []), (302, [0.0] * 8)]
    asked = [(i, vector(8 if i % 2 else 5)) for i in range(12)] + [(20, None), (21, []), (22, vector(3))]
    want = set()
    for q, v in asked:
        scored = []
        for i, w in frames:
            if v and w and len(v) == len(w):
                size = np.linalg.norm(v) * np.linalg.norm(w)
                scored.append((-round(float(np.dot(np.float32(v).astype(float), np.float32(w).astype(float)) / size), 5) if size else 0.0, i))
        want |= {(q, i, -s) for s, i in sorted(scored)[:5] if -s >= 0.2}
    monkeypatch.setattr(S, "BROADCAST_QUERIES", sent)
    monkeypatch.setattr(S, "PART_ROWS", 70)
    f = spark.createDataFrame(frames, "id long, vector array<float>")
    got = S.cosine_topk(f, spark.createDataFrame(asked, "query_id long, query_vector array<float>"), 5, 0.2)
    assert {(r.query_id, r.id, round(r.score, 5)) for r in got.collect()} == want
    assert S.cosine_topk(f, spark.createDataFrame([], "query_id long, query_vector array<float>"), 5, 0.2).count() == 0


def test_cells_reach_the_recall(spark, sf):
    """At the thresholds that searches use, nine tenths of what the exact search finds come by cells."""
    from framelake.sources.tables import frames, query_vectors

    f, q = frames(spark, sf.replace("sf0.001", "sf0.01")), query_vectors(spark, sf.replace("sf0.001", "sf0.01"))
    index = S.fit_cells(f)
    for threshold in (0.2, 0.3):
        exact = {(r.query_id, r.id): r.score for r in S.cosine_topk(f, q, 10, threshold).collect()}
        near = {(r.query_id, r.id): r.score for r in S.cell_topk(f, q, index, 10, threshold).collect()}
        both = exact.keys() & near.keys()
        assert len(both) >= 0.9 * len(exact) and all(abs(exact[x] - near[x]) < 1e-6 for x in both)
    assert S.cell_topk(f, q, index, 1 << 20, -1.0).select("id").distinct().count() == f.count()  # every row is indexed
    assert S.cell_topk(f.where("false"), q, S.fit_cells(f.where("false"))).count() == 0


def test_encoder_and_steps(spark, tmp_path):
    import numpy as np

    a, b, c, none = K.hash_encoder()(["the red house on the hill", "the red house on a hill", "quantum chromodynamics", ""])
    assert none is None and abs(np.linalg.norm(a) - 1) < 1e-9 and a @ b > 0.7 > 0.4 > a @ c
    grams = [" the red house on the hill "[i : i + 3] for i in range(25)]
    import hashlib

    want = np.zeros(64)
    for g in grams:
        h = int.from_bytes(hashlib.sha256(g.encode()).digest()[:8], "little")
        want[(h >> 1) % 64] += 1 if h & 1 else -1
    assert np.allclose(a, want / np.linalg.norm(want))

    ran = []

    def settle(df):
        path = str(tmp_path / f"s{len(ran)}")
        df.write.parquet(path)
        ran.append(path)
        return spark.read.schema(df.schema).parquet(path)

    steps = [("one", lambda d: d.withColumn("error", F.when(F.col("id") == 1, "bad"))), ("two", lambda d: d.withColumn("x", F.col("id") * 2))]
    out, took = K.run_steps(spark.range(3), steps, settle=settle)
    assert sorted((r.id, r.error, r.x) for r in out.collect()) == [(0, None, 0), (1, "bad", None), (2, None, 4)]
    assert [n for n, _ in took] == ["one", "two"] and len(ran) == 2 and all(t > 0 for _, t in took)


def test_scroll_pages(spark):
    from framelake.sources.stores import scroll

    df = spark.range(100).withColumn("v", F.col("id") * 2)
    got, offset, pages = [], None, 0
    while True:
        page, offset = scroll(df, F.col("id") % 3 != 0, ["v"], offset, 20)
        got += [r.id for r in page.collect()]
        pages += 1
        if offset is None:
            break
    assert got == [i for i in range(100) if i % 3] and pages == 4
    assert scroll(df, F.lit(False), ["v"])[1] is None


def test_segment_for_frame_over_buckets(spark):
    """Long and overlapping segments, wide gaps, equal distances and files without segments, in buckets of seven seconds."""
    import random

    rng = random.Random(12)
    segments = [(f"f{f}", i, a, a + rng.choice([0, 3, 40])) for f in range(4) for i, a in enumerate(sorted(rng.randint(-20, 400) for _ in range(8)))]
    segments += [("f9", 1, 0.0, 4.0), ("f9", 0, 6.0, 10.0)]
    frames = [(n, f"f{n % 5}", float(rng.randint(-30, 460))) for n in range(400)] + [(900, "f0", None), (901, "f9", 5.0), (902, "none", 3.0)]
    want = {}
    for n, f, t in frames:
        own = [(i, a, b) for g, i, a, b in segments if g == f]
        held = [i for i, a, b in own if t is not None and a <= t <= b]
        want[n] = None if t is None or not own else min(held) if held else min((abs(t - (a + b) / 2), i) for i, a, b in own)[1]
    made = J.segment_for_frame(spark.createDataFrame(frames, "id long, file_path string, ts double"), spark.createDataFrame([(f, i, float(a), float(b)) for f, i, a, b in segments], "file_path string, segment_index int, start_sec double, end_sec double"), width=7.0)
    assert {r.id: r.segment_index for r in made.collect()} == want and want[901] == 0


def test_queries_without_sql(spark, sf):
    """What no SQL can say: encoded documents, forests' reports and predictions, against direct computation."""
    import numpy as np

    from framelake.plans.registry import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    encode = K.hash_encoder()
    got = {r.doc_id: (r.dim, r.total) for r in queries()["k01_batch_encode"](spark, sf).collect()}
    want = {d: (64, round(float(sum(np.float64(np.float32(x)) for x in encode([t])[0])), 5)) for d, t in docs.items() if d % 7 and t}
    assert got.keys() == want.keys() and all(got[d][0] == 64 and abs(got[d][1] - want[d][1]) < 2e-5 for d in want)

    report = {r.label: r for r in queries()["k09_train_report"](spark, sf).collect()}
    labels = [x for x in report if x.startswith("g")]
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("label % 3 g").groupBy("g").count().collect()
    assert {x: report[x].support for x in labels} == {f"g{r.g}": r["count"] - int(r["count"] * 0.8) for r in rows}
    assert abs(report["macro"].f1 - np.mean([report[x].f1 for x in labels])) < 1e-5
    assert abs(report["accuracy"].recall - sum(report[x].recall * report[x].support for x in labels) / sum(report[x].support for x in labels)) < 1e-5

    for r in queries()["k10_batch_predict"](spark, sf).collect():
        assert (r.construction_phase is None) == (r.phase_confidence is None) == (r.phase_needs_review is None)
        assert r.phase_confidence is None or (1 / 3 - 1e-6 <= r.phase_confidence <= 1 and r.construction_phase in ("g0", "g1", "g2"))
        assert r.phase_confidence is None or abs(r.phase_confidence - 0.85) < 1e-3 or r.phase_needs_review == (r.phase_confidence < 0.85)

    near = queries()["c05_cell_candidates"](spark, sf).collect()
    assert all(r.rank <= 10 and r.score >= 0.2 - 1e-9 for r in near) and np.mean([r.in_exact for r in near]) > 0.8
