"""The crawl as a source, keyed state in event order, quantiles and ranks of large groups."""

from __future__ import annotations

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import quantiles as N
from framelake.operators import ranking as G
from framelake.operators import stats as A
from framelake.sources.crawl import MediaCrawl, Walk
from framelake.streaming import streams as S


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# Crawl


def tree(root, *names):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_bytes(b"x" * len(n))


@pytest.fixture(scope="module")
def crawl(spark):
    spark.dataSource.register(MediaCrawl)
    return lambda **o: spark.read.format("media_crawl").options(**o).load()


def test_crawl_prunes_while_it_lists(spark, crawl, tmp_path, monkeypatch):
    tree(tmp_path, "a.JPG", "._b.jpg", ".hidden/c.mp4", "d/e.mp4", "d/deep/er/f.mov", "d/Thumbs.db", "d/f.txt", "Recovery/g.mov", "cache/h.jpg", "d/TIMELAPSE_1.jpg", "z/.x/y.jpg")
    os.symlink(tmp_path / "d", tmp_path / "link")
    (tmp_path / "locked").mkdir()
    (tmp_path / "locked" / "l.jpg").write_bytes(b"")
    opened = []
    scan = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(os.path.relpath(p, tmp_path)) or scan(p))
    walk = Walk({"path": str(tmp_path), "exclude_dirs": str(tmp_path / "cache"), "exclude_names": "timelapse_*"})
    found = sorted(r[0] for p in walk.partitions() for r in walk.read(p))
    assert [os.path.relpath(f, tmp_path) for f in found] == ["a.JPG", "d/deep/er/f.mov", "d/e.mp4", "locked/l.jpg"]
    assert set(opened) == {".", "d", "d/deep", "d/deep/er", "locked", "z"}  # neither hidden, system, excluded nor linked ones
    got = crawl(path=str(tmp_path), exclude_dirs=str(tmp_path / "cache"), exclude_names="timelapse_*", depth="2")
    assert rows(got, "file_path", "media_type", "size") == [(f, "video" if f[-1] in "v4" else "image", os.path.getsize(f)) for f in found]
    assert got.rdd.getNumPartitions() == 5  # the root, d, locked and z by themselves, d/deep with all below


def test_crawl_passes_by_what_it_may_not_read(crawl, tmp_path, monkeypatch):
    tree(tmp_path, "d/e.mp4", "no/f.mp4")
    scan = os.scandir

    def refuse(p):
        if str(p).endswith("/no"):
            raise PermissionError(p)
        return scan(p)

    monkeypatch.setattr(os, "scandir", refuse)
    walk = Walk({"path": f"file://{tmp_path}"})
    assert [os.path.basename(r[0]) for p in walk.partitions() for r in walk.read(p)] == ["e.mp4"]
    with pytest.raises(Exception, match="no folder"):
        crawl(path=str(tmp_path / "none")).count()


def test_crawl_stream_yields_only_new_files(spark, crawl, tmp_path):
    root, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    tree(root, "a/1.jpg", "b/2.mp4", ".h/3.jpg")
    seen = lambda: rows(spark.read.parquet(out).select(F.regexp_extract("file_path", r"[^/]+$", 0)))

    def run():
        time.sleep(0.1)
        source = spark.readStream.format("media_crawl").option("path", str(root)).option("settle", "0.05").load()
        S.run_to_end(source, out, cp)

    run()
    assert seen() == [("1.jpg",), ("2.mp4",)]
    run()
    assert seen() == [("1.jpg",), ("2.mp4",)]
    tree(root, "a/4.jpg", "c/d/5.mp4")
    old = root / "elsewhere.jpg"
    old.write_bytes(b"")
    os.utime(old, (1, 1))  # an old file that is moved in
    os.rename(old, root / "b" / "6.jpg")
    run()
    assert seen() == [("1.jpg",), ("2.mp4",), ("4.jpg",), ("5.mp4",), ("6.jpg",)]


def test_crawl_feeds_ingest(spark, crawl, tmp_path):
    """Crawled files through content decisions: copies are told apart, a second run decides on new files alone."""
    root = tmp_path / "in"
    for name, content in (("a/1.jpg", b"same"), ("b/2.jpg", b"same"), ("b/3.jpg", b"other")):
        tree(root, name)
        (root / name).write_bytes(content)

    def ingest():
        time.sleep(0.1)
        source = spark.readStream.format("media_crawl").option("path", str(root)).option("settle", "0.05").load()
        hashed = source.withColumn("file_hash", S.file_digest(F.col("file_path"), F.col("media_type")))
        return S.ingest_contents(hashed, str(tmp_path / "log"), str(tmp_path / "cp"))

    actions = lambda df: rows(df.select(F.regexp_extract("file_path", r"[^/]+$", 0), "action"))
    assert actions(ingest()) == [("1.jpg", "inserted"), ("2.jpg", "duplicate_copy"), ("3.jpg", "inserted")]
    (root / "c").mkdir()
    (root / "c" / "4.jpg").write_bytes(b"other")
    assert actions(ingest()) == [("1.jpg", "inserted"), ("2.jpg", "duplicate_copy"), ("3.jpg", "inserted"), ("4.jpg", "duplicate_copy")]


# Keyed state


def events(spark, data):
    made = spark.createDataFrame(data, "id long, seq long, t string, status string, point_id long")
    return made.select("id", "seq", F.to_timestamp("t").alias("ts"), "status", "point_id")


def stream(spark, batches, path):
    for b in batches:
        events(spark, b).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    return S.read_stream(spark, path, events(spark, []).schema)


EARLY = [(1, 0, "2024-01-01 00:00:00", "pending", None), (1, 2, "2024-01-01 00:20:00", "done", 7), (2, 3, "2024-01-01 00:21:00", "pending", 5), (9, 9, "2024-01-01 01:00:00", "x", None)]
LATE = [(1, 1, "2024-01-01 00:10:00", "processing", None), (2, 4, "2024-01-01 00:50:00", None, 6), (3, 5, "2024-01-01 01:05:00", "pending", None), (3, 6, "2024-01-01 01:04:00", "error", None)]
END = [(8, 10, "2024-01-03 00:00:00", "end", None)]


def test_late_rows_change_the_outcome_as_in_a_batch(spark, tmp_path):
    """A row that comes a batch later, within the delay, stands between two earlier ones; beyond the end all is flushed."""
    source = lambda: stream(spark, [], str(tmp_path / "in"))
    stream(spark, [EARLY, LATE, END], str(tmp_path / "in"))
    every = events(spark, EARLY + LATE + END)
    S.run_to_end(S.status_changes(source(), "1 hour"), str(tmp_path / "changes"), str(tmp_path / "cp1"))
    columns, before_end = ("id", "seq", "old_status", "status"), F.col("id") != 8
    want = rows(S.status_changes_batch(every).where(before_end), *columns)
    assert (1, 1, "pending", "processing") in want and rows(spark.read.parquet(str(tmp_path / "changes")).where(before_end), *columns) == want
    S.run_to_end(S.first_indexed(source(), "1 hour"), str(tmp_path / "first"), str(tmp_path / "cp2"))
    assert rows(spark.read.parquet(str(tmp_path / "first")), "id", "seq", "point_id") == rows(S.first_indexed_batch(every), "id", "seq", "point_id") == [(1, 2, 7)]


def test_restart_from_the_checkpoint(spark, tmp_path):
    """State of the first run is there in the second."""
    path, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    S.run_to_end(S.status_changes(stream(spark, [EARLY], path), "1 hour"), out, cp)
    S.run_to_end(S.status_changes(stream(spark, [LATE, END], path), "1 hour"), out, cp)
    columns = ("id", "seq", "old_status", "status")
    want = rows(S.status_changes_batch(events(spark, EARLY + LATE)), *columns)
    assert rows(spark.read.parquet(out).where("id <> 8"), *columns) == want


def test_idle_keys_leave(spark, tmp_path):
    """An id that rests for longer than the idle time counts as new when it comes back; state holds the others alone."""
    at = lambda day, seq, id_: (id_, seq, f"2024-01-{day:02d} 00:00:00", "done", None)
    batches = [[at(1, 0, 1), at(1, 1, 2)], [at(2, 2, 2)], [at(9, 3, 3)], [at(10, 4, 1), at(10, 5, 2)], [at(12, 6, 4)]]
    source = stream(spark, batches, str(tmp_path / "in"))
    S.run_to_end(S.status_changes(source, "0 seconds", idle_days=3), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id", "seq") == [(1, 0), (1, 4), (2, 1), (2, 5), (3, 3), (4, 6)]


# Request windows


def test_windows_have_rate_and_bounded_p95(spark, tmp_path):
    rng = random.Random(2)
    data = [(f"2024-01-01 00:{i % 10:02d}:00", "/a", 200, int(rng.expovariate(0.01))) for i in range(20_000)] + [("2024-01-01 00:00:00", "/b", 500, None), ("2024-01-01 05:00:00", "/a", 200, 1)]
    log = spark.createDataFrame(data, "t string, endpoint string, response_status int, response_ms int").select(F.to_timestamp("t").alias("ts"), "endpoint", "response_status", "response_ms")
    log.repartition(1).write.parquet(str(tmp_path / "in"))
    S.run_to_end(S.tumbling_requests(S.read_stream(spark, str(tmp_path / "in"), log.schema), 10), str(tmp_path / "out"), str(tmp_path / "cp"))
    for df in (S.tumbling_requests(log, 10), spark.read.parquet(str(tmp_path / "out"))):
        got = {(r.endpoint, r.window_start.hour): r for r in df.collect()}
        a, b = got["/a", 0], got["/b", 0]
        assert a.requests == 20_000 and a.rate == round(20_000 / 600, 6) and (b.requests, b.errors, b.p95_ms) == (1, 1, None)
        exact = sorted(d[3] for d in data[:20_000])
        assert exact[int(20_000 * 0.945)] <= a.p95_ms <= exact[int(20_000 * 0.955)]


# Quantiles and ranks


@pytest.mark.parametrize("sent", [50_000, 0])
def test_quantiles_equal_direct(spark, sent, monkeypatch):
    monkeypatch.setattr(N, "WAYS", 16)  # several passes
    monkeypatch.setattr(N, "FACTS_SENT", sent)
    rng = np.random.default_rng(1)
    data = [("hot", float(x)) for x in rng.exponential(50, 3_000)] + [("ties", float(x)) for x in rng.integers(0, 3, 500)] + [("one", 4.5), (None, 1.0), (None, 2.0), ("none", None), ("wide", -1e300), ("wide", 0.0), ("wide", 1e-300), ("wide", 1e300)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in N.quantiles(df, ["g"], F.col("v"), a=0.0, b=0.5, c=0.95, d=1.0).collect()}
    want = {}
    for g, v in data:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert got.keys() == want.keys()
    for g, vs in want.items():
        assert np.allclose([got[g].a, got[g].b, got[g].c, got[g].d], np.quantile(vs, [0, 0.5, 0.95, 1]), rtol=1e-12, atol=0 if g != "wide" else 1e-3), g
    whole = N.quantiles(df.where("g = 'hot'"), [], F.col("v"), b=0.5).collect()
    assert len(whole) == 1 and np.isclose(whole[0].b, np.median(want["hot"]))
    assert N.quantiles(df.where("false"), ["g"], F.col("v"), b=0.5).count() == 0


def test_timing_of_nothing(spark):
    df = spark.createDataFrame([("done", None, None)], "status string, embedding_ms int, processed_at timestamp")
    assert [tuple(r) for r in A.timing(df).collect()] == [(0, None, None, None, None, None)]


@pytest.mark.parametrize("share", [0.0, 0.37, 0.8, 1.0])
def test_holdouts_number_only_the_bucket_with_the_cut(spark, share):
    rng = random.Random(6)
    data = [(i, rng.choice(["a", "b", None]), f"2024-01-{rng.randint(1, 9):02d} 0{rng.randint(0, 3)}:{rng.randint(0, 5)}0:00") for i in range(400)] + [(900, "few", None), (901, "few", "2024-01-01 00:00:00"), (902, "one", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(data, "id long, label string, t string").select("id", "label", F.to_timestamp("t").alias("ts"))
    classes = {}
    for i, c, t in data:
        classes.setdefault(c, []).append((t or "", i))
    got = {r.id: r.part for r in G.temporal_holdout(df, "label", "ts", "id", share).collect()}
    assert len(got) == len(data)
    for c, members in classes.items():
        cut = int(len(members) * share)
        cut = len(members) if cut in (0, len(members)) else cut
        assert {i for _, i in sorted(members)[:cut]} == {i for _, i in members if got[i] == "train"}, c
    import hashlib

    got = {r.id: r.part for r in G.stratified_holdout(df, "label", "id", share).collect()}
    for members in classes.values():
        order = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for _, i in members)
        assert {i for _, i in order[: int(len(members) * share)]} == {i for _, i in members if got[i] == "train"}
