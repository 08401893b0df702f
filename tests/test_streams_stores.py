"""Streams against their batch twins, and stores on folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.plans.stream_queries import _ended, _events, _stream
from framelake.sources import listing, stores
from framelake.sources.tables import audit_logs, read
from framelake.streaming import streams as S


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_first_indexed_stream(spark, sf):
    got = _ended(spark, S.first_indexed(_stream(spark, sf)))
    assert rows(got, "id", "seq", "point_id") == rows(S.first_indexed_batch(_events(read(spark, sf, "events"))), "id", "seq", "point_id")


def test_closed_windows_equal_batch(spark, sf, tmp_path):
    log = audit_logs(spark, sf).select("ts", "endpoint", "response_status", "response_ms", "client_ip")
    log.repartition(1).write.parquet(str(tmp_path / "in"))
    source = S.read_stream(spark, str(tmp_path / "in"), log.schema)
    S.run_to_end(S.tumbling_requests(source, 60), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = S.tumbling_requests(log, 60)
    closed = log.agg((F.max("ts") - F.expr("INTERVAL 2 HOURS")).alias("t")).first().t
    keep = F.col("window_start") < F.lit(closed)
    columns = ("window_start", "endpoint", "requests", "errors")
    assert rows(got.where(keep), *columns) == rows(want.where(keep), *columns)


def test_redelivered_and_sessions(spark, sf, tmp_path):
    e = read(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    e.unionByName(e).repartition(1).write.parquet(str(tmp_path / "in"))
    source = S.read_stream(spark, str(tmp_path / "in"), e.schema)
    S.run_to_end(S.once(source, ["event_id"]), str(tmp_path / "once"), str(tmp_path / "cp1"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == e.count()
    S.run_to_end(S.sessions(source, "user_id"), str(tmp_path / "ses"), str(tmp_path / "cp2"))
    closed = e.agg((F.max("ts") - F.expr("INTERVAL 2 HOURS")).alias("t")).first().t
    keep = F.col("end") < F.lit(closed)
    want = S.sessions(e.unionByName(e), "user_id").where(keep)
    assert rows(spark.read.parquet(str(tmp_path / "ses")).where(keep), "user_id", "start", "end", "n") == rows(want, "user_id", "start", "end", "n")


def test_fan_out_and_ingest(spark, sf, tmp_path):
    e = _events(read(spark, sf, "events"))
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    source = S.read_stream(spark, str(tmp_path / "in"), e.schema)
    paths = {n: str(tmp_path / n) for n in ("media_updates", "vector_indexed")}
    S.run_to_end(source, "", str(tmp_path / "cp"), each=S.fan_out_to(paths))
    assert spark.read.parquet(paths["media_updates"]).count() == e.count()
    assert spark.read.parquet(paths["vector_indexed"]).count() == e.where("point_id IS NOT NULL").count()

    store = stores.Store(spark, str(tmp_path / "store"), ["file_path"])
    files = e.select(F.col("seq").cast("string").alias("file_path"), "status")
    files.repartition(3).write.parquet(str(tmp_path / "files"))
    found = S.read_stream(spark, str(tmp_path / "files"), files.schema)
    S.ingest_stream(found, lambda b: b, lambda b, n: store.upsert(b), str(tmp_path / "cp3"))
    assert store.read().count() == files.count()


def test_stuck_alerts(spark, tmp_path):
    data = [(1, 0, "2024-01-01 00:00:00", "processing"), (2, 1, "2024-01-01 00:10:00", "processing"), (2, 2, "2024-01-01 00:20:00", "done"), (3, 3, "2024-01-01 05:00:00", "done")]
    later = [(4, 4, "2024-01-01 06:00:00", "done")]
    make = lambda d: spark.createDataFrame(d, "id long, seq long, t string, status string").select("id", "seq", F.to_timestamp("t").alias("ts"), "status")
    make(data).repartition(1).write.parquet(str(tmp_path / "in"))
    make(later).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    S.run_to_end(S.stuck_alerts(S.read_stream(spark, str(tmp_path / "in"), make(data).schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_store_versions(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"), ["k"])
    df = lambda d: spark.createDataFrame(d, "k long, v string, t long")
    assert store.upsert(df([(1, "a", 0), (2, "b", 0)])) == 1
    store.upsert(df([(2, "c", 1), (2, "d", 2), (3, "e", 0)]), [F.desc("t")])
    assert rows(store.read(), "k", "v") == [(1, "a"), (2, "d"), (3, "e")]
    store.delete(df([(1, "", 0)]).select("k"))
    assert rows(store.read(), "k") == [(2,), (3,)]


def test_folder_scan_and_rules(spark, tmp_path):
    for name in ("a.JPG", "._b.jpg", ".hidden/c.mp4", "d/e.mp4", "d/Thumbs.db", "d/f.txt", "Recovery/g.mov"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = listing.scan_folder(spark, str(tmp_path)).withColumn("file_path", F.regexp_replace("file_path", f".*{tmp_path.name}/", ""))
    assert rows(listing.keep_media(found), "file_path", "media_type") == [("a.JPG", "image"), ("d/e.mp4", "video")]
    assert listing.glob_to_regex("IMG_[!0]?*.jpg") == r"(?is)^IMG_[^0]..*\.jpg$"


def _events_of(spark, data):
    return spark.createDataFrame(data, "id long, seq long, t string, status string").select("id", "seq", F.to_timestamp("t").alias("ts"), "status")


def test_stuck_inside_a_batch_and_over_batches(spark, tmp_path):
    """Every late end counts, wherever batches are cut, and an older row that comes late changes nothing."""
    first = [(1, 0, "2024-01-01 00:00:00", "processing"), (1, 1, "2024-01-01 05:00:00", "done"), (2, 2, "2024-01-01 00:00:00", "processing"), (2, 3, "2024-01-01 01:00:00", "processing"), (2, 4, "2024-01-01 04:00:00", "processing")]
    second = [(2, 5, "2024-01-01 03:30:00", "done"), (2, 6, "2024-01-01 05:30:00", "done"), (3, 7, "2024-01-01 05:20:00", "processing"), (4, 8, "2024-01-01 09:00:00", "done")]
    for name, batches in (("one", [first + second]), ("two", [first, second])):
        for b in batches:
            _events_of(spark, b).repartition(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        S.run_to_end(S.stuck_alerts(S.read_stream(spark, str(tmp_path / name / "in"), _events_of(spark, first).schema)), str(tmp_path / name / "out"), str(tmp_path / name / "cp"))
        got = rows(spark.read.parquet(str(tmp_path / name / "out")), "id", F.date_format("since", "HH:mm"))
        assert got == rows(S.stuck_batch(_events_of(spark, first + second)), "id", F.date_format("since", "HH:mm"))


def test_stuck_stream_equals_batch_on_events(spark, sf, tmp_path):
    e = _events(read(spark, sf, "events")).select("id", "seq", "ts", "status")
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    S.run_to_end(S.stuck_alerts(S.read_stream(spark, str(tmp_path / "in"), e.schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    closed = e.agg((F.max("ts") - F.expr("INTERVAL 131 MINUTES")).alias("t")).first().t
    keep = F.col("since") < F.lit(closed)
    want = rows(S.stuck_batch(e).where(keep), "id", "since")
    assert want and rows(spark.read.parquet(str(tmp_path / "out")).where(keep), "id", "since") == want


def test_status_streams_over_batches(spark, sf, tmp_path):
    """Changes, first points and the newest status, with the events cut into batches by time."""
    e = _events(read(spark, sf, "events"))
    cut = e.agg(F.percentile_approx("ts", [0.3, 0.7])).first()[0]
    part = F.when(F.col("ts") < F.lit(cut[0]), 0).when(F.col("ts") < F.lit(cut[1]), 1).otherwise(2)
    for i in range(3):
        e.where(part == i).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: S.read_stream(spark, str(tmp_path / "in"), e.schema)
    S.run_to_end(S.status_changes(source()), str(tmp_path / "changes"), str(tmp_path / "cp1"))
    columns = ("id", "seq", "old_status", "status")
    assert rows(spark.read.parquet(str(tmp_path / "changes")), *columns) == rows(S.status_changes_batch(e), *columns)
    S.run_to_end(S.first_indexed(source()), str(tmp_path / "first"), str(tmp_path / "cp2"))
    assert rows(spark.read.parquet(str(tmp_path / "first")), "id", "seq", "point_id") == rows(S.first_indexed_batch(e), "id", "seq", "point_id")
    S.run_to_end(S.latest_status(source()), "", str(tmp_path / "cp3"), "update", lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"newest/batch={n}")))
    newest = spark.read.parquet(str(tmp_path / "newest")).groupBy("id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))
    assert rows(newest, "id", "status") == rows(e.groupBy("id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status")), "id", "status")


def test_limit_breaches_stream(spark, sf, tmp_path):
    log = audit_logs(spark, sf).select("ts", "endpoint", "client_ip")
    log.repartition(1).write.parquet(str(tmp_path / "in"))
    for slide in (None, 360):
        breaches = lambda df: S.limit_breaches(df, {"/api/click": 1, "default": 0}, 720, slide)  # noqa: B023, E731
        at = str(tmp_path / f"out{slide}")
        S.run_to_end(breaches(S.read_stream(spark, str(tmp_path / "in"), log.schema)), at, f"{at}-cp")
        closed = log.agg((F.max("ts") - F.expr("INTERVAL 13 HOURS")).alias("t")).first().t
        keep, columns = F.col("window_start") < F.lit(closed), ("window_start", "client_ip", "endpoint", "n", "allowed")
        want = rows(breaches(log).where(keep), *columns)
        assert want and rows(spark.read.parquet(at).where(keep), *columns) == want


def test_ingest_contents_over_batches(spark, tmp_path):
    """A content counts once over batches, and a batch that comes again decides as before."""
    batches = [[("a", "h1"), ("b", "h1"), ("c", "h2")], [("d", "h2"), ("e", "h3"), ("e", "h3")], [("f", None), ("g", "h3")]]
    make = lambda b: spark.createDataFrame(b, "file_path string, file_hash string")
    for b in batches:
        make(b).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = S.read_stream(spark, str(tmp_path / "in"), make(batches[0]).schema)
    done = S.ingest_contents(source, str(tmp_path / "log"), str(tmp_path / "cp"))
    assert done.count() == 7
    assert rows(done.where("action = 'inserted'").groupBy("file_hash").agg(F.count("*").alias("n")), "file_hash", "n") == [("h1", 1), ("h2", 1), ("h3", 1)]
    before = rows(done, "file_path", "action")
    again = S.ingest_contents(source, str(tmp_path / "log"), str(tmp_path / "cp2"))  # all batches anew over the same log
    assert rows(again, "file_path", "action") == before
    assert S.ingest_contents(S.read_stream(spark, str(tmp_path / "in"), make(batches[0]).schema).where("false"), str(tmp_path / "none"), str(tmp_path / "cp4")).count() == 0
