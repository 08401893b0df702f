"""Queries on streams: the batch twins over whole tables, and streams run to their end where state is the point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch
from ..sources.tables import audit_logs, read
from ..streaming import streams as S
from .catalog import query


_EVENTS = "ev AS (SELECT user_id AS id, event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'done' WHEN 'error' THEN 'error' ELSE 'processing' END AS status, CASE WHEN event_type = 'purchase' THEN event_id * 10 END AS point_id FROM events)"


def _events(df: DataFrame) -> DataFrame:
    status = F.expr("CASE event_type WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'done' WHEN 'error' THEN 'error' ELSE 'processing' END")
    return df.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), F.expr("CASE WHEN event_type = 'purchase' THEN event_id * 10 END").alias("point_id"))


def _files_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of files, whether it is one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    batch = spark.read.parquet(path)
    folder = any(f"/{name}.parquet/" in f for f in batch.inputFiles()[:1])
    return spark.readStream.schema(batch.schema).parquet(path if folder else f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(_files_stream(spark, sf_dir, "events"))


def _ended(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    at = scratch(spark)
    S.run_to_end(df, f"{at}/out", f"{at}/checkpoint", mode)
    return spark.read.schema(df.schema).parquet(f"{at}/out")


@query("j01_status_changes", f"WITH {_EVENTS}, l AS (SELECT *, lag(status) OVER w AS old_status, row_number() OVER w AS k FROM ev WINDOW w AS (PARTITION BY id ORDER BY ts, seq)) SELECT id, seq, old_status, status FROM l WHERE k = 1 OR status IS DISTINCT FROM old_status")
def j01(spark, sf_dir):
    return S.status_changes_batch(_events(read(spark, sf_dir, "events"))).select("id", "seq", "old_status", "status")


@query("j01_status_changes_stream", f"WITH {_EVENTS}, l AS (SELECT *, lag(status) OVER w AS old_status, row_number() OVER w AS k FROM ev WINDOW w AS (PARTITION BY id ORDER BY ts, seq)) SELECT id, seq, old_status, status FROM l WHERE k = 1 OR status IS DISTINCT FROM old_status")
def j01_stream(spark, sf_dir):
    return _ended(spark, S.status_changes(_stream(spark, sf_dir))).select("id", "seq", "old_status", "status")


@query("j02_first_indexed", f"WITH {_EVENTS}, l AS (SELECT *, count(*) OVER w AS rows_before, count(point_id) OVER w AS points_before FROM ev WINDOW w AS (PARTITION BY id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT id, seq, point_id FROM l WHERE point_id IS NOT NULL AND rows_before > 0 AND points_before = 0")
def j02(spark, sf_dir):
    return S.first_indexed_batch(_events(read(spark, sf_dir, "events"))).select("id", "seq", "point_id")


@query("j02_first_indexed_stream", f"WITH {_EVENTS}, l AS (SELECT *, count(*) OVER w AS rows_before, count(point_id) OVER w AS points_before FROM ev WINDOW w AS (PARTITION BY id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT id, seq, point_id FROM l WHERE point_id IS NOT NULL AND rows_before > 0 AND points_before = 0")
def j02_stream(spark, sf_dir):
    return _ended(spark, S.first_indexed(_stream(spark, sf_dir))).select("id", "seq", "point_id")


@query("j03_fan_out", f"WITH {_EVENTS} SELECT 'media_updates' AS channel, count(*) AS n FROM ev UNION ALL SELECT 'vector_indexed', count(point_id) FROM ev")
def j03(spark, sf_dir):
    return S.fan_out(_events(read(spark, sf_dir, "events"))).groupBy("channel").agg(F.count("*").alias("n"))


@query("j04_status_snapshot", f"WITH {_EVENTS} SELECT status, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) AS k FROM ev) WHERE k = 1 GROUP BY 1")
def j04(spark, sf_dir):
    newest = _events(read(spark, sf_dir, "events")).groupBy("id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))
    return newest.groupBy("status").agg(F.count("*").alias("n"))


@query("j04_status_snapshot_stream", f"WITH {_EVENTS} SELECT status, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) AS k FROM ev) WHERE k = 1 GROUP BY 1")
def j04_stream(spark, sf_dir):
    """Every micro-batch's changed ids go to a folder of its own; a snapshot takes each id's newest."""
    at = scratch(spark)
    newest = S.latest_status(_stream(spark, sf_dir))
    S.run_to_end(newest, "", f"{at}/checkpoint", "update", lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}"))
    rows = spark.read.schema(newest.schema).parquet(f"{at}/out")
    return rows.groupBy("id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("j05_incremental_ingest", "SELECT doc_id, sha256(text) AS file_hash, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 THEN 'inserted' ELSE 'duplicate_copy' END AS action FROM documents")
def j05(spark, sf_dir):
    """Documents as a stream of files, decided batch by batch against the log of contents decided before. All there is
    comes in one batch here; tests take several."""
    files = _files_stream(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    at = scratch(spark)
    return S.ingest_contents(files, f"{at}/decided", f"{at}/checkpoint", "doc_id", "file_hash")


@query(
    "j06_tumbling_requests",
    """SELECT time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '1970-01-01') AS window_start, endpoint, count(*) AS requests, round(count(*) / 3600.0::double, 6) AS rate,
      count(*) FILTER (response_status >= 400) AS errors, list_sort(list(response_ms))[cast(ceil(0.95::double * count(*)) AS int)] AS p95_ms FROM audit_logs GROUP BY 1, 2""",
    "audit_logs",
)
def j06(spark, sf_dir):
    return S.tumbling_requests(audit_logs(spark, sf_dir), 60)


@query("j07_limit_breaches", "SELECT time_bucket(INTERVAL 720 MINUTE, ts, TIMESTAMP '1970-01-01') AS window_start, client_ip, endpoint, count(*) AS n, CASE endpoint WHEN '/api/click' THEN 2 ELSE 3 END AS allowed FROM audit_logs GROUP BY 1, 2, 3 HAVING count(*) > CASE endpoint WHEN '/api/click' THEN 2 ELSE 3 END", "audit_logs")
def j07(spark, sf_dir):
    return S.limit_breaches(audit_logs(spark, sf_dir), {"/api/click": 2, "default": 3}, 720)


@query("j08_keyed_sessions", """WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 120 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM s) SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM g GROUP BY user_id, sid""")
def j08(spark, sf_dir):
    return S.sessions(read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", 120)


@query("j09_redelivered_once", f"WITH {_EVENTS} SELECT status, count(*) AS n FROM (SELECT DISTINCT id, status, date_trunc('hour', ts) AS h FROM ev) GROUP BY 1")
def j09(spark, sf_dir):
    twice = _events(read(spark, sf_dir, "events")).withColumn("h", F.date_trunc("hour", "ts"))
    return S.once(twice.unionByName(twice), ["id", "status", "h"]).groupBy("status").agg(F.count("*").alias("n"))


@query("j10_stuck_alerts", f"WITH {_EVENTS}, l AS (SELECT *, lead(ts) OVER (PARTITION BY id ORDER BY ts, seq) AS nxt FROM ev) SELECT id, ts AS since FROM l WHERE status = 'processing' AND coalesce(nxt, (SELECT max(ts) FROM ev)) > ts + INTERVAL 2 HOUR")
def j10(spark, sf_dir):
    return S.stuck_batch(_events(read(spark, sf_dir, "events")))
