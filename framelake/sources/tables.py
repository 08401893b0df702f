"""The engine's tables, derived from the given ones by rules that hold in Spark and in any ANSI SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frames: one row per sampled frame or image, with its vector.
FRAME_COLUMNS = (
    "vec_id AS id",
    "cast(floor(vec_id / 10) AS bigint) AS file_id",
    "CASE WHEN cast(floor(vec_id / 10) AS bigint) % 4 = 0 THEN '/lib/d' || cast(floor(vec_id / 10) AS bigint) || '/img' || vec_id || '.jpg'"
    " ELSE '/lib/d' || (cast(floor(vec_id / 10) AS bigint) % 5) || '/v' || cast(floor(vec_id / 10) AS bigint) || '.mp4' END AS file_path",
    "CASE WHEN cast(floor(vec_id / 10) AS bigint) % 4 = 0 THEN 'image' ELSE 'video' END AS file_type",
    "CASE WHEN cast(floor(vec_id / 10) AS bigint) % 4 = 0 THEN NULL ELSE cast(vec_id % 10 AS int) END AS frame_index",
    "CASE WHEN cast(floor(vec_id / 10) AS bigint) % 4 = 0 THEN NULL ELSE cast(vec_id % 10 AS double) * 2.0 END AS ts",
    "CASE WHEN cast(floor(vec_id / 10) AS bigint) % 4 = 0 OR cast(floor(vec_id / 10) AS bigint) % 3 = 0 THEN NULL ELSE cast(floor((vec_id % 10) / 3) AS int) END AS audio_segment_index",
    "CASE label % 3 WHEN 0 THEN 'speech' WHEN 1 THEN 'music' ELSE 'non_verbal' END AS audio_segment_type",
    "CASE label % 4 WHEN 0 THEN 'Speech' WHEN 1 THEN 'Music' WHEN 2 THEN 'Hammer' ELSE 'Wind' END AS audio_event_top",
    "CASE WHEN label < 6 THEN 'phase' || label ELSE NULL END AS construction_phase",
    "CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN '' ELSE 'scene of class ' || label END AS caption",
    "CASE WHEN vec_id % 4 = 0 THEN NULL ELSE cast((vec_id * 37 % 1000) AS double) / 1000.0 END AS audio_rms_energy",
    "CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 'm' || (vec_id % 2) END AS yolo_model",
    "'c' || label AS label",
    "label AS class_id",
)
FRAMES_SQL = f"frames AS (SELECT {', '.join(FRAME_COLUMNS)}, embedding AS vector FROM embeddings)"

#: Files: one row per file that the pipeline has met. Numbers that come as text stay text here.
FILE_COLUMNS = (
    "event_id AS id",
    "CASE WHEN event_id % 11 = 0 THEN '' ELSE '/mnt/source/' END || 'u' || user_id || '/' || CASE event_id % 3 WHEN 0 THEN 'PXL_2025' WHEN 1 THEN 'DJI_2024' ELSE 'clip_' END"
    " || CASE WHEN event_id % 12 < 9 THEN '0' ELSE '1' END || CASE WHEN event_id % 12 < 9 THEN cast(event_id % 12 + 1 AS varchar(2)) ELSE cast(event_id % 12 - 9 AS varchar(2)) END"
    " || '15_' || (event_id % 9500) || CASE event_id % 6 WHEN 0 THEN '.mp4' WHEN 1 THEN '.jpg' WHEN 2 THEN '.mov' WHEN 3 THEN '.PNG' WHEN 4 THEN '.m4v' ELSE '.heic' END AS file_path",
    "CASE WHEN event_id % 2 = 0 THEN 'video' ELSE 'image' END AS file_type",
    "cast(event_id % 9800 AS varchar(20)) AS hash_seed",
    "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'done' WHEN 'click' THEN 'processing' ELSE 'pending' END AS status",
    "CASE WHEN event_type = 'error' AND event_id % 10 <> 0 THEN 'stage ' || (event_id % 7) || ' failed: code ' || (user_id % 5) ELSE NULL END AS error_message",
    "CASE WHEN event_type IN ('purchase', 'view') THEN ts ELSE NULL END AS processed_at",
    "ts AS created_at",
    "CASE WHEN event_id % 13 = 0 THEN NULL ELSE cast(floor(value * 100) AS int) END AS embedding_ms",
    "'w' || (user_id % 4) AS worker_id",
    "CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE cast(cast(floor(value * 100000) AS bigint) AS varchar(20)) END AS file_size_bytes",
    "CASE WHEN event_id % 19 = 0 THEN '' ELSE cast(cast(floor(value) AS bigint) AS varchar(20)) END AS duration_secs",
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 3 = 0 END AS frame_cache_hit",
    "CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'vit-' || (event_id % 2) END AS model_version",
    "CASE WHEN event_type IN ('purchase', 'view') AND event_id % 9 <> 0 THEN event_id * 10 ELSE NULL END AS point_id",
    "user_id AS user_id",
)
FILES_SQL = f"media_files AS (SELECT {', '.join(FILE_COLUMNS)} FROM events)"

#: Requests: the append-only log.
AUDIT_COLUMNS = (
    "event_id AS id",
    "ts AS ts",
    "'/api/' || event_type AS endpoint",
    "CASE WHEN event_type IN ('click', 'purchase') THEN 'POST' ELSE 'GET' END AS method",
    "CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 23 = 0 THEN 404 ELSE 200 END AS response_status",
    "cast(floor(value * 20) AS int) AS response_ms",
    "'10.0.' || (user_id % 8) || '.' || (user_id % 200) || CASE WHEN event_id % 4 = 0 THEN ', 192.168.0.1' ELSE '' END AS forwarded_for",
    "CASE WHEN event_id % 5 = 0 THEN '' ELSE props END AS body",
    "'10.0.' || (user_id % 8) || '.' || (user_id % 200) AS client_ip",
)
AUDIT_SQL = f"audit_logs AS (SELECT {', '.join(AUDIT_COLUMNS)} FROM events)"

#: Segments: three for a video file whose id is no multiple of 3, with a gap between the second and the third.
SEGMENTS_SQL = """segments AS (
  SELECT DISTINCT f.file_path, s.i AS segment_index, s.a AS start_sec, s.b AS end_sec FROM (SELECT DISTINCT file_path, file_id FROM frames WHERE file_type = 'video' AND file_id % 3 <> 0) f
  CROSS JOIN (SELECT 0 AS i, 0.0e0 AS a, 6.0e0 AS b UNION ALL SELECT 1, 6.0e0, 11.0e0 UNION ALL SELECT 2, 15.0e0, 18.0e0) s)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr(*FRAME_COLUMNS, "embedding AS vector")


def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session zone UTC; the source's zone-less times become instants."""
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).selectExpr(*FILE_COLUMNS)


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).selectExpr(*AUDIT_COLUMNS)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = frames(spark, sf_dir).where("file_type = 'video' AND file_id % 3 <> 0").select("file_path").distinct()
    rows = F.expr("inline(array(named_struct('segment_index', 0, 'start_sec', 0.0D, 'end_sec', 6.0D), named_struct('segment_index', 1, 'start_sec', 6.0D, 'end_sec', 11.0D), named_struct('segment_index', 2, 'start_sec', 15.0D, 'end_sec', 18.0D)))")
    return files.select("file_path", rows)


def query_vectors(spark: SparkSession, sf_dir: str, every: int = 50) -> DataFrame:
    """Queries for similarity search: every row whose id is divisible by every."""
    return frames(spark, sf_dir).where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))


QUERIES_SQL = "queries AS (SELECT id AS query_id, vector AS query_vector FROM frames WHERE id % 50 = 0)"
