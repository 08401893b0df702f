"""Queries on joins, enrichment jobs and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich as K
from ..operators import joins as J
from ..sources.shared import scratch, settled
from ..sources.stores import upsert, write_report
from ..sources.tables import frames, media_files, query_vectors, read, segments
from .catalog import query
from .filter_queries import _as_of
from .search_queries import _HITS, PARAPHRASES_SQL, hits, paraphrases

_AT = "TIMESTAMP '2024-01-31 00:00:00'"
_SEG = """(SELECT s.segment_index FROM segments s WHERE s.file_path = f.file_path AND f.ts IS NOT NULL ORDER BY CASE WHEN f.ts BETWEEN s.start_sec AND s.end_sec THEN 0 ELSE 1 END,
  CASE WHEN f.ts BETWEEN s.start_sec AND s.end_sec THEN 0 ELSE abs(f.ts - (s.start_sec + s.end_sec) / 2) END, s.segment_index LIMIT 1)"""


@query("e01_point_in_segment", f"SELECT id, {_SEG} AS segment_index FROM frames f", "segments")
def e01(spark, sf_dir):
    return J.segment_for_frame(frames(spark, sf_dir), segments(spark, sf_dir))


@query(
    "e02_window_readings",
    """WITH p AS (SELECT event_id AS id, user_id AS source, cast(floor(epoch(ts)) AS bigint) AS t FROM events WHERE event_type = 'purchase'),
      r AS (SELECT user_id AS source, cast(floor(epoch(ts)) AS bigint) AS t, event_id AS seq, value AS rate, event_type AS activity, least(1.0, abs(value - 75) / 60) AS stress FROM events WHERE event_type <> 'purchase'),
      m AS (SELECT p.id, count(*) AS n, round(avg(rate), 6) AS avg_rate, round(max(rate), 6) AS max_rate, list(activity ORDER BY seq)[cast(floor(count(*) / 2) AS bigint) + 1] AS activity, round(avg(stress), 6) AS avg_stress FROM p JOIN r ON p.source = r.source AND abs(p.t - r.t) <= 21600 GROUP BY 1)
      SELECT p.id, n, avg_rate, max_rate, activity, avg_stress FROM p LEFT JOIN m USING (id)""",
)
def e02(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))
    points = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), "t")
    readings = e.where("event_type <> 'purchase'").select(F.col("user_id").alias("source"), "t", F.col("event_id").alias("seq"), F.col("value").alias("rate"), F.col("event_type").alias("activity"), F.expr("least(1.0D, abs(value - 75) / 60)").alias("stress"))
    return J.window_readings(points, readings, 21600, digits=(6, 6))


_NAMED = "SELECT id, coalesce(cast(make_date(CASE WHEN contains(file_path, 'PXL_2025') THEN 2025 ELSE NULL END, cast(id % 12 + 1 AS int), 15) AS timestamp), created_at) AS taken FROM media_files"
_PHASE_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS phase, TIMESTAMP '{a}' AS a, TIMESTAMP '{b}' AS b" for n, a, b in J.PHASES)


@query("e03_phase_labels", f"SELECT id, phase FROM ({_NAMED}) t JOIN ({_PHASE_ROWS}) p ON taken BETWEEN a AND b", "media_files")
def e03(spark, sf_dir):
    from ..functions.scalars import date_from_name

    files = media_files(spark, sf_dir)
    own = F.when(F.col("file_path").contains("PXL_2025"), date_from_name(F.col("file_path")).cast("timestamp"))
    return J.label_by_window(files.select("id", F.coalesce(own, "created_at").alias("taken")), J.PHASES, F.col("taken")).select("id", "phase")


@query("e04_orphan_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def e04(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file_path"), "l_orderkey", "l_linenumber")
    return J.orphans(rows, read(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("file_path"))).select("l_orderkey", "l_linenumber")


@query("e05_unindexed_objects", "SELECT count(*) FILTER (d) AS kept, count(*) FILTER (NOT d) AS deleted, cast(coalesce(sum(CASE WHEN NOT d THEN size END), 0) AS bigint) AS freed FROM (SELECT file_path IN (SELECT file_path FROM media_files WHERE status = 'done' AND point_id IS NOT NULL) AS d, size FROM (SELECT file_path, id % 1000 AS size FROM media_files))", "media_files")
def e05(spark, sf_dir):
    files = media_files(spark, sf_dir)
    return J.unindexed(files.select("file_path", (F.col("id") % 1000).alias("size")), files)


@query("e06_skip_stored", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def e06(spark, sf_dir):
    stored = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(stored, "o_custkey", "left_anti").select("o_orderkey")


@query("e07_payload_enrichment", "SELECT id, CASE WHEN id % 4 = 1 THEN 'n2' ELSE yolo_model END AS yolo_model, CASE WHEN id % 4 = 1 THEN cast(id % 6 AS int) END AS yolo_object_count FROM frames", "frames")
def e07(spark, sf_dir):
    f = frames(spark, sf_dir).select("id", "yolo_model")
    results = read(spark, sf_dir, "embeddings").where("vec_id % 4 = 1").select(F.col("vec_id").alias("id"), F.lit("n2").alias("yolo_model"), (F.col("vec_id") % 6).cast("int").alias("yolo_object_count"))
    return J.enrich(f, results, ["yolo_model", "yolo_object_count"])


@query("e08_file_features", "SELECT id, file_path, round(avg(audio_rms_energy) OVER (PARTITION BY file_path), 6) AS file_energy FROM frames", "frames")
def e08(spark, sf_dir):
    f = frames(spark, sf_dir).select("id", "file_path", "audio_rms_energy")
    return f.join(f.groupBy("file_path").agg(F.round(F.avg("audio_rms_energy"), 6).alias("file_energy")), "file_path").select("id", "file_path", "file_energy")


@query(
    "e10_nearest_label",
    "WITH l AS (SELECT id AS label_index, vector AS label_vector FROM frames WHERE id < 36), p AS (SELECT f.id, l.label_index, round(list_dot_product(cast(f.vector AS double[]), cast(label_vector AS double[])) / (sqrt(list_dot_product(cast(f.vector AS double[]), cast(f.vector AS double[]))) * sqrt(list_dot_product(cast(label_vector AS double[]), cast(label_vector AS double[])))), 9) AS s FROM frames f CROSS JOIN l) SELECT id, label_index, s AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, label_index) AS n FROM p) WHERE n = 1",
    "frames",
)
def e10(spark, sf_dir):
    f = frames(spark, sf_dir)
    return J.nearest_label(f, f.where("id < 36").select(F.col("id").alias("label_index"), F.col("vector").alias("label_vector")))


@query("e11_missing_since", "SELECT id FROM media_files WHERE status = 'pending' AND file_path NOT IN (SELECT file_path FROM media_files WHERE id % 2 = 0)", "media_files")
def e11(spark, sf_dir):
    files = media_files(spark, sf_dir)
    return J.orphans(files.where("status = 'pending'").select("id", "file_path"), files.where("id % 2 = 0")).select("id")


@query("e12_hash_membership", "SELECT doc_id, r.recorded_path, r.recorded_path IS NOT NULL AS is_recorded FROM (SELECT doc_id, sha256(text) AS h FROM documents) d LEFT JOIN (SELECT sha256(text) AS h, min(source || '/' || doc_id) AS recorded_path FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) r USING (h)")
def e12(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"))
    return J.recorded_hashes(docs.select("doc_id", "file_hash"), docs.where("doc_id % 2 = 0")).select("doc_id", "recorded_path", "is_recorded")


@query("e13_missing_artefacts", "SELECT file_path, CASE WHEN bool_or(id % 3 = 0) THEN 'skipped' ELSE 'dispatched' END AS action FROM media_files WHERE regexp_matches(lower(file_path), '\\.(mp4|mov|m4v)$') GROUP BY 1", "media_files")
def e13(spark, sf_dir):
    files = media_files(spark, sf_dir)
    return J.missing_artefacts(files, files.where("id % 3 = 0").select(F.concat("file_path", F.lit(".moov")).alias("file_path")))


@query("h01_result_jaccard", f"WITH {_HITS}, a AS (SELECT query_id, list(id) AS x FROM hits WHERE rank <= 10 GROUP BY 1), b AS (SELECT query_id, list(id) AS y FROM hits WHERE rank > 5 AND rank <= 20 GROUP BY 1) SELECT query_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM a JOIN b USING (query_id)", "frames queries")
def h01(spark, sf_dir):
    h = hits(spark, sf_dir)
    sets = lambda c: h.where(c).groupBy("query_id").agg(F.collect_set("id").alias("ids"))
    return J.paraphrase_jaccard(sets("rank <= 10"), sets("rank > 5 AND rank <= 20")).withColumn("jaccard", F.round("jaccard", 6))


@query("h02_paraphrase_consistency", f"WITH {_HITS}, c AS ({PARAPHRASES_SQL}) SELECT * FROM c", "frames queries")
def h02(spark, sf_dir):
    return paraphrases(spark, sf_dir)


@query("h03_tagged_union", "SELECT source, count(*) AS n, count(DISTINCT key) AS keys FROM (SELECT 'files' AS source, file_path AS key FROM media_files UNION ALL SELECT 'frames', file_path FROM frames UNION ALL SELECT 'pages', url FROM pages) GROUP BY 1", "media_files frames")
def h03(spark, sf_dir):
    tag = lambda df, c, s: df.select(F.lit(s).alias("source"), F.col(c).alias("key"))
    rows = tag(media_files(spark, sf_dir), "file_path", "files").unionByName(tag(frames(spark, sf_dir), "file_path", "frames")).unionByName(tag(read(spark, sf_dir, "pages"), "url", "pages"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query("h04_missing_classes", "SELECT DISTINCT label FROM frames WHERE label NOT IN (SELECT label FROM frames WHERE id < 12)", "frames")
def h04(spark, sf_dir):
    f = frames(spark, sf_dir).select("id", "label")
    return f.select("label").distinct().join(f.where("id < 12").select("label").distinct(), "label", "left_anti")


_LABELS = "SELECT file_path, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM frames GROUP BY 1"


@query("h05_equal_label_sets", f"SELECT labels, count(*) AS files FROM ({_LABELS}) GROUP BY 1", "frames")
def h05(spark, sf_dir):
    sets = frames(spark, sf_dir).groupBy("file_path").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return sets.groupBy(F.array_join("labels", ",").alias("labels")).agg(F.count("*").alias("files"))


@query("k01_batch_encode")
def k01(spark, sf_dir):
    """Documents that can be read, encoded by their runs of three letters; every seventh is unreadable and left out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("text")).otherwise("").alias("text"))
    made = K.batch_encode(docs, "doc_id", "text", K.hash_encoder)
    return made.select("doc_id", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("k02_encode_once", f"WITH asked AS (SELECT DISTINCT sha256(text) AS key FROM conversations WHERE role = 'user'), cache AS (SELECT sha256(text) AS key, max({_AT} - INTERVAL 1 DAY * (conv_id % 14)) AS cached_at FROM conversations WHERE role = 'user' AND conv_id % 2 = 0 GROUP BY 1), live AS (SELECT * FROM cache WHERE cached_at > {_AT} - INTERVAL 7 DAY) SELECT key, true AS was_cached FROM live UNION ALL SELECT key, false FROM asked WHERE key NOT IN (SELECT key FROM live)")
def k02(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").where("role = 'user'").select(F.sha2("text", 256).alias("key"), F.col("text").alias("content"), "conv_id")
    age = F.expr("make_dt_interval(cast(conv_id % 14 AS int))")
    cache = rows.where("conv_id % 2 = 0").groupBy("key").agg(F.max(_as_of() - age).alias("cached_at")).withColumn("vector", F.array(F.lit(0.0).cast("float")))
    return K.encode_once(rows, cache, K.hash_encoder, _as_of()).select("key", (F.size("vector") == 1).alias("was_cached"))


_CAPTION = "SELECT id, CASE WHEN id % 10 = 9 OR frame_index IS NULL THEN 'failed' WHEN id % 6 = 0 THEN 'skipped' ELSE 'processed' END AS action FROM frames WHERE file_type = 'video' AND caption IS NULL"


def _captions(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("file_hash", F.when(F.col("id") % 10 != 9, F.concat(F.lit("h"), F.col("file_id").cast("string"))))
    return K.caption_decisions(f, f.where("id % 6 <> 0"))


@query("k03_caption_decisions", _CAPTION, "frames")
def k03(spark, sf_dir):
    return _captions(spark, sf_dir).select("id", "action")


@query("f32_backfill_summary", f"SELECT count(*) AS total, count(*) FILTER (action = 'processed') AS processed, count(*) FILTER (action = 'skipped') AS skipped, count(*) FILTER (action = 'failed') AS failed FROM ({_CAPTION})", "frames")
def f32(spark, sf_dir):
    return K.summary(_captions(spark, sf_dir))


@query("k04_segment_backfill", f"SELECT id, CASE WHEN gate THEN NULL ELSE {_SEG} END AS segment_index, CASE WHEN gate THEN 'skipped' ELSE 'processed' END AS action FROM (SELECT *, min(id) OVER (PARTITION BY file_path) % 20 = 10 AS gate FROM frames WHERE file_type = 'video') f", "segments")
def k04(spark, sf_dir):
    f = frames(spark, sf_dir).where("file_type = 'video'").withColumn("method", F.when(F.col("id") % 20 == 10, "vad_two_pass").otherwise("old"))
    return K.segment_backfill(f, segments(spark, sf_dir))


@query("k05_file_feature_backfill", f"SELECT id, CASE WHEN id % 2 = 0 THEN true WHEN file_id % 5 = 0 THEN false ELSE file_id % 3 = 1 END AS has_speech, CASE WHEN id % 2 = 0 THEN 1.0 WHEN file_id % 5 = 0 THEN 0.0 ELSE cast(file_id % 7 AS double) END AS energy, CASE WHEN id % 2 <> 0 THEN {_AT} END AS updated_at FROM frames", "frames")
def k05(spark, sf_dir):
    f = frames(spark, sf_dir)
    f = f.select("id", "file_path", "file_id", F.when(F.col("id") % 2 == 0, F.lit(True)).alias("has_speech"), F.when(F.col("id") % 2 == 0, 1.0).alias("energy"), F.lit(None).cast("timestamp").alias("updated_at"))
    features = f.where("file_id % 5 <> 0").groupBy("file_path").agg((F.max("file_id") % 3 == 1).alias("has_speech"), (F.max("file_id") % 7).cast("double").alias("energy"))
    return K.file_feature_backfill(f, features, _as_of()).select("id", "has_speech", "energy", "updated_at")


@query("k06_detection_targets", "SELECT id FROM frames WHERE contains(file_path, '/d2/') AND id % 3 <> 0 AND frame_index IS NOT NULL", "frames")
def k06(spark, sf_dir):
    labels = F.when(F.col("id") % 3 == 0, F.array(F.lit("person"))).when(F.col("id") % 3 == 1, F.array().cast("array<string>"))
    f = frames(spark, sf_dir).withColumn("yolo_labels", labels).withColumn("file_hash", F.col("file_id").cast("string"))
    return K.detection_targets(f, "/d2/").select("id")


@query("k07_status_reset", f"SELECT id, CASE WHEN (status = 'error' AND coalesce(error_message LIKE '%code 3%', false)) OR (status = 'processing' AND created_at < {_AT} - INTERVAL 2 HOUR) THEN 'pending' ELSE status END AS status FROM media_files", "media_files")
def k07(spark, sf_dir):
    return K.reset_status(media_files(spark, sf_dir), _as_of(), "%code 3%").select("id", "status")


@query("k08_default_version", "SELECT id, CASE WHEN status = 'done' AND model_version IS NULL THEN 'pre-tracking' ELSE model_version END AS model_version FROM media_files", "media_files")
def k08(spark, sf_dir):
    return K.default_version(media_files(spark, sf_dir)).select("id", "model_version")


def _chain(spark, sf_dir):
    mark = lambda cond, text: lambda df: df.withColumn("error", F.when(cond, text))
    steps = [("embed", mark(F.col("id") % 9 == 0, "no vector")), ("guard", mark(F.col("label") == "c3", "blocked")), ("answer", lambda df: df.withColumn("answer", F.concat(F.lit("ok "), "label")))]
    return K.run_observed_steps(frames(spark, sf_dir).select("id", "label"), steps, settled)


@query("k11_step_chain", "SELECT id, CASE WHEN id % 9 = 0 THEN 'no vector' WHEN label = 'c3' THEN 'blocked' END AS error, CASE WHEN id % 9 = 0 OR label = 'c3' THEN NULL ELSE 'ok ' || label END AS answer FROM frames", "frames")
def k11(spark, sf_dir):
    return _chain(spark, sf_dir)[0].select("id", "error", "answer")


@query(
    "k11_step_metrics",
    """SELECT 'embed' AS step, count(*) AS n_rows, count(*) FILTER (id % 9 = 0) AS failed, true AS timed FROM frames UNION ALL SELECT 'guard', count(*) FILTER (id % 9 <> 0), count(*) FILTER (id % 9 <> 0 AND label = 'c3'), true FROM frames
      UNION ALL SELECT 'answer', count(*) FILTER (id % 9 <> 0 AND label <> 'c3'), 0, true FROM frames""",
    "frames",
)
def k11_metrics(spark, sf_dir):
    """Rows and failures of every step as its run told them, and whether it was timed."""
    told = _chain(spark, sf_dir)[1]
    return spark.createDataFrame([(t.name, t.rows, t.failed, t.seconds > 0) for t in told], "step string, n_rows long, failed long, timed boolean")


@query("f24_detection_rollup", "SELECT l_orderkey, coalesce(array_to_string(list_sort(list_distinct(list(l_returnflag) FILTER (l_discount >= 0.05))), ','), '') AS labels, cast(count(*) FILTER (l_discount >= 0.05) AS int) AS n FROM lineitem GROUP BY 1")
def f24(spark, sf_dir):
    d = F.collect_list(F.struct(F.col("l_returnflag").alias("label"), F.col("l_discount").alias("confidence")))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(d.alias("d")).select("l_orderkey", K.detection_rollup(F.col("d"), 0.05).alias("r"))
    return rows.select("l_orderkey", F.array_join("r.labels", ",").alias("labels"), F.col("r.n").alias("n"))


@query("a15_upsert_report", "SELECT status, count(*) AS n FROM (SELECT id, CASE WHEN id % 5 = 0 THEN 'done' ELSE status END AS status FROM media_files) GROUP BY 1", "media_files")
def a15(spark, sf_dir):
    files = media_files(spark, sf_dir).select("id", "status")
    report = upsert(files, files.where("id % 5 = 0").withColumn("status", F.lit("done")), ["id"]).groupBy("status").agg(F.count("*").alias("n"))
    path = scratch(spark)
    write_report(report, path)
    return spark.read.schema(report.schema).json(path)

