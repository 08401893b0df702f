"""Queries on statistics, windows, sessions and hold-outs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import context_line, extension
from ..operators import joins as J
from ..operators import ranking as G
from ..operators import stats as A
from ..sources.stores import latest
from ..sources.tables import audit_logs, frames, media_files, query_vectors, read
from .catalog import query
from .filter_queries import _as_of
from .search_queries import _HITS, _SCORED, PARAPHRASES_SQL, _hits_sql, hits, paraphrases

_AT = "TIMESTAMP '2024-01-31 00:00:00'"
_EXT = "lower(regexp_extract(file_path, '\\.[^.]+$'))"
_SEC = "embedding_ms / 1000.0::double"
_TIMING = f"count(*) AS total, nullif(round(avg({_SEC}), 2), 0) AS avg_sec, nullif(round(quantile_cont({_SEC}, 0.5), 2), 0) AS median_sec, nullif(round(quantile_cont({_SEC}, 0.95), 2), 0) AS p95_sec, nullif(round(min({_SEC}), 2), 0) AS min_sec, nullif(round(max({_SEC}), 2), 0) AS max_sec"


@query("f01_count_by_status", "SELECT status, count(*) AS n FROM media_files GROUP BY 1", "media_files")
def f01(spark, sf_dir):
    return media_files(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


_FOLD = ", ".join([f"count(*) FILTER (status = '{s}') AS status_{s}" for s in A.STATUSES] + [f"count(*) FILTER (file_type = '{t}') AS type_{t}" for t in ("image", "video")])


@query("f02_status_fold", f"SELECT {_FOLD}, count(*) AS total FROM media_files", "media_files")
def f02(spark, sf_dir):
    return A.status_fold(media_files(spark, sf_dir))


@query("f03_type_status_percent", "SELECT coalesce(file_type, 'all') AS kind, count(*) AS total, count(*) FILTER (status = 'done') AS indexed, round(count(*) FILTER (status = 'done') * 100.0::double / count(*), 1) AS pct FROM media_files GROUP BY GROUPING SETS ((file_type), ())", "media_files")
def f03(spark, sf_dir):
    return A.type_status_cube(media_files(spark, sf_dir))


@query("f04_top_errors", "SELECT substr(error_message, 1, 120) AS message, count(*) AS n FROM media_files WHERE status = 'error' AND error_message IS NOT NULL GROUP BY 1 ORDER BY n DESC, message LIMIT 10", "media_files")
def f04(spark, sf_dir):
    return A.top_errors(media_files(spark, sf_dir))


@query("f05_stuck", f"SELECT id, round(epoch({_AT} - created_at) / 3600, 4) AS age_hours FROM media_files WHERE status = 'processing' AND {_AT} - created_at > INTERVAL 2 HOUR", "media_files")
def f05(spark, sf_dir):
    return A.stuck(media_files(spark, sf_dir), _as_of()).select("id", F.round("age_hours", 4).alias("age_hours"))


@query("f06_timing", f"SELECT {_TIMING} FROM media_files WHERE status = 'done' AND embedding_ms IS NOT NULL AND processed_at >= {_AT} - INTERVAL 720 HOUR", "media_files")
def f06(spark, sf_dir):
    return A.timing(media_files(spark, sf_dir), _as_of() - F.expr("INTERVAL 720 HOURS"))


@query("f07_worker_timing", f"SELECT worker_id, {_TIMING} FROM media_files WHERE status = 'done' AND embedding_ms IS NOT NULL GROUP BY 1", "media_files")
def f07(spark, sf_dir):
    return A.timing(media_files(spark, sf_dir), by=["worker_id"])


@query("f08_worker_load", f"SELECT worker_id, count(*) AS all_time, count(*) FILTER (processed_at >= {_AT} - INTERVAL 48 HOUR) AS recent, round(avg({_SEC}) FILTER (processed_at >= {_AT} - INTERVAL 48 HOUR), 3) AS recent_avg_sec FROM media_files WHERE status = 'done' GROUP BY 1", "media_files")
def f08(spark, sf_dir):
    return A.worker_load(media_files(spark, sf_dir), _as_of() - F.expr("INTERVAL 48 HOURS"))


@query("f09_status_share", "SELECT status, count(*) AS n, round(count(*) * 100.0::double / sum(count(*)) OVER (), 1) AS pct FROM media_files GROUP BY 1", "media_files")
def f09(spark, sf_dir):
    return A.share(media_files(spark, sf_dir), "status")


@query("f10_backlog_eta", f"SELECT *, round(pending * 48.0::double / nullif(recent, 0), 1) AS eta_hours FROM (SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'done' AND processed_at >= {_AT} - INTERVAL 48 HOUR) AS recent FROM media_files)", "media_files")
def f10(spark, sf_dir):
    return A.backlog_eta(media_files(spark, sf_dir), _as_of(), 48)


_HOURLY = "count(*) AS files, count(*) FILTER (file_type = 'video') AS videos, count(*) FILTER (file_type = 'image') AS images FROM media_files"


@query("f11_hourly_throughput", f"SELECT date_trunc('hour', processed_at) AS hour, {_HOURLY} WHERE processed_at IS NOT NULL GROUP BY 1", "media_files")
def f11(spark, sf_dir):
    return A.hourly(media_files(spark, sf_dir), "processed_at")


@query("f12_hourly_discovery", f"SELECT date_trunc('hour', created_at) AS hour, {_HOURLY} WHERE created_at >= {_AT} - INTERVAL 72 HOUR GROUP BY 1", "media_files")
def f12(spark, sf_dir):
    return A.hourly(media_files(spark, sf_dir), "created_at", _as_of() - F.expr("INTERVAL 72 HOURS"))


_BUCKETS = "b AS (SELECT date_trunc('hour', processed_at) AS bucket, count(*) AS n FROM media_files WHERE processed_at IS NOT NULL GROUP BY 1), cal AS (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL 1 HOUR)) AS bucket), full_b AS (SELECT bucket, coalesce(n, 0) AS n FROM cal LEFT JOIN b USING (bucket))"


@query("f13_resample", f"WITH {_BUCKETS} SELECT bucket, n FROM full_b", "media_files")
def f13(spark, sf_dir):
    return A.resample(media_files(spark, sf_dir), "processed_at", "hour")


@query("f13_minute_summary", "SELECT count(*) AS minutes, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, max(n) AS top FROM (SELECT date_trunc('minute', processed_at) AS m, count(*) AS n FROM media_files WHERE processed_at IS NOT NULL GROUP BY 1)", "media_files")
def f13_minutes(spark, sf_dir):
    per = media_files(spark, sf_dir).where("processed_at IS NOT NULL").groupBy(F.date_trunc("minute", "processed_at").alias("m")).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("minutes"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.max("n").alias("top"))


_PER_EXT = f"SELECT {_EXT} AS file_ext, count(*) AS n, round(avg({_SEC}), 6) AS mean_sec, round(stddev_samp({_SEC}), 6) AS std_sec, round(max({_SEC}), 6) AS max_sec FROM media_files WHERE status = 'done' AND embedding_ms IS NOT NULL GROUP BY 1"


@query("f14_extension_timing", _PER_EXT, "media_files")
def f14(spark, sf_dir):
    return A.by_extension(media_files(spark, sf_dir), extension(F.col("file_path")))


@query("f15_slowest_fastest", f"SELECT max_by(file_ext, mean_sec) AS slowest, min_by(file_ext, mean_sec) AS fastest, round(max(mean_sec) / min(mean_sec), 6) AS ratio FROM ({_PER_EXT})", "media_files")
def f15(spark, sf_dir):
    return A.slowest_fastest(A.by_extension(media_files(spark, sf_dir), extension(F.col("file_path"))))


@query("f16_cache_hit_rate", "SELECT round(avg(CASE WHEN frame_cache_hit THEN 1.0::double WHEN NOT frame_cache_hit THEN 0.0::double END), 6) AS rate, count(frame_cache_hit) AS n FROM media_files", "media_files")
def f16(spark, sf_dir):
    return media_files(spark, sf_dir).agg(F.round(F.avg(F.col("frame_cache_hit").cast("double")), 6).alias("rate"), F.count("frame_cache_hit").alias("n"))


@query("f17_type_distribution", f"SELECT file_ext, count(*) AS n, round(count(*) * 100.0::double / sum(count(*)) OVER (), 1) AS pct FROM (SELECT {_EXT} AS file_ext FROM media_files) GROUP BY 1", "media_files")
def f17(spark, sf_dir):
    return A.share(media_files(spark, sf_dir).select(extension(F.col("file_path")).alias("file_ext")), "file_ext")


@query("f18_storage", "SELECT count(s) AS n, round(sum(s) / 1e9, 6) AS total_gb, round(avg(s) / 1e6, 6) AS avg_mb, round(max(s) / 1e9, 6) AS max_gb FROM (SELECT cast(try_cast(file_size_bytes AS bigint) AS double) AS s FROM media_files)", "media_files")
def f18(spark, sf_dir):
    return A.storage(media_files(spark, sf_dir), F.expr("try_cast(file_size_bytes AS bigint)"))


@query("f19_top_tags", "SELECT tag, count(*) AS n FROM (SELECT unnest(['t' || (event_id % 13), 'u' || (user_id % 5), event_type]) AS tag FROM events) GROUP BY 1 ORDER BY n DESC, tag LIMIT 10")
def f19(spark, sf_dir):
    tags = F.to_json(F.array(F.concat(F.lit("t"), F.col("event_id") % 13), F.concat(F.lit("u"), F.col("user_id") % 5), F.col("event_type")))
    rows = read(spark, sf_dir, "events").select(F.explode(F.from_json(tags, "array<string>")).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)


@query("f20_coverage", "SELECT count(*) AS points, count(*) FILTER (caption IS NOT NULL) AS captioned, count(*) FILTER (yolo_model IS NOT NULL) AS enriched, round(count(*) FILTER (caption IS NOT NULL) * 100.0::double / count(*), 1) AS captioned_pct, round(count(*) FILTER (yolo_model IS NOT NULL) * 100.0::double / count(*), 1) AS enriched_pct FROM frames", "frames")
def f20(spark, sf_dir):
    return A.coverage(frames(spark, sf_dir), captioned=F.col("caption").isNotNull(), enriched=F.col("yolo_model").isNotNull())


@query("f21_distinct_values", "SELECT DISTINCT caption AS value FROM frames WHERE caption <> ''", "frames")
def f21(spark, sf_dir):
    return frames(spark, sf_dir).where("caption <> ''").select(F.col("caption").alias("value")).distinct()


@query(
    "f22_topic_tags",
    "WITH l AS (SELECT id AS label_index, vector AS v FROM frames WHERE id < 36), p AS (SELECT f.id, l.label_index, round(list_dot_product(cast(f.vector AS double[]), cast(v AS double[])) / (sqrt(list_dot_product(cast(f.vector AS double[]), cast(f.vector AS double[]))) * sqrt(list_dot_product(cast(v AS double[]), cast(v AS double[])))), 9) AS s FROM (SELECT * FROM frames WHERE id >= 36 ORDER BY md5(cast(id AS varchar)), id LIMIT 400) f CROSS JOIN l) SELECT cast(row_number() OVER (ORDER BY n DESC, met) AS int) AS place, label_index, n FROM (SELECT label_index, count(*) AS n, min(row(md5(cast(id AS varchar)), id)) AS met FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, label_index) AS k FROM p) WHERE k = 1 GROUP BY 1) ORDER BY place LIMIT 10",
    "frames",
)
def f22(spark, sf_dir):
    f = frames(spark, sf_dir)
    return J.topic_tags(f.where("id >= 36"), f.where("id < 36").select(F.col("id").alias("label_index"), F.col("vector").alias("label_vector")))


@query("f23_version_census", "SELECT model_version, count(*) AS n, min(processed_at) AS first, max(processed_at) AS last FROM media_files GROUP BY 1", "media_files")
def f23(spark, sf_dir):
    return media_files(spark, sf_dir).groupBy("model_version").agg(F.count("*").alias("n"), F.min("processed_at").alias("first"), F.max("processed_at").alias("last"))


_LE = " UNION ALL ".join(f"SELECT {b}::double AS le" for b in A.LATENCY_BUCKETS) + " UNION ALL SELECT 'inf'::double"
_HIST = f"h AS (SELECT endpoint, le, count(*) FILTER (response_ms / 1000.0::double <= le) AS n FROM audit_logs CROSS JOIN ({_LE}) GROUP BY 1, 2)"


@query("f25_latency_histogram", f"WITH {_HIST} SELECT endpoint, CASE WHEN NOT isinf(le) THEN le END AS le, n FROM h", "audit_logs")
def f25(spark, sf_dir):
    """The last bucket has no bound: null here."""
    made = A.histogram(audit_logs(spark, sf_dir), ["endpoint"], F.col("response_ms") / 1000.0, A.LATENCY_BUCKETS)
    return made.withColumn("le", F.when(F.col("le") != float("inf"), F.col("le")))


@query(
    "f25_histogram_quantile",
    f"""WITH {_HIST}, b AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS low, max(n) OVER (PARTITION BY endpoint) AS total FROM h WINDOW w AS (PARTITION BY endpoint ORDER BY le))
      SELECT endpoint, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (total * 0.95::double - below) / (n - below) END, 6) AS value FROM b WHERE n >= total * 0.95::double AND below < total * 0.95::double""",
    "audit_logs",
)
def f25_quantile(spark, sf_dir):
    return A.histogram_quantile(A.histogram(audit_logs(spark, sf_dir), ["endpoint"], F.col("response_ms") / 1000.0, A.LATENCY_BUCKETS), ["endpoint"], 0.95)


_RESULTS = " UNION ALL ".join(f"SELECT {b}::double AS le" for b in A.RESULT_BUCKETS) + " UNION ALL SELECT NULL"


@query("f25_result_histogram", f"WITH {_SCORED}, {_hits_sql(40, 0.3)}, r AS (SELECT q.query_id, count(h.id) AS n FROM queries q LEFT JOIN hits h USING (query_id) GROUP BY 1) SELECT le, count(*) FILTER (le IS NULL OR r.n <= le) AS n FROM r CROSS JOIN ({_RESULTS}) GROUP BY 1", "frames queries")
def f25_results(spark, sf_dir):
    """Queries by the number of their results; the last bucket has no bound: null here."""
    found = hits(spark, sf_dir, 40, 0.3).groupBy("query_id").agg(F.count("*").alias("n"))
    counts = query_vectors(spark, sf_dir).select("query_id").join(found, "query_id", "left").na.fill(0, ["n"])
    return A.histogram(counts, [], F.col("n"), A.RESULT_BUCKETS).withColumn("le", F.when(F.col("le") != float("inf"), F.col("le")))


@query("f26_request_metrics", "SELECT time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS window_start, endpoint, count(*) AS requests, round(count(*) / 600.0::double, 6) AS rate, round(avg(CASE WHEN response_status >= 400 THEN 1.0::double ELSE 0.0::double END), 6) AS error_rate, round(quantile_cont(response_ms, 0.5), 3) AS p50_ms, round(quantile_cont(response_ms, 0.95), 3) AS p95_ms FROM audit_logs GROUP BY 1, 2", "audit_logs")
def f26(spark, sf_dir):
    return A.request_metrics(audit_logs(spark, sf_dir), 10)


_METRICS = f"""m AS (SELECT query_id, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS low, max(score) AS high, count(*) FILTER (score >= 0.5 AND score < 1.01) AS exact, count(*) FILTER (score >= 0.4 AND score < 0.5) AS strong, count(*) FILTER (score >= 0.3 AND score < 0.4) AS fair, count(*) FILTER (score >= 0.22 AND score < 0.3) AS weak FROM hits WHERE score >= 0.22 AND rank <= 10 GROUP BY 1),
  r AS (SELECT q.query_id, coalesce(n, 0) AS n, round(coalesce(mean, 0), 6) AS mean, round(coalesce(std, 0), 6) AS std, round(coalesce(low, 0), 6) AS low, round(coalesce(high, 0), 6) AS high, round(coalesce(mean / greatest(std, 1e-6), 0), 6) AS snr, round(coalesce(mean - 0.22, 0), 6) AS separation, coalesce(exact, 0) AS exact, coalesce(strong, 0) AS strong, coalesce(fair, 0) AS fair, coalesce(weak, 0) AS weak FROM queries q LEFT JOIN m USING (query_id))"""


def _retrieval(spark, sf_dir):
    return A.retrieval_metrics(query_vectors(spark, sf_dir), hits(spark, sf_dir).where("score >= 0.22 AND rank <= 10"), 0.22)


@query("f27_retrieval_metrics", f"WITH {_HITS}, {_METRICS} SELECT * FROM r", "frames queries")
def f27(spark, sf_dir):
    return _retrieval(spark, sf_dir)


@query("f28_retrieval_gates", f"WITH {_HITS}, {_METRICS}, c AS ({PARAPHRASES_SQL}) SELECT *, snr >= 2.0 AND separation >= 0.05 AND hit_rate >= 0.5 AS passed FROM (SELECT (SELECT round(avg(mean), 6) FROM c) AS consistency, (SELECT round(avg(std), 6) FROM c) AS consistency_std, count(*) AS queries, round(avg(snr), 6) AS snr, round(avg(separation), 6) AS separation, round(avg(CASE WHEN n > 0 THEN 1.0::double ELSE 0.0::double END), 6) AS hit_rate FROM r)", "frames queries")
def f28(spark, sf_dir):
    return A.retrieval_gates(_retrieval(spark, sf_dir), paraphrases(spark, sf_dir))


@query("f29_answer_proxies", "SELECT *, faithfulness >= 0.70 AND relevancy >= 0.75 AS passed FROM (SELECT round(avg(CASE WHEN length(text) > 20 THEN 1.0::double ELSE 0.0::double END), 6) AS relevancy, round(avg(CASE WHEN conv_id % 3 > 0 THEN 1.0::double ELSE 0.0::double END), 6) AS faithfulness FROM conversations WHERE role = 'assistant')")
def f29(spark, sf_dir):
    contexts = F.when(F.col("conv_id") % 3 > 0, F.array(F.col("text"))).otherwise(F.array().cast("array<string>"))
    return A.answer_proxies(read(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("text").alias("answer"), contexts.alias("contexts")))


_PRED = "p AS (SELECT class_id AS label, CASE WHEN id % 4 = 0 THEN (class_id + 1) % 10 ELSE class_id END AS prediction FROM frames)"


@query(
    "f30_classifier_report",
    f"""WITH {_PRED}, t AS (SELECT label, count(*) AS support, count(*) FILTER (label = prediction) AS hit FROM p GROUP BY 1), s AS (SELECT prediction AS label, count(*) AS said FROM p GROUP BY 1),
      e AS (SELECT cast(label AS varchar) AS label, hit::double / said AS precision, hit::double / support AS recall, support, hit FROM t JOIN s USING (label)), g AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM e)
      SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (SELECT label, precision, recall, f1, support FROM g
        UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), cast(sum(support) AS bigint) FROM g UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), cast(sum(support) AS bigint) FROM g
        UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), cast(sum(support) AS bigint) FROM g)""",
    "frames",
)
def f30(spark, sf_dir):
    wrong = F.when(F.col("id") % 4 == 0, (F.col("class_id") + 1) % 10).otherwise(F.col("class_id"))
    return A.classifier_report(frames(spark, sf_dir).select(F.col("class_id").cast("string").alias("label"), wrong.cast("string").alias("prediction")))


@query("f30_confusion_matrix", f"WITH {_PRED} SELECT label, prediction, count(*) AS n, round(count(*) * 1.0::double / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM p GROUP BY 1, 2", "frames")
def f30_confusion(spark, sf_dir):
    wrong = F.when(F.col("id") % 4 == 0, (F.col("class_id") + 1) % 10).otherwise(F.col("class_id"))
    return A.confusion_matrix(frames(spark, sf_dir).select(F.col("class_id").alias("label"), wrong.alias("prediction")))


@query("f30_review_counts", "SELECT prediction, count(*) FILTER (c >= 0.85) AS automatic, count(*) FILTER (c < 0.85) AS review FROM (SELECT class_id AS prediction, (id * 37 % 1000) / 1000.0::double AS c FROM frames) GROUP BY 1", "frames")
def f30_review(spark, sf_dir):
    return A.review_counts(frames(spark, sf_dir).select(F.col("class_id").alias("prediction"), (F.col("id") * 37 % 1000 / F.lit(1000.0)).alias("confidence")))


@query("f30_baseline_drop", f"""WITH a AS (SELECT class_id AS label, round(avg(CASE WHEN id % 4 = 0 THEN 0.0::double ELSE 1.0::double END), 6) AS hit FROM frames GROUP BY 1), b AS (SELECT class_id AS label, round(avg(CASE WHEN id % 10 = 0 THEN 0.0::double ELSE 1.0::double END), 6) AS hit FROM frames GROUP BY 1)
  SELECT cast(label AS varchar) AS label, round(a.hit - b.hit, 6) AS change, a.hit - b.hit < -0.10 AS warn FROM a JOIN b USING (label)""", "frames")
def f30_drop(spark, sf_dir):
    """Recall of one split against another one's; a fall of more than ten points is a warning."""
    wrong = lambda n: F.when(F.col("id") % n == 0, (F.col("class_id") + 1) % 10).otherwise(F.col("class_id")).cast("string").alias("prediction")
    f = frames(spark, sf_dir)
    report = lambda n: A.classifier_report(f.select(F.col("class_id").cast("string").alias("label"), wrong(n)))
    return A.report_change(report(4), report(10), "recall").where("label NOT IN ('macro', 'weighted', 'accuracy')")


@query("f31_drop_small_classes", "SELECT id, file_path FROM frames WHERE file_path IN (SELECT file_path FROM frames GROUP BY 1 HAVING count(*) >= 5)", "frames")
def f31(spark, sf_dir):
    return G.drop_small_classes(frames(spark, sf_dir), "file_path").select("id", "file_path")


_SESSIONS = """s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 600 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM s), ses AS (SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n, round(epoch(max(ts) - min(ts)) / 60, 1) AS minutes FROM g GROUP BY user_id, sid)"""


@query("g01_gap_sessions", f'WITH {_SESSIONS} SELECT user_id, start, "end", n, minutes FROM ses')
def g01(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return G.gap_sessions(e, "ts", 600, ["user_id"])


@query("g01_last_sessions", """WITH s AS (SELECT ts, CASE WHEN lag(ts) OVER (ORDER BY ts) IS NULL OR ts - lag(ts) OVER (ORDER BY ts) > INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS new FROM events), g AS (SELECT *, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM s) SELECT min(ts) AS start, max(ts) AS "end", count(*) AS n, round(epoch(max(ts) - min(ts)) / 60, 1) AS minutes FROM g GROUP BY sid ORDER BY start DESC LIMIT 10""")
def g01_last(spark, sf_dir):
    return G.last_sessions(G.gap_sessions(read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts")), "ts"))


@query(
    "g02_merge_intervals",
    """WITH i AS (SELECT l_orderkey AS f, cast(l_linenumber * 5 + l_partkey % 4 AS double) AS a, cast(l_linenumber * 5 + l_partkey % 4 + l_quantity / 12 AS double) AS b FROM lineitem WHERE l_orderkey % 3 <> 0),
      m AS (SELECT *, CASE WHEN lag(b) OVER w IS NULL OR a - lag(b) OVER w > 2.0 THEN 1 ELSE 0 END AS new FROM i WINDOW w AS (PARTITION BY f ORDER BY a, b)), r AS (SELECT *, sum(new) OVER (PARTITION BY f ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m),
      k AS (SELECT f, run, min(a) AS a, max_by(b, row(a, b)) AS b FROM r GROUP BY 1, 2 HAVING max_by(b, row(a, b)) - min(a) >= 1.0)
      SELECT o_orderkey AS file_path, round(coalesce(a, 0), 6) AS start_sec, round(coalesce(b, 60.0), 6) AS end_sec, CASE WHEN o_orderkey NOT IN (SELECT f FROM i) THEN 'silence' WHEN run IS NULL THEN 'whole' ELSE 'segment' END AS kind FROM orders LEFT JOIN k ON f = o_orderkey""",
)
def g02(spark, sf_dir):
    i = read(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").selectExpr("l_orderkey AS file_path", "cast(l_linenumber * 5 + l_partkey % 4 AS double) AS start_sec", "cast(l_linenumber * 5 + l_partkey % 4 + l_quantity / 12 AS double) AS end_sec")
    files = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_path"), F.lit(60.0).alias("duration"))
    return G.merge_intervals(i, files).select("file_path", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"), "kind")


@query("g03_trailing_mean", f"WITH {_BUCKETS} SELECT bucket, n, round(avg(n) OVER (ORDER BY bucket ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM full_b", "media_files")
def g03(spark, sf_dir):
    return A.trailing_mean(A.resample(media_files(spark, sf_dir), "processed_at", "hour"), 10, "day")


@query("g04_slowest", f"SELECT id, file_path, round({_SEC}, 1) AS sec FROM media_files WHERE status = 'done' AND embedding_ms IS NOT NULL ORDER BY embedding_ms DESC, id LIMIT 20", "media_files")
def g04(spark, sf_dir):
    return G.top_n(media_files(spark, sf_dir).where("status = 'done' AND embedding_ms IS NOT NULL"), [F.desc("embedding_ms"), F.col("id")], 20).select("id", "file_path", F.round(F.col("embedding_ms") / 1000.0, 1).alias("sec"))


@query("g05_newest_errors", "SELECT id, error_message, created_at FROM media_files WHERE status = 'error' ORDER BY created_at DESC, id LIMIT 5", "media_files")
def g05(spark, sf_dir):
    return G.top_n(media_files(spark, sf_dir).where("status = 'error'"), [F.desc("created_at"), F.col("id")], 5).select("id", "error_message", "created_at")


@query("g06_latest_per_key", "SELECT file_path, id, status FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY created_at DESC, id) AS n FROM media_files) WHERE n = 1", "media_files")
def g06(spark, sf_dir):
    return latest(media_files(spark, sf_dir), ["file_path"], [F.desc("created_at"), F.col("id")]).select("file_path", "id", "status")


_BUDGET = 50_000_000


@query("g07_trim_to_budget", f"SELECT key, size, total - before > {_BUDGET} AS \"delete\" FROM (SELECT o_orderkey AS key, s AS size, sum(s) OVER () AS total, coalesce(sum(s) OVER (ORDER BY o_orderdate DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, cast(floor(o_totalprice) AS bigint) AS s FROM orders))")
def g07(spark, sf_dir):
    objects = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.floor("o_totalprice").alias("size"), F.col("o_orderdate").alias("last_modified"))
    return G.trim_to_budget(objects, _BUDGET)


@query(
    "g08_greedy_fill",
    """WITH RECURSIVE r AS (SELECT o_custkey AS c, o_orderkey AS k, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
      w AS (SELECT c, rn, k, s, CASE WHEN s <= 300000 THEN s ELSE 0.0::double END AS used, CASE WHEN s <= 300000 THEN 1 ELSE 0 END AS n, s <= 300000 AS keep FROM r WHERE rn = 1
        UNION ALL SELECT r.c, r.rn, r.k, r.s, CASE WHEN w.used + r.s <= 300000 AND w.n < 4 THEN w.used + r.s ELSE w.used END, CASE WHEN w.used + r.s <= 300000 AND w.n < 4 THEN w.n + 1 ELSE w.n END, w.used + r.s <= 300000 AND w.n < 4 FROM w JOIN r ON r.c = w.c AND r.rn = w.rn + 1)
      SELECT c AS list, k AS key, s AS size FROM w WHERE keep""",
)
def g08(spark, sf_dir):
    items = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("list"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("size"))
    return G.greedy_fill(items, "list", 300_000, 4)


@query(
    "g09_best_rendition",
    """SELECT item, key, width FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY CASE quality WHEN 'hd' THEN 0 WHEN 'sd' THEN 1 ELSE 2 END, width DESC, key) AS n FROM (SELECT l_orderkey AS item, CASE l_linenumber % 4 WHEN 0 THEN 'hls' WHEN 1 THEN 'sd' WHEN 2 THEN 'hd' ELSE '4k' END AS quality, cast(l_quantity * 40 AS int) AS width, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice * 4000 END AS size, l_linenumber AS key, CASE WHEN l_returnflag = 'R' THEN 'text/html' ELSE 'video/mp4' END AS t FROM lineitem)
      WHERE quality <> '4k' AND starts_with(t, 'video/') AND width >= 640 AND coalesce(size, 0) <= 200e6) WHERE n = 1""",
)
def g09(spark, sf_dir):
    files = read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS item", "CASE l_linenumber % 4 WHEN 0 THEN 'hls' WHEN 1 THEN 'sd' WHEN 2 THEN 'hd' ELSE '4k' END AS quality", "cast(l_quantity * 40 AS int) AS width",
        "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice * 4000 END AS size", "l_linenumber AS key", "CASE WHEN l_returnflag = 'R' THEN 'text/html' ELSE 'video/mp4' END AS file_type",
    )
    return G.best_rendition(files).select("item", "key", "width")


@query("g10_temporal_holdout", "SELECT o_orderkey, CASE WHEN cut = 0 OR cut = n OR k <= cut THEN 'train' ELSE 'test' END AS part FROM (SELECT o_orderkey, floor(count(*) OVER (PARTITION BY o_orderpriority) * 0.8) AS cut, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k FROM orders)")
def g10(spark, sf_dir):
    return G.temporal_holdout(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_orderkey").select("o_orderkey", "part")


@query("g11_boundary_holdout", "SELECT o_orderkey, CASE WHEN o_orderdate BETWEEN TIMESTAMP '1995-06-01' - INTERVAL 14 DAY AND TIMESTAMP '1995-06-01' + INTERVAL 14 DAY OR o_orderdate BETWEEN TIMESTAMP '1997-01-01' - INTERVAL 14 DAY AND TIMESTAMP '1997-01-01' + INTERVAL 14 DAY THEN 'test' ELSE 'train' END AS part FROM orders")
def g11(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    split = G.boundary_holdout(rows, ["1995-06-01", "1997-01-01"], "o_orderdate")
    used, _ = G.with_fallback(split, G.stratified_holdout(rows, "o_orderpriority", "o_orderkey"), "o_orderpriority")
    return used.select("o_orderkey", "part")


@query("g12_source_holdout", "SELECT id, CASE WHEN contains(file_path, '/d2/') THEN 'test' ELSE 'train' END AS part FROM frames", "frames")
def g12(spark, sf_dir):
    f = frames(spark, sf_dir)
    used, _ = G.with_fallback(G.source_holdout(f, "file_path", "/d2/"), G.stratified_holdout(f, "class_id", "id"), "class_id", least_train=10)
    return used.select("id", "part")


_STRATIFIED = "row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(cast(o_orderkey AS varchar)), o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderpriority) * 0.8)"


@query("g11_holdout_falls_back", f"SELECT o_orderkey, CASE WHEN {_STRATIFIED} THEN 'train' ELSE 'test' END AS part FROM orders")
def g11_fallback(spark, sf_dir):
    """No order lies near the boundary asked for, so the classes are split at random instead."""
    rows = read(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    used, _ = G.with_fallback(G.boundary_holdout(rows, ["2030-06-01"], "o_orderdate"), G.stratified_holdout(rows, "o_orderpriority", "o_orderkey"), "o_orderpriority")
    return used.select("o_orderkey", "part")


@query("g13_stratified_holdout", "SELECT id, CASE WHEN row_number() OVER (PARTITION BY class_id ORDER BY md5(cast(id AS varchar)), id) <= floor(count(*) OVER (PARTITION BY class_id) * 0.8) THEN 'train' ELSE 'test' END AS part FROM frames", "frames")
def g13(spark, sf_dir):
    return G.stratified_holdout(frames(spark, sf_dir), "class_id", "id").select("id", "part")


_SECTIONS = f"WITH {_HITS}, u AS (SELECT query_id, id, rank, CASE WHEN rank % 3 = 0 THEN 'audio' WHEN rank % 3 = 1 THEN 'visual' ELSE 'vision' END AS source FROM hits), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank, id) AS n FROM u), kept AS (SELECT query_id, id, rank, source FROM k WHERE source = 'vision' OR (source = 'visual' AND n <= 5) OR (source = 'audio' AND n <= 10))"


def _capped(spark, sf_dir):
    source = F.when(F.col("rank") % 3 == 0, "audio").when(F.col("rank") % 3 == 1, "visual").otherwise("vision")
    return G.section_caps(hits(spark, sf_dir).withColumn("source", source), {"visual": 5, "audio": 10, "vision": None})


@query("g14_section_caps", f"{_SECTIONS} SELECT query_id, id, rank, source FROM kept", "frames queries")
def g14(spark, sf_dir):
    return _capped(spark, sf_dir).select("query_id", "id", "rank", "source")


@query("i18_context_text", f"{_SECTIONS} SELECT query_id, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS context FROM (SELECT query_id, kept.rank, concat_ws(' ', '[' || kept.rank || ']', file_path, 'at ' || cast(ts AS varchar) || 's', '- ' || nullif(caption, ''), '(' || construction_phase || ')') AS line FROM kept JOIN frames USING (id) WHERE source = 'visual') GROUP BY 1", "frames queries")
def i18(spark, sf_dir):
    line = context_line(F.col("rank"), F.col("file_path"), F.col("ts"), F.col("caption"), F.col("construction_phase"))
    rows = _capped(spark, sf_dir).where("source = 'visual'").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return rows.select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("context"))


@query("g15_recent_history", "SELECT user_id, props, place FROM (SELECT user_id, props, cast(row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, props) AS int) AS place FROM events GROUP BY user_id, props) WHERE place <= 5")
def g15(spark, sf_dir):
    return J.recent(read(spark, sf_dir, "events"), "user_id", "props", "ts", 5).select("user_id", "props", "place")


@query(
    "g16_anchor_rate",
    """WITH c AS (SELECT user_id, ts, CASE WHEN event_id % 40 = 0 THEN 0 ELSE cast(sum(1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bigint) END AS n FROM (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY 1, 2)),
      f AS (SELECT *, CASE WHEN n < lag(n) OVER (PARTITION BY user_id ORDER BY ts) THEN 1 ELSE 0 END AS fell FROM c), r AS (SELECT *, sum(fell) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM f),
      a AS (SELECT user_id, run, min(ts) AS ats, min_by(n, ts) AS an FROM r WHERE n > 0 GROUP BY 1, 2)
      SELECT user_id, ts, n, CASE WHEN epoch(ts - ats) / 60 >= 1 THEN round((n - an) / (epoch(ts - ats) / 60), 6) END AS rate FROM r LEFT JOIN a USING (user_id, run)""",
)
def g16(spark, sf_dir):
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    n = F.count("*").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return G.anchor_rates(e.withColumn("n", n).select("user_id", "ts", F.when(F.col("event_id") % 40 == 0, F.lit(0)).otherwise(F.col("n")).cast("long").alias("n")), "user_id")
