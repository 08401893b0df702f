"""Queries on predicates, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import predicates as P
from ..sources.listing import matches
from ..sources.tables import audit_logs, frames, media_files, read
from .catalog import query

_AS_OF = "2024-01-31 00:00:00"


def _as_of():
    return F.lit(_AS_OF).cast("timestamp")


def _contains_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


@query("b01_equality_filter", "SELECT id, file_path FROM frames WHERE audio_segment_type = 'music' AND construction_phase = 'phase1'", "frames")
def b01(spark, sf_dir):
    return frames(spark, sf_dir).where(matches(audio_segment_type="music", audio_event_top=None, construction_phase="phase1", label=None)).select("id", "file_path")


@query("b02_metadata_filter", "SELECT id, file_path, status FROM media_files WHERE status = 'error' AND file_type = 'image' ORDER BY id LIMIT 20", "media_files")
def b02(spark, sf_dir):
    return P.metadata_filter(media_files(spark, sf_dir), {"status": "error", "file_type": "image", "no_such": 1}).select("id", "file_path", "status")


@query("b03_any_text_filter", "SELECT id, file_path FROM frames WHERE contains(file_path, '/d1/') OR contains(file_path, 'img12')", "frames")
def b03(spark, sf_dir):
    return frames(spark, sf_dir).where(P.path_contains(F.col("file_path"), "/d1/", "img12")).select("id", "file_path")


@query("b04_empty_predicates", "SELECT id, caption IS NULL AS no_caption, caption IS NOT NULL AS has_caption, audio_rms_energy IS NULL AS no_energy, len(vector) = 0 AS no_vector FROM frames", "frames")
def b04(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.select("id", P.is_empty(f, "caption").alias("no_caption"), (~P.is_empty(f, "caption")).alias("has_caption"), P.is_empty(f, "audio_rms_energy").alias("no_energy"), P.is_empty(f, "vector").alias("no_vector"))


@query("b06_like_filters", "SELECT id, file_path FROM media_files WHERE file_path LIKE '%PXL%' AND starts_with(file_path, '/mnt/')", "media_files")
def b06(spark, sf_dir):
    return media_files(spark, sf_dir).where(F.col("file_path").like("%PXL%") & F.col("file_path").startswith("/mnt/")).select("id", "file_path")


@query("b07_relative_time", f"SELECT id, created_at FROM media_files WHERE created_at >= TIMESTAMP '{_AS_OF}' - INTERVAL 72 HOUR", "media_files")
def b07(spark, sf_dir):
    return media_files(spark, sf_dir).where(F.col("created_at") >= _as_of() - F.expr("INTERVAL 72 HOURS")).select("id", "created_at")


_ASKED = """asked AS (SELECT conv_id * 1000 + turn AS question_id, text || CASE conv_id % 4 WHEN 0 THEN ' in 2024' WHEN 1 THEN ' in January 2024' WHEN 2 THEN ' in summer' ELSE '' END AS question FROM conversations WHERE role = 'user'),
  parsed AS (SELECT question_id, nullif(regexp_extract(question, '\\b(199\\d|20[012]\\d)\\b', 1), '') AS y, lower(question) AS q FROM asked)"""
_MONTHS_SQL = "CASE " + " ".join(f"WHEN contains(q, '{s}') THEN {list(m)}" for s, m in S.SEASONS) + " " + " ".join(f"WHEN contains(q, '{m}') THEN [{i + 1}]" for i, m in enumerate(S.MONTHS)) + " END"


def _questions(spark, sf_dir):
    asked = read(spark, sf_dir, "conversations").where("role = 'user'")
    tail = F.expr("CASE conv_id % 4 WHEN 0 THEN ' in 2024' WHEN 1 THEN ' in January 2024' WHEN 2 THEN ' in summer' ELSE '' END")
    return asked.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.concat("text", tail).alias("question"))


def _temporal(months: bool) -> str:
    fits = f" AND (m IS NULL OR list_contains(m, month(created_at)))" if months else ""  # noqa: F541
    return f"""WITH {_ASKED}, wanted AS (SELECT question_id, cast(y AS int) AS y, {_MONTHS_SQL} AS m FROM parsed)
      SELECT question_id, rank, id, file_path, created_at FROM (
        SELECT question_id, cast(row_number() OVER (PARTITION BY question_id ORDER BY created_at DESC, id) AS int) AS rank, id, file_path, created_at
        FROM wanted JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY month(created_at) ORDER BY created_at DESC, id) AS n FROM media_files WHERE status = 'done') WHERE n <= 20) f
          ON (y IS NULL OR y = year(created_at)){fits} WHERE (y IS NOT NULL OR m IS NOT NULL)) WHERE rank <= 20"""


@query("b08_year_filter", _temporal(False), "media_files")
def b08(spark, sf_dir):
    return P.temporal_search(media_files(spark, sf_dir), _questions(spark, sf_dir))


@query("b09_month_filter", _temporal(True), "media_files")
def b09(spark, sf_dir):
    return P.temporal_search(media_files(spark, sf_dir), _questions(spark, sf_dir), months="applied")


@query("b10_payload_projection", "SELECT id, file_path, file_type, ts, coalesce(caption, '') AS caption FROM frames", "frames")
def b10(spark, sf_dir):
    return frames(spark, sf_dir).select("id", "file_path", "file_type", "ts", F.coalesce("caption", F.lit("")).alias("caption"))


@query("b11_scene_window", "SELECT id, CASE WHEN ts IS NOT NULL THEN floor(ts / 5) * 5 END AS scene_start, CASE WHEN ts IS NOT NULL THEN floor(ts / 5) * 5 + 5 END AS scene_end FROM frames", "frames")
def b11(spark, sf_dir):
    start, end = P.scene_window(F.col("ts"))
    return frames(spark, sf_dir).select("id", start.cast("double").alias("scene_start"), end.cast("double").alias("scene_end"))


@query(
    "b15_clean_columns",
    "SELECT id, try_cast(file_size_bytes AS bigint) AS size_bytes, try_cast(nullif(duration_secs, '') AS double) AS duration, lower(regexp_extract(file_path, '\\.[^.]+$')) AS file_ext, embedding_ms / 1000.0::double AS embedding_sec, cast(floor(epoch(processed_at)) AS bigint) AS processed_epoch FROM media_files",
    "media_files",
)
def b15(spark, sf_dir):
    return P.clean_files(media_files(spark, sf_dir))


@query("b16_quality_checks", "SELECT count(*) FILTER (file_type IS NULL) AS no_type, (SELECT count(*) FROM (SELECT file_path FROM media_files GROUP BY 1 HAVING count(*) > 1)) AS duplicate_paths FROM media_files", "media_files")
def b16(spark, sf_dir):
    per_path = media_files(spark, sf_dir).groupBy("file_path").agg(F.count("*").alias("n"), F.count_if(F.col("file_type").isNull()).alias("no_type"))
    return per_path.agg(F.sum("no_type").alias("no_type"), F.count_if(F.col("n") > 1).alias("duplicate_paths"))


@query("b17_dimension_check", "SELECT cast(len(vector) AS int) AS dim, count(*) AS n FROM frames GROUP BY 1", "frames")
def b17(spark, sf_dir):
    return P.dimension_counts(frames(spark, sf_dir))


@query("i01_query_cache_key", "SELECT conv_id, turn, substr(sha256(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))), 1, 24) AS cache_key FROM conversations WHERE role = 'user'")
def i01(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", S.query_cache_key(F.col("text")).alias("cache_key"))


@query("i02_frame_cache_key", "SELECT id, substr(sha256(hash_seed || ':fps=0.5:res=768'), 1, 16) AS cache_key FROM media_files", "media_files")
def i02(spark, sf_dir):
    return media_files(spark, sf_dir).select("id", S.frame_cache_key(F.col("hash_seed"), F.lit(0.5), F.lit(768)).alias("cache_key"))


@query("i03_body_hash", "SELECT id, CASE WHEN length(body) > 0 THEN sha256(body) END AS body_sha256 FROM audit_logs", "audit_logs")
def i03(spark, sf_dir):
    return audit_logs(spark, sf_dir).select("id", S.body_hash(F.col("body")).alias("body_sha256"))


@query("i04_client_ip", "SELECT id, trim(split_part(forwarded_for, ',', 1)) AS ip FROM audit_logs", "audit_logs")
def i04(spark, sf_dir):
    return audit_logs(spark, sf_dir).select("id", S.client_ip(F.col("forwarded_for"), F.col("client_ip")).alias("ip"))


@query("i05_truncations", "SELECT doc_id, substr(text, 1, 512) AS s512, substr(text, 1, 120) AS s120, substr(text, 1, 80) AS s80 FROM documents")
def i05(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", *[S.cut(F.col("text"), n).alias(f"s{n}") for n in (512, 120, 80)])


@query(
    "i06_date_from_name",
    """SELECT id, try_cast(substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) AS date) AS named_date FROM (SELECT id,
       coalesce(nullif(regexp_extract(regexp_extract(file_path, '[^/]*$'), '(?i)(PXL|VID|IMG|MVIMG|PANO)_(\\d{8})_', 2), ''), nullif(regexp_extract(regexp_extract(file_path, '[^/]*$'), '(?i)DJI_(\\d{8})', 1), '')) AS d FROM media_files)""",
    "media_files",
)
def i06(spark, sf_dir):
    return media_files(spark, sf_dir).select("id", S.date_from_name(F.col("file_path")).alias("named_date"))


@query("i07_path_parts", "SELECT page_id, regexp_extract(url, '[^/]*$') AS base_name, regexp_replace(url, '/?[^/]*$', '') AS parent, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '\\.[^.]+$')) AS ext FROM pages")
def i07(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", S.base_name(url).alias("base_name"), S.parent_dir(url).alias("parent"), S.extension(url).alias("ext"))


_A, _T, _V = (_contains_any("text", w) for w in (S.AUDIO_WORDS, S.TEMPORAL_WORDS, S.VISUAL_WORDS))


@query("i08_intent", f"SELECT conv_id, turn, CASE WHEN ({_A} AND ({_T} OR {_V})) OR ({_T} AND {_V}) THEN 'mixed' WHEN {_A} THEN 'audio' WHEN {_T} THEN 'temporal' ELSE 'visual' END AS intent FROM conversations")
def i08(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", S.intent(F.col("text")).alias("intent"))


_SPEECH = _contains_any("text", S.SPEECH_WORDS)
_SEG = " ".join(f"WHEN contains(lower(text), '{w}') THEN '{t}'" for w, t in S.SEGMENT_WORDS)
_LANG = " ".join(f"WHEN contains(lower(text), '{x}') THEN '{x}'" for x in S.LANGUAGES)


@query("i09_audio_filters", f"SELECT conv_id, turn, CASE {_SEG} WHEN {_SPEECH} THEN 'speech' END AS segment_type, CASE WHEN {_SPEECH} THEN true END AS has_speech, CASE {_LANG} END AS language_hint FROM conversations")
def i09(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", S.audio_filters(F.col("text")).alias("f")).select("conv_id", "turn", "f.*")


@query("i11_label_type", "SELECT id, CASE audio_event_top WHEN 'Speech' THEN 'speech' WHEN 'Music' THEN 'music' ELSE CASE WHEN class_id % 2 = 0 THEN 'event' ELSE 'non_verbal' END END AS segment_type FROM frames", "frames")
def i11(spark, sf_dir):
    others = F.when(F.col("class_id") % 2 == 0, F.array(F.lit("Unknown"), F.lit("Siren"))).otherwise(F.array(F.lit("Unknown")))
    return frames(spark, sf_dir).select("id", S.segment_type_of(F.col("audio_event_top"), others).alias("segment_type"))


@query(
    "i12_segment_typing",
    """SELECT doc_id, n_words, CASE WHEN n_words >= 4 THEN 'speech' ELSE 'music' END AS segment_type, n_words >= 4 OR rms > 0.01 AS has_speech FROM (
      SELECT doc_id, rms, cast(CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '\\s+')) END AS int) AS n_words FROM (
        SELECT doc_id, (doc_id * 37 % 1000) / 50000.0::double AS rms, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents))""",
)
def i12(spark, sf_dir):
    rms = F.pmod(F.col("doc_id") * 37, F.lit(1000)) / F.lit(50000.0)
    made = S.segment_typing(F.col("text"), F.lit("Music"), F.array().cast("array<string>"), rms=rms)
    return read(spark, sf_dir, "documents").select("doc_id", made.alias("s")).select("doc_id", "s.n_words", "s.segment_type", "s.has_speech")


@query("i13_activity", "SELECT event_id, CASE WHEN value >= 40 AND value < 70 THEN 'rest' WHEN value >= 70 AND value < 100 THEN 'light' WHEN value >= 100 AND value < 140 THEN 'moderate' ELSE 'vigorous' END AS activity, round(least(1.0, abs(value - 75) / 60.0::double), 6) AS stress FROM events")
def i13(spark, sf_dir):
    v = F.col("value")
    return read(spark, sf_dir, "events").select("event_id", S.activity(v).alias("activity"), F.round(S.stress_index(v, F.lit(75.0)), 6).alias("stress"))


@query("i14_color_features", "SELECT p_partkey, printf('#%02x%02x%02x', p_size * 5, p_size * 3, p_partkey % 256) AS hex, p_size * 5 - p_partkey % 256 AS warmth, cast(p_size * 3 AS double) AS colorfulness FROM part")
def i14(spark, sf_dir):
    size, b = F.col("p_size"), F.col("p_partkey") % 256
    made = S.color_features(size * 5, size * 3, b, size.cast("double"), size.cast("double"), size.cast("double"))
    return read(spark, sf_dir, "part").select("p_partkey", made.alias("c")).select("p_partkey", "c.*")


@query("i15_clip_bounds", "SELECT id, CASE WHEN ts >= a AND ts <= b THEN a ELSE greatest(0.0, ts - 3) END AS start_sec, CASE WHEN ts >= a AND ts <= b THEN b ELSE ts + 3 END AS end_sec FROM (SELECT id, ts, audio_segment_index * 6.0::double AS a, audio_segment_index * 6.0::double + 4 AS b FROM frames WHERE ts IS NOT NULL)", "frames")
def i15(spark, sf_dir):
    start = F.col("audio_segment_index") * F.lit(6.0)
    return frames(spark, sf_dir).where("ts IS NOT NULL").select("id", S.clip_bounds(F.col("ts"), start, start + 4).alias("c")).select("id", "c.*")


@query("i16_playlist", "SELECT l_orderkey, count(*) AS clips, round(sum(greatest(0.1, l_quantity / 10 - 1)), 6) AS total, cast(ceil(max(greatest(0.1, l_quantity / 10 - 1))) AS bigint) AS target FROM lineitem GROUP BY 1")
def i16(spark, sf_dir):
    clip = S.clip_seconds(F.lit(1.0), F.col("l_quantity") / 10)
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("clips"), F.round(F.sum(clip), 6).alias("total"), F.ceil(F.max(clip)).alias("target"))


@query("i17_citations", "SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_distinct(list_transform(regexp_extract_all(a, '\\[(\\d+)\\]', 1), lambda x: cast(x AS int)))), lambda x: cast(x AS varchar)), ',') AS cited FROM (SELECT conv_id, turn, text || ' [' || (turn % 5) || '][' || (conv_id % 3) || '] [x]' AS a FROM conversations)")
def i17(spark, sf_dir):
    answer = F.concat("text", F.lit(" ["), (F.col("turn") % 5).cast("string"), F.lit("]["), (F.col("conv_id") % 3).cast("string"), F.lit("] [x]"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(S.cited(answer)).cast("array<string>"), ",").alias("cited"))


@query("i19_evaluation_context", "SELECT id, coalesce(nullif(caption, ''), file_path) AS context FROM frames", "frames")
def i19(spark, sf_dir):
    return frames(spark, sf_dir).select("id", S.evaluation_context(F.col("caption"), F.col("file_path")).alias("context"))


@query("i20_notifications", "SELECT id, status, error_message FROM media_files WHERE id % 3 <> 0", "media_files")
def i20(spark, sf_dir):
    payload = S.notification(*[F.col(c) for c in ("file_path", "file_type", "status", "error_message", "id")])
    sent = media_files(spark, sf_dir).select(F.when(F.col("id") % 3 == 0, F.lit("{broken")).otherwise(payload).alias("payload"))
    return sent.select(S.parse_notification(F.col("payload")).alias("n")).where("n.id IS NOT NULL").select("n.id", "n.status", "n.error_message")


@query("i21_multi_hot", "SELECT file_path, cast(max(CASE WHEN label = 'c1' THEN 1 ELSE 0 END) AS double) AS c1, cast(max(CASE WHEN label = 'c2' THEN 1 ELSE 0 END) AS double) AS c2, round(count(*) / cast(max(count(*)) OVER () AS double), 6) AS share FROM frames GROUP BY 1", "frames")
def i21(spark, sf_dir):
    per = frames(spark, sf_dir).groupBy("file_path").agg(F.collect_set("label").alias("labels"), F.count("*").alias("n"))
    top = per.agg(F.max("n").alias("top"))
    hot = S.multi_hot(F.col("labels"), ["c1", "c2"])
    return per.crossJoin(F.broadcast(top)).select("file_path", hot[0].alias("c1"), hot[1].alias("c2"), F.round(F.col("n") / F.col("top"), 6).alias("share"))


@query(
    "i22_frame_seconds",
    "SELECT id, frame_index / 0.5::double AS sec, frame_index < n AS valid FROM frames JOIN (SELECT file_path, count(*) - max(file_id) % 3 AS n FROM frames GROUP BY 1) USING (file_path) WHERE frame_index IS NOT NULL",
    "frames",
)
def i22(spark, sf_dir):
    """Seconds of every video frame, and whether its file still has that many frames."""
    f = frames(spark, sf_dir)
    counts = f.groupBy("file_path").agg((F.count("*") - F.max("file_id") % 3).alias("n"))
    rows = f.where("frame_index IS NOT NULL").select("id", "file_path", "frame_index").join(counts, "file_path")
    return rows.select("id", S.frame_seconds(F.col("frame_index")).alias("sec"), S.valid_index(F.col("frame_index"), F.col("n")).alias("valid"))


@query("i23_caption_pairs", "SELECT id, caption, cast(('0x' || substr(md5(cast(id AS varchar)), 1, 4)) AS bigint) % 5 > 0 AS train FROM frames WHERE length(caption) >= 10 AND file_path <> ''", "frames")
def i23(spark, sf_dir):
    """A repeatable 80/20 split by a hash of the id."""
    bucket = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 4), 16, 10).cast("long") % 5
    return frames(spark, sf_dir).where("length(caption) >= 10 AND file_path <> ''").select("id", "caption", (bucket > 0).alias("train"))


@query("i24_rounding", "SELECT p_partkey, round(p_size / 8.0::double, 2) AS up, round_even(p_size / 8.0::double, 2) AS even FROM part")
def i24(spark, sf_dir):
    x = F.col("p_size") / F.lit(8.0)
    return read(spark, sf_dir, "part").select("p_partkey", S.half_up(x, 2).alias("up"), S.half_even(x, 2).alias("even"))


@query("i25_processing_plan", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'copy' WHEN s > 3600 THEN 'skip' ELSE 'transcode' END AS plan, greatest(1200, cast(floor(s * 1.5) AS int)) AS extract_timeout, greatest(1800, cast(floor(s * 5) AS int) + 120) AS encode_timeout FROM (SELECT event_id, value * 20 AS s FROM events)")
def i25(spark, sf_dir):
    codec = F.when(F.col("event_id") % 3 == 0, "h264").otherwise("hevc")
    return read(spark, sf_dir, "events").select("event_id", S.processing_plan(codec, F.col("value") * 20).alias("p")).select("event_id", "p.*")
