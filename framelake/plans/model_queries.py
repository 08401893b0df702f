"""Queries on classification and on whole batches of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import audio_filters, context_line, intent
from ..operators import classify as M
from ..operators import dedup as D
from ..operators import ranking as G
from ..operators import stats as A
from ..operators.predicates import temporal_search
from ..sources.shared import scratch, settled
from ..sources.tables import frames, media_files
from .catalog import query
from .filter_queries import _A, _ASKED, _MONTHS_SQL, _SEG, _SPEECH, _T, _V, _questions
from .search_queries import _HITS, _LAST, hits


def _split(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("label", F.concat(F.lit("g"), (F.col("class_id") % 3).cast("string")))
    return G.stratified_holdout(f, "label", "id")


@query("k09_train_report")
def k09(spark, sf_dir):
    """Hold-out report of a forest trained on four fifths of the frames."""
    rows = _split(spark, sf_dir)
    model = M.train(rows.where("part = 'train'").select("id", "label", "vector"))
    tested = M.predict(model, rows.where("part = 'test'").select("id", "label", "vector"))
    return A.classifier_report(settled(tested.select("label", F.col("predicted").alias("prediction"))))


@query("a15_model_sink", "SELECT count(*) AS n, true AS same FROM frames", "frames")
def a15_model(spark, sf_dir):
    """A forest that is saved and loaded says of every frame what it said before."""
    rows = _split(spark, sf_dir).select("id", "label", "vector")
    model = M.train(rows, trees=20, depth=6)
    path = scratch(spark)
    M.save_model(model, path)
    before, after = (M.predict(m, rows).select("id", "predicted", F.round("confidence", 9).alias("confidence")) for m in (model, M.load_model(path)))
    both = before.join(after.withColumnsRenamed({"predicted": "__p", "confidence": "__c"}), "id")
    return both.agg(F.count("*").alias("n"), (F.count_if((F.col("predicted") != F.col("__p")) | (F.col("confidence") != F.col("__c"))) == 0).alias("same"))


def _dated(spark, sf_dir):
    """The split frames under names with a camera's date: every third before the phases, after them, or among them."""
    date = F.when(F.col("id") % 3 == 0, "20250820").when(F.col("id") % 3 == 1, "20251015").otherwise("20270101")
    named = F.concat(F.regexp_replace("file_path", "[^/]*$", ""), F.lit("PXL_"), date, F.lit("_"), F.col("id").cast("string"), F.lit(".jpg"))
    return _split(spark, sf_dir).withColumn("file_path", named)


@query("k10_prediction_scope", "SELECT id FROM frames WHERE contains(file_path, '/d2/') AND id % 3 = 1", "frames")
def k10_scope(spark, sf_dir):
    return M.prediction_scope(_dated(spark, sf_dir), "/d2/").select("id")


@query("k10_cleared_labels", "SELECT id, contains(file_path, '/d2/') AND id % 3 = 1 AS predicted FROM frames", "frames")
def k10_cleared(spark, sf_dir):
    """Which frames have a label after the run: those in scope; old labels are gone everywhere else."""
    return _predicted(spark, sf_dir).select("id", F.col("construction_phase").isNotNull().alias("predicted"))


@query("k10_batch_predict")
def k10(spark, sf_dir):
    """Labels of all frames under one folder whose names carry a date among the phases, confidence and review flag."""
    return _predicted(spark, sf_dir)


def _predicted(spark, sf_dir):
    rows = _dated(spark, sf_dir)
    model = M.train(rows.where("part = 'train'").select("id", "label", "vector"))
    scope = M.prediction_scope(rows, "/d2/").select("id", "vector")
    done = M.apply_predictions(frames(spark, sf_dir).drop("vector"), M.predict(model, scope))
    return done.select("id", "construction_phase", "phase_confidence", "phase_needs_review")


_of_question = lambda sql: sql.replace("lower(text)", "lower(question)")


@query(
    "k12_multi_source_answers",
    f"""WITH RECURSIVE {_HITS}, {_LAST}, found AS (SELECT * FROM hits WHERE ts IS NULL OR (query_id, id) IN (SELECT query_id, id FROM walk WHERE keep)),
      visual AS (SELECT query_id, count(*) AS n_visual, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS context FROM (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS k, concat_ws(' ', '[' || rank || ']', file_path, 'at ' || cast(ts AS varchar) || 's', '- ' || nullif(caption, ''), '(' || construction_phase || ')') AS line FROM found) WHERE k <= 5 GROUP BY 1),
      {_ASKED}, dated AS (SELECT question_id, cast(y AS int) AS y, {_MONTHS_SQL} AS m FROM parsed), years AS (SELECT year(created_at) AS yy, count(*) AS n FROM media_files WHERE status = 'done' GROUP BY 1),
      temporal AS (SELECT question_id, cast(least(5, sum(n)) AS bigint) AS n_temporal FROM dated JOIN years ON y IS NULL OR y = yy WHERE y IS NOT NULL OR m IS NOT NULL GROUP BY 1),
      heard AS (SELECT query_id, audio_segment_type, count(*) AS n FROM found GROUP BY 1, 2), wanted AS (SELECT question_id, question_id % 10 * 50 AS query_id, CASE {_of_question(_SEG)} WHEN {_of_question(_SPEECH)} THEN 'speech' END AS audio_segment_type FROM asked),
      audio AS (SELECT question_id, cast(least(10, sum(n)) AS bigint) AS n_audio FROM wanted JOIN heard USING (query_id, audio_segment_type) GROUP BY 1)
      SELECT question_id, CASE WHEN ({_of_question(_A)} AND ({_of_question(_T)} OR {_of_question(_V)})) OR ({_of_question(_T)} AND {_of_question(_V)}) THEN 'mixed' WHEN {_of_question(_A)} THEN 'audio' WHEN {_of_question(_T)} THEN 'temporal' ELSE 'visual' END AS intent,
        coalesce(n_visual, 0) AS n_visual, coalesce(n_temporal, 0) AS n_temporal, coalesce(n_audio, 0) AS n_audio, context
      FROM asked LEFT JOIN visual ON visual.query_id = question_id % 10 * 50 LEFT JOIN temporal USING (question_id) LEFT JOIN audio USING (question_id)""",
    "frames queries media_files",
)
def k12(spark, sf_dir):
    """For every question its intent, the rows of the visual, temporal and audio branches, and the visual context.

    The i-th question takes the i-th query vector in turn as its embedding."""
    asked = _questions(spark, sf_dir).withColumn("query_id", F.pmod("question_id", F.lit(10)) * 50)
    found = D.last_kept_dedup(hits(spark, sf_dir))
    visual = G.section_caps(found.withColumn("source", F.lit("visual")), {"visual": 5})
    per_vector = visual.groupBy("query_id").agg(F.count("*").alias("n_visual"), F.array_sort(F.collect_list(F.struct("rank", context_line(F.col("rank"), F.col("file_path"), F.col("ts"), F.col("caption"), F.col("construction_phase")).alias("line")))).alias("l"))
    temporal = temporal_search(media_files(spark, sf_dir), asked.select("question_id", "question"), 5).groupBy("question_id").agg(F.count("*").alias("n_temporal"))
    wanted = asked.select("question_id", "query_id", audio_filters(F.col("question"))["segment_type"].alias("audio_segment_type")).where("audio_segment_type IS NOT NULL")
    audio = found.select("query_id", "id", "audio_segment_type").join(wanted, ["query_id", "audio_segment_type"]).groupBy("question_id").agg(F.least(F.count("*"), F.lit(10)).alias("n_audio"))
    out = asked.join(per_vector, "query_id", "left").join(temporal, "question_id", "left").join(audio, "question_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("question_id", intent(F.col("question")).alias("intent"), n("n_visual"), n("n_temporal"), n("n_audio"), F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("context"))
