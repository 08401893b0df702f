"""Queries on similarity search and de-duplication."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import needs_vision, vision_inputs
from ..operators import cell_index as X
from ..operators import dedup as D
from ..operators import drift as V
from ..operators import joins as J
from ..operators import search as S
from ..operators.predicates import scene_window
from ..sources.shared import scratch
from ..sources.tables import frames, media_files, query_vectors, read
from .catalog import query

THRESHOLD, K = 0.2, 40

_COS = "list_dot_product(cast(f.vector AS double[]), cast(q.query_vector AS double[])) / (sqrt(list_dot_product(cast(f.vector AS double[]), cast(f.vector AS double[]))) * sqrt(list_dot_product(cast(q.query_vector AS double[]), cast(q.query_vector AS double[]))))"
_SCORED = f"scored AS (SELECT q.query_id, f.*, round({_COS}, 9) AS score FROM queries q CROSS JOIN frames f)"


def _hits_sql(k: int, threshold: float, name: str = "hits") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS int) AS rank FROM scored WHERE score >= {threshold}) WHERE rank <= {k})"


_HITS = f"{_SCORED}, {_hits_sql(K, THRESHOLD)}"
_WALK = """h AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, id) AS rn FROM {rows} WHERE ts IS NOT NULL {more}),
  walk AS (SELECT query_id, file_path, rn, id, [ts] AS kept, true AS keep FROM h WHERE rn = 1
    UNION ALL SELECT h.query_id, h.file_path, h.rn, h.id, CASE WHEN len(list_filter(w.kept, lambda k: abs(k - h.ts) < 5)) = 0 THEN list_append(w.kept, h.ts) ELSE w.kept END,
      len(list_filter(w.kept, lambda k: abs(k - h.ts) < 5)) = 0 FROM walk w JOIN h ON h.query_id = w.query_id AND h.file_path = w.file_path AND h.rn = w.rn + 1)"""
_NMS = _WALK.format(rows="hits", more="")
_SEGDEDUP = f"""{_WALK.format(rows='hits', more='AND audio_segment_index IS NULL')},
  best AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_path, audio_segment_index ORDER BY score DESC, id) AS n FROM hits WHERE audio_segment_index IS NOT NULL) WHERE n = 1),
  deduped AS (SELECT hits.* FROM hits WHERE (query_id, id) IN (SELECT query_id, id FROM best) OR (query_id, id) IN (SELECT query_id, id FROM walk WHERE keep) OR (ts IS NULL AND audio_segment_index IS NULL))"""
_DIRCAP = """capped AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY query_id, regexp_replace(file_path, '/?[^/]*$', ''), ts IS NULL) AS n,
  row_number() OVER (PARTITION BY query_id, regexp_replace(file_path, '/?[^/]*$', ''), ts IS NULL ORDER BY score DESC, id) AS r FROM {rows}) WHERE ts IS NOT NULL OR n < 4 OR r <= 2)"""


def hits(spark: SparkSession, sf_dir: str, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, id, score, rank) with the frames' columns but the vector."""
    f = frames(spark, sf_dir)
    return S.cosine_topk(f, query_vectors(spark, sf_dir), k, threshold).join(f.drop("vector"), "id")


PARAPHRASES_SQL = """WITH v AS (SELECT query_id, k, list(id) AS y FROM hits CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE id % 4 <> k AND rank <= 10 GROUP BY 1, 2),
  a AS (SELECT query_id, list(id) AS x FROM hits WHERE rank <= 10 GROUP BY 1),
  j AS (SELECT query_id, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS jac FROM a JOIN v USING (query_id))
  SELECT q.query_id, round(avg(jac), 6) AS mean, round(stddev_pop(jac), 6) AS std FROM queries q LEFT JOIN j USING (query_id) GROUP BY 1"""


def paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, mean, std) of the Jaccard likeness of each query's best ten to those of three variants, which each lack
    every fourth row; null where there are no rows."""
    h = hits(spark, sf_dir).where("rank <= 10")
    variants = h.select("query_id", "id", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("k")).where("id % 4 <> k")
    own = h.groupBy("query_id").agg(F.collect_set("id").alias("ids"))
    each = variants.groupBy("query_id", "k").agg(F.collect_set("id").alias("ids"))
    means = J.paraphrase_jaccard(own, each).groupBy("query_id").agg(F.round(F.avg("jaccard"), 6).alias("mean"), F.round(F.stddev_pop("jaccard"), 6).alias("std"))
    return query_vectors(spark, sf_dir).select("query_id").join(means, "query_id", "left")


@query("c01_cosine_topk", f"WITH {_SCORED}, {_hits_sql(20, 0.3)} SELECT query_id, id, score, rank FROM hits", "frames queries")
def c01(spark, sf_dir):
    return S.cosine_topk(frames(spark, sf_dir), query_vectors(spark, sf_dir), 20, 0.3)


@query(
    "c02_two_pass",
    f"WITH {_SCORED}, {_hits_sql(50, 0.2)}, again AS (SELECT query_id, id, round(dot / (nf * nq + 1e-8), 9) AS score FROM (SELECT h.query_id, h.id, list_dot_product(cast(f.vector AS double[]), cast(q.query_vector AS double[])) AS dot, sqrt(list_dot_product(cast(f.vector AS double[]), cast(f.vector AS double[]))) AS nf, sqrt(list_dot_product(cast(q.query_vector AS double[]), cast(q.query_vector AS double[]))) AS nq FROM hits h JOIN frames f USING (id) JOIN queries q USING (query_id))) SELECT query_id, id, score, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS int) AS rank FROM again",
    "frames queries",
)
def c02(spark, sf_dir):
    return S.two_pass(frames(spark, sf_dir), query_vectors(spark, sf_dir), 10, 0.2, 5).select("query_id", "id", "score", "rank")


@query("c03_filter_browse", "SELECT id, file_path, 1.0::double AS score FROM frames WHERE audio_event_top = 'Hammer' ORDER BY id LIMIT 20", "frames")
def c03(spark, sf_dir):
    return S.browse(frames(spark, sf_dir), F.col("audio_event_top") == "Hammer").select("id", "file_path", "score")


@query(
    "c04_grouped_topk",
    f"""WITH {_HITS}, inside AS (SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, id) AS int) AS group_rank FROM hits) WHERE group_rank <= 3),
      best AS (SELECT query_id, file_path, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path) AS int) AS place FROM inside WHERE group_rank = 1)
      SELECT query_id, file_path, id, score, group_rank, place FROM inside JOIN best USING (query_id, file_path) WHERE place <= 5""",
    "frames queries",
)
def c04(spark, sf_dir):
    return S.grouped_topk(hits(spark, sf_dir), "file_path", 5, 3).select("query_id", "file_path", "id", "score", "group_rank", "place")


@query("c05_lsh_candidates")
def c05(spark, sf_dir):
    """Candidates by random projections, their exact scores, and whether the exact search has them among its best ten."""
    f, q = frames(spark, sf_dir), query_vectors(spark, sf_dir)
    exact = S.cosine_topk(f, q, 10, 0.4).select("query_id", "id", F.lit(True).alias("in_exact"))
    near = S.lsh_candidates(f, q).select("query_id", "id", F.round("score", 6).alias("score"))
    return near.join(exact, ["query_id", "id"], "left").withColumn("in_exact", F.coalesce("in_exact", F.lit(False)))


@query("c05_cell_candidates")
def c05_cells(spark, sf_dir):
    """The best ten by cells, their scores, and whether the exact search has them among its best ten."""
    f, q = frames(spark, sf_dir), query_vectors(spark, sf_dir)
    exact = S.cosine_topk(f, q, 10, THRESHOLD).select("query_id", "id", F.lit(True).alias("in_exact"))
    near = S.cell_topk(f, q, S.fit_cells(f), 10, THRESHOLD)
    return near.join(exact, ["query_id", "id"], "left").withColumn("in_exact", F.coalesce("in_exact", F.lit(False)))


@query("c05_cell_recall", f"WITH {_SCORED}, {_hits_sql(10, THRESHOLD)} SELECT count(*) AS wanted, true AS reached FROM hits", "frames queries")
def c05_recall(spark, sf_dir):
    """How many rows the exact search returns, and whether nine tenths of them come by cells too."""
    f, q = frames(spark, sf_dir), query_vectors(spark, sf_dir)
    near = S.cell_topk(f, q, S.fit_cells(f), 10, THRESHOLD).select("query_id", "id", F.lit(1).alias("found"))
    both = S.cosine_topk(f, q, 10, THRESHOLD).join(near, ["query_id", "id"], "left")
    return both.agg(F.count("*").alias("wanted"), (F.count("found") >= 0.9 * F.count("*")).alias("reached"))


def _indexed(spark: SparkSession, sf_dir: str, k: int, threshold: float) -> X.Found:
    """Four fifths of the frames make the index, the last fifth is inserted into its cells, and all queries search it."""
    f = frames(spark, sf_dir).select("id", "vector")
    index = X.CellIndex.build(f.where("id % 5 <> 0"), scratch(spark))
    index.insert(f.where("id % 5 = 0"))
    return index.search(query_vectors(spark, sf_dir), k, threshold)


@query("c05_index_topk", f"WITH {_SCORED}, {_hits_sql(20, 0.3)} SELECT query_id, id, score, rank FROM hits", "frames queries")
def c05_index(spark, sf_dir):
    return _indexed(spark, sf_dir, 20, 0.3).hits


@query("c05_index_report", f"WITH {_SCORED}, {_hits_sql(10, 0.35)} SELECT query_id, count(h.id) AS hits, true AS within FROM queries LEFT JOIN hits h USING (query_id) GROUP BY 1", "frames queries")
def c05_report(spark, sf_dir):
    """Hits of every query, and whether it read no more cells than there are; the number that it read is in visits."""
    found = _indexed(spark, sf_dir, 10, 0.35)
    read_ = found.visits.groupBy("query_id").agg(F.count("*").alias("cells_read"))
    hits_ = found.hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    every = query_vectors(spark, sf_dir).select("query_id").join(read_, "query_id", "left").join(hits_, "query_id", "left")
    return every.select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("cells_read", F.lit(0)) <= found.cells).alias("within"))


@query(
    "i10_route",
    f"""WITH {_SCORED}, {_hits_sql(10, 0.385)}, found AS (SELECT query_id, count(*) AS n, list(id ORDER BY rank) FILTER (file_type = 'image') AS images FROM hits GROUP BY 1)
      SELECT query_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) < 3 THEN 'vision' ELSE 'aggregate' END AS route, CASE WHEN coalesce(n, 0) < 3 THEN coalesce(array_to_string(images[1:3], ','), '') ELSE '' END AS looked_at FROM queries LEFT JOIN found USING (query_id)""",
    "frames queries",
)
def i10(spark, sf_dir):
    """The route of every query by the number of its results, and the images that the vision route looks at."""
    h = hits(spark, sf_dir, 10, 0.385)
    found = h.groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "id", "file_type"))).alias("results"))  # ten at most
    every = query_vectors(spark, sf_dir).select("query_id").join(found, "query_id", "left")
    route = needs_vision(F.coalesce("n", F.lit(0)))
    looked = F.when(route == "vision", F.array_join(F.transform(vision_inputs(F.col("results")), lambda r: r["id"].cast("string")), ","))
    return every.select("query_id", F.coalesce("n", F.lit(0)).alias("n"), route.alias("route"), F.coalesce(looked, F.lit("")).alias("looked_at"))


@query("c06_l2_normalise", "SELECT id, round(list_dot_product(u, u), 6) AS norm, round(list_sum(u), 6) AS total FROM (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM (SELECT id, cast(vector AS double[]) AS v FROM frames))", "frames")
def c06(spark, sf_dir):
    unit = frames(spark, sf_dir).select("id", S.l2_normalise(F.col("vector")).alias("u"))
    return unit.select("id", F.round(S.dot(F.col("u"), F.col("u")), 6).alias("norm"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("c07_envelope", f"WITH RECURSIVE {_HITS}, {_SEGDEDUP} SELECT query_id, count(*) AS raw_frame_count, count(*) FILTER (keep) AS returned, count(*) - count(*) FILTER (keep) AS scenes_collapsed FROM (SELECT query_id, (query_id, id) IN (SELECT query_id, id FROM deduped) AS keep FROM hits) GROUP BY 1", "frames queries")
def c07(spark, sf_dir):
    h = hits(spark, sf_dir)
    return S.envelope(h, D.segment_dedup(h))


def _words_shared(question: pd.Series, caption: pd.Series) -> pd.Series:
    """A stand-in for a cross-encoder: the share of a caption's words that the question has, less a tenth."""
    return pd.Series([len(set(q.split()) & set(c.split())) / max(1, len(set(c.split()))) - 0.1 for q, c in zip(question, caption, strict=True)])


@query(
    "c08_rerank",
    f"""WITH {_HITS}, said AS (SELECT *, 'scene ' || label || ' of ' || class_id AS cap, 'scene class ' || (query_id % 10) AS question FROM hits),
      made AS (SELECT *, CASE WHEN caption <> '' THEN round(len(list_intersect(string_split(caption, ' '), string_split(question, ' '))) / len(list_distinct(string_split(caption, ' '))) - 0.1, 9) ELSE 0.0 END AS rs, max(CASE WHEN caption <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS any_caption FROM said)
      SELECT query_id, id, rs AS rerank_score, cast(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN any_caption = 1 THEN -rs ELSE 0 END, rank) AS int) AS new_rank FROM made""",
    "frames queries",
)
def c08(spark, sf_dir):
    asked = hits(spark, sf_dir).withColumn("question", F.concat(F.lit("scene class "), (F.col("query_id") % 10).cast("string")))
    return S.rerank_by_caption(asked, _words_shared).select("query_id", "id", F.round("rerank_score", 9).alias("rerank_score"), "new_rank")


@query("c09_sort_modes", f"WITH {_HITS} SELECT query_id, id, place FROM (SELECT query_id, id, cast(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(audio_rms_energy, -1) DESC, id) AS int) AS place FROM hits) WHERE place > 20 AND place <= 40", "frames queries")
def c09(spark, sf_dir):
    return S.page(hits(spark, sf_dir), "energy_desc", 2).select("query_id", "id", "place")


@query("c10_drift", "SELECT count(*) AS n, round(avg(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)))), 6) AS mean_cosine, round(avg(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)))), 6) >= 0.99 AS passed FROM (SELECT cast(vector AS double[]) AS v, list_transform(cast(vector AS double[]), lambda x: round(x, 1)) AS w FROM frames)", "frames")
def c10(spark, sf_dir):
    f = frames(spark, sf_dir).select("id", "vector")
    return S.drift(f, f.select("id", F.transform("vector", lambda x: F.round(x.cast("double"), 1)).alias("vector")))


@query("b05_score_threshold", f"WITH {_SCORED} SELECT query_id, count(*) AS n FROM scored WHERE score >= 0.35 GROUP BY 1", "frames queries")
def b05(spark, sf_dir):
    """All scores at or above a threshold, counted for each query, without a limit on their number."""
    f, q = frames(spark, sf_dir), query_vectors(spark, sf_dir)
    return S.cosine_scores(f, q, 0.35).groupBy("query_id").agg(F.count("*").alias("n"))


@query("d01_temporal_nms", f"WITH RECURSIVE {_HITS}, {_NMS} SELECT query_id, id FROM walk WHERE keep UNION ALL SELECT query_id, id FROM hits WHERE ts IS NULL", "frames queries")
def d01(spark, sf_dir):
    return D.temporal_nms(hits(spark, sf_dir)).select("query_id", "id")


@query("d02_segment_dedup", f"WITH RECURSIVE {_HITS}, {_SEGDEDUP} SELECT query_id, id, score FROM deduped", "frames queries")
def d02(spark, sf_dir):
    return D.segment_dedup(hits(spark, sf_dir)).select("query_id", "id", "score")


@query("d03_flood_cap", f"WITH {_HITS}, {_DIRCAP.format(rows='hits')} SELECT query_id, id FROM capped", "frames queries")
def d03(spark, sf_dir):
    return D.flood_cap(hits(spark, sf_dir)).select("query_id", "id")


_LAST = """h AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY rank) AS rn FROM hits WHERE ts IS NOT NULL),
  walk AS (SELECT query_id, file_path, rn, id, ts AS last, true AS keep FROM h WHERE rn = 1
    UNION ALL SELECT h.query_id, h.file_path, h.rn, h.id, CASE WHEN abs(h.ts - w.last) > 5 THEN h.ts ELSE w.last END, abs(h.ts - w.last) > 5 FROM walk w JOIN h ON h.query_id = w.query_id AND h.file_path = w.file_path AND h.rn = w.rn + 1)"""


@query("d04_last_kept_dedup", f"WITH RECURSIVE {_HITS}, {_LAST} SELECT query_id, id FROM walk WHERE keep UNION ALL SELECT query_id, id FROM hits WHERE ts IS NULL", "frames queries")
def d04(spark, sf_dir):
    return D.last_kept_dedup(hits(spark, sf_dir)).select("query_id", "id")


@query("d05_exact_dedup", "SELECT sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE substr(text, 1, 8192) END) AS file_hash, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1")
def d05(spark, sf_dir):
    """Documents stand for files: even ones for images, hashed whole, odd ones for videos, hashed by their head."""
    digest = D.content_hash(F.col("text"), F.col("doc_id") % 2 != 0)
    return D.exact_dedup(read(spark, sf_dir, "documents").select("doc_id", digest.alias("file_hash")), order="doc_id")


_KNOWN = "known AS (SELECT source || '/' || lang || '/' || (CASE WHEN doc_id % 4 = 0 THEN doc_id + 100000 ELSE doc_id END) || '.txt' AS file_path, sha256(text) AS file_hash, CASE doc_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'processing' WHEN 2 THEN 'pending' ELSE 'done' END AS status, doc_id FROM documents WHERE doc_id % 3 <> 0)"


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "documents")
    path = lambda n: F.concat("source", F.lit("/"), "lang", F.lit("/"), n.cast("string"), F.lit(".txt"))
    found = docs.select(path(F.col("doc_id")).alias("file_path"), F.sha2("text", 256).alias("file_hash"), F.when(F.col("doc_id") % 50 == 7, "cannot_hash_file").alias("reason"))
    moved = F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") + 100000).otherwise(F.col("doc_id"))
    status = F.expr("CASE doc_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'processing' WHEN 2 THEN 'pending' ELSE 'done' END")
    known = docs.where("doc_id % 3 <> 0").select(path(moved).alias("file_path"), F.sha2("text", 256).alias("file_hash"), status.alias("status"), "doc_id")
    return found, known, known.where("doc_id % 8 = 0").select("file_path").unionByName(found.select("file_path"))


@query(
    "d06_ingest_decisions",
    f"""WITH {_KNOWN}, found AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS file_path, sha256(text) AS file_hash, CASE WHEN doc_id % 50 = 7 THEN 'cannot_hash_file' END AS reason FROM documents),
      there AS (SELECT file_path FROM known WHERE doc_id % 8 = 0 UNION SELECT file_path FROM found),
      p AS (SELECT file_path, min(CASE WHEN status = 'done' THEN 0 WHEN status IN ('pending', 'processing') THEN 1 ELSE 2 END) AS pr FROM known GROUP BY 1),
      c AS (SELECT file_hash, min(file_path) AS old_path, list(file_path) AS old_paths FROM known GROUP BY 1),
      d AS (SELECT f.file_path, f.file_hash, c.old_path, CASE WHEN reason IS NOT NULL THEN reason WHEN pr = 0 THEN 'already_ingested' WHEN pr = 1 THEN 'redispatched'
        WHEN c.old_path IS NOT NULL AND NOT list_contains(old_paths, f.file_path) THEN CASE WHEN c.old_path IN (SELECT file_path FROM there) THEN 'duplicate_copy' ELSE 'relocated' END
        WHEN list_contains(old_paths, f.file_path) THEN 'duplicate_hash' ELSE 'inserted' END AS action FROM found f LEFT JOIN p USING (file_path) LEFT JOIN c USING (file_hash))
      SELECT file_path, file_hash, CASE WHEN action = 'relocated' THEN old_path END AS old_path, CASE WHEN action = 'inserted' AND row_number() OVER (PARTITION BY file_hash, action ORDER BY file_path) > 1 THEN 'duplicate_copy' ELSE action END AS action FROM d""",
)
def d06(spark, sf_dir):
    found, known, there = _batch(spark, sf_dir)
    return D.ingest_decisions(found, known, there)


@query("d07_relocate_frames", "SELECT id, CASE WHEN file_path LIKE '/lib/d1/%' THEN '/new' || file_path ELSE file_path END AS file_path FROM frames", "frames")
def d07(spark, sf_dir):
    f = frames(spark, sf_dir)
    moves = f.where("file_path LIKE '/lib/d1/%'").select(F.col("file_path").alias("old_path")).distinct().withColumn("new_path", F.concat(F.lit("/new"), "old_path"))
    return D.relocate(f.select("id", "file_path"), moves).select("id", "file_path")


_KEYS = "CASE o_orderkey % 4 WHEN 0 THEN 'pexels-search-' || o_custkey || '.mp4' WHEN 1 THEN 'pexels-' || o_custkey || '.mp4' WHEN 2 THEN 'slug_' || o_custkey || '.mp4' ELSE 'other' || o_orderkey || '.txt' END"


@query(
    "d08_keep_newest",
    f"""WITH l AS (SELECT {_KEYS} || '' AS name, o_orderkey AS key, o_orderdate AS last_modified, o_totalprice AS size, CASE WHEN o_orderkey % 4 < 3 THEN cast(o_custkey AS varchar) END AS external_id FROM orders)
      SELECT external_id IS NULL AS unknown, count(*) AS n, count(*) FILTER (keep) AS kept, round(sum(CASE WHEN NOT keep THEN size ELSE 0 END), 2) AS freed FROM (SELECT *, external_id IS NULL OR row_number() OVER (PARTITION BY external_id ORDER BY last_modified DESC, key) = 1 AS keep FROM l) GROUP BY 1""",
)
def d08(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.expr(_KEYS.replace("||", "||")).alias("name"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("last_modified"), F.col("o_totalprice").alias("size"))
    marked = D.keep_newest(rows.withColumn("external_id", D.external_id(F.col("name"))))
    return marked.groupBy(F.col("external_id").isNull().alias("unknown")).agg(F.count("*").alias("n"), F.count_if("keep").alias("kept"), F.round(F.sum(F.when(~F.col("keep"), F.col("size")).otherwise(0.0)), 2).alias("freed"))


@query(
    "d09_merge_sources",
    f"""WITH {_HITS}, v AS (SELECT query_id, id, file_path, ts, rank, 'visual' AS source FROM hits WHERE rank <= 10), a AS (SELECT query_id, id, file_path, ts, rank, 'audio' AS source FROM hits WHERE rank % 2 = 0 AND audio_segment_type = 'speech'),
      own AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.query_id = a.query_id AND v.file_path = a.file_path AND v.ts IS NOT DISTINCT FROM a.ts))
      SELECT query_id, id, source, place FROM (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY source DESC, rank, id) AS int) AS place FROM (SELECT * FROM v UNION ALL SELECT * FROM own)) WHERE source = 'visual' OR place <= 14""",
    "frames queries",
)
def d09(spark, sf_dir):
    h = hits(spark, sf_dir).select("query_id", "id", "file_path", "ts", "rank", "audio_segment_type")
    audio = h.where("rank % 2 = 0 AND audio_segment_type = 'speech'")
    return D.merge_sources(h.where("rank <= 10"), audio, 14).select("query_id", "id", "source", "place")


def search(spark: SparkSession, sf_dir: str, limit: int = 20) -> DataFrame:
    """The flagship: candidates, second pass, segment and folder de-duplication, then the result rows."""
    f, q = frames(spark, sf_dir), query_vectors(spark, sf_dir)
    rescored = S.two_pass(f, q, limit, THRESHOLD).drop("rank").join(f.drop("vector"), "id")
    kept = D.flood_cap(D.segment_dedup(rescored))
    start, end = scene_window(F.col("ts"))
    top = S.ranked(kept, ["query_id"], [F.desc("score"), F.col("id")]).where(F.col("rank") <= limit)
    return top.select("query_id", "rank", "id", "score", "file_path", "file_type", "ts", "caption", start.cast("double").alias("scene_start"), end.cast("double").alias("scene_end"))


_EXACT = "round(list_dot_product(cast(f.vector AS double[]), cast(q.query_vector AS double[])) / (sqrt(list_dot_product(cast(f.vector AS double[]), cast(f.vector AS double[]))) * sqrt(list_dot_product(cast(q.query_vector AS double[]), cast(q.query_vector AS double[]))) + 1e-8), 9)"
_SEARCH_HITS = f"scored AS (SELECT q.query_id, f.*, round({_COS}, 9) AS score, {_EXACT} AS again FROM queries q CROSS JOIN frames f), {_hits_sql(100, THRESHOLD, 'first')}, hits AS (SELECT * REPLACE (again AS score) FROM first)"


@query(
    "search_end_to_end",
    f"""WITH RECURSIVE {_SEARCH_HITS}, {_SEGDEDUP}, {_DIRCAP.format(rows='deduped')}
      SELECT query_id, place AS rank, id, score, file_path, file_type, ts, caption, CASE WHEN ts IS NOT NULL THEN floor(ts / 5) * 5 END AS scene_start, CASE WHEN ts IS NOT NULL THEN floor(ts / 5) * 5 + 5 END AS scene_end
      FROM (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS int) AS place FROM capped) WHERE place <= 20""",
    "frames queries",
)
def search_end_to_end(spark, sf_dir):
    return search(spark, sf_dir)


@query(
    "e09_store_drift",
    "SELECT done_files, points, vectors, vectors - done_files AS drift FROM (SELECT count(*) FILTER (status = 'done') AS done_files, count(point_id) AS points FROM media_files) CROSS JOIN (SELECT count(*) AS vectors FROM frames)",
    "media_files frames",
)
def e09(spark, sf_dir):
    """Vectors in the frame store less files that are done; below zero some done files have no vector."""
    files = media_files(spark, sf_dir).agg(F.count_if(F.col("status") == "done").alias("done_files"), F.count("point_id").alias("points"))
    vectors = frames(spark, sf_dir).agg(F.count("*").alias("vectors"))
    return files.crossJoin(vectors).withColumn("drift", F.col("vectors") - F.col("done_files"))  # one row each


@query(
    "e09_missing_rows",
    "SELECT coalesce(f.id, m.id) AS id, cast(f.id IS NOT NULL AS bigint) AS left_n, coalesce(m.n, 0) AS right_n FROM frames f FULL JOIN (SELECT point_id AS id, count(*) AS n FROM media_files WHERE point_id IS NOT NULL GROUP BY 1) m ON f.id = m.id WHERE f.id IS NULL OR m.id IS NULL OR m.n <> 1",
    "media_files frames",
)
def e09_missing(spark, sf_dir):
    """Points of files that the frame store lacks, and frames that no file points at, by digests of both stores."""
    points = media_files(spark, sf_dir).where("point_id IS NOT NULL").select(F.col("point_id").alias("id"))
    return V.compare(frames(spark, sf_dir).select("id"), points, "id").rows


@query(
    "e09_frames_per_file",
    """SELECT coalesce(f.file_id, m.id) AS file_id, coalesce(f.n, 0) AS n_frames, coalesce(m.status, 'unknown') AS status, m.status IS NOT DISTINCT FROM 'done' AND f.n IS NULL AS lacks_vectors
      FROM (SELECT file_id, count(*) AS n FROM frames GROUP BY 1) f FULL JOIN media_files m ON f.file_id = m.id""",
    "media_files frames",
)
def e09_frames(spark, sf_dir):
    return V.frames_per_file(frames(spark, sf_dir), media_files(spark, sf_dir).select(F.col("id").alias("file_id"), "status"), "file_id")