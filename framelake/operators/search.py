"""Exact similarity search for tables of queries: scores, top-k, second pass, groups, reranking and envelopes.

Queries come as (query_id, query_vector). How they meet the frames follows the queries' number: up to BROADCAST_QUERIES
of them are sent to every task; more are shuffled to parts of about PART_ROWS frames and stream past each part, so that a
task holds a part and one batch of queries. Frames are shuffled once for every TURN_QUERIES queries. Either way each task
keeps only k rows of a query (a partial and a final window limit), so k rows a task are shuffled, and the answers are the
same: a query meets the frames of its own dimension, and one whose vector is null or empty, or has a dimension that no frame
has, gets no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_QUERIES, PART_ROWS, TURN_QUERIES = 2_000, 50_000, 200_000
PAIR = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
#: From the ids and vectors of some queries and of some frames, both of one dimension, to rows of PAIR.
Scorer = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Null where a norm is 0 and no epsilon is given."""
    return F.try_divide(dot(a, b), norm(a) * norm(b) + F.lit(epsilon))


def l2_normalise(a: Column) -> Column:
    """A vector of norm 0 stays as it is. The norm is an element of an array, else it is worked out for each component."""
    size = F.array(norm(a))
    return F.element_at(F.transform(size, lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))), 1)


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


#: Scores that a task holds at once, and queries that it turns into a matrix at once.
CELLS, QUERY_ROWS = 1_000_000, 2_000


def _best(unit: np.ndarray, frames: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query index, frame index and score of each query's best k frames of a few, ties included, that reach its least;
    where there are k of them, their last becomes the least."""
    wide = frames.astype(np.float64)
    size = np.linalg.norm(wide, axis=1)
    scores = (wide / np.where(size == 0, 1, size)[:, None]) @ unit.T
    if len(wide) > k:
        np.maximum(least, np.partition(scores, len(wide) - k, axis=0)[len(wide) - k] - 1e-9, out=least)
    frame, query = np.nonzero(scores >= least)
    return query, frame, scores[frame, query]


def slices(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most n."""
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def _units(wide: np.ndarray) -> np.ndarray:
    m = wide.astype(np.float64)
    size = np.linalg.norm(m, axis=1)
    return m / np.where(size == 0, 1, size)[:, None]


def _by_dimension(ids: list, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of each dimension that occurs."""
    groups: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            groups.setdefault(len(v), []).append(i)
    out = {}
    for d, at in groups.items():
        m = np.array([vectors[i] for i in at], np.float64)
        size = np.linalg.norm(m, axis=1)
        out[d] = (np.array([ids[i] for i in at], np.int64), m / np.where(size == 0, 1, size)[:, None])
    return out


def _matched(asked: dict[int, tuple[np.ndarray, np.ndarray]], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """For each batch of (id, vector) and each dimension: query ids, their unit vectors, frame ids, frame vectors."""
    for batch in batches:
        lengths = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0)
        for d, (ids, unit) in asked.items():
            fits = np.flatnonzero(lengths == d)
            if len(fits):
                part = batch.take(pa.array(fits))
                yield ids, unit, part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(fits), d)


def _product(asked: dict[int, tuple[np.ndarray, np.ndarray]], batches: Iterator[pa.RecordBatch], k: int, threshold: float, digits: int) -> Iterator[pa.RecordBatch]:
    """Some CELLS scores at once. A query's k-th best so far is the least that later frames of the task have to reach."""
    least = {d: np.full(len(unit), threshold - 1e-9) for d, (_, unit) in asked.items()}
    for ids, unit, frame_ids, vectors in _matched(asked, batches):
        step = max(64, CELLS // len(unit))
        for at in range(0, len(vectors), step):
            query, frame, score = _best(unit, vectors[at : at + step], k, least[unit.shape[1]])
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), frame_ids.take(pa.array(frame + at)), pa.array(np.round(score, digits))], schema=PAIR)


def _streamed(batches: Iterator[pa.RecordBatch], score: Scorer) -> Iterator[pa.RecordBatch]:
    """Rows of (block, part, turn, asks, id, vector) in that order: the frames of a part are held while its queries pass."""
    at: tuple | None = None
    held: list[pa.RecordBatch] = []
    frames: dict[int, tuple[np.ndarray, np.ndarray]] | None = None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else [0]
        for lo, hi in zip(edges, edges[1:], strict=False):
            rows, (*place, asks) = batch.slice(lo, hi - lo).select(["id", "vector"]), keys[lo].tolist()
            if place != at:
                at, held, frames = place, [], None
            if not asks:
                held.append(rows)
                continue
            if frames is None:
                frames, held = _grouped(pa.Table.from_batches(held) if held else None), []
            for some in slices([rows], QUERY_ROWS):
                for d, (ids, asked) in _grouped(pa.Table.from_batches([some])).items():
                    if d in frames:
                        yield from score(ids, asked, *frames[d])


def _best_of_part(k: int, threshold: float, digits: int) -> Scorer:
    """Scores of some queries with the frames of a part: at least the best k of each query."""

    def run(ids: np.ndarray, asked: np.ndarray, frame_ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        unit = _units(asked)
        least = np.full(len(unit), threshold - 1e-9)
        step = max(64, CELLS // len(unit))
        for first in range(0, len(vectors), step):
            query, frame, score = _best(unit, vectors[first : first + step], k, least)
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(frame_ids[frame + first]), pa.array(np.round(score, digits))], schema=PAIR)

    return run


def _grouped(frames: pa.Table | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of each dimension, as they are."""
    out = {}
    if frames is not None and frames.num_rows:
        ids, vectors = (frames.column(i).combine_chunks() for i in range(2))
        lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for d in np.unique(lengths[lengths > 0]).tolist():
            fits = pa.array(np.flatnonzero(lengths == d))
            out[d] = (ids.take(fits).to_numpy(), vectors.take(fits).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
    return out


def block_scores(frames: DataFrame, queries: DataFrame, threshold: float, k: int, digits: int) -> DataFrame:
    """Scores of frames (block, id, vector) with queries (block, query_id, query_vector) of their block."""
    return _met(frames, queries, _best_of_part(k, threshold, digits))


def _met(frames: DataFrame, queries: DataFrame, score: Scorer) -> DataFrame:
    """What score says of frames and queries of a block. A block's frames are dealt into parts of about PART_ROWS, and its
    queries, in turns of about TURN_QUERIES, go to each of them. Vectors of floats on both sides travel as floats."""
    floats = dict(frames.dtypes)["vector"] == dict(queries.dtypes)["query_vector"] == "array<float>"
    parts = frames.groupBy("block").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    turns = queries.groupBy("block").agg(F.ceil(F.count("*") / TURN_QUERIES).cast("int").alias("turns"))
    sizes = F.broadcast(parts.join(turns, "block"))  # one row a block
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    vector = lambda c: F.col(c).cast("array<float>" if floats else "array<double>").alias("vector")
    own = frames.join(sizes, "block").select(F.col("block").cast("int").alias("block"), dealt("id", "parts").alias("part"), every("turns").alias("turn"), F.lit(0).alias("asks"), F.col("id").cast("long").alias("id"), vector("vector"))
    asked = queries.join(sizes, "block").select(F.col("block").cast("int").alias("block"), every("parts").alias("part"), dealt("query_id", "turns").alias("turn"), F.lit(1).alias("asks"), F.col("query_id").cast("long").alias("id"), vector("query_vector"))
    met = own.unionByName(asked).repartition("block", "part", "turn").sortWithinPartitions("block", "part", "turn", "asks")
    return met.mapInArrow(lambda batches: _streamed(batches, score), "query_id long, id long, score double")


def cosine_scores(frames: DataFrame, queries: DataFrame, threshold: float, k: int = 1 << 30, id_col: str = "id", vector_col: str = "vector", digits: int = 9) -> DataFrame:
    """(query_id, id, score) of pairs at or above the threshold; of those a batch of frames gives at least its best k.

    A batch of frames meets all its queries in one matrix product; scores are rounded so that equal ones tie alike
    whatever the order of summation. Frames without a vector or of another dimension match nothing.
    """
    n = queries.count()
    spark = frames.sparkSession
    schema = "query_id long, id long, score double"
    pairs = frames.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("vector IS NOT NULL")
    if n <= BROADCAST_QUERIES:
        rows = queries.select("query_id", "query_vector").collect()
        sent = spark.sparkContext.broadcast(_by_dimension([r.query_id for r in rows], [r.query_vector for r in rows]))
        scored = pairs.mapInArrow(lambda batches: _product(sent.value, batches, k, threshold, digits), schema)
    else:
        whole = F.lit(0).alias("block")
        scored = block_scores(pairs.select(whole, "id", "vector"), queries.select(whole, "query_id", "query_vector"), threshold, k, digits)
    return scored.where(F.col("score") >= threshold)


def nearest(frames: DataFrame, targets: DataFrame, digits: int = 9) -> DataFrame:
    """(id, target_id, score): the most similar target of each frame (id, vector), the least id of equals; the best is
    taken inside the batch, so a frame leaves a task as one row. targets: (target_id, target_vector), a vocabulary of
    at most BROADCAST_QUERIES. A frame without a vector, or of a dimension that no target has, is left out."""
    rows = targets.select("target_id", "target_vector").orderBy("target_id").limit(BROADCAST_QUERIES + 1).collect()
    if len(rows) > BROADCAST_QUERIES:
        raise ValueError(f"a vocabulary has at most {BROADCAST_QUERIES} entries")
    sent = frames.sparkSession.sparkContext.broadcast(_by_dimension([r.target_id for r in rows], [r.target_vector for r in rows]))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, unit, frame_ids, vectors in _matched(sent.value, batches):
            step = max(64, CELLS // len(unit))
            for first in range(0, len(vectors), step):
                wide = vectors[first : first + step].astype(np.float64)
                size = np.linalg.norm(wide, axis=1)
                scores = np.round((wide / np.where(size == 0, 1, size)[:, None]) @ unit.T, digits)
                at = scores.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([frame_ids.slice(first, len(wide)), pa.array(ids[at]), pa.array(scores[np.arange(len(at)), at])], names=["id", "target_id", "score"])

    return frames.select(F.col("id").cast("long").alias("id"), "vector").where("vector IS NOT NULL").mapInArrow(best, "id long, target_id long, score double")


def cosine_topk(frames: DataFrame, queries: DataFrame, k: int = 20, threshold: float = 0.3, id_col: str = "id", vector_col: str = "vector", digits: int = 9) -> DataFrame:
    """(query_id, id, score, rank): each query's best k frames at or above the threshold, by score and then id."""
    scored = cosine_scores(frames, queries, threshold, k, id_col, vector_col, digits)
    return ranked(scored, ["query_id"], [F.desc("score"), F.col("id")]).where(F.col("rank") <= k)


def two_pass(frames: DataFrame, queries: DataFrame, limit: int = 20, threshold: float = 0.2, oversample: int = 5, candidates: DataFrame | None = None) -> DataFrame:
    """Candidates (limit * oversample of them, from the exact pass unless given), scored again with an epsilon in the
    denominator and sorted anew; no second threshold. Where a norm is 0 or a vector is missing the first score stays."""
    first = candidates if candidates is not None else cosine_topk(frames, queries, limit * max(1, oversample), threshold)
    joined = first.join(frames.select("id", "vector"), "id", "left").join(queries, "query_id", "left")
    exact = cosine(F.col("vector"), F.col("query_vector"), 1e-8)
    usable = F.coalesce(norm(F.col("query_vector")) > 0, F.lit(False)) & F.col("vector").isNotNull()
    rescored = joined.withColumn("score", F.round(F.when(usable, exact).otherwise(F.col("score")), 9)).drop("vector", "query_vector", "rank")
    return ranked(rescored, ["query_id"], [F.desc("score"), F.col("id")])


def browse(frames: DataFrame, condition: Column | None, limit: int = 20) -> DataFrame:
    """A filter without a query: rows in the order of ids, score 1. Without a filter too it is refused."""
    if condition is None:
        raise ValueError("a query or a filter is needed")
    return frames.where(condition).orderBy("id").limit(limit).withColumn("score", F.lit(1.0))


def grouped_topk(hits: DataFrame, group: str = "file_path", limit: int = 10, group_size: int = 3) -> DataFrame:
    """The best limit groups of each query, at most group_size hits of each."""
    order = [F.desc("score"), F.col("id")]
    inside = ranked(hits, ["query_id", group], order, "group_rank").where(F.col("group_rank") <= group_size)
    best = ranked(inside.where("group_rank = 1").select("query_id", group, "score"), ["query_id"], [F.desc("score"), F.col(group)], "place").where(F.col("place") <= limit)
    return inside.join(best.select("query_id", group, "place"), ["query_id", group])


def _within(radius: float, tables: int) -> Scorer:
    """Of vectors that end with a bucket for each table: pairs nearer than the radius that share a bucket in some table."""

    def run(ids: np.ndarray, asked: np.ndarray, frame_ids: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        wanted = asked[:, :-tables]
        least = (np.square(wanted).sum(axis=1) - radius**2) / 2 - 1e-9
        step = max(64, CELLS // len(asked))
        for first in range(0, len(rows), step):
            part = rows[first : first + step]
            vectors = part[:, :-tables]
            frame, query = np.nonzero(vectors @ wanted.T >= least + np.square(vectors).sum(axis=1)[:, None] / 2)
            for at in range(0, len(frame), QUERY_ROWS):
                f, q = frame[at : at + QUERY_ROWS], query[at : at + QUERY_ROWS]
                far = np.square(vectors[f] - wanted[q]).sum(axis=1)
                kept = (np.sqrt(far) < radius) & (part[f, -tables:] == asked[q, -tables:]).any(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[kept]]), pa.array(frame_ids[f[kept] + first]), pa.array(1 - far[kept] / 2)], schema=PAIR)

    return run


def lsh_candidates(frames: DataFrame, queries: DataFrame, bucket: float = 0.6, tables: int = 12, radius: float = 1.1, seed: int = 7) -> DataFrame:
    """(query_id, id, score) by bucketed random projections of normalised vectors within a distance; approximate, and blind
    below the cosine that the distance stands for (1.1: 0.395). Cells reach lower ones.

    The rows are those of approxSimilarityJoin. That joins on buckets, and as a unit vector's projection falls into one of
    two or three so wide ones, it makes about tables / 2 rows, with both vectors, of every pair there is. Here parts of
    frames meet the queries, and pairs within the distance are asked whether they share a bucket. A row without a vector
    has no candidates."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def units(df: DataFrame, key: str, vector: str) -> DataFrame:
        own = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
        return own.select(F.lit(0).alias("block"), F.col(key).cast("long").alias(key), array_to_vector(l2_normalise(F.col(vector))).alias("features"))

    left, right = units(frames, "id", "vector"), units(queries, "query_id", "query_vector")
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(left)
    buckets = F.concat(*[vector_to_array(F.col("hashes")[i]) for i in range(tables)])
    both = lambda df, key, name: model.transform(df).select("block", key, F.concat(vector_to_array("features"), buckets).alias(name))
    return _met(both(left, "id", "vector"), both(right, "query_id", "query_vector"), _within(radius, tables)).distinct()


@dataclass(frozen=True)
class CellIndex:
    """Unit centres of cells, and how many of a query's nearest cells to look into."""

    centres: np.ndarray
    probes: int


def fit_cells(frames: DataFrame, cells: int = 32, sample: int = 20_000, recall: float = 0.97, k: int = 10, seed: int = 7) -> CellIndex:
    """Cells by k-means over at most sample unit vectors, the first in the order of a hash of their ids. The number of
    probes is the least with which 200 of those find the share recall of their k nearest in the sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = frames.where("vector IS NOT NULL AND size(vector) > 0").select("id", l2_normalise(F.col("vector")).alias("vector"))
    picked = own.orderBy(F.xxhash64("id"), "id").limit(sample)
    units = np.array([r.vector for r in picked.collect()], np.float64)
    if not len(units):
        return CellIndex(np.zeros((0, 0)), 0)
    model = KMeans(k=min(cells, len(units)), seed=seed, maxIter=15).fit(picked.select(array_to_vector("vector").alias("features")))
    centres = np.array(model.clusterCenters())
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    cell = (units @ centres.T).argmax(axis=1)
    asked = units[:200]
    order = np.argsort(-(asked @ centres.T), axis=1)
    place = np.argsort(order, axis=1)  # of every cell in each query's order
    near = np.argsort(-(asked @ units.T), axis=1, kind="stable")[:, : k + 1]
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return CellIndex(centres, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1)


def cell_topk(frames: DataFrame, queries: DataFrame, index: CellIndex, k: int = 10, threshold: float = 0.2, digits: int = 9) -> DataFrame:
    """(query_id, id, score, rank) as cosine_topk, from the cells that each query looks into: approximate, with exact
    scores. Every frame of the index's dimension is in it, in the cell of its nearest centre."""
    sent = frames.sparkSession.sparkContext.broadcast(index)

    def placed(id_col: str, vector_col: str, probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = sent.value.centres
            for _, unit, ids, vectors in _matched({centres.shape[1]: (np.arange(len(centres)), centres)} if len(centres) else {}, slices(batches, QUERY_ROWS)):
                n = min(probes, len(unit))
                cells = np.argsort(-(vectors.astype(np.float64) @ unit.T), axis=1, kind="stable")[:, :n].ravel()
                at = pa.array(np.repeat(np.arange(len(ids)), n))
                held = pa.FixedSizeListArray.from_arrays(pa.array(vectors.astype(np.float32).ravel()), vectors.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), ids.take(at), held.take(at)], names=["block", id_col, vector_col])

        return run

    left = frames.selectExpr("cast(id AS bigint) AS id", "cast(vector AS array<float>) AS vector").where("vector IS NOT NULL").mapInArrow(placed("id", "vector", 1), "block int, id long, vector array<float>")
    right = queries.selectExpr("cast(query_id AS bigint) AS query_id", "cast(query_vector AS array<float>) AS query_vector").where("query_vector IS NOT NULL").mapInArrow(placed("query_id", "query_vector", index.probes), "block int, query_id long, query_vector array<float>")
    scored = block_scores(left, right, threshold, k, digits).where(F.col("score") >= threshold)
    return ranked(scored, ["query_id"], [F.desc("score"), F.col("id")]).where(F.col("rank") <= k)


def envelope(hits: DataFrame, returned: DataFrame, dedup: bool = True) -> DataFrame:
    """One row for each query: raw hits, hits returned, and how many went (0 without de-duplication)."""
    raw = hits.groupBy("query_id").agg(F.count("*").alias("raw_frame_count"))
    kept = returned.groupBy("query_id").agg(F.count("*").alias("returned"))
    gone = F.col("raw_frame_count") - F.coalesce("returned", F.lit(0)) if dedup else F.lit(0).cast("long")
    return raw.join(kept, "query_id", "left").select("query_id", "raw_frame_count", F.coalesce("returned", F.lit(0)).alias("returned"), gone.alias("scenes_collapsed"))


def rerank_by_caption(hits: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """hits with question, caption and rank: captioned ones get scorer(question, caption), others 0; sorted by it, then
    by the first order. Queries without any caption keep their order. A negative score ranks below no caption."""
    udf = F.pandas_udf(scorer, "double")
    has = F.coalesce(F.col("caption") != "", F.lit(False))
    made = hits.withColumn("rerank_score", F.when(has, udf("question", F.coalesce("caption", F.lit("")))).otherwise(0.0))
    some = F.max(has.cast("int")).over(Window.partitionBy("query_id")) == 1
    return ranked(made.withColumn("__some", some), ["query_id"], [F.when(F.col("__some"), -F.col("rerank_score")).otherwise(0.0), F.col("rank")], "new_rank").drop("__some")


SORTS = {
    "similarity_desc": lambda: [F.desc("score"), F.col("id")],
    "similarity_asc": lambda: [F.asc("score"), F.col("id")],
    "energy_desc": lambda: [F.desc(F.coalesce("audio_rms_energy", F.lit(-1.0))), F.col("id")],
    "energy_asc": lambda: [F.asc(F.coalesce("audio_rms_energy", F.lit(float("inf")))), F.col("id")],
}


def page(hits: DataFrame, sort: str, number: int = 1, size: int = 20) -> DataFrame:
    """One page of each query's hits in one of the sort modes."""
    place = ranked(hits, ["query_id"], SORTS[sort](), "place")
    return place.where((F.col("place") > (number - 1) * size) & (F.col("place") <= number * size))


def drift(a: DataFrame, b: DataFrame, gate: float = 0.99) -> DataFrame:
    """The mean cosine of two encodings of the same ids, and whether it reaches the gate."""
    both = a.select("id", F.col("vector").alias("va")).join(b.select("id", F.col("vector").alias("vb")), "id")
    return both.agg(F.count("*").alias("n"), F.round(F.avg(cosine(F.col("va"), F.col("vb"))), 6).alias("mean_cosine")).withColumn("passed", F.coalesce(F.col("mean_cosine") >= gate, F.lit(False)))
