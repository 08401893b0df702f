"""An index of vectors by cells, kept on disk, with exact search.

Cells are those of the nearest of a set of centres, fitted once to a bounded sample. The index holds every vector in a
folder of its cell, and for each cell the least and the greatest angle between its vectors and its centre. A query at the
angle a to a centre is at least max(a - greatest, least - a, 0) away from all of the cell (the triangle inequality on the
sphere), which bounds the cosine that the cell can offer.

A search visits a query's cells in the order of these bounds, in rounds: a few first, then those whose bound still reaches
the k-th best score so far or, before there are k, the threshold; it ends when no cell is left that does. So its rows are
those of the exhaustive search, whatever the data; how many cells are read depends on how well the vectors cluster, and is
returned. Only folders of cells that some query visits are opened.

Insertion adds a batch in the cells of the same centres and widens their angles by facts of its own; an id that comes again
replaces its older row. Vectors that are zero or not of the centres' dimension lie in cell -1, which every query visits;
null or empty ones are not in the index. A query without a vector gets no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed_store import Folder, VersionTaken
from ..sources.shared import settled
from .search import QUERY_ROWS, block_scores, l2_normalise, ranked, slices

SAMPLE, MOST_CELLS = 20_000, 4_096
#: Slack for rounding in angles and scores.
SLACK = 1e-7


def fit_centres(frames: DataFrame, cells: int = 64, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centres by k-means over at most sample vectors, the first in the order of a hash of their ids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = frames.where("vector IS NOT NULL AND size(vector) > 0").select("id", l2_normalise(F.col("vector")).alias("vector"))
    picked = settled(own.orderBy(F.xxhash64("id"), "id").limit(sample))
    n = picked.count()
    if not n:
        return np.zeros((0, 0))
    size = picked.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first().d  # the commonest dimension
    model = KMeans(k=min(cells, MOST_CELLS, n), seed=seed, maxIter=15).fit(picked.where(F.size("vector") == size).select(array_to_vector("vector").alias("features")))
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def _angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centres.T, -1, 1))


def _units(vectors: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have d components and are not zero, and their unit vectors."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(lengths == d) if d else np.zeros(0, np.int64)
    wide = vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), d or 1)
    norm = np.linalg.norm(wide, axis=1)
    return fits[norm > 0], wide[norm > 0] / norm[norm > 0, None]


def _placed(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    centres = sent.value
    for batch in slices(batches, QUERY_ROWS):
        cell, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
        at, unit = _units(batch.column(1), centres.shape[1])
        if len(at):
            far = _angles(unit, centres)
            cell[at], angle[at] = far.argmin(axis=1), far.min(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(angle), pa.array(cell)], names=["id", "vector", "angle", "cell"])


def _bounds(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """For each query and cell: the greatest cosine that the cell can offer, and the cell's place in the order of visits."""
    centres, cells, least, most = sent.value
    for batch in slices(batches, QUERY_ROWS):
        lengths = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        bound = np.ones((batch.num_rows, len(cells)))
        near = np.zeros((batch.num_rows, len(cells)))
        at, unit = _units(batch.column(1), centres.shape[1])
        real = cells >= 0
        if len(at) and real.any():
            a = _angles(unit, centres[cells[real]])
            bound[np.ix_(at, real)] = np.cos(np.maximum(np.maximum(a - most[real], least[real] - a), 0))
            near[np.ix_(at, real)] = a
        # A query of another dimension meets the odd vectors alone, and one that is zero has cosine 0 with all.
        other = np.ones(batch.num_rows, bool)
        other[at] = False
        bound[np.ix_(other, real)] = np.where(lengths[other] == centres.shape[1], 0.0, -2.0)[:, None]
        order = np.lexsort((near, -bound), axis=1)
        place = np.argsort(order, axis=1)
        q = np.repeat(np.flatnonzero(lengths > 0), len(cells))
        c = np.tile(np.arange(len(cells)), np.count_nonzero(lengths > 0))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(q)), pa.array(cells[c], pa.int32()), pa.array(bound[q, c]), pa.array(place[q, c], pa.int32())], names=["query_id", "block", "bound", "place"])


@dataclass(frozen=True)
class Found:
    """hits: (query_id, id, score, rank); visits: (query_id, cell, round) of the cells that were read; cells: how many
    there are."""

    hits: DataFrame
    visits: DataFrame
    cells: int


class CellIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Folder(spark, f"{self.path}/_log")

    @staticmethod
    def build(frames: DataFrame, path: str, cells: int = 64, seed: int = 7) -> CellIndex:
        """A new index of the frames (id, vector)."""
        index = CellIndex(frames.sparkSession, path)
        centres = fit_centres(frames, cells, seed=seed)
        index.log.create("centres.json", json.dumps(centres.tolist()))
        index.insert(frames)
        return index

    def centres(self) -> np.ndarray:
        made = np.array(json.loads(self.log.read("centres.json")), np.float64)
        return made if made.size else np.zeros((0, 0))

    def batches(self) -> list[str]:
        """Folders of the batches, in their order."""
        names = sorted(n for n in self.log.names() if n.startswith("batch-"))
        return [self.log.read(n) for n in names]

    def insert(self, frames: DataFrame) -> None:
        """Frames (id, vector) in the cells of the centres as they are; of rows that share an id any one."""
        folder = f"{self.path}/{uuid.uuid4().hex}"
        sent = self.spark.sparkContext.broadcast(self.centres())
        rows = frames.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")).where("id IS NOT NULL AND size(vector) > 0").dropDuplicates(["id"])
        placed = rows.mapInArrow(lambda b: _placed(b, sent), "id long, vector array<float>, angle double, cell int")
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{folder}/rows")
        written = self.spark.read.schema("id long, vector array<float>, angle double, cell int").parquet(f"{folder}/rows")
        facts = written.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"))
        facts.coalesce(1).write.parquet(f"{folder}/facts")  # one row a cell
        while True:
            try:
                return self.log.create(f"batch-{len(self.batches()):08d}", folder)
            except VersionTaken:
                continue

    def facts(self) -> DataFrame:
        """(cell, n, least, most) over all batches."""
        schema = "cell int, n long, least double, most double"
        every = [self.spark.read.schema(schema).parquet(f"{b}/facts") for b in self.batches()]
        return reduce(DataFrame.unionByName, every).groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """(cell, id, vector) of all cells or of those named, whose folders alone are opened. Ids of later batches hide
        those of earlier ones."""
        schema = "id long, vector array<float>, angle double, cell int"
        whole = [self.spark.read.schema(schema).parquet(f"{b}/rows") for b in self.batches()]
        out = []
        for i, df in enumerate(whole):
            part = df.where(F.col("cell").isin(cells)) if cells is not None else df
            if whole[i + 1 :]:
                part = part.join(reduce(DataFrame.unionByName, [x.select("id") for x in whole[i + 1 :]]), "id", "left_anti")
            out.append(part.select("cell", "id", "vector"))
        return reduce(DataFrame.unionByName, out)

    def search(self, queries: DataFrame, k: int = 10, threshold: float = 0.2, first: tuple[int, ...] = (2, 8), digits: int = 9) -> Found:
        """Each query's best k at or above the threshold, by score and then id. first: how many cells at most the first
        rounds visit; the last round visits all that are left and may matter."""
        facts = sorted((r.cell, r.least, r.most) for r in self.facts().collect())  # one row a cell
        cells, least, most = (np.array([f[i] for f in facts], t) for i, t in enumerate((np.int32, np.float64, np.float64)))
        sent = self.spark.sparkContext.broadcast((self.centres(), cells, least - SLACK, most + SLACK))
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "query_vector")
        bounds = settled(asked.mapInArrow(lambda b: _bounds(b, sent), "query_id long, block int, bound double, place int").where(F.col("bound") >= threshold - SLACK))
        hits = self.spark.createDataFrame([], "query_id long, id long, score double")
        visits = self.spark.createDataFrame([], "query_id long, block int, round int")
        for number, limit in enumerate((*first, None)):
            worst = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") >= k)
            left = bounds.join(visits, ["query_id", "block"], "left_anti").join(worst, "query_id", "left")
            left = left.where(F.col("bound") >= F.coalesce("worst", F.lit(threshold)) - SLACK)
            if limit is not None:
                left = ranked(left, ["query_id"], [F.col("place")], "turn").where(F.col("turn") <= limit)
            new = settled(left.select("query_id", "block", F.lit(number).alias("round")))
            opened = [r.block for r in new.select("block").distinct().collect()]  # at most one for each cell
            if not opened:
                break
            frames = self.rows(opened).withColumnRenamed("cell", "block")
            scored = block_scores(frames, new.join(asked, "query_id").select("block", "query_id", "query_vector"), threshold, k, digits).where(F.col("score") >= threshold)
            best = ranked(hits.unionByName(scored), ["query_id"], [F.desc("score"), F.col("id")]).where(F.col("rank") <= k)
            hits = settled(best.drop("rank"))
            visits = settled(visits.unionByName(new))
        return Found(ranked(hits, ["query_id"], [F.desc("score"), F.col("id")]), visits.withColumnRenamed("block", "cell"), len(cells))
