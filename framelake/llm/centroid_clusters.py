"""Centroid clustering over integers with an incremental distance matrix.

Vectors become integers floor(scale * x). Every vector's row carries its exact dot products with all centroids; these
rows are written once a round. A round assigns vectors to the nearest centroid, takes the exact componentwise floor of
each cluster's mean, and hands the tasks only what changed: for each centroid the components whose difference is not
zero. A task adds difference times component to the dot products it has persisted and takes the least of
|x|^2 + |c|^2 - 2 x.c again, so a centroid that stands still costs nothing and no distance is worked out anew.

Only centroids (k rows) pass through the driver. Sums are partial in every task before their shuffle, so a cluster of
any size is k rows a task. The dot products are 32-bit where the longest vector proves that they fit. A round's rows
replace those of the round before, which are removed once the new ones are written.

Kept are vectors of exactly dim components, none null or not finite, whose squared length in integers is below 2**61, so
that every squared distance fits a long (a real length of about 5.9 million at scale 256); others give no row. Fewer than
k kept vectors: as many centroids as there are. Repeated rows each give a row; equal hashes (repeated ids) are ordered by
components; vectors without an id take part and come last among the seeds. Ties go to the smaller cluster number. An empty
cluster keeps its centroid. Sums of distances that exceed a long are null. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged, staged_path

Changes = list[tuple[int, np.ndarray, np.ndarray]]
_EXACT = 2.0**53


def integer_vectors(vectors: DataFrame, dim: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x, norm) of the kept vectors: integer components and their squared length."""
    scaled = F.transform(F.col(f"`{vector_col}`"), lambda v: v.cast("double") * scale)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), scaled.alias("v")).where(F.size("v") == dim)
    rows = rows.where(F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2.0**31)))
    rows = rows.select("vec_id", F.transform("v", lambda v: F.floor(v)).alias("x"))
    return rows.withColumn("norm", F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v * v)).where(F.col("norm") < 1 << 61)


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hashes of salt and id."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    top = rows.orderBy(digest.asc_nulls_last(), "x").limit(k).select("x").collect()  # k rows
    return np.array([r.x for r in top], np.int64)


def changes(old: np.ndarray, new: np.ndarray) -> Changes:
    """Of every centroid that moved: its number, the components that changed, and by how much."""
    found = []
    for c, d in enumerate(new - old):
        at = np.flatnonzero(d)
        if len(at):
            found.append((c, at, d[at]))
    return found


def add_changes(dots: np.ndarray, xt: np.ndarray, moved: Changes) -> None:
    """dots (centroids by vectors) brought up to date; xt has components by vectors. Products that stay below 2**53 are
    exact in doubles and quicker there."""
    widest = float(np.abs(xt).max(initial=0))
    doubles = xt.astype(np.float64)
    for c, at, by in moved:
        if widest * float(np.abs(by).astype(np.float64).sum()) < _EXACT:
            dots[c] += np.rint(by.astype(np.float64) @ doubles[at]).astype(np.int64)
        else:
            dots[c] += by @ xt[at]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix of rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def _advance(batches: Iterator[pa.RecordBatch], dim: int, k: int, moved: Changes, squares: np.ndarray, kind: pa.DataType, last: bool) -> Iterator[pa.RecordBatch]:
    """Update each vector's dot products and take the nearest centroid. Batches without dot products start from zero."""
    for whole in batches:
        for batch in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
            xt = np.ascontiguousarray(_matrix(batch.column("x"), dim).T)
            norm = batch.column("norm").to_numpy()
            dots = np.ascontiguousarray(_matrix(batch.column("dots"), k).T) if "dots" in batch.schema.names else np.zeros((k, batch.num_rows), np.int64)
            add_changes(dots, xt, moved)
            far = squares[:, None] - 2 * dots
            cluster = np.argmin(far, axis=0)  # the first of equals
            near = norm + far[cluster, np.arange(len(cluster))]
            ids, cluster = batch.column("vec_id"), pa.array(cluster, pa.int32())
            if last:
                yield pa.RecordBatch.from_arrays([ids, cluster, pa.array(near, pa.int64())], names=["vec_id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([ids, batch.column("x"), batch.column("norm"), _lists(dots.T, kind), cluster], names=["vec_id", "x", "norm", "dots", "cluster"])


def moved_centroids(assigned: DataFrame, centroids: np.ndarray, wide: bool) -> np.ndarray:
    """The componentwise floor of every cluster's mean; an empty cluster's centroid stays."""
    term = (lambda i: F.col("x")[i].cast("decimal(38,0)")) if wide else (lambda i: F.col("x")[i])
    sums = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(term(i)) for i in range(centroids.shape[1])]).alias("sums"))
    new = centroids.copy()
    for r in sums.collect():  # at most k rows
        new[r.cluster] = [int(s) // r.n for s in r.sums]
    return new


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector after the given rounds, and the final centroids."""
    spark = vectors.sparkSession
    rows = staged(integer_vectors(vectors, dim, scale, id_col, vector_col))
    centroids = first_centroids(rows, k, salt)
    k = len(centroids)
    if not k:
        return rows.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), centroids
    longest = rows.agg(F.max("norm")).first()[0] ** 0.5 + dim**0.5  # floors of means reach that far at most
    wide = longest**2 >= 2**31
    number, kind = ("long", pa.int64()) if wide else ("int", pa.int32())
    moved, path = changes(np.zeros_like(centroids), centroids), None
    for _ in range(rounds):
        squares = (centroids * centroids).sum(1)
        step = partial(_advance, dim=dim, k=k, moved=moved, squares=squares, kind=kind, last=False)
        before, path = path, staged_path(spark)
        rows = staged(rows.mapInArrow(step, f"vec_id long, x array<long>, norm long, dots array<{number}>, cluster int"), path)
        if before:
            drop_staged(spark, before)
        new = moved_centroids(rows, centroids, wide)
        moved, centroids = changes(centroids, new), new
    squares = (centroids * centroids).sum(1)
    step = partial(_advance, dim=dim, k=k, moved=moved, squares=squares, kind=kind, last=True)
    out = staged(rows.mapInArrow(step, "vec_id long, cluster int, distance long"))
    if path:
        drop_staged(spark, path)
    return out, centroids


def op11_centroid_clusters(vectors: DataFrame) -> DataFrame:
    """Each vector with its cluster, the distances summed over cluster and table, and its centroid's digest."""
    assigned, centroids = cluster(vectors)
    sums = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # at most k rows
    fits = lambda x: F.lit(int(x) if x < 1 << 63 else None).cast("long")
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.element_at(F.array(*values).cast(f"array<{kind}>"), F.col("cluster") + 1)
    inertia = of([fits(sums.get(c, 0)) for c in range(len(centroids))], "long") if sums else F.lit(None).cast("long")
    digest = of([F.lit(d) for d in digests], "string") if sums else F.lit(None).cast("string")
    return assigned.select("vec_id", "cluster", "distance", inertia.alias("cluster_inertia"), fits(sum(sums.values())).alias("inertia"), digest.alias("centroid_sha256"))


def _sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """The same rounds as plain queries: every distance from scratch."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x AS m FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT r, min(CAST(list_inner_product(CAST(x AS DOUBLE[]), CAST(x AS DOUBLE[])) + list_inner_product(CAST(m AS DOUBLE[]), CAST(m AS DOUBLE[]))
            - 2 * list_inner_product(CAST(x AS DOUBLE[]), CAST(m AS DOUBLE[])) AS BIGINT) * 64 + c) AS best FROM v CROSS JOIN c{i} GROUP BY r)"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN (SELECT c, list(mean ORDER BY j) AS m FROM (SELECT best % 64 AS c, j, CAST(floor(sum(xj) / count(*)) AS BIGINT) AS mean
                FROM (SELECT best, unnest(x) AS xj, generate_subscripts(x, 1) AS j FROM a{i} JOIN v USING (r)) GROUP BY 1, 2) GROUP BY c) n USING (c))"""
            )
    return (
        "WITH "
        + ", ".join(parts)
        + f""" SELECT vec_id, CAST(best % 64 AS INTEGER) AS cluster, best // 64 AS distance, CAST(sum(best // 64) OVER (PARTITION BY best % 64) AS BIGINT) AS cluster_inertia,
        CAST(sum(best // 64) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c = best % 64"""
    )


OP11_SQL = _sql()
