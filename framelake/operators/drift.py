"""Drift between two stores of rows by digest trees.

Both sides are summed up by buckets of the key's hash: rows, and the sum of a hash of what is compared, which knows no order.
Equal buckets are told by these numbers alone; buckets that differ are split by further bits of the hash, level by level,
and only the rows of the last level's differing buckets are compared key by key. What passes through the driver is the
numbers of the buckets that differ, at most FANOUT a level and parent, and at most OPENED at all: beyond that the levels end
and the rows are compared as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT_BITS, LEVELS, OPENED = 10, 2, 20_000


@dataclass(frozen=True)
class Drift:
    """rows: (key, left_n, right_n) of the keys whose rows or values differ; buckets and differing of every level."""

    rows: DataFrame
    levels: list[tuple[int, int]]


def _bucket(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def _digests(rows: DataFrame, key: str, values: list[str], bits: int) -> DataFrame:
    both = F.xxhash64(key, *values).cast("decimal(38,0)")
    return rows.groupBy(_bucket(key, bits).alias("__bucket")).agg(F.count("*").alias("__n"), F.sum(both).alias("__sum"))


def _within(rows: DataFrame, key: str, bits: int, parents: list[int] | None) -> DataFrame:
    return rows if parents is None else rows.where(_bucket(key, bits).isin(parents))


def compare(left: DataFrame, right: DataFrame, key: str, values: list[str] | None = None, fanout_bits: int = FANOUT_BITS, depth: int = LEVELS) -> Drift:
    """left and right have the key and the columns of values. A key that only one side has counts 0 on the other."""
    values = values or []
    left, right = (df.select(key, *values) for df in (left, right))
    levels: list[tuple[int, int]] = []
    parents: list[int] | None = None
    bits = 0
    for level in range(1, depth + 1):
        a, b = (_digests(_within(df, key, bits, parents), key, values, level * fanout_bits) for df in (left, right))
        joined = a.join(b.withColumnsRenamed({"__n": "__m", "__sum": "__other"}), "__bucket", "full")
        same = F.col("__n").eqNullSafe(F.col("__m")) & F.col("__sum").eqNullSafe(F.col("__other"))
        counts = joined.agg(F.count("*").alias("all"), F.count_if(~same).alias("differ")).first()
        levels.append((counts["all"], counts["differ"]))
        if counts["differ"] > OPENED:
            break
        parents, bits = [r["__bucket"] for r in joined.where(~same).select("__bucket").collect()], level * fanout_bits
        if not parents:
            break
    rows_ = [_within(df, key, bits, parents) for df in (left, right)]
    sums = [df.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.xxhash64(key, *values).cast("decimal(38,0)")).alias("h")) for df in rows_]
    l, r = sums[0].alias("l"), sums[1].alias("r")
    both = l.join(r, F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")), "full")
    n = lambda side: F.coalesce(F.col(f"{side}.n"), F.lit(0))
    differs = (n("l") != n("r")) | ~F.col("l.h").eqNullSafe(F.col("r.h"))
    out = both.where(differs).select(F.when(F.col("l.n").isNotNull(), F.col(f"l.{key}")).otherwise(F.col(f"r.{key}")).alias(key), n("l").alias("left_n"), n("r").alias("right_n"))
    return Drift(out, levels)


def frames_per_file(frames: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, n_frames, status, lacks_vectors) of every file that either store knows: unknown is one that only the frames
    name, and a done file without a frame lacks its vectors. files: (key, status), one row each."""
    counts = frames.groupBy(key).agg(F.count("*").alias("__n"))
    both = counts.join(files.select(key, "status"), key, "full")
    n = F.coalesce("__n", F.lit(0))
    lacks = (F.coalesce("status", F.lit("")) == "done") & (n == 0)
    return both.select(key, n.alias("n_frames"), F.coalesce("status", F.lit("unknown")).alias("status"), lacks.alias("lacks_vectors"))
