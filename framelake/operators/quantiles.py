"""Exact quantiles of large groups by counting, and facts of groups beside their rows.

No task holds a group. The order statistics that a quantile needs are closed in on: every pass counts, in partial sums, the
rows of each interval in WAYS ranges of equal width, and keeps for each wanted rank the range that holds it, narrowed to the
least and greatest value found there, until they are one. A pass reads only rows inside open intervals; two or three passes
do for values of ordinary spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled

WAYS = 4_096
#: Facts of up to so many groups are sent to all tasks; beyond, a group's rows are dealt over SALTS keys.
FACTS_SENT, SALTS = 50_000, 32


def beside(rows: DataFrame, facts: DataFrame, by: list[str], few: bool | None = None) -> DataFrame:
    """rows with the facts of their group, which may be null; rows of groups without any go. Facts must be cheap to read."""
    few = facts.count() <= FACTS_SENT if few is None else few
    names = {c: f"__of_{i}" for i, c in enumerate(by)}
    right = facts.withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    if few:
        return rows.join(F.broadcast(right), same or None, "inner").drop(*names.values())
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS)).cast("int"))
    right = right.withColumn("__salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*same, F.col("__salt") == F.col("__salted")], "inner").drop("__salt", "__salted", *names.values())


def order_statistics(rows: DataFrame, by: list[str], wanted: DataFrame) -> DataFrame:
    """(by, rank, value): the value of each wanted rank (from 0) of its group, of rows (by, value) without nulls."""
    key = [*by, "__low", "__high"]
    ends = rows.groupBy(*by).agg(F.min("value").alias("__low"), F.max("value").alias("__high"))
    left = _same(wanted, ends, by).select(*by, "rank", "__low", "__high", F.lit(0).cast("long").alias("__before"))
    while True:
        left = settled(left)
        open_ = left.where("__low < __high")
        intervals = open_.select(*key).distinct()
        n = intervals.count()
        if not n:
            return left.select(*by, "rank", F.col("__low").alias("value"))
        inside = beside(rows, intervals, by, n <= FACTS_SENT).where("value >= __low and value <= __high")
        place = F.least(F.lit(WAYS - 1), F.floor((F.col("value") - F.col("__low")) / (F.col("__high") - F.col("__low")) * WAYS)).cast("int")
        counts = inside.groupBy(*key, place.alias("__place")).agg(F.count("*").alias("__n"), F.min("value").alias("__a"), F.max("value").alias("__b"))
        along = Window.partitionBy(*key).orderBy("__place")  # at most WAYS rows
        counts = counts.withColumn("__upto", F.sum("__n").over(along))
        hit = _same(open_, counts, key).where("rank >= __before + __upto - __n and rank < __before + __upto")
        narrowed = hit.select(*by, "rank", F.col("__a").alias("__low"), F.col("__b").alias("__high"), (F.col("__before") + F.col("__upto") - F.col("__n")).alias("__before"))
        left = left.where("__low = __high").unionByName(narrowed)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a inner join b on keys that may be null, the keys once."""
    if not keys:
        return a.crossJoin(b)  # one row on the right
    names = {c: f"__same_{i}" for i, c in enumerate(keys)}
    return a.join(b.withColumnsRenamed(names), [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]).drop(*names.values())


def quantiles(rows: DataFrame, by: list[str], value: Column, **wanted: float) -> DataFrame:
    """(by, and a column for each name): the quantile of the group's finite values, linear between its two neighbours. A
    group without values has no row."""
    own = rows.select(*by, value.cast("double").alias("value")).where("value IS NOT NULL AND abs(value) < double('Infinity')")
    sizes = settled(own.groupBy(*by).agg((F.count("*") - 1).alias("__last")))
    at = {name: F.col("__last") * F.lit(float(q)) for name, q in wanted.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in at.values()])))
    found = order_statistics(own, by, sizes.select(*by, F.explode(ranks).alias("rank")))
    packed = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("__values"))  # a few ranks
    both = _same(sizes, packed, by)
    value_at = lambda r: F.element_at("__values", r)
    line = lambda p: value_at(F.floor(p)) + (value_at(F.ceil(p)) - value_at(F.floor(p))) * (p - F.floor(p))
    return both.select(*by, *[line(p).alias(name) for name, p in at.items()])
