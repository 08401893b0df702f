"""Windows, sessions, budgets and hold-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from .quantiles import beside


def gap_sessions(df: DataFrame, ts: str, minutes: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by, start, end, n, minutes): a session ends where the next time is more than the gap away; an exact gap joins.

    Sessions are first taken inside each day (session_window, summed up in part before its shuffle). Only a day's first
    and last one can go on in another day, so two rows for each day with rows, and key, are put in order to be chained;
    no task sorts all times, whether there is a key or not.
    """
    own = by or []
    micros = 60_000_000 * minutes
    day = F.floor(F.unix_micros(ts) / F.lit(max(86_400_000_000, micros))).cast("long")
    rows = df.where(F.col(ts).isNotNull()).groupBy(*own, day.alias("__day"), F.session_window(ts, f"{minutes} minutes").alias("w"))
    inside = rows.agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")).drop("w")
    one = F.struct("start", "end", "n")
    ends = inside.groupBy(*own, "__day").agg(F.min(one).alias("first"), F.max(one).alias("last"))
    edges = ends.select(*own, F.explode(F.array_distinct(F.array("first", "last"))).alias("s")).select(*own, "s.*")
    along = Window.partitionBy(*own).orderBy("start")
    new = F.coalesce(F.unix_micros("start") - F.unix_micros(F.lag("end").over(along)) > micros, F.lit(True))
    chains = edges.withColumn("__chain", F.sum(new.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    chained = chains.groupBy(*own, "__chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    named = ends.select(F.col("first.start").alias("__first"), F.col("last.start").alias("__last"), *[F.col(c).alias(f"__{i}") for i, c in enumerate([*own, "__day"])])
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate([*own, "__day"])]
    within = inside.join(named, same).where((F.col("start") != F.col("__first")) & (F.col("start") != F.col("__last"))).select(*own, "start", "end", "n")
    out = chained.select(*own, "start", "end", "n").unionByName(within)
    return out.select(*own, "start", "end", "n", F.round((F.unix_micros("end") - F.unix_micros("start")) / 6e7, 1).alias("minutes"))


def last_sessions(sessions: DataFrame, n: int = 10) -> DataFrame:
    return sessions.orderBy(F.desc("start")).limit(n)


def merge_intervals(intervals: DataFrame, files: DataFrame, gap: float = 2.0, least: float = 1.0) -> DataFrame:
    """(file_path, start_sec, end_sec, kind): intervals of a file joined while the next starts at most the gap after the
    one before it ends; a merged one ends where its last interval does, and goes if it is shorter than least. A file
    that has nothing left counts whole; one without intervals is silence. files: (file_path, duration)."""
    by = Window.partitionBy("file_path").orderBy("start_sec", "end_sec")
    new = F.coalesce(F.col("start_sec") - F.lag("end_sec").over(by) > gap, F.lit(True))
    runs = intervals.withColumn("run", F.sum(new.cast("int")).over(by))
    merged = runs.groupBy("file_path", "run").agg(F.min("start_sec").alias("start_sec"), F.max_by("end_sec", F.struct("start_sec", "end_sec")).alias("end_sec")).where(F.col("end_sec") - F.col("start_sec") >= least)
    some = intervals.select("file_path").distinct().withColumn("__some", F.lit(True))
    joined = files.join(some, "file_path", "left").join(merged, "file_path", "left")
    kind = F.when(F.col("__some").isNull(), "silence").when(F.col("run").isNull(), "whole").otherwise("segment")
    return joined.select("file_path", F.coalesce("start_sec", F.lit(0.0)).alias("start_sec"), F.coalesce("end_sec", "duration").alias("end_sec"), kind.alias("kind"))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def trim_to_budget(objects: DataFrame, budget: float, bucket: str = "month") -> DataFrame:
    """(key, size, delete): newest first until the rest fits the budget; the object that crosses the line goes too.

    Sums run in two steps, over days and inside a day, so no task sorts everything. objects: (key, size, last_modified).
    """
    rows = objects.withColumn("__day", F.to_date("last_modified"))
    days = rows.groupBy("__day").agg(F.sum("size").alias("__s"))
    newest = Window.orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each day
    days = days.select("__day", F.coalesce(F.sum("__s").over(newest), F.lit(0)).alias("__before"))
    total = rows.agg(F.sum("size").alias("__total"))
    inner = Window.partitionBy("__day").orderBy(F.desc("last_modified"), "key").rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.join(days, "__day").crossJoin(F.broadcast(total)).withColumn("__sofar", F.col("__before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return marked.select("key", "size", (F.col("__total") - F.col("__sofar") > budget).alias("delete"))


def greedy_fill(items: DataFrame, by: str, cap: float, n: int) -> DataFrame:
    """(by, key): items of each group in order that fit under the cap; one that would exceed it is passed over and later
    ones are tried, until n are taken. A group is one download list. items: (by, pos, key, size)."""
    rows = items.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "key", F.col("size").cast("double").alias("size")))).alias("a"))
    none = F.struct(F.lit(0.0).alias("used"), F.filter("a", lambda x: F.lit(False)).alias("kept"))
    fits = lambda acc, x: (acc["used"] + x["size"] <= cap) & (F.size(acc["kept"]) < n)
    walk = F.aggregate("a", none, lambda acc, x: F.when(fits(acc, x), F.struct((acc["used"] + x["size"]).alias("used"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc))
    return rows.select(by, F.explode(walk["kept"]).alias("k")).select(by, "k.key", "k.size")


def best_rendition(files: DataFrame, qualities: tuple[str, ...] = ("hd", "sd", "hls"), max_size: float = 200e6, min_width: int = 640) -> DataFrame:
    """The widest usable file of the best quality of each item. files: (item, quality, file_type, width, size, key)."""
    rank = F.coalesce(*[F.when(F.col("quality") == q, i) for i, q in enumerate(qualities)])
    fit = files.withColumn("__q", rank).where(F.col("__q").isNotNull() & F.col("file_type").startswith("video/") & (F.coalesce("width", F.lit(0)) >= min_width) & (F.coalesce("size", F.lit(0)) <= max_size))
    return fit.withColumn("__n", F.row_number().over(Window.partitionBy("item").orderBy("__q", F.desc("width"), "key"))).where("__n = 1").drop("__n", "__q")


def _first_share(rows: DataFrame, label: str, bucket: Column, order: list[Column], share: float, whole: bool) -> DataFrame:
    """Adds part: the first floor(share * n) rows of each class in the order, which goes by bucket first, are train, the
    rest test; with whole, a class that would be cut to nothing on either side is train altogether. Counts by class and
    bucket find the bucket with the cut, and only the rows of that one are numbered."""
    placed = rows.withColumn("__bucket", bucket)
    counts = settled(placed.groupBy(F.col(label).alias("__class"), "__bucket").agg(F.count("*").alias("__n")))
    along = Window.partitionBy("__class").orderBy(F.asc_nulls_first("__bucket"))  # one row for each bucket
    upto = counts.withColumn("__upto", F.sum("__n").over(along)).withColumn("__all", F.sum("__n").over(Window.partitionBy("__class")))
    cut = F.floor(F.col("__all") * F.lit(share))
    train = F.when((cut == 0) | (cut == F.col("__all")), F.col("__all")).otherwise(cut) if whole else cut
    # The bucket in which the last row of train stands, and how many of its rows are train.
    marked = upto.withColumn("__train", train)
    last = marked.where("__train > 0 and __upto >= __train and __upto - __n < __train")
    facts = marked.select("__class").distinct().join(
        last.select(F.col("__class").alias("__of"), F.struct("__bucket").alias("__last"), (F.col("__train") - F.col("__upto") + F.col("__n")).alias("__take")), F.col("__class").eqNullSafe(F.col("__of")), "left"
    ).drop("__of").withColumnRenamed("__class", label)
    with_facts = beside(placed, settled(facts), [label])
    bucket_, edge = F.col("__bucket"), F.col("__last.__bucket")
    inside = F.col("__last").isNotNull() & bucket_.eqNullSafe(edge)
    before = F.coalesce(F.when(F.col("__last").isNull(), F.lit(False)).when(edge.isNull(), F.lit(False)).when(bucket_.isNull(), F.lit(True)).otherwise(bucket_ < edge), F.lit(False))
    cut_rows = with_facts.where(inside).withColumn("__i", F.row_number().over(Window.partitionBy(label).orderBy(*order)))
    part = lambda hit: F.when(hit, "train").otherwise("test")
    columns = rows.columns
    return cut_rows.select(*columns, part(F.col("__i") <= F.col("__take")).alias("part")).unionByName(with_facts.where(~inside).select(*columns, part(before).alias("part")))


def temporal_holdout(rows: DataFrame, label: str, ts: str, key: str, share: float = 0.8) -> DataFrame:
    """Adds part: the earliest share of each class is train, the rest test; a class that would be cut to nothing on
    either side is train as a whole. Hours of ts are the buckets in which classes are cut."""
    return _first_share(rows, label, F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 3600), [F.col(ts), F.col(key)], share, True)


def boundary_holdout(rows: DataFrame, ends: list[str], ts: str, days: int = 14) -> DataFrame:
    """Adds part: test within the days of a boundary, both ends included."""
    near = F.lit(False)
    for e in ends:
        at = F.lit(e).cast("timestamp")
        near = near | ((F.col(ts) >= at - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) <= at + F.expr(f"INTERVAL {days} DAYS")))
    return rows.withColumn("part", F.when(near, "test").otherwise("train"))


def source_holdout(rows: DataFrame, path: str, test: str) -> DataFrame:
    return rows.withColumn("part", F.when(F.col(path).contains(test), "test").otherwise("train"))


def with_fallback(split: DataFrame, fallback: DataFrame, label: str, least: int = 10, least_train: int = 0) -> tuple[DataFrame, bool]:
    """The split, or the fallback when either side has fewer rows than its least or a tested class is missing from
    training; and whether it fell back."""
    counts = split.groupBy(label).agg(F.count_if(F.col("part") == "test").alias("t"), F.count_if(F.col("part") == "train").alias("n"))
    test, train, missing = counts.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count_if((F.col("n") == 0) & (F.col("t") > 0))).first()
    bad = test < least or train < least_train or missing > 0
    return (fallback if bad else split), bad


def stratified_holdout(rows: DataFrame, label: str, key: str, share: float = 0.8) -> DataFrame:
    """Adds part by a hash order inside each class; repeatable. The hash's first four digits are the buckets."""
    digest = F.md5(F.col(key).cast("string"))
    return _first_share(rows, label, F.substring(digest, 1, 4), [digest, F.col(key)], share, False)


def drop_small_classes(rows: DataFrame, label: str, least: int = 5) -> DataFrame:
    keep = rows.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(label)
    return rows.join(keep, label, "left_semi")


def section_caps(rows: DataFrame, caps: dict[str, int | None]) -> DataFrame:
    """At most so many rows of each source for each query, in the order of rank; None stands for all."""
    n = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank", "id"))
    limit = F.coalesce(*[F.when(F.col("source") == s, F.lit(c if c is not None else (1 << 31) - 1)) for s, c in caps.items()], F.lit(0))
    return rows.withColumn("__n", n).where(F.col("__n") <= limit).drop("__n")


def anchor_rates(counts: DataFrame, by: str) -> DataFrame:
    """Adds rate: growth a minute since the anchor, the first count above 0, taken anew whenever the count falls; null
    before a minute has passed. counts: (by, ts, n), n cumulative."""
    order = Window.partitionBy(by).orderBy("ts")
    fell = F.coalesce(F.col("n") < F.lag("n").over(order), F.lit(False))
    runs = counts.withColumn("__run", F.sum(fell.cast("int")).over(order))
    first = F.min_by(F.struct("ts", "n"), "ts")
    base = runs.where("n > 0").groupBy(by, "__run").agg(first.alias("__a"))
    joined = runs.join(base, [by, "__run"], "left")
    minutes = (F.unix_micros("ts") - F.unix_micros("__a.ts")) / 6e7
    return joined.select(by, "ts", "n", F.when(minutes >= 1, F.round((F.col("n") - F.col("__a.n")) / minutes, 6)).alias("rate"))
