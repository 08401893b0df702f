"""Range, nearest and set joins between frames, segments, readings, listings and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from .quantiles import beside


def segment_for_frame(frames: DataFrame, segments: DataFrame, id_col: str = "id", width: float = 60.0) -> DataFrame:
    """(id, segment_index): the segment of the frame's file that holds its time, both ends included; in a gap the one
    whose middle is nearest. Of several the one with the least index. Null for files without segments and for images.

    Time falls into buckets of width seconds, and file and bucket are the join keys, so no file's segments meet in one
    row or task. A bucket's rows are the segments that it meets, the middles that lie in it, and one that carries the last
    middle of earlier buckets and the first one of later ones along the file. So frames are shuffled once, meet these rows
    in one join, and are summed up where the join has put them.
    """
    bucket = lambda c: F.floor(c / width).cast("long")
    asked = frames.select(id_col, "file_path", "ts", bucket(F.col("ts")).alias("__b"))
    timed = asked.where("ts IS NOT NULL")
    middle = (F.col("start_sec") + F.col("end_sec")) / 2
    one = segments.select("file_path", F.col("segment_index").alias("i"), "start_sec", "end_sec", middle.alias("mid"), bucket(middle).alias("__b"))
    covered = F.when(F.col("end_sec") >= F.col("start_sec"), F.sequence(bucket(F.col("start_sec")), bucket(F.col("end_sec"))))
    met = F.explode(F.array_distinct(F.concat(F.coalesce(covered, F.array().cast("array<bigint>")), F.array("__b"))))
    none = F.lit(None).cast("double")
    near = one.select("file_path", met.alias("__b"), "i", "start_sec", "end_sec", "mid")

    ends = one.groupBy("file_path", "__b").agg(F.min(F.struct("mid", "i")).alias("low"), F.max(F.struct(F.col("mid").alias("mid"), (-F.col("i")).alias("i"))).alias("high"))
    grid = timed.select("file_path", "__b").distinct().join(ends, ["file_path", "__b"], "full")
    along = Window.partitionBy("file_path").orderBy("__b")
    before = F.last("high", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("before")
    after = F.first("low", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("after")
    carried = grid.select("file_path", "__b", before, after).select(
        "file_path", "__b", F.explode(F.array(F.struct((-F.col("before.i")).alias("i"), F.col("before.mid").alias("mid")), F.struct(F.col("after.i").alias("i"), F.col("after.mid").alias("mid")))).alias("x")
    )
    far = carried.where("x.mid IS NOT NULL").select("file_path", "__b", "x.i", none.alias("start_sec"), none.alias("end_sec"), "x.mid")

    pairs = timed.join(near.unionByName(far), ["file_path", "__b"], "left")
    inside = F.min(F.when((F.col("start_sec") <= F.col("ts")) & (F.col("ts") <= F.col("end_sec")), F.col("i")))
    nearest = F.min(F.when(F.col("mid").isNotNull(), F.struct(F.abs(F.col("ts") - F.col("mid")).alias("d"), "i")))
    found = pairs.groupBy("file_path", "__b", id_col).agg(F.coalesce(inside, nearest["i"]).alias("segment_index")).select(id_col, "segment_index")
    kind = found.schema["segment_index"].dataType
    return found.unionByName(asked.where("ts IS NULL").select(id_col, F.lit(None).cast(kind).alias("segment_index")))


def _window_edges(points: DataFrame, readings: DataFrame, seconds: int, by: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of buckets as wide as the window: (id, by, n, sums, first rank) of each point, (by, rank, activity) of each reading in
    the order of time, and (by, ordered): whether seq rises with time in a source.

    A point's window is the end of the bucket before its own, its own bucket, and the beginning of the next one. Running
    counts, sums and maxima of a bucket, from both sides, tell each of the three parts where a row that asks stands among the
    readings, so the work is linear in points plus readings, and a source is split by time.
    """
    bucket = lambda c: F.floor(c / F.lit(seconds)).cast("long")
    none = {"seq": "long", "rate": "double", "activity": "string", "stress": "double"}
    kinds = {f.name: f.dataType for f in readings.schema.fields}
    held = readings.where(F.col("t").isNotNull() & F.col(by).isNotNull()).select(by, bucket(F.col("t")).alias("bucket"), "t", *none, F.lit(0).alias("part"), F.lit(None).cast(points.schema["id"].dataType).alias("id"))
    part = lambda p, d, edge: F.struct((bucket(F.col("t")) + d).alias("bucket"), edge.alias("t"), F.lit(p).alias("part"))
    three = F.array(part(1, -1, F.col("t") - seconds), part(2, 0, F.col("t")), part(3, 1, F.col("t") + seconds))
    asks = points.where(F.col("t").isNotNull() & F.col(by).isNotNull()).select("id", by, F.explode(three).alias("a"))
    asks = asks.select(by, "a.bucket", "a.t", *[F.lit(None).cast(kinds[c]).alias(c) for c in none], "a.part", "id")
    rows = held.unionByName(asks)

    reading = F.col("part") == 0
    facts = rows.groupBy(by, "bucket").agg(F.count_if(reading).alias("size"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    along = Window.partitionBy(by).orderBy("bucket")  # one row for each bucket
    behind = along.rowsBetween(Window.unboundedPreceding, -1)
    facts = facts.select(by, "bucket", "size", F.coalesce(F.sum("size").over(behind), F.lit(0)).alias("base"), (F.col("low") <= F.max("high").over(behind)).alias("back"))
    inside = Window.partitionBy(by, "bucket")
    placed = rows.join(facts.drop("back"), [by, "bucket"])
    forth, back = inside.orderBy("t", "part", "seq"), inside.orderBy(F.desc("t"), "part", "seq")
    upto = {"n": F.count(F.when(reading, 1)), "n_rate": F.count("rate"), "rate": F.sum("rate"), "top": F.max("rate"), "n_stress": F.count("stress"), "stress": F.sum("stress")}
    frame = lambda over, whole: over if whole else over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = {c: F.when(F.col("part") == 1, x.over(frame(back, False))).when(F.col("part") == 2, x.over(frame(inside, True))).otherwise(x.over(frame(forth, False))) for c, x in upto.items()}
    counted = placed.select(by, "bucket", "id", "part", "seq", "activity", "base", "size", *[x.alias(f"w_{c}") for c, x in sides.items()], F.count(F.when(reading, 1)).over(frame(forth, False)).alias("rank"))
    per_point = counted.where("part > 0").groupBy("id", by).agg(
        F.sum("w_n").alias("n"), F.sum("w_n_rate").alias("n_rate"), F.sum("w_rate").alias("rate"), F.max("w_top").alias("top"), F.sum("w_n_stress").alias("n_stress"), F.sum("w_stress").alias("stress"),
        F.max(F.when(F.col("part") == 1, F.col("base") + F.col("size") - F.col("w_n"))).alias("first"),
    )
    ranks = counted.where(reading).select(by, (F.col("base") + F.col("rank")).alias("rank"), "activity")
    falls = held.withColumn("fell", F.coalesce(F.col("seq") < F.lag("seq").over(inside.orderBy("t", "seq")), F.lit(False))).groupBy(by).agg(F.max("fell").alias("fell"))
    order = falls.join(facts.groupBy(by).agg(F.max(F.coalesce("back", F.lit(False))).alias("back")), by).select(by, (~(F.col("fell") | F.col("back"))).alias("ordered"))
    return per_point, ranks, order


def window_readings(points: DataFrame, readings: DataFrame, seconds: int = 30, by: str = "source", digits: tuple[int, int] = (1, 3)) -> DataFrame:
    """For each point (id, source, t) the readings (source, t, seq, rate, activity, stress) of its source at most that
    many seconds away, both ends included: their number, average and maximum rate, the middle one's activity in the
    order of seq, and average stress; nulls where there are none. Times are in seconds.

    Where seq rises with time, as in files that a device wrote, the middle reading is looked up by its rank, and the rest
    comes from running sums; no point meets its readings. A source whose seq does not rise has its points meet the readings
    of three buckets, as the middle of any subset has no rank to look up.
    """
    per_point, ranks, order = _window_edges(points, readings, seconds, by)
    order = settled(order)
    rising = order.where("ordered").select(by)
    middle = (F.col("first") + F.floor(F.col("n") / 2) + 1).alias("rank")
    # The rank is a key of its own beside the source, so a large source is spread over it.
    found = per_point.where("n > 0").withColumn("rank", middle).join(ranks, [by, "rank"])
    found = beside(found, rising, [by]).select(
        "id", "n", F.round(F.col("rate") / F.col("n_rate"), digits[0]).alias("avg_rate"), F.round("top", digits[0]).alias("max_rate"), "activity", F.round(F.col("stress") / F.col("n_stress"), digits[1]).alias("avg_stress")
    )
    other = order.where("NOT ordered").select(by)
    if other.count():
        found = found.unionByName(_met_readings(beside(points, other, [by]), beside(readings, other, [by]), seconds, by, digits))
    return points.select("id").join(found, "id", "left")


def _met_readings(points: DataFrame, readings: DataFrame, seconds: int, by: str, digits: tuple[int, int]) -> DataFrame:
    """Points joined with the readings of three buckets."""
    bucket = lambda c: F.floor(c / F.lit(seconds)).cast("long")
    asked = points.select("id", by, F.col("t").alias("pt"), F.explode(F.array(*[bucket(F.col("t")) + d for d in (-1, 0, 1)])).alias("bucket"))
    near = asked.join(readings.withColumn("bucket", bucket(F.col("t"))), [by, "bucket"]).where(F.abs(F.col("t") - F.col("pt")) <= seconds)
    rows = F.array_sort(F.collect_list(F.struct("seq", "activity")))
    return near.groupBy("id").agg(
        F.count("*").alias("n"), F.round(F.avg("rate"), digits[0]).alias("avg_rate"), F.round(F.max("rate"), digits[0]).alias("max_rate"),
        F.element_at(rows, (F.floor(F.count("*") / 2) + 1).cast("int"))["activity"].alias("activity"), F.round(F.avg("stress"), digits[1]).alias("avg_stress"),
    )


#: Phases with their first and last day. The last day counts up to its midnight.
PHASES = (
    ("Phase 1: Site Mobilization", "2025-09-01", "2025-10-08"), ("Phase 2: Foundation", "2025-10-09", "2025-11-06"), ("Phase 3a: Rough Framing", "2025-11-07", "2026-02-02"),
    ("Phase 3b: MEP & Framing", "2026-02-03", "2026-02-19"), ("Phase 4: Exterior Finish", "2026-02-20", "2026-03-02"), ("Phase 5: Final Completion", "2026-03-03", "2026-12-31"),
)


def label_by_window(rows: DataFrame, windows: tuple[tuple[str, str, str], ...], ts: Column) -> DataFrame:
    """A row for every window (name, first, last; both ends included) that holds the row's time; none, none."""
    named = F.array(*[F.when((ts >= F.lit(a).cast("timestamp")) & (ts <= F.lit(b).cast("timestamp")), F.lit(n)) for n, a, b in windows])
    return rows.withColumn("phase", F.explode(F.filter(named, lambda x: x.isNotNull())))


def orphans(rows: DataFrame, listing: DataFrame, key: str = "file_path") -> DataFrame:
    """Rows whose key the listing lacks."""
    return rows.join(listing.select(key).distinct(), key, "left_anti")


def unindexed(listing: DataFrame, files: DataFrame, key: str = "file_path") -> DataFrame:
    """kept, deleted and freed bytes: objects stay whose file is done and indexed."""
    done = files.where("status = 'done' AND point_id IS NOT NULL").select(key).distinct().withColumn("__done", F.lit(True))
    marked = listing.join(done, key, "left")
    gone = F.col("__done").isNull()
    return marked.agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("deleted"), F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0)).alias("freed"))


def enrich(frames: DataFrame, results: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """frames with columns from results where they have the key; other rows keep theirs. One result for each key."""
    new = results.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    old = [F.col(c) if c in frames.columns else F.lit(None) for c in columns]
    joined = frames.join(new, key, "left")
    return joined.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(o) for c, o in zip(columns, old, strict=True)}).drop("__hit", *[f"__{c}" for c in columns])


def nearest_label(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label_index, similarity): the most similar of a fixed, small vocabulary (label_index, label_vector), the
    first of equals. See search.nearest."""
    from .search import nearest

    near = nearest(vectors, labels.select(F.col("label_index").cast("long").alias("target_id"), F.col("label_vector").alias("target_vector")))
    return near.select("id", F.col("target_id").alias("label_index"), F.col("score").alias("similarity"))


def topic_tags(vectors: DataFrame, labels: DataFrame, k: int = 10, sample: int = 400) -> DataFrame:
    """(place, label_index, n): the k labels that are nearest to most of a sample of rows, the first in the order of a
    digest of their ids; of equal counts the label that the sample meets first. Without rows the vocabulary's first k."""
    order = [F.md5(F.col("id").cast("string")), F.col("id")]
    picked = vectors.where("vector IS NOT NULL").orderBy(*order).limit(sample).select("id", "vector")
    near = nearest_label(picked, labels).withColumn("met", F.struct(F.md5(F.col("id").cast("string")), F.col("id")))
    counts = near.groupBy("label_index").agg(F.count("*").alias("n"), F.min("met").alias("met"))
    placed = counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "met"))).where(F.col("place") <= k)  # at most as many rows as labels
    head = labels.select(F.col("label_index").cast("long").alias("label_index")).withColumn("place", F.row_number().over(Window.orderBy("label_index"))).where(F.col("place") <= k)
    none = counts.agg((F.count("*") == 0).alias("none"))
    instead = head.crossJoin(F.broadcast(none)).where("none").select("place", "label_index", F.lit(0).cast("long").alias("n"))  # one row beside the head
    return placed.select("place", "label_index", "n").unionByName(instead)


def missing_artefacts(listing: DataFrame, artefacts: DataFrame, suffix: str = ".moov") -> DataFrame:
    """Videos with whether the side file path + suffix exists: action is skipped or dispatched."""
    videos = listing.where(F.lower("file_path").rlike(r"\.(mp4|mov|m4v)$")).select("file_path").distinct()
    have = artefacts.select(F.col("file_path").alias("__side")).distinct()
    joined = videos.join(have, F.concat("file_path", F.lit(suffix)) == F.col("__side"), "left")
    return joined.select("file_path", F.when(F.col("__side").isNull(), "dispatched").otherwise("skipped").alias("action"))


def recorded_hashes(found: DataFrame, known: DataFrame, key: str = "file_hash") -> DataFrame:
    """found with whether its content is on record, and the least path of it."""
    first = known.groupBy(key).agg(F.min("file_path").alias("recorded_path"))
    return found.join(first, key, "left").withColumn("is_recorded", F.col("recorded_path").isNotNull())


def paraphrase_jaccard(a: DataFrame, b: DataFrame, key: str = "query_id") -> DataFrame:
    """Jaccard of two result sets (array column ids) per key; two empty ones are equal."""
    both = a.select(key, F.col("ids").alias("x")).join(b.select(key, F.col("ids").alias("y")), key)
    union = F.size(F.array_union("x", "y"))
    return both.select(key, F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("x", "y")) / union).alias("jaccard"))


def recent(rows: DataFrame, by: str, value: str, order: str, n: int) -> DataFrame:
    """The n latest distinct values of each group, moved to the front as they recur."""
    last = rows.groupBy(by, value).agg(F.max(order).alias(order))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), value))
    return last.withColumn("place", place).where(F.col("place") <= n)
