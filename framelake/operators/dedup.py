"""De-duplication of hits, files and ingest batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parent_dir
from ..sources.shared import settled


def _fold(keep) -> Column:
    """Ids that an order-dependent walk over the sorted array __hits keeps; keep(kept, next) says whether it stays."""
    none = F.filter("__hits", lambda x: F.lit(False))
    return F.aggregate("__hits", none, lambda acc, x: F.when(keep(acc, x), F.concat(acc, F.array(x))).otherwise(acc))


def _walk(hits: DataFrame, by: list[str], order: Column, keep) -> DataFrame:
    """hits whose (by) group's walk keeps them. A group is one query's candidates in one file, which top-k bounds."""
    rows = hits.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("id").alias("id"), F.col("ts").alias("ts")))).alias("__hits"))
    kept = rows.select(*by, F.explode(_fold(keep)).alias("k")).select(*by, F.col("k.id").alias("id"))
    return hits.join(kept, [*by, "id"], "left_semi")


def temporal_nms(hits: DataFrame, window: float = 5.0, by: tuple[str, ...] = ("query_id", "file_path")) -> DataFrame:
    """Best first, without frames closer than the window to any better one that stayed; rows without a time all stay."""
    timed = _walk(hits.where("ts IS NOT NULL"), list(by), -F.col("score"), lambda acc, x: ~F.exists(acc, lambda y: F.abs(x["ts"] - y["ts"]) < window))
    return timed.unionByName(hits.where("ts IS NULL"))


def segment_dedup(hits: DataFrame, window: float = 5.0) -> DataFrame:
    """The best frame of each audio segment; frames without a segment go through temporal_nms."""
    best = F.row_number().over(Window.partitionBy("query_id", "file_path", "audio_segment_index").orderBy(F.desc("score"), "id"))
    inside = hits.where("audio_segment_index IS NOT NULL").withColumn("__n", best).where("__n = 1").drop("__n")
    return inside.unionByName(temporal_nms(hits.where("audio_segment_index IS NULL"), window))


def flood_cap(hits: DataFrame, per_dir: int = 2, flood: int = 4) -> DataFrame:
    """Of flood or more images in one folder the best per_dir stay; videos and smaller folders are left alone."""
    if per_dir <= 0:
        return hits
    image = F.col("ts").isNull()
    by = Window.partitionBy("query_id", "__dir", "__image")
    marked = hits.withColumn("__dir", parent_dir(F.col("file_path"))).withColumn("__image", image)
    marked = marked.withColumn("__n", F.count("*").over(by)).withColumn("__r", F.row_number().over(by.orderBy(F.desc("score"), "id")))
    return marked.where(~F.col("__image") | (F.col("__n") < flood) | (F.col("__r") <= per_dir)).drop("__dir", "__image", "__n", "__r")


def last_kept_dedup(hits: DataFrame, window: float = 5.0) -> DataFrame:
    """In the order of retrieval, a frame stays if it is more than the window from the last one that stayed in its file."""
    far = lambda acc, x: F.coalesce(F.abs(x["ts"] - F.try_element_at(acc, F.lit(-1))["ts"]) > window, F.lit(True))
    timed = _walk(hits.where("ts IS NOT NULL"), ["query_id", "file_path"], F.col("rank"), far)
    return timed.unionByName(hits.where("ts IS NULL"))


def content_hash(content: Column, is_video: Column, head: int = 8192) -> Column:
    """SHA-256 of all bytes of an image, of the first head bytes of a video."""
    return F.when(is_video, F.sha2(F.substring(content, 1, head), 256)).otherwise(F.sha2(content, 256))


def exact_dedup(df: DataFrame, digest: str = "file_hash", order: str = "id") -> DataFrame:
    """(digest, first, copies): one row for each content."""
    return df.groupBy(digest).agg(F.min(order).alias("first"), F.count("*").alias("copies"))


def ingest_decisions(found: DataFrame, known: DataFrame, listing: DataFrame, force_relocate: bool = False, object_store: bool = False) -> DataFrame:
    """What to do with each discovered file (file_path, file_hash, unreadable reason or null).

    In this order: an unreadable file gives its reason; a path that is done is skipped; one that is pending or
    processing is sent again; content known under another path is a copy while that path still exists, else the record
    moves; content known under this path is skipped; the rest is new. Of several new files with one content in a batch
    the first path is inserted and the others are copies. known may hold a path or content more than once: the
    furthest status of a path and the least path of a content count.
    """
    rank = F.when(F.col("status") == "done", 0).when(F.col("status").isin("pending", "processing"), 1).otherwise(2)
    paths = known.groupBy("file_path").agg(F.min(rank).alias("path_rank"))
    contents = known.groupBy("file_hash").agg(F.min("file_path").alias("old_path"))
    own = known.select("file_hash", "file_path").distinct().withColumn("__same", F.lit(True))
    there = listing.select(F.col("file_path").alias("old_path"), F.lit(True).alias("old_exists")).distinct()
    joined = found.join(paths, "file_path", "left").join(own, ["file_hash", "file_path"], "left").join(contents, "file_hash", "left").join(there, "old_path", "left")
    same = F.coalesce(F.col("__same"), F.lit(False))
    stays = F.coalesce(F.col("old_exists"), F.lit(False)) & F.lit(not force_relocate and not object_store)
    plain = (
        F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("path_rank") == 0, "already_ingested").when(F.col("path_rank") == 1, "redispatched")
        .when(F.col("old_path").isNotNull() & ~same & stays, "duplicate_copy").when(F.col("old_path").isNotNull() & ~same, "relocated").when(same, "duplicate_hash").otherwise("inserted")
    )
    decided = settled(joined.select("file_path", "file_hash", "old_path", plain.alias("action")))
    # The least path of each new content, and one row of it: no window holds all copies of a content.
    heads = decided.where("action = 'inserted'").groupBy(F.col("file_hash").alias("__hash")).agg(F.min(F.struct("file_path")).alias("__head"))
    placed = decided.join(heads, F.col("file_hash").eqNullSafe(F.col("__hash")), "left")
    nth = F.row_number().over(Window.partitionBy("file_hash", "file_path", "action").orderBy("file_path"))
    first = F.col("file_path").eqNullSafe(F.col("__head.file_path")) & (nth == 1)
    again = F.when((F.col("action") == "inserted") & ~first, "duplicate_copy").otherwise(F.col("action"))
    return placed.withColumn("action", again).select("file_path", "file_hash", F.when(F.col("action") == "relocated", F.col("old_path")).alias("old_path"), "action")


def relocate(frames: DataFrame, moves: DataFrame) -> DataFrame:
    """Frames under their files' new paths; moves: (old_path, new_path), one row for each old path."""
    return frames.join(moves.withColumnRenamed("old_path", "file_path"), "file_path", "left").withColumn("file_path", F.coalesce("new_path", "file_path")).drop("new_path")


#: Forms of names that hold an id, in their order.
NAME_FORMS = (r"^pexels-[a-z]+-([0-9]+)\.mp4$", r"^pexels-([0-9]+)\.mp4$", r"_([0-9]+)\.mp4$")


def external_id(name: Column) -> Column:
    """The id in a name, by three forms in their order; null if there is none."""
    found = [F.regexp_extract(name, p, 1) for p in NAME_FORMS]
    return F.coalesce(*[F.when(x != "", x) for x in found])


def keep_newest(listing: DataFrame, id_col: str = "external_id") -> DataFrame:
    """Adds keep: the newest of each id; rows without an id are kept."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("last_modified"), "key"))
    known = listing.where(F.col(id_col).isNotNull()).withColumn("keep", n == 1)
    return known.unionByName(listing.where(F.col(id_col).isNull()).withColumn("keep", F.lit(True)))


def merge_sources(visual: DataFrame, audio: DataFrame, limit: int) -> DataFrame:
    """Visual rows, then audio rows that match none of them by file and time (null equals null), cut to limit in all."""
    v, a = visual.withColumn("source", F.lit("visual")), audio.withColumn("source", F.lit("audio"))
    seen = visual.select(F.col("query_id").alias("q"), F.col("file_path").alias("p"), F.col("ts").alias("t")).distinct()
    own = a.join(seen, (F.col("query_id") == F.col("q")) & F.col("file_path").eqNullSafe(F.col("p")) & F.col("ts").eqNullSafe(F.col("t")), "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("source"), "rank", "id"))
    both = v.unionByName(own).withColumn("place", place)
    return both.where((F.col("source") == "visual") | (F.col("place") <= limit))
