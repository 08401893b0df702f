"""Queries on listings, stores and table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import extension
from ..operators import predicates
from ..sources import listing, stores
from ..sources.crawl import MediaCrawl
from ..sources.shared import scratch
from ..sources.tables import audit_logs, frames, media_files, read
from .catalog import query

_MEDIA = "regexp_matches(lower(file_path), '\\.(jpg|jpeg|png|heic|webp|bmp|gif|mp4|mov|mkv|avi|flv|wmv|webm|m4v)$')"
_TYPE = "CASE WHEN regexp_matches(lower(file_path), '\\.(jpg|jpeg|png|heic|webp|bmp|gif)$') THEN 'image' ELSE 'video' END"


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of paths: files, documents by source and language, pages by address."""
    files = media_files(spark, sf_dir).select("file_path")
    texts = read(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("file_path"))
    return files.unionByName(texts).unionByName(read(spark, sf_dir, "pages").select(F.col("url").alias("file_path")))


_LISTING = "listing AS (SELECT file_path FROM media_files UNION ALL SELECT source || '/' || lang || '/' || doc_id || '.txt' FROM documents UNION ALL SELECT url FROM pages)"


@query("a01_listing_scan", f"WITH {_LISTING} SELECT file_path, {_TYPE} AS media_type FROM listing WHERE {_MEDIA}", "media_files")
def a01(spark, sf_dir):
    return listing.keep_media(_listing(spark, sf_dir)).select("file_path", "media_type")


@query("a01_crawl_folders", "SELECT DISTINCT source, lang, true AS found FROM documents")
def a01_crawl(spark, sf_dir):
    """Folders by source and language, written from all documents' ids and found again by the crawl, two levels deep."""
    path = scratch(spark)
    ids = read(spark, sf_dir, "documents").select("source", "lang", F.col("doc_id").cast("string").alias("value"))
    ids.hint("rebalance", "source", "lang").write.partitionBy("source", "lang").text(path)
    spark.dataSource.register(MediaCrawl)
    files = spark.read.format("media_crawl").options(path=path, extensions="txt=text", depth="2").load()
    part = lambda name: F.regexp_extract("file_path", f"/{name}=([^/]+)/", 1).alias(name)
    return files.groupBy(part("source"), part("lang")).agg((F.sum("size") > 0).alias("found"))


@query("a02_name_exclusion", "SELECT id, file_path FROM media_files WHERE NOT (upper(regexp_extract(file_path, '[^/]*$')) LIKE 'DJI%' OR upper(regexp_extract(file_path, '[^/]*$')) LIKE '%.PNG')", "media_files")
def a02(spark, sf_dir):
    return listing.exclude_names(media_files(spark, sf_dir).select("id", "file_path"), "dji*, *.png")


@query("a03_prefix_exclusion", "SELECT id, file_path FROM media_files WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT '/mnt/source/u' || (user_id * 3) AS p FROM events WHERE user_id % 7 = 0) x WHERE starts_with(file_path, p || '/'))", "media_files")
def a03(spark, sf_dir):
    folders = read(spark, sf_dir, "events").where("user_id % 7 = 0").select(F.concat(F.lit("/mnt/source/u"), (F.col("user_id") * 3).cast("string"), F.lit("/")).alias("prefix"))
    return listing.exclude_prefixes(media_files(spark, sf_dir).select("id", "file_path"), folders)


@query("a04_object_listing", "SELECT 'bucket/' || file_path AS object_key, created_at AS last_modified FROM media_files WHERE id % 4 <> 0", "media_files")
def a04(spark, sf_dir):
    folder = F.when(F.col("id") % 4 == 0, F.lit("bucket/dir/")).otherwise(F.concat(F.lit("bucket/"), "file_path"))
    keys = media_files(spark, sf_dir).select(folder.alias("file_path"), "created_at")
    return listing.keep_media(keys).select(F.col("file_path").alias("object_key"), F.col("created_at").alias("last_modified"))


@query("a05_count_by_type", f"WITH {_LISTING} SELECT count(*) FILTER (t = 'image') AS image, count(*) FILTER (t = 'video') AS video, count(*) AS total FROM (SELECT {_TYPE} AS t FROM listing WHERE {_MEDIA})", "media_files")
def a05(spark, sf_dir):
    return listing.count_by_type(listing.keep_media(_listing(spark, sf_dir)))


@query("a06_table_scan", "SELECT id, endpoint, response_ms FROM audit_logs WHERE response_status >= 400", "audit_logs")
def a06(spark, sf_dir):
    return audit_logs(spark, sf_dir).where("response_status >= 400").select("id", "endpoint", "response_ms")


@query("a07_payload_scroll", "SELECT id, file_path, caption FROM frames WHERE file_type = 'video' AND caption IS NOT NULL", "frames")
def a07(spark, sf_dir):
    return frames(spark, sf_dir).where("file_type = 'video' AND caption IS NOT NULL").select("id", "file_path", "caption")


@query("a07_scroll_pages", "SELECT id, file_path, caption, 100 AS page_size FROM frames WHERE file_type = 'video' AND caption IS NOT NULL AND id >= 40 ORDER BY id LIMIT 100", "frames")
def a07_pages(spark, sf_dir):
    """Two pages of 50 rows, the second from where the first one ends."""
    f, wanted = frames(spark, sf_dir), F.expr("file_type = 'video' AND caption IS NOT NULL")
    first, then = stores.scroll(f, wanted, ["file_path", "caption"], offset=40, limit=50)
    second, _ = stores.scroll(f, wanted, ["file_path", "caption"], offset=then, limit=50)
    return first.unionByName(second).withColumn("page_size", F.lit(100))


@query("a08_lookup_by_ids", "SELECT id, file_path, label FROM frames WHERE id IN (SELECT doc_id * 3 FROM labels WHERE quality = 1)", "frames")
def a08(spark, sf_dir):
    ids = read(spark, sf_dir, "labels").where("quality = 1").select((F.col("doc_id") * 3).alias("id"))
    return stores.lookup(frames(spark, sf_dir).select("id", "file_path", "label"), ids)


#: Rows that a bucket of a stored table is meant to hold.
BUCKET_ROWS = 1_000_000


def _stored(rows: DataFrame, keys: list[str]) -> stores.Store:
    """A new store on a shared folder with these rows as its first version."""
    buckets = max(4, rows.count() // BUCKET_ROWS)
    store = stores.Store(rows.sparkSession, scratch(rows.sparkSession), keys, buckets)
    store.upsert(rows)
    return store


@query("a12_vector_upsert", "SELECT id, label, round(list_sum(list_transform(vector, lambda x: cast(x AS double))), 6) AS total FROM (SELECT id, label, CASE WHEN id % 5 = 0 THEN list_transform(vector, lambda x: cast(-x AS float)) ELSE vector END AS vector FROM frames)", "frames")
def a12(spark, sf_dir):
    base = frames(spark, sf_dir).select("id", "label", "vector")
    changed = base.where("id % 5 = 0").withColumn("vector", F.transform("vector", lambda x: -x))
    store = _stored(base, ["id"])
    store.upsert(changed)
    return store.read().select("id", "label", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query("a13_row_upsert", "SELECT o_orderkey, CASE WHEN m IS NULL THEN o_orderstatus ELSE 'X' END AS status, coalesce(m, o_totalprice) AS price FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey")
def a13(spark, sf_dir):
    base = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    changes = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("X").alias("status"), F.col("l_extendedprice").alias("price"))
    changes = changes.join(base.select("o_orderkey"), "o_orderkey", "left_semi").groupBy("o_orderkey", "status").agg(F.max("price").alias("price"))
    store = _stored(base, ["o_orderkey"])
    store.upsert(changes)
    return store.read()


@query("a14_delete_by_key", "SELECT id, status FROM media_files WHERE NOT (status = 'error' AND user_id % 3 = 0) AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", "media_files")
def a14(spark, sf_dir):
    keys = read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    store = _stored(media_files(spark, sf_dir).select("id", "status", "user_id"), ["id"])
    store.delete_where(F.expr("status = 'error' AND user_id % 3 = 0"))
    store.delete(keys)
    return store.read().select("id", "status")


@query("a16_partial_update", "SELECT id, CASE WHEN class_id = 3 THEN 'seen' ELSE caption END AS caption, CASE WHEN file_path LIKE '%/d1/%' THEN NULL ELSE construction_phase END AS construction_phase, label FROM frames", "frames")
def a16(spark, sf_dir):
    base = frames(spark, sf_dir).select("id", "caption", "construction_phase", "label", "file_path", "class_id")
    store = _stored(base, ["id"])
    store.set_where(F.col("class_id") == 3, caption="seen")
    store.set_where(F.col("file_path").contains("/d1/"), construction_phase=None)
    return store.read().select("id", "caption", "construction_phase", "label")


@query("b12_relativise_paths", "SELECT id, CASE WHEN starts_with(file_path, '/mnt/source/') THEN substr(file_path, 13) ELSE file_path END AS file_path, starts_with(file_path, '/mnt/source/') AS changed FROM media_files", "media_files")
def b12(spark, sf_dir):
    return predicates.relativise(media_files(spark, sf_dir).select("id", "file_path"))


@query(
    "b13_prefix_map",
    """SELECT id, coalesce((SELECT max_by(target || substr(file_path, length(prefix) + 1), length(prefix)) FROM (
      SELECT '/mnt/source/' AS prefix, 'M:/' AS target UNION ALL SELECT DISTINCT '/mnt/source/u' || user_id || '/', 'U' || (user_id % 9) || ':/' FROM events WHERE user_id % 5 = 0) m WHERE starts_with(file_path, prefix)), file_path) AS mapped FROM media_files""",
    "media_files",
)
def b13(spark, sf_dir):
    own = read(spark, sf_dir, "events").where("user_id % 5 = 0").selectExpr("concat('/mnt/source/u', user_id, '/') AS prefix", "concat('U', user_id % 9, ':/') AS target").distinct()
    prefixes = own.unionByName(own.limit(1).select(F.lit("/mnt/source/").alias("prefix"), F.lit("M:/").alias("target")))
    return predicates.map_longest_prefix(media_files(spark, sf_dir).select("id", "file_path"), prefixes).select("id", "mapped")


@query("b14_extension_type", f"SELECT id, lower(regexp_extract(file_path, '\\.[^.]+$')) AS ext, {_TYPE} AS media_type FROM media_files", "media_files")
def b14(spark, sf_dir):
    listing.check_extensions({"image": listing.IMAGE_EXTENSIONS, "video": listing.VIDEO_EXTENSIONS})
    return media_files(spark, sf_dir).select("id", extension(F.col("file_path")).alias("ext"), listing.file_type(F.col("file_path")).alias("media_type"))


def _side_files(df: DataFrame, kind: str, key: str = "id") -> str:
    """A derived side file written to a new shared folder; JSON as files that hold one array each."""
    path = scratch(df.sparkSession)
    if kind == "csv":
        df.write.option("header", True).csv(path)
    else:
        part = F.pmod(F.xxhash64(key), F.lit(max(16, df.count() // 5_000)))  # some 5,000 records a file
        arrays = df.groupBy(part.alias("part")).agg(F.to_json(F.collect_list(F.struct(*df.columns)), {"pretty": "true"}).alias("value"))
        arrays.write.partitionBy("part").text(path)
    return path


@query("a09_sensor_csv", "SELECT activity_level, count(*) AS n, round(avg(heart_rate_bpm), 6) AS rate, round(avg(stress_index), 6) AS stress, max(timestamp) AS last FROM (SELECT ts AS timestamp, value AS heart_rate_bpm, event_type AS activity_level, value / 500 AS stress_index FROM events) GROUP BY 1")
def a09(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.col("value").alias("heart_rate_bpm"), F.col("event_type").alias("activity_level"), (F.col("value") / 500).alias("stress_index"))
    back = stores.read_sensor_csv(spark, _side_files(rows, "csv"))
    return back.groupBy("activity_level").agg(F.count("*").alias("n"), F.round(F.avg("heart_rate_bpm"), 6).alias("rate"), F.round(F.avg("stress_index"), 6).alias("stress"), F.max("timestamp").alias("last"))


@query("a10_detection_json", "SELECT 'v' || id AS id, cast(id % 4 AS int) AS yolo_object_count, label AS first_label FROM frames", "frames")
def a10(spark, sf_dir):
    rows = frames(spark, sf_dir).select(F.concat(F.lit("v"), F.col("id")).alias("id"), F.array("label").alias("yolo_labels"), (F.col("id") % 4).cast("int").alias("yolo_object_count"), F.lit("m").alias("yolo_model"))
    back = stores.read_detections(spark, _side_files(rows, "json"))
    return back.select("id", "yolo_object_count", F.col("yolo_labels")[0].alias("first_label"))


@query("a11_question_json", "SELECT cast(item_id AS varchar) AS id, text AS question FROM benchmark")
def a11(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.col("text").alias("ground_truth"), F.array().cast("array<string>").alias("relevant_file_ids"))
    return stores.read_questions(spark, _side_files(rows, "json")).select("id", "question")
