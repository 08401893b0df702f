"""Filters and projections over files and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import any_of, extension, months_of, year_of

MOUNT = "/mnt/source/"


def is_empty(df: DataFrame, name: str) -> Column:
    """Null, or an array without elements; for other types null alone."""
    c = F.col(name)
    return c.isNull() | (F.size(c) == 0) if df.schema[name].dataType.typeName() == "array" else c.isNull()


def metadata_filter(df: DataFrame, equal: dict[str, object], limit: int = 20, strict: bool = False, order: str = "id") -> DataFrame:
    """Rows with all the values; names that are no column are passed over, or refused if strict."""
    unknown = [k for k in equal if k not in df.columns]
    if unknown and strict:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    for k, v in equal.items():
        if k in df.columns:
            df = df.where(F.col(k) == v)
    return df.orderBy(order).limit(limit)


def path_contains(path: Column, *texts: str) -> Column:
    return any_of([path.contains(t) for t in texts])


def scene_window(ts: Column, width: float = 5.0) -> tuple[Column, Column]:
    """Start and end of the scene that holds a time; null for images."""
    start = F.when(ts.isNotNull(), F.floor(ts / width) * width)
    return start, start + width


def relative_path(path: Column, mount: str = MOUNT) -> Column:
    return F.when(path.startswith(mount), F.substring(path, len(mount) + 1, 1 << 30)).otherwise(path)


def relativise(df: DataFrame, path_col: str = "file_path") -> DataFrame:
    """Paths below the mount, and whether a row changes (for a dry run, count those)."""
    new = relative_path(F.col(path_col))
    return df.withColumn("changed", new != F.col(path_col)).withColumn(path_col, new)


def map_longest_prefix(paths: DataFrame, prefixes: DataFrame, path_col: str = "file_path") -> DataFrame:
    """Adds mapped: the path with its longest known prefix replaced, or the path itself.

    Prefixes (prefix, target) join on their own length's head of the path, one candidate for each length that occurs,
    so that large tables of prefixes stay an equi-join.
    """
    lengths = prefixes.agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("__lengths"))
    heads = paths.select(path_col).distinct().crossJoin(F.broadcast(lengths)).select(path_col, F.explode("__lengths").alias("__n"))
    heads = heads.where(F.length(path_col) >= F.col("__n")).withColumn("prefix", F.expr(f"substring({path_col}, 1, __n)"))
    best = heads.join(prefixes, "prefix").groupBy(path_col).agg(F.max_by("target", "__n").alias("__target"), F.max("__n").alias("__n"))
    mapped = F.when(F.col("__n").isNotNull(), F.concat("__target", F.expr(f"substring({path_col}, __n + 1)"))).otherwise(F.col(path_col))
    return paths.join(best, path_col, "left").withColumn("mapped", mapped).drop("__target", "__n")


def temporal_search(files: DataFrame, questions: DataFrame, limit: int = 20, months: str = "ignored") -> DataFrame:
    """Finished files of the year that each question names, newest first, at most limit for each.

    months: "ignored" takes a question that names only a month as one about all years; "applied" filters by month too.
    Files are ranked once for every year, every month of any year and so on (0 stands for any), and a question meets the
    newest of those that it asks for by equal keys.
    """
    year, names = year_of(F.col("question")), months_of(F.col("question"))
    asked = questions.select("question_id", year.alias("year"), names.alias("months")).where("year is not null or months is not null")
    every = F.array(F.lit(0))
    named = F.coalesce(F.col("months").cast("array<int>"), every) if months == "applied" else every
    asked = asked.select("question_id", F.coalesce(F.col("year").cast("int"), F.lit(0)).alias("__y"), F.explode(F.array_distinct(named)).alias("__m"))
    done = files.where("status = 'done'").select("id", "file_path", "created_at")
    kinds = F.array(F.year("created_at"), F.lit(0)), F.array(F.month("created_at"), F.lit(0)) if months == "applied" else every
    keyed = done.select("*", F.explode(kinds[0]).alias("__y")).select("*", F.explode(kinds[1]).alias("__m"))
    newest = Window.partitionBy("__y", "__m").orderBy(F.desc("created_at"), "id")
    pool = keyed.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= limit).drop("__n")  # limit rows of each key, pruned in every task
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("created_at"), "id"))
    hits = asked.join(pool, ["__y", "__m"]).withColumn("rank", rank).where(F.col("rank") <= limit)
    return hits.select("question_id", "rank", "id", "file_path", "created_at")


def clean_files(df: DataFrame) -> DataFrame:
    """Numbers out of text (malformed ones null), the extension, and seconds of processing."""
    return df.select(
        "id", F.expr("try_cast(file_size_bytes AS bigint)").alias("size_bytes"), F.expr("try_cast(duration_secs AS double)").alias("duration"), extension(F.col("file_path")).alias("file_ext"),
        (F.col("embedding_ms") / 1000.0).alias("embedding_sec"), F.unix_seconds("processed_at").alias("processed_epoch"),
    )


def dimension_counts(frames: DataFrame, vector: str = "vector") -> DataFrame:
    return frames.groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n"))
