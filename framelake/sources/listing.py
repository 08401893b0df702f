"""File listings: scans, exclusions and what becomes of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import all_of, any_of, base_name, extension

#: Extensions by type, junk names and folders of operating systems.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".heic", ".webp", ".bmp", ".gif")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".mkv", ".avi", ".flv", ".wmv", ".webm", ".m4v")
JUNK_NAMES = (".DS_Store", "Thumbs.db")
SYSTEM_FOLDERS = ("$RECYCLE.BIN", "System Volume Information", "$SysReset", "Recovery", "Config.Msi", ".Spotlight-V100", ".Trashes", ".fseventsd")


def file_type(path: Column) -> Column:
    """image, video or null by extension."""
    ext = extension(path)
    return F.when(ext.isin(*IMAGE_EXTENSIONS), "image").when(ext.isin(*VIDEO_EXTENSIONS), "video")


def check_extensions(registered: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Extension to type; an extension under two types is an error."""
    out: dict[str, str] = {}
    for kind, extensions in registered.items():
        for e in extensions:
            if out.setdefault(e, kind) != kind:
                raise ValueError(f"{e} is registered for {out[e]} and {kind}")
    return out


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, size, modified) of everything under a folder or object prefix; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select(F.col("path").alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def keep_media(listing: DataFrame, path_col: str = "file_path") -> DataFrame:
    """Supported files outside hidden and system folders, with their type. Keys that end in / are folders."""
    path = F.col(path_col)
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    hidden = F.exists(folders, lambda d: d.startswith(".") | d.isin(*SYSTEM_FOLDERS))
    junk = base_name(path).startswith("._") | base_name(path).isin(*JUNK_NAMES)
    return listing.where(~path.endswith("/") & ~junk & ~hidden).withColumn("media_type", file_type(path)).where("media_type is not null")


def glob_to_regex(pattern: str) -> str:
    """* and ? of a shell pattern, and [..] sets, as a whole-string expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return f"(?is)^{out}$"


def exclude_names(listing: DataFrame, patterns: str, path_col: str = "file_path") -> DataFrame:
    """Without files whose name matches any of the comma-separated patterns, in either case."""
    given = [p.strip() for p in patterns.split(",") if p.strip()]
    return listing.where(~any_of([base_name(F.col(path_col)).rlike(glob_to_regex(p)) for p in given])) if given else listing


def exclude_prefixes(listing: DataFrame, prefixes: DataFrame, path_col: str = "file_path") -> DataFrame:
    """Without files under any of the folders in the prefixes' column prefix: an anti join on each file's own folders,
    so the folders may be many."""
    parts = F.split(F.col(path_col), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    clean = prefixes.select(F.regexp_replace("prefix", "/+$", "").alias("__folder")).distinct()
    under = listing.select(F.col(path_col).alias("__path"), F.explode(above).alias("__folder")).join(clean, "__folder", "left_semi").select("__path").distinct()
    return listing.join(under, F.col(path_col) == F.col("__path"), "left_anti")


def count_by_type(listing: DataFrame) -> DataFrame:
    return listing.agg(F.count_if(F.col("media_type") == "image").alias("image"), F.count_if(F.col("media_type") == "video").alias("video"), F.count("*").alias("total"))


def matches(**equal: object) -> Column:
    """All given column = value pairs; None stands for no condition."""
    return all_of([F.col(k) == v for k, v in equal.items() if v is not None])
