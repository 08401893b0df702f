"""Contents that a stream has met, in runs by prefix with Bloom filters.

Every micro-batch adds a run: its new contents in folders by a prefix of their digest, and a filter for each prefix. A batch
reads the filters of the prefixes that it has, asks them for its contents, and opens only the folders that may hold one. FAN
runs of a level are merged into one of the next, so their number grows with the logarithm of the batches.

A run covers a range of batch numbers, and a batch is decided by the runs that lie before it, so one that comes again, or a
whole stream that is played again over the same folder, finds what it found before. Merging only reads complete runs, and a
merged one counts from the moment its filters are written, which are written last.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed_store import Folder

FAN, BITS, PROBES = 8, 12, 7


def _places(keys: np.ndarray, size: int) -> np.ndarray:
    """PROBES bit places for each 64-bit key, by double hashing."""
    keys = keys.astype(np.int64).view(np.uint64)
    step = ((keys >> np.uint64(33)) ^ (keys * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1)
    return ((keys[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(size)).astype(np.int64)


def _filter(frame: pd.DataFrame) -> pd.DataFrame:
    size = max(64, BITS * len(frame))
    bits = np.zeros(size, bool)
    bits[_places(frame["hash"].to_numpy(), size).ravel()] = True
    return pd.DataFrame({"prefix": [frame["prefix"].iloc[0]], "size": [size], "bits": [np.packbits(bits).tobytes()]})


def _maybe(asked: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Which runs may hold which of the hashes asked for, all of one prefix."""
    keys = asked["hash"].to_numpy()
    out = []
    for run, size, bits in zip(filters["run"], filters["size"], filters["bits"], strict=True):
        on = np.unpackbits(np.frombuffer(bits, np.uint8))[_places(keys, int(size))].all(axis=1) if len(keys) else np.zeros(0, bool)
        out += [(run, asked["prefix"].iloc[0], int(h)) for h in keys[on]]
    return pd.DataFrame(out, columns=["run", "prefix", "hash"])


class KnownContents:
    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        """digits of a digest in hexadecimal are the prefix: 256 folders at most in a run by default."""
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits
        self.log = Folder(spark, f"{self.path}/filters")

    def _keyed(self, contents: DataFrame, content: str) -> DataFrame:
        text = F.col(f"`{content}`").cast("string")
        prefix: Column = F.substring(F.md5(text), 1, self.digits)
        return contents.where(F.col(f"`{content}`").isNotNull()).select(text.alias("content"), F.concat(F.lit("p"), prefix).alias("prefix"), F.xxhash64(text).alias("hash"))

    def runs(self, before: int) -> list[tuple[int, int, str]]:
        """(first batch, first batch after, name) of the runs that cover the batches before, the widest ones."""
        found = []
        for name in self.log.names():
            level, _, at = name.partition("-")
            if at.isdigit() and "_SUCCESS" in Folder(self.spark, f"{self.path}/filters/{name}").names():
                width = FAN ** int(level.removeprefix("level"))
                found.append((int(at) * width, (int(at) + 1) * width, name))
        kept: list[tuple[int, int, str]] = []
        for first, after, name in sorted((r for r in found if r[1] <= before), key=lambda r: (r[0] - r[1], r)):
            if not any(a <= first and after <= b for a, b, _ in kept):
                kept.append((first, after, name))
        return sorted(kept)

    def _write(self, keyed: DataFrame, name: str) -> None:
        keyed.write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/contents/{name}")
        held = self.spark.read.schema("content string, hash long, prefix string").parquet(f"{self.path}/contents/{name}")
        made = held.select("prefix", "hash").groupBy("prefix").applyInPandas(_filter, "prefix string, size long, bits binary")
        made.write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/filters/{name}")

    def add(self, contents: DataFrame, number: int, content: str = "content") -> None:
        """The new contents of a batch."""
        self._write(self._keyed(contents, content).distinct(), f"level0-{number}")

    def merge(self, before: int) -> None:
        """FAN neighbouring runs of one level into one of the next, for all that lie before a batch."""
        level = 0
        while FAN ** (level + 1) <= before:
            width = FAN ** (level + 1)
            have = {name for _, _, name in self.runs(before)}
            for at in range(before // width):
                parts = [f"level{level}-{at * FAN + i}" for i in range(FAN)]
                if all(p in have for p in parts):
                    read = lambda p: self.spark.read.schema("content string, hash long, prefix string").parquet(f"{self.path}/contents/{p}")
                    whole = reduce(DataFrame.unionByName, [read(p) for p in parts]).select("content", "prefix", "hash")
                    self._write(whole.hint("rebalance", "prefix"), f"level{level + 1}-{at}")
                    for p in parts:
                        self.log.delete(p)
                        Folder(self.spark, f"{self.path}/contents").delete(p)
            level += 1

    def probe(self, contents: DataFrame, number: int, content: str = "content") -> tuple[DataFrame, list[str]]:
        """(content) of those that a batch before this one has added, and the folders that were opened to know."""
        none = self.spark.createDataFrame([], f"`{content}` string")
        runs = [name for _, _, name in self.runs(number)]
        if not runs:
            return none, []
        asked = self._keyed(contents, content).distinct()
        prefixes = {r.prefix for r in asked.select("prefix").distinct().collect()}  # at most 16 ** digits
        there = [f"{self.path}/filters/{run}/prefix={p}" for run in runs for p in sorted(prefixes.intersection(n.removeprefix("prefix=") for n in Folder(self.spark, f"{self.path}/filters/{run}").names()))]
        if not there:
            return none, []
        where = F.col("_metadata.file_path")
        filters = self.spark.read.schema("size long, bits binary").parquet(*there)
        filters = filters.select(F.regexp_extract(where, r"/filters/([^/]+)/prefix=", 1).alias("run"), F.regexp_extract(where, r"/prefix=([^/]+)/", 1).alias("prefix"), "size", "bits")
        maybe = asked.select("prefix", "hash").groupBy("prefix").cogroup(filters.groupBy("prefix")).applyInPandas(_maybe, "run string, prefix string, hash long")
        opened = sorted(f"{self.path}/contents/{r.run}/prefix={r.prefix}" for r in maybe.select("run", "prefix").distinct().collect())
        if not opened:
            return none, []
        held = self.spark.read.schema("content string, hash long").parquet(*opened)
        return asked.join(held.select("content").distinct(), "content", "left_semi").select(F.col("content").alias(content)), opened
