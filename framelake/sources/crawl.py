"""Folders of media files as a data source, for batch reads and streams.

    spark.dataSource.register(MediaCrawl)
    spark.read.format("media_crawl").option("path", root).load()
    spark.readStream.format("media_crawl").option("path", root).load()

Every subfolder down to depth levels below the root is a partition of its own, and what lies deeper is walked by its task, so
no listing passes through one process. Hidden folders, system folders and excluded ones are never opened: they are left out
where their parent is listed. Excluded folders are known by device and inode too, so another mount of one is left out as
well. Links are not followed. A folder that may not be read is skipped.

Rows: (file_path, media_type, size, modified). The path is one that every executor sees, as a shared mount is.

In a stream the offset is a time: a batch holds the files whose inode changed (written, renamed or moved there) after the
last offset and at least settle seconds before now, so that a file is not taken while it is written. A file that is touched
later comes again, as does the last batch after a failure; what follows has to be idempotent, as keyed writes are.

Options: path; exclude_dirs and exclude_names, separated by commas (names are shell patterns, in either case); depth (1);
settle (2.0); extensions, as "txt=text,md=text", in place of the known image and video ones.
"""

from __future__ import annotations

import datetime
import fnmatch
import os
import stat
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .listing import IMAGE_EXTENSIONS, JUNK_NAMES, SYSTEM_FOLDERS, VIDEO_EXTENSIONS

SCHEMA = "file_path string, media_type string, size long, modified timestamp"


def _list(option: str) -> list[str]:
    return [x.strip() for x in option.split(",") if x.strip()]


@dataclass
class FolderPartition(InputPartition):
    """A folder with all below it, or its own files alone; those changed in (after, until]."""

    path: str
    whole: bool
    after: int = -1
    until: int = 1 << 63


class Walk:
    def __init__(self, options: dict[str, str]):
        path = options.get("path") or ""
        self.root = unquote(urlparse(path).path) if path.startswith("file:") else path
        self.depth = int(options.get("depth", 1))
        self.patterns = [p.upper() for p in _list(options.get("exclude_names", ""))]
        self.types = dict(f".{x}".lower().split("=") for x in _list(options.get("extensions", ""))) or ({e: "image" for e in IMAGE_EXTENSIONS} | {e: "video" for e in VIDEO_EXTENSIONS})
        self.excluded = _list(options.get("exclude_dirs", ""))

    def _inodes(self) -> set[tuple[int, int]]:
        out = set()
        for p in self.excluded:
            try:
                s = os.stat(p)
                out.add((s.st_dev, s.st_ino))
            except OSError:
                continue
        return out

    def entries(self, folder: str, inodes: set[tuple[int, int]]) -> tuple[list[os.DirEntry], list[str]]:
        """The files of a folder that count, and the folders in it that may be opened."""
        files, folders = [], []
        try:
            with os.scandir(folder) as found:
                for e in found:
                    if e.is_dir(follow_symlinks=False):
                        if not e.name.startswith(".") and e.name not in SYSTEM_FOLDERS and not (inodes and self._inode(e) in inodes):
                            folders.append(e.path)
                    elif e.is_file(follow_symlinks=False) and self._counts(e.name):
                        files.append(e)
        except OSError:
            return files, folders
        return files, sorted(folders)

    @staticmethod
    def _inode(e: os.DirEntry) -> tuple[int, int] | None:
        try:
            s = e.stat(follow_symlinks=False)
            return s.st_dev, s.st_ino
        except OSError:
            return None

    def _counts(self, name: str) -> bool:
        if name.startswith("._") or name in JUNK_NAMES or any(fnmatch.fnmatchcase(name.upper(), p) for p in self.patterns):
            return False
        return os.path.splitext(name)[1].lower() in self.types

    def partitions(self, after: int = -1, until: int = 1 << 63) -> list[FolderPartition]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no folder {self.root}")
        inodes, out, level = self._inodes(), [], [self.root]
        for _ in range(self.depth):
            below: list[str] = []
            for folder in level:
                out.append(FolderPartition(folder, False, after, until))
                below += self.entries(folder, inodes)[1]
            level = below
        return out + [FolderPartition(f, True, after, until) for f in level]

    def read(self, part: FolderPartition) -> Iterator[tuple]:
        inodes, left = self._inodes(), [part.path]
        while left:
            files, folders = self.entries(left.pop(), inodes)
            for e in files:
                try:
                    s = e.stat(follow_symlinks=False)
                except OSError:
                    continue  # it went meanwhile
                if stat.S_ISREG(s.st_mode) and part.after < s.st_ctime_ns <= part.until:
                    yield e.path, self.types[os.path.splitext(e.name)[1].lower()], s.st_size, datetime.datetime.fromtimestamp(s.st_mtime, datetime.UTC)
            if part.whole:
                left += folders


class CrawlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.walk = Walk(options)

    def partitions(self):
        return self.walk.partitions()

    def read(self, partition):
        return self.walk.read(partition)


class CrawlStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.walk = Walk(options)
        self.settle = float(options.get("settle", 2.0))

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict):
        return self.walk.partitions(start["until"], end["until"])

    def read(self, partition):
        return self.walk.read(partition)


class MediaCrawl(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_crawl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CrawlReader:
        return CrawlReader(dict(self.options))

    def streamReader(self, schema) -> CrawlStreamReader:
        return CrawlStreamReader(dict(self.options))
