"""A keyed table on folders that changes by small deltas.

Rows are dealt into buckets by a hash of their key. A change writes only the rows it names, into the buckets they belong
to, and becomes visible when its manifest is created under the next version number, which fails if another writer has taken
that number. A manifest names every folder that is alive and the buckets it is alive for, so a version is read from one
small file, and old versions stay readable until they are vacuumed.

A delta row puts a whole row, deletes a key, or sets some columns of a row that exists. Reading merges: of each column, the
latest delta that defines it wins over the base row; the order is that of the versions. Buckets without deltas are scanned
as they are; only the others' rows are shuffled for the merge. Compaction writes the merged rows of the buckets that have
gathered many deltas as their new base.

Writers do not block each other. Puts, deletes and settings by key go under the next free number as they are, since they
mean the same after another writer's change. A change by predicate and a compaction are worked out again.

Null keys are keys like any other. Rows of one change that share a key: the first in the given order, else any one. A put
that lacks columns leaves them null; one with new columns adds them to the table. Column names that begin with an underscore
are refused.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, replace
from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

PUT, DELETE, SET = "put", "delete", "set"
_MARKS = "_op string, _set array<string>"


class VersionTaken(Exception):
    """Another writer has created that version."""


@dataclass(frozen=True)
class Part:
    """A data folder: its rows come after those of parts with a lower seq, and count in these buckets only."""

    folder: str
    base: bool
    seq: int
    buckets: tuple[int, ...]


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    schema: str
    parts: tuple[Part, ...]

    def text(self) -> str:
        parts = [{"folder": p.folder, "base": p.base, "seq": p.seq, "buckets": p.buckets} for p in self.parts]
        return json.dumps({"version": self.version, "buckets": self.buckets, "schema": self.schema, "parts": parts})

    @staticmethod
    def of(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["version"], d["buckets"], d["schema"], tuple(Part(p["folder"], p["base"], p["seq"], tuple(p["buckets"])) for p in d["parts"]))


class Folder:
    """Small files of a folder that any Spark file system holds."""

    def __init__(self, spark: SparkSession, path: str):
        jvm, self.path = spark._jvm, path.rstrip("/")
        self._at = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(self._conf)
        self._jvm = jvm

    def names(self) -> list[str]:
        at = self._at(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """The whole file at once, or VersionTaken if one of that name is there: a file under a name of its own is given
        the wanted one, by a hard link on a local disk and elsewhere by the file system's rename that replaces nothing."""
        own, wanted = (self._at(f"{self.path}/{n}") for n in (f".{uuid.uuid4().hex}", name))
        stream = self._fs.create(own)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(*(unquote(urlparse(self._fs.makeQualified(p).toUri().toString()).path) for p in (own, wanted)))
            else:
                none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                modes = self._jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
                modes[0] = none
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self._conf).rename(own, wanted, modes)
        except FileExistsError as e:
            raise VersionTaken(name) from e
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise VersionTaken(name) from e
            raise
        finally:
            if self._fs.exists(own):
                self._fs.delete(own, False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{name}"), True)


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        """buckets counts for a new store; an old one keeps its own number."""
        self.spark, self.path, self.keys, self._buckets = spark, path.rstrip("/"), keys, buckets
        self.log = Folder(spark, f"{self.path}/_log")

    # Versions

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.log.names() if n.endswith(".json") and not n.startswith("."))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.version() if version is None else version
        return Manifest.of(self.log.read(f"{version:020d}.json")) if version else Manifest(0, self._buckets, "", ())

    def _commit(self, made: Manifest) -> int:
        self.log.create(f"{made.version:020d}.json", made.text())
        return made.version

    def _append(self, part: Part, schema: StructType, seen: Manifest, again: bool = True) -> int:
        """The part as the newest of all, under the next free number; with again, after whatever came in between."""
        while True:
            merged = _joint(seen.schema, schema)
            try:
                return self._commit(Manifest(seen.version + 1, seen.buckets, merged, (*seen.parts, replace(part, seq=seen.version + 1))))
            except VersionTaken:
                if not again:
                    raise
                seen = self.manifest()

    # Writing

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _write(self, rows: DataFrame, n: int) -> tuple[str, tuple[int, ...]]:
        """Rows in a new folder with one folder for each bucket, and the buckets that got any."""
        folder = uuid.uuid4().hex
        placed = rows.withColumn("_bucket", self._bucket(n)).hint("rebalance", "_bucket")
        placed.write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        names = Folder(self.spark, f"{self.path}/data/{folder}").names()
        return folder, tuple(sorted(int(x.split("=")[1]) for x in names if x.startswith("_bucket=")))

    def _delta(self, rows: DataFrame, op: str, columns: list[str], seen: Manifest, again: bool = True) -> int:
        _joint(seen.schema, rows.schema)
        marked = rows.withColumn("_op", F.lit(op)).withColumn("_set", F.array(*map(F.lit, columns)).cast("array<string>"))
        folder, touched = self._write(marked, seen.buckets)
        return self._append(Part(folder, False, 0, touched), rows.schema, seen, again) if touched else seen.version

    def upsert(self, rows: DataFrame, order: list[Column] | None = None) -> int:
        """Whole rows in place of those with their keys."""
        seen = self.manifest()
        schema = _joint(seen.schema, rows.schema)
        if order:
            rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*self.keys).orderBy(*order))).where("_n = 1").drop("_n")
        else:
            rows = rows.dropDuplicates(self.keys)
        if seen.version:
            return self._delta(rows, PUT, [], seen)
        folder, touched = self._write(rows, seen.buckets)
        try:
            return self._commit(Manifest(1, seen.buckets, schema, (Part(folder, True, 1, touched),)))
        except VersionTaken:
            Folder(self.spark, f"{self.path}/data").delete(folder)
            return self.upsert(rows)

    def delete(self, keys: DataFrame) -> int:
        return self._delta(keys.select(*self.keys).distinct(), DELETE, [], self.manifest())

    def set_by_key(self, values: DataFrame) -> int:
        """The columns of values, its keys aside, set on the rows that have those keys; null clears. Keys that no row has
        stay unknown."""
        return self._delta(values.dropDuplicates(self.keys), SET, [c for c in values.columns if c not in self.keys], self.manifest())

    def _by_predicate(self, condition: Column, op: str, values: dict[str, object]) -> int:
        while True:
            seen = self.manifest()
            rows = self.read(seen.version)
            kinds = {f.name: f.dataType for f in rows.schema.fields}
            made = [(v if isinstance(v, Column) else F.lit(v)).cast(kinds[c]).alias(c) for c, v in values.items()]
            try:
                return self._delta(rows.where(condition).select(*self.keys, *made), op, list(values), seen, again=False)
            except VersionTaken:
                continue

    def set_where(self, condition: Column, **values: object) -> int:
        """The named columns set on the rows for which the condition holds, worked out anew if another writer comes first."""
        return self._by_predicate(condition, SET, values)

    def delete_where(self, condition: Column) -> int:
        return self._by_predicate(condition, DELETE, {})

    # Reading

    def _paths(self, parts: list[Part], among: set[int]) -> list[str]:
        return [f"{self.path}/data/{p.folder}/_bucket={b}" for p in parts for b in p.buckets if b in among]

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, the newest unless one is given; of some buckets alone if they are named."""
        seen = self.manifest(version)
        if not seen.version:
            raise ValueError(f"{self.path} holds no version")
        schema = StructType.fromJson(json.loads(seen.schema))
        among = set(range(seen.buckets)) if buckets is None else buckets
        base, deltas = [p for p in seen.parts if p.base], [p for p in seen.parts if not p.base]
        changed = among & {b for p in deltas for b in p.buckets}
        still, moved = self._paths(base, among - changed), self._paths(base, changed)
        found = [self.spark.read.schema(schema).parquet(*still)] if still else []
        if changed:
            old = self.spark.read.schema(schema).parquet(*moved) if moved else self.spark.createDataFrame([], schema)
            found.append(self._merged(old, schema, deltas, changed))
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], schema)

    def _merged(self, old: DataFrame, schema: StructType, deltas: list[Part], changed: set[int]) -> DataFrame:
        marks = StructType.fromDDL(_MARKS)
        seq = F.create_map(*[F.lit(x) for p in deltas for x in (p.folder, p.seq)])
        rows = self.spark.read.schema(StructType([*schema.fields, *marks.fields])).parquet(*self._paths(deltas, changed))
        rows = rows.withColumn("_seq", F.element_at(seq, F.regexp_extract("_metadata.file_path", r"/data/([0-9a-f]{32})/_bucket=", 1)))
        columns = [f.name for f in schema.fields if f.name not in self.keys]
        whole = F.col("_op").isin(PUT, DELETE)

        def newest(c: str) -> Column:
            """The value of the latest delta that says anything of the column, in a struct so that a null counts."""
            return F.max_by(F.when(whole | F.array_contains("_set", c), F.struct(F.col(f"`{c}`").alias("v"))), F.when(whole | F.array_contains("_set", c), F.col("_seq")))

        last = rows.groupBy(*self.keys).agg(
            F.max_by(F.when(whole, F.col("_op")), F.when(whole, F.col("_seq"))).alias("_op"), F.struct(*[newest(c).alias(c) for c in columns]).alias("_new")
        )
        left, right = old.withColumn("_old", F.lit(True)).alias("o"), last.alias("d")
        same = reduce(lambda a, b: a & b, [F.col(f"o.`{k}`").eqNullSafe(F.col(f"d.`{k}`")) for k in self.keys])
        both = left.join(right, same, "full_outer")
        there = F.coalesce(F.col("d._op") == PUT, F.col("o._old"), F.lit(False))
        # A key beside null tells nothing of the side it came from, so the side's own mark does.
        key = lambda k: F.when(F.col("o._old"), F.col(f"o.`{k}`")).otherwise(F.col(f"d.`{k}`")).alias(k)
        value = lambda c: F.when(F.col(f"d._new.`{c}`").isNotNull(), F.col(f"d._new.`{c}`.v")).otherwise(F.col(f"o.`{c}`")).alias(c)
        return both.where(there).select(*[key(f.name) if f.name in self.keys else value(f.name) for f in schema.fields])

    # Upkeep

    def deltas(self) -> dict[int, int]:
        """How many deltas every changed bucket has."""
        out: dict[int, int] = {}
        for p in self.manifest().parts:
            for b in p.buckets if not p.base else ():
                out[b] = out.get(b, 0) + 1
        return out

    def compact(self, most: int = 0) -> int:
        """New base rows for the buckets with more than so many deltas. Deltas that come meanwhile stay after them; if
        another compaction comes first, this one gives up its work."""
        seen = self.manifest()
        full = {b for b, n in self.deltas().items() if n > most}
        if not full:
            return seen.version
        folder, touched = self._write(self.read(seen.version, full), seen.buckets)
        now = seen
        while True:
            if not _placed(seen, full) <= _placed(now, full):
                Folder(self.spark, f"{self.path}/data").delete(folder)
                return now.version
            kept = [replace(p, buckets=tuple(b for b in p.buckets if b not in full)) if p.seq <= seen.version else p for p in now.parts]
            parts = (*(p for p in kept if p.buckets), Part(folder, True, seen.version, touched))
            try:
                return self._commit(Manifest(now.version + 1, now.buckets, now.schema, parts))
            except VersionTaken:
                now = self.manifest()

    def vacuum(self, versions: int = 1) -> list[str]:
        """Forget all but the newest versions, and remove the folders that those alone had; returns their names. Not to be
        run while others write: a change that is not committed yet has no manifest that names its folder."""
        known = self.versions()
        kept, gone = known[-versions:], known[:-versions]
        alive = {p.folder for v in kept for p in self.manifest(v).parts}
        for v in gone:
            self.log.delete(f"{v:020d}.json")
        data = Folder(self.spark, f"{self.path}/data")
        dead = [n for n in data.names() if n not in alive]
        for n in dead:
            data.delete(n)
        return dead


def _placed(seen: Manifest, buckets: set[int]) -> set[tuple[str, int]]:
    return {(p.folder, b) for p in seen.parts for b in p.buckets if b in buckets}


def _joint(known: str, more: StructType) -> str:
    """The known schema with the new columns at its end; a column of another type is refused."""
    fields = {f.name: f for f in StructType.fromJson(json.loads(known)).fields} if known else {}
    for f in more.fields:
        if f.name.startswith("_"):
            raise ValueError(f"{f.name}: names that begin with an underscore are the store's own")
        if f.name in fields and fields[f.name].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        fields.setdefault(f.name, StructField(f.name, f.dataType))
    return StructType(list(fields.values())).json()
