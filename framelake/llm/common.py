"""Shared plumbing: table access, durable staging and small numpy helpers used inside tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Rows of whole texts that are held at once, on their way to Python and in it. The 10,000 that Spark hands over unasked
#: are 45 MB of long texts, of which an executor and its workers hold several copies and keep the memory of most.
TEXTS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_MULT = 0x9E3779B97F4A7C15 | 1
_POW = np.ones(1, U64)
_INV = np.ones(1, U64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly two columns, whatever else the input carries: the id as bigint and the text, null as empty."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of df has in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, with one of its own for this application, which may go when the application
    has ended. Where the session names none, a local one, as in tests, gets a temporary folder; a cluster is refused, as
    its executors would each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='framelake-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"


def staged_path(spark: SparkSession) -> str:
    """A new folder name below the shared one."""
    return f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives the loss of executors."""
    path = path or staged_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside hands Python at most TEXTS rows at once; the session's own limit, if less, stays, and is put back."""
    before = spark.conf.get(_BATCH, None)
    if before is None or not 0 < int(before) <= TEXTS:
        spark.conf.set(_BATCH, TEXTS)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def staged_texts(df: DataFrame) -> DataFrame:
    """As staged, for what reads whole texts or sets in Python."""
    with small_batches(df.sparkSession):
        return staged(df)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most TEXTS at once."""
    for batch in batches:
        yield from (batch.slice(i, TEXTS) for i in range(0, batch.num_rows, TEXTS))


def drop_staged(spark: SparkSession, path: str) -> None:
    """Remove a staged folder whose last reader is done."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of 64-bit words."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_MULT))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table over byte values, true inside any of the inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


BLANK = byte_set((0x20, 0x20), (0x09, 0x0D))


def spans(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.zeros(len(is_word) + 2, np.int8)
    edge[1:-1] = is_word
    at = np.flatnonzero(edge[1:] != edge[:-1])
    return at[::2], at[1::2]


def _powers(n: int) -> None:
    """Grow the tables of powers of the multiplier and of its inverse modulo 2**64 to n entries."""
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, 2 * len(_POW), 1 << 15)
        out = []
        for base in (_MULT, pow(_MULT, -1, 1 << 64)):
            x = np.full(n, base, U64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=U64))
        _POW, _INV = out


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one pass of prefix sums; equal bytes give equal hashes anywhere."""
    if not len(starts):
        return np.zeros(0, U64)
    _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * _INV[: len(buf)], dtype=U64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _POW[ends - 1] + (ends - starts).astype(U64))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of width words; none if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(width):
        out = out * U64(_MULT) + words[k : k + n]
    return mix(out)


def words_of(text: str, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a text and the starts and ends of its words, split at ASCII blanks."""
    buf = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if lower:
        buf = LOWER[buf]
    return buf, *spans(~BLANK[buf])
