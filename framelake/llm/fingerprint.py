"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line of the text, blank ones too) hashes to a wide vector: EXACT lanes modulo 2**64 from an extendable
hash of its bytes, and LIKE lanes modulo 2**16, where every word adds +1 or -1 to one lane that the word and up to two
that follow it in the paragraph pick. A fingerprint is the lane-wise sum over the paragraphs, so their order does not
matter, and adding or subtracting a paragraph's vector updates it in place: the edited text is told by deleting the
paragraphs that change and inserting those that come. Equal multisets of paragraphs have equal
fingerprints; others differ but for a chance of about 2**-64 for each lane.

The likeness of two fingerprints is 2<a,b> / (<a,a> + <b,b>) over the LIKE lanes, cut to 0..1: the shared share of word
triples, with a standard error of about 1/sqrt(LIKE). Two empty fingerprints are alike (1).

Null or empty text: one blank paragraph. Repeated ids are ordered by text. One document alone follows itself.
Other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, id_text, mix, span_hashes, words_of

EXACT, LIKE = 32, 512
_STEP = U64(0x9E3779B97F4A7C15)


def paragraph_vectors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The sums of both groups of lanes over a text's paragraphs."""
    raw = text.encode("utf-8", "surrogatepass")
    exact = np.frombuffer(b"".join(hashlib.shake_128(p).digest(8 * EXACT) for p in raw.split(b"\n")), "<u8").reshape(-1, EXACT).sum(0, dtype=U64)
    buf, starts, ends = words_of(text)
    words = span_hashes(buf, starts, ends)
    line = np.cumsum(buf == 10)[starts] if len(starts) else starts
    keys = words.copy()
    for k in (1, 2):
        same = line[k:] == line[:-k] if len(line) > k else np.zeros(0, bool)
        keys[: len(same)] += np.where(same, words[k:] * U64(2 * k + 1), U64(0)) * _STEP
    keys = mix(keys)
    signs = 1 - 2 * (keys >> U64(63)).astype(np.int64)
    like = np.bincount((keys & U64(LIKE - 1)).astype(np.int64), signs, LIKE).astype(np.int64) if len(keys) else np.zeros(LIKE, np.int64)
    return exact, like.astype(np.int16)


def insert(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of both multisets together."""
    return a[0] + b[0], a[1] + b[1]


def delete(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of a without the paragraphs of b."""
    return a[0] - b[0], a[1] - b[1]


def to_text(v: tuple[np.ndarray, np.ndarray]) -> str:
    return base64.b64encode(v[0].astype("<u8").tobytes() + v[1].astype("<i2").tobytes()).decode()


def from_text(s: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(s)
    return np.frombuffer(raw[: 8 * EXACT], "<u8").astype(U64), np.frombuffer(raw[8 * EXACT :], "<i2").astype(np.int16)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if np.array_equal(a[0], b[0]):
        return 1.0
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    norm = float(x @ x + y @ y)
    return min(1.0, max(0.0, 2 * float(x @ y) / norm)) if norm else 0.0


def edit(text: str, following: str) -> str:
    """The last half, rounded down, replaced by as much of the following text's beginning."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


Parts = tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], int]


def in_two_parts(text: str) -> Parts:
    """A text's fingerprint, that of the paragraphs from the one on in which its last half begins, and where that starts."""
    at = text.rfind("\n", 0, len(text) - len(text) // 2) + 1
    tail = paragraph_vectors(text[at:])
    return (insert(paragraph_vectors(text[: at - 1]), tail) if at else tail), tail, at


def _row(doc_id, text, parts: Parts, following, theirs: Parts) -> tuple:
    """The edited text's fingerprint is the text's own without the paragraphs that change, and with those that come."""
    edited = edit(text, following)
    own, tail, at = parts
    other = insert(delete(own, tail), paragraph_vectors(edited[at:]))
    theirs = theirs[0]
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own), to_text(other), likeness(own, other), likeness(own, theirs)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(_OUT), _OUT, strict=True)], schema=_OUT)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All documents of a sorted partition but its last, which has no follower here."""
    last = None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = in_two_parts(text)
            if last:
                rows.append(_row(*last, text, own))
            last = (doc_id, text, own)
        yield _batch(rows)


_ENDS = pa.schema([("head_id", pa.int64()), ("head_hash", pa.int64()), ("head", pa.string()), ("last_id", pa.int64()), ("last", pa.string())])
ENDS = "head_id long, head_hash long, head string, last_id long, last string"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last document of a sorted partition, one row."""
    head = last = None
    for batch in batches:
        if n := batch.num_rows:
            ids, texts, hashes = batch.columns
            head = head or (ids[0].as_py(), hashes[0].as_py(), texts[0].as_py())
            last = (ids[n - 1].as_py(), texts[n - 1].as_py())
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*head, *last), _ENDS, strict=True)], schema=_ENDS)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([_row(r["last_id"], r["last"], in_two_parts(r["last"]), r["next"], in_two_parts(r["next"])) for r in batch.to_pylist()])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_text(paragraph_vectors(t)) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every document."""
    return id_text(docs, id_col, text_col).mapInArrow(_vectors, "doc_id long, fingerprint string")


_PLACE = [("none", "i1"), ("down", "i8"), ("hash", "i8")]
SAMPLED = 20


def in_descending_ranges(rows: DataFrame, n: int) -> DataFrame:
    """rows of (doc_id, hash, ...) in n partitions by descending doc_id (none last), then hash. The bounds are numbers that
    the driver holds, SAMPLED sampled keys for each partition, so every reader of the result sees the same partitions,
    whether or not Spark shuffles it once."""
    key = [F.col("doc_id").isNull().cast("tinyint").alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down"), F.col("hash")]
    drawn = rows.select(*key).orderBy(F.xxhash64("none", "down", "hash", F.monotonically_increasing_id())).limit(SAMPLED * n).collect()
    sample = np.sort(np.array([tuple(r) for r in drawn], _PLACE))
    bounds = np.unique(sample[SAMPLED::SAMPLED])

    @F.pandas_udf("int")
    def part(none: pd.Series, down: pd.Series, hashed: pd.Series) -> pd.Series:
        keys = np.empty(len(none), _PLACE)
        keys["none"], keys["down"], keys["hash"] = none, down, hashed
        return pd.Series(np.searchsorted(bounds, keys, side="right").astype(np.int32))

    return rows.withColumn("part", part(*key)).repartitionById(n, "part").drop("part")


def op2_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and its follower in descending doc_id.

    One range shuffle puts followers side by side. Only the last document of a partition needs another one's first,
    and those pairs, one for each partition, are matched in the order of the partitions' first documents.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("doc_id"), F.col("hash"), F.col("text")]
    ranged = in_descending_ranges(id_text(docs).withColumn("hash", F.xxhash64("text")), n).sortWithinPartitions(*order)
    ends = ranged.mapInArrow(_ends, ENDS).withColumn("key", F.concat_ws(":", F.coalesce(F.col("head_id").cast("string"), F.lit("")), "head_hash"))
    by = Window.orderBy(F.desc("head_id"), "head_hash")  # keys only, one row for each partition
    turn = ends.select("key", F.lead("key").over(by).alias("follower"), F.first("key").over(by).alias("top"))
    turn = turn.select("key", F.coalesce("follower", "top").alias("follower"))
    pairs = ends.select("key", "last_id", "last").join(turn, "key").join(ends.select(F.col("key").alias("follower"), F.col("head").alias("next")), "follower")
    return ranged.mapInArrow(_along, OUT).unionByName(pairs.select("last_id", "last", "next").mapInArrow(_pairs, OUT))
