"""Importance resampling towards a target distribution.

Features are runs of consecutive lower-cased words, hashed by CRC-32 into buckets. Two passes of counts (all documents,
all target texts) give a bucket its gain, the floored scaled log ratio of the smoothed shares; the array of gains, one
number for each bucket, goes to all tasks, and a document's weight is the sum over its features. Adding Gumbel noise
from a hash of the id makes the highest scores a sample without replacement.

Scores are written once. The cutoff is found by bisection over numbers: every job counts the rows above WAYS - 1
evenly spaced scores exactly and keeps the one interval that holds the wanted count, until it is one score; among rows
tied there, the same over doc_id, and among rows that share that too, over a row number written with them. Only such
counts reach the driver. The drawn rows are then range-partitioned by their order, written with their partition's
number, and ranked by their place in it plus the totals of the partitions before it; all others pass by without a
shuffle. No partition holds a group of ties whole, as the row number splits it.

Null or empty text: no words, weight 0, not eligible. A null id is hashed as an empty one and comes last among ties.
Repeated rows are rows of their own, whichever of equal ones is drawn. With empty or null target texts every gain is the
log ratio against none; an empty table of documents gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, staged

BUCKETS, WAYS = 10_000, 64
REMEMBERED = 400_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str) -> list[bytes]:
    """Lower-cased A-Z, then runs of digits, letters and whatever lies beyond ASCII, as UTF-8."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Hasher:
    """Buckets of a text's runs of one to n words; single words are looked up, at most REMEMBERED of them."""

    def __init__(self, n: int, buckets: int):
        self.n, self.buckets = n, buckets
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        """The number of words, and the bucket of every feature."""
        found = words(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        try:
            single = [known[w] for w in found]
        except KeyError:
            for w in set(found).difference(known):
                known[w] = zlib.crc32(w) % self.buckets
            single = [known[w] for w in found]
        runs = [zlib.crc32(b" ".join(found[i : i + k])) % self.buckets for k in range(2, self.n + 1) for i in range(len(found) - k + 1)]
        return len(found), np.array(single + runs, np.int64)


def _counts(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """One task's histogram of buckets."""
    hasher, total = Hasher(n, buckets), np.zeros(buckets, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total += np.bincount(hasher(text)[1], minlength=buckets) if text else 0
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: one number for each, the only thing that is gathered."""
    one = texts.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    sums = one.mapInArrow(partial(_counts, n=n, buckets=buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # at most as many rows as buckets
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each bucket."""
    b = len(source)
    total_s, total_t = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (total_s + b) / ((s + 1) * (total_t + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, salt: str) -> int:
    """Scaled Gumbel noise from the id's hash."""
    h = int(hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORES = ["doc_id", "n_words", "n_features", "weight", "score"]
SCORES = ", ".join(f"{c} long" for c in _SCORES)


def _scores(batches: Iterator[pa.RecordBatch], gain, n: int, salt: str) -> Iterator[pa.RecordBatch]:
    gain = gain.value
    hasher = Hasher(n, len(gain))
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            count, at = hasher(text)
            weight = int(gain[at].sum())
            rows.append((doc_id, count, len(at), weight, weight + noise(doc_id, salt)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(_SCORES))], names=_SCORES)


def least_reaching(rows: DataFrame, value: Column, low: int, high: int, wanted: int) -> int:
    """The smallest v in low..high for which at least wanted rows have a value of at most v (high must do). Each job counts
    the rows below all of its thresholds in one pass."""
    while low < high:
        cuts = sorted({low + (high - low) * i // WAYS for i in range(WAYS)})
        counted = rows.agg(*[F.count_if(value <= c).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
        reach = [c for c, k in zip(cuts, counted, strict=True) if k >= wanted]
        short = [c for c, k in zip(cuts, counted, strict=True) if k < wanted]
        high = reach[0] if reach else high
        low = short[-1] + 1 if short else low
    return high


def find_cutoff(rows: DataFrame, keys: list[Column], wanted: int) -> list[int]:
    """For keys that order rows ascending, the values of the last of the wanted rows: one key after the other, each among
    the rows that tie in those before it. The last key must be distinct."""
    found: list[int] = []
    for key in keys:
        ends = rows.agg(F.min(key), F.max(key)).first()
        cut = least_reaching(rows, key, ends[0], ends[1], wanted)
        wanted -= rows.where(key < cut).count()
        rows = rows.where(key == cut)
        found.append(cut)
    return found


def up_to(keys: list[Column], cut: list[int]) -> Column:
    """Rows at or before the cutoff in the order of the keys."""
    out = F.lit(True)
    for key, c in reversed(list(zip(keys, cut, strict=True))):
        out = (key < c) | ((key == c) & out)
    return out


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with rank 1, 2, 3... in the order of distinct keys. They are written once with their range partition's number,
    so that its totals and its rows come from the same bounds."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    base = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return placed.withColumn("inside", inside).join(F.broadcast(base), "part").withColumn("rank", F.col("base") + F.col("inside")).drop("part", "inside", "base")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, n: int = 1, buckets: int = BUCKETS, salt: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank is null where it is not drawn."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_col, n, buckets))
    sent = spark.sparkContext.broadcast(gain)
    scores = staged(id_text(docs, id_col, text_col).mapInArrow(partial(_scores, gain=sent, n=n, salt=salt), SCORES).withColumn("row", F.monotonically_increasing_id()))
    fit = F.col("n_words") >= least_words
    eligible = scores.where(fit)
    wanted = percent * eligible.count() // 100
    if not wanted:
        return scores.select(*_SCORES, F.lit(None).cast("long").alias("rank"))
    largest = (1 << 63) - 1
    keys = [-F.col("score"), F.coalesce("doc_id", F.lit(largest)), F.col("row")]
    drawn = fit & up_to(keys, find_cutoff(eligible, keys, wanted))
    order = scores.where(drawn).withColumns({"k0": keys[0], "k1": keys[1]})
    top = ranked(order, ["k0", "k1", "row"]).select(*_SCORES, F.col("rank").cast("long").alias("rank"))
    return top.unionByName(scores.where(~drawn).select(*_SCORES, F.lit(None).cast("long").alias("rank")))


def op13_importance_sample(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH RECURSIVE steps AS (SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY ALL),
named AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 2 * octet_length(encode(w)), 2), lambda p: CAST('0x' || substr(hex(encode(w)), p, 2) AS BIGINT))),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN named USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN named USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) AS DOUBLE) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT r, sum(n * gain) AS weight FROM dw JOIN named USING (w) JOIN g USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(w) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS eligible FROM scored WHERE n >= 20)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN place <= 10 * eligible // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)
"""
