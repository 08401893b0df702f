"""Quality rules with risk-controlled thresholds.

Every document gets counts over its whole text. Two fixed base rules reject at once. Beyond them, each rule compares
one ratio with a cutoff that labelled documents choose. Per stratum (language) the rules' cutoffs are tightened along
one nested sequence of steps: one rule after the other, each from 1000 down to its lowest, first the rule beyond whose
lowest cutoff the labelled junk lies farthest. Junk alone picks that order, so good documents test a sequence that does
not depend on them. A step passes while the exact binomial tail P[Bin(n_good, risk) <= good documents that any rule
rejects] stays at or below level / strata (Bonferroni over strata alone, as a fixed sequence needs no further share);
the first step that fails ends the sequence. That tail is at most the level exactly when the Clopper-Pearson upper
bound of the false rejection rate is at most the risk. So with probability 1 - level no stratum loses more than the
risk in good documents to all rules together, beyond those that the base rules reject anyway. A stratum needs
log(level / strata) / log(1 - risk) good labels, 437 in each of four; with fewer nothing more is rejected.

Any number of strata is judged alike. What belongs to a stratum (order of rules, cutoffs) is broadcast up to STRATA_SENT
strata; beyond, it is joined by shuffle, a stratum's documents dealt over SALTS keys.

Null or empty text: all counts 0 (it fails the base rule on length). Null language: a stratum of its own, ''. Labels
that are null are left out; a document with several labels is good if all are. Repeated rows each give a row; an empty
table gives an empty result, and without labels only the base rules reject. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import byte_set, sliced, span_hashes, staged, staged_texts, windows, words_of

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_DIGIT = byte_set((0x30, 0x39))
_TAIL = byte_set((0x80, 0xBF))

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_distinct")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string())] + [(c, pa.int64()) for c in _COUNTS])
SCHEMA = "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in _COUNTS)


@dataclass(frozen=True)
class Rule:
    """Rejects a document whose value, in whole steps, is at or above the cutoff."""

    name: str
    value: str  # SQL over the counts, 0 to 1000
    lowest: int  # no cutoff is sought below


RULES = (
    Rule("symbols", "1000 * n_symbols / greatest(word_chars, 1)", 5),
    Rule("digits", "1000 * n_digits / greatest(word_chars, 1)", 20),
    Rule("dup_lines", "1000 * n_dup_lines / greatest(n_lines, 1)", 50),
    Rule("repeats", "1000 * n_repeat_words / greatest(n_words, 1)", 50),
    Rule("sameness", "1000 - 1000 * n_distinct / greatest(n_words, 1)", 300),
    Rule("long_words", "20 * word_chars / greatest(n_words, 1)", 100),
    Rule("short", "1000 - n_words", 880),
)
#: The fixed base rules, and a step past the end of every sequence.
BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"
END = 1 << 20
STRATA_SENT, SALTS = 50_000, 64


def repeat_words(hashes: np.ndarray, width: int = 8) -> int:
    """Words inside windows of that many words which the text holds twice or more."""
    w = windows(hashes, width)
    if len(w) < 2:
        return 0
    order = np.sort(w)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(w, twice))
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int(np.count_nonzero(np.cumsum(cover)[:-1]))


def count_text(text: str) -> tuple[int, ...]:
    buf, starts, ends = words_of(text, lower=False)
    hashes = span_hashes(buf, starts, ends)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    inside = int((ends - starts).sum()) - int(np.count_nonzero(_TAIL[buf]))
    return len(hashes), inside, int(np.count_nonzero(_SYMBOL[buf])), dup, repeat_words(hashes), lines, int(np.count_nonzero(_DIGIT[buf])), len(np.unique(hashes))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        got = np.array([count_text(t) for t in batch.column(2).to_pylist()], np.int64).reshape(-1, len(_COUNTS))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(got[:, i]) for i in range(len(_COUNTS)))], schema=_SCHEMA)


def _count_rows(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """As _count, with the text inside the struct column that is handed on."""
    for batch in sliced(batches):
        texts = batch.column(2).field(text_col).cast(pa.string()).to_pylist()
        got = np.array([count_text(t or "") for t in texts], np.int64).reshape(-1, len(_COUNTS))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(got[:, i]) for i in range(len(_COUNTS))), batch.column(2)], names=[*_SCHEMA.names, "row"])


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", carry: bool = False) -> DataFrame:
    """One row of counts per document. Symbols are the characters #*$%&|<> anywhere; words end at ASCII blanks.
    With carry, the document itself follows in the struct column row."""
    clean = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    key, stratum = F.col(f"`{id_col}`").cast("long").alias("doc_id"), clean(stratum_col).alias("stratum")
    if not carry:
        return docs.select(key, stratum, clean(text_col).alias("text")).mapInArrow(_count, SCHEMA)
    whole = docs.select(key, stratum, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.mapInArrow(partial(_count_rows, text_col=text_col), StructType([*StructType.fromDDL(SCHEMA).fields, whole.schema["row"]]))


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, from its front to where it no longer moves."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + top * d, 1.0 + top / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P[Bin(n, p) <= k], by the regularised incomplete beta function I(1 - p; n - k, k + 1)."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    a, b, x = float(n - k), float(k + 1), 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log1p(-p) + b * math.log(p))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _fraction(b, a, p) / b


def most_rejected(n: int, risk: float, share: float) -> int:
    """The most good documents of n that may be rejected: the greatest k with P[Bin(n, risk) <= k] <= share, -1 if none."""
    low, high = -1, n
    while high - low > 1:
        k = (low + high) // 2
        low, high = (k, high) if binomial_at_most(k, n, risk) <= share else (low, k)
    return low


def _beside(rows: DataFrame, facts: DataFrame, few: bool) -> DataFrame:
    """rows with their stratum's facts (one row a stratum, null where it has none)."""
    if few:
        return rows.join(F.broadcast(facts), "stratum", "left")
    salted = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["stratum", "__salt"], "left").drop("__salt")


def choose_cutoffs(counts: DataFrame, labels: DataFrame, risk: float = 0.01, level: float = 0.05, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(stratum, rule, cutoff): where the sequence of each stratum ends."""
    n = len(rules)
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    values = [F.expr(f"cast(least(1000, greatest(0, floor({r.value}))) as int)").alias(f"v{i}") for i, r in enumerate(rules)]
    held = staged(counts.join(marks, "doc_id").select("doc_id", "stratum", "quality", F.expr(BASE_FAILED).alias("base_failed"), *values))

    junk = F.expr("quality = 0 and not base_failed")
    sums = held.groupBy("stratum").agg(*[F.coalesce(F.sum(F.when(junk, F.expr(f"1000 * greatest(0, v{i} - {r.lowest}) div {1001 - r.lowest}"))), F.lit(0)).alias(f"s{i}") for i, r in enumerate(rules)])
    rank = lambda i: sum((((F.col(f"s{j}") >= F.col(f"s{i}")) if j < i else (F.col(f"s{j}") > F.col(f"s{i}"))).cast("int") for j in range(n) if j != i), F.lit(0))
    order = staged(sums.select("stratum", F.array(*[rank(i) for i in range(n)]).alias("ranks")))
    few = order.count() <= STRATA_SENT

    good = _beside(held.where("quality = 1"), order, few)
    first = F.least(*[F.when(F.col(f"v{i}") >= r.lowest, F.element_at("ranks", i + 1) * 1001 + 1000 - F.col(f"v{i}")) for i, r in enumerate(rules)], F.lit(END))
    hist = staged(good.select("stratum", F.when(F.col("base_failed"), F.lit(END)).otherwise(first).alias("step")).groupBy("stratum", "step").agg(F.count("*").alias("n")))
    share = level / max(1, hist.select("stratum").distinct().count())

    @F.pandas_udf("long")
    def most(n_good: pd.Series) -> pd.Series:
        return pd.Series([most_rejected(int(x), risk, share) for x in n_good], dtype="int64")

    bounds = hist.groupBy("stratum").agg(F.sum("n").alias("n_good")).select("stratum", most("n_good").alias("most")).where("most >= 0")
    along = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 1001 steps a rule
    # Steps without a good document of their own pass as the one before them does; the very first ones reject none.
    tested = hist.select("stratum", "step", F.sum("n").over(along).alias("rejected")).join(bounds, "stratum")
    stops = tested.groupBy("stratum").agg(F.coalesce(F.min(F.when(F.col("rejected") > F.col("most"), F.col("step"))), F.lit(END)).alias("stop")).join(order, "stratum")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.lowest).alias("lowest"), (1001 * (F.element_at("ranks", i + 1) + 1) - F.col("stop")).alias("cutoff")) for i, r in enumerate(rules)])).alias("x")
    return stops.select("stratum", each).select("stratum", "x.rule", F.greatest("x.cutoff", "x.lowest").alias("cutoff")).where("cutoff <= 1000")


def apply_cutoffs(counts: DataFrame, cutoffs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed and kept; cutoffs: (stratum, rule, cutoff)."""
    wide = staged(cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == i, F.col("cutoff"))).alias(f"cut_{r.name}") for i, r in enumerate(rules)]))
    joined = _beside(counts, wide, wide.count() <= STRATA_SENT)
    bad = F.lit(False)
    for r in rules:
        bad = bad | F.coalesce(F.expr(f"floor({r.value})") >= F.col(f"cut_{r.name}"), F.lit(False))
    return joined.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & ~bad).select(*counts.columns, "base_failed", "kept")


def judge_quality(docs: DataFrame, labels: DataFrame, risk: float = 0.01, level: float = 0.05, carry: bool = False) -> DataFrame:
    """Counts, base verdict and final verdict per document. The counts are written once and read by both passes; with carry
    the documents are counted again as they are judged, so that no text is written for it."""
    counts = staged_texts(text_counts(docs))
    cutoffs = choose_cutoffs(counts, labels, risk, level)
    return apply_cutoffs(text_counts(docs, carry=True) if carry else counts, cutoffs)


def op10_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge_quality(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
