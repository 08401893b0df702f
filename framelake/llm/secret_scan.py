"""Secret scans, in DataFrame functions alone.

Base kinds are regular expressions, leftmost and without overlap: assign (a keyword, = or :, a value of 6 or more
characters), access (AKIA and 16 or more) and hex (24 or more). The entropy kind adds candidate strings: whole runs of
20 or more letters, digits and +/_-. A window of 20 characters slides along a candidate. Counts per character (packed
into six longs of twelve counts each) are updated as one leaves and one enters, and with them the sum of c*log2(c), so
each step costs the same. Long candidates are cut into pieces of PIECE characters that overlap by a window less one,
so no window is lost and no step looks at more than its piece. A candidate counts when some window reaches the threshold
of the window's character class (hexadecimal, or letters and digits mixed) and is harmless by no pattern itself. The
whole candidate is let go only where a pattern describes it from its first to its last character, so a secret behind a
path, a key's prefix or a sample word counts. Candidates inside a base span are not reported again.

Positions are running sums over matches and the gaps between them, and what covers a candidate is a running maximum;
both are taken by doubling steps, so a text of n matches costs n log n, and a text's length counts once.

Positions are code points, end exclusive. Null or empty text: no spans. Repeated rows each give a row; an empty table
gives an empty result; other columns of the input pass through redact() and are ignored elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Fixed values of the base kinds: pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
_GATE = {"assign": r"(?i)password|passwd|secret|token|api_?key", "access": "AKIA", "hex": r"[0-9a-f]{24}"}
KINDS = ("assign", "access", "hex", "entropy")

WINDOW, PIECE, CHUNK = 20, 512, 1024
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])"
_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-"
#: Bits per character that a window must reach: random hexadecimal has about 3.4 in 20 characters, random letters and digits 4.1.
THRESHOLD = {"hex": 3.0, "mixed": 3.8}
#: Candidates that are no secrets as a whole: numbers, words (of one case, capitalised, or joined in camel case), UUIDs,
#: paths of short words. Repeated groups are possessive, as others cost the regex engine a stack frame each time.
ALLOW = (
    r"^[0-9_/+-]+$",
    r"^[_/+-]*+(?:(?:[A-Z]?[a-z]++|[A-Z]++|(?:[A-Z]?[a-z]{3,}+)++)(?:[_/+-]++|$))++$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[a-z0-9]{1,12}(?:[/_-][a-z]{2,12}){2,}+$",
)
#: Windows that do not count: numbers, letters of one case, samples, runs of one character, alphabets.
HARMLESS = r"^[0-9_/+-]+$|^[a-z_/+-]+$|^[A-Z_/+-]+$|(?i:example|sample|dummy|placeholder|changeme|lorem|your[_-])|(.)\1{5,}|(?i:abcdefgh|0123456789|qwertyuiop)"
HEXADECIMAL = r"^(?:[0-9a-f]+|[0-9A-F]+)$"


SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums, maxima or the like: every entry takes in the one 1, 2, 4, ... places before it."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < F.size(values))
    return F.aggregate(steps, values, lambda acc, s: F.transform(acc, lambda x, i: F.when(i >= s, join(x, F.get(acc, i - s))).otherwise(x)))


def _located(text: Column, pattern: str, group: int) -> Column:
    """Array of (start, end, whole, n) of all matches; n is the length of the group. Pieces between matches give positions."""

    def places(whole: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
        sizes = F.zip_with(gaps, whole, lambda g, w: F.length(g) + F.length(w))
        part = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda p: F.length(p)) if group else F.transform(whole, lambda w: F.length(w))
        rows = F.arrays_zip(_let(sizes, lambda s: _running(s, lambda x, y: x + y)).alias("end"), whole.alias("whole"), part.alias("n"))
        return F.transform(rows, lambda r: F.struct((r["end"] - F.length(r["whole"])).alias("start"), r["end"].alias("end"), r["whole"].alias("whole"), r["n"].alias("n")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _kind(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, rank, end, kind) of one base kind; texts that can't match are not searched for positions."""
    found = F.filter(_located(text, pattern, group), lambda x: x["n"] >= least)
    return F.when(text.rlike(_GATE[kind]), _spans(found, kind)).otherwise(F.expr(f"cast(array() as {SPANS})"))


def _pieces(candidate: Column, window: int) -> Column:
    """Pieces that overlap by a window less one, so that every window lies in one of them."""
    return F.regexp_extract_all(candidate, F.lit(f"(?=(.{{1,{PIECE + window - 1}}})).{{1,{PIECE}}}"), F.lit(1))


def _slide(piece: Column, window: int, skip: bool = False) -> Column:
    """(best, hot): the greatest entropy of any window, and whether one that is not harmless reaches its threshold.
    With skip, pieces of so few characters that none can are not slid over."""
    weigh = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    words = range(-(-len(_ALPHABET) // 12))
    shift = lambda code: F.pmod(code, F.lit(12)) * 5
    one = lambda code, k: F.when((code >= 12 * k) & (code < 12 * k + 12), F.call_function("shiftleft", F.lit(1).cast("long"), shift(code))).otherwise(F.lit(0).cast("long"))

    def count(acc: Column, code: Column) -> Column:
        word = acc[f"w{words[-1]}"]
        for k in reversed(words[:-1]):
            word = F.when(code < 12 * k + 12, acc[f"w{k}"]).otherwise(word)
        return F.call_function("shiftright", word, shift(code)).bitwiseAND(F.lit(31).cast("long")).cast("int")

    def counts(text: Column, entropy: Column) -> Column:
        high = F.when(entropy >= THRESHOLD["mixed"], F.lit(True)).otherwise(text.rlike(HEXADECIMAL))
        return F.when(high, ~text.rlike(HARMLESS)).otherwise(F.lit(False))

    def judged(acc: Column) -> list[Column]:
        """best and hot with the window that ends at the last character so far."""
        entropy = F.lit(math.log2(window)) - acc["total"] / window
        full = acc["n"] >= window
        best = F.when(full, F.greatest(acc["best"], entropy)).otherwise(acc["best"])
        hot = F.when(~acc["hot"] & full & (entropy >= THRESHOLD["hex"]), counts(F.substring(piece, acc["n"] - (window - 1), F.lit(window)), entropy)).otherwise(acc["hot"])
        return [best.alias("best"), hot.alias("hot")]

    def step(acc: Column, e: Column) -> Column:
        gone, come = e["gone"], e["come"]
        had = count(acc, gone)
        has = count(acc, come) - F.when(gone == come, F.lit(1)).otherwise(F.lit(0))
        lost = F.when(gone >= 0, F.element_at(weigh, had) - F.element_at(weigh, had + 1)).otherwise(F.lit(0.0))
        total = acc["total"] + lost + F.element_at(weigh, has + 2) - F.element_at(weigh, has + 1)
        return F.struct(*[(acc[f"w{k}"] - one(gone, k) + one(come, k)).alias(f"w{k}") for k in words], (acc["n"] + 1).alias("n"), total.alias("total"), *judged(acc))

    none = F.struct(*[F.lit(0).cast("long").alias(f"w{k}") for k in words], F.lit(0).alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"), F.lit(False).alias("hot"))
    codes = F.transform(F.filter(F.split(piece, ""), lambda c: c != ""), lambda c: F.instr(F.lit(_ALPHABET), c) - 1)
    events = lambda c: F.zip_with(c, F.slice(F.concat(F.array_repeat(F.lit(-1), window), c), F.lit(1), F.size(c)), lambda x, y: F.struct(x.alias("come"), y.alias("gone")))
    slid = lambda c: F.aggregate(events(c), none, step, lambda acc: F.struct(*judged(acc)))
    few = lambda c: F.size(F.array_distinct(c)) < 2 ** THRESHOLD["hex"]  # noqa: E731  # then no window can be hot
    still = F.struct(F.lit(0.0).alias("best"), F.lit(False).alias("hot"))
    return _let(codes, lambda c: F.when(few(c) if skip else F.lit(False), still).otherwise(slid(c)))


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The greatest Shannon entropy, in bits per character, of any window of the candidate."""
    return F.array_max(F.transform(_pieces(candidate, window), lambda p: _slide(p, window)["best"]))


def _candidates(text: Column) -> Column:
    """Array of (start, rank, end, kind) of high-entropy candidates."""

    def hot(x: Column) -> Column:
        allowed = F.lit(False)
        for p in ALLOW:
            allowed = allowed | x["whole"].rlike(p)
        return F.when(allowed, F.lit(False)).otherwise(F.exists(_pieces(x["whole"], WINDOW), lambda p: _slide(p, WINDOW, skip=True)["hot"]))

    found = _spans(F.filter(_located(text, CANDIDATE, 0), hot), "entropy")
    return F.when(text.rlike(CANDIDATE), found).otherwise(F.expr(f"cast(array() as {SPANS})"))


def _uncovered(spans: Column) -> Column:
    """Sorted spans without entropy spans that lie inside a base span: one that starts no later and ends no earlier."""
    ends = F.transform(spans, lambda x: F.when(x["kind"] != "entropy", x["end"]).otherwise(F.lit(0)))
    return _let(_let(ends, lambda e: _running(e, F.greatest)), lambda far: F.filter(spans, lambda x, i: (x["kind"] != "entropy") | (F.get(far, i) < x["end"])))


def secret_spans(docs: DataFrame, text_col: str = "text", into: str = "secret_spans") -> DataFrame:
    """The input with one more column: array of (start, rank, end, kind), in the order of starts, then kinds."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = F.array_sort(F.concat(*[_kind(text, *k) for k in BASE], _candidates(text)))
    return docs.withColumn(into, _let(found, lambda s: F.when(F.size(s) > 1, _uncovered(s)).otherwise(s)))


def _between(chunks: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a text in chunks of CHUNK code points."""

    def part(k: Column) -> Column:
        first = F.greatest(a - k * CHUNK, F.lit(0))
        return F.substring(F.get(chunks, k), first + 1, F.least(b - k * CHUNK, F.lit(CHUNK)) - first)

    return F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")), part), "")).otherwise(F.lit(""))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The input with every span in its text replaced by the mark; overlapping spans become one. Null text stays null."""
    found = unused(docs, "secret_spans")
    spans, text = F.col(found), F.col(f"`{text_col}`")

    def clean(chunks: Column, far: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(far, i - 1)).otherwise(F.lit(0))
        marked = F.transform(spans, lambda x, i: F.when(x["start"] >= before(i), F.concat(_between(chunks, before(i), x["start"]), F.lit(mark))))
        return F.concat(F.array_join(marked, ""), _between(chunks, F.element_at(far, -1), F.length(text)))

    ends = F.transform(spans, lambda x: x["end"])
    done = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), lambda c: _let(_let(ends, lambda e: _running(e, F.greatest)), lambda far: clean(c, far)))
    return secret_spans(docs, text_col, found).withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(text)).drop(found)


def op1_secret_scan(docs: DataFrame) -> DataFrame:
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return secret_spans(named).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter(spans, lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"), joined(spans).alias("spans"), count("entropy").alias("n_entropy"),
    )
