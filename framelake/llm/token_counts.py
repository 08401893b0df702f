"""Token counts: an exact histogram of encoded lengths and its suffix sums.

The histogram has one row for each length that occurs. With the number of documents at least that long and the tokens
in them, every context limit L is answered at once: tokens kept when texts are cut at L = tokens of the shorter ones
+ L * documents at least L long. Suffix sums are taken within blocks of lengths and over the blocks' totals, so no
task holds more than a block. The histogram is written once, as three passes read it: texts are encoded once.

Null or empty text: length 0. Repeated rows count each. An empty table gives an empty histogram. Other columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, staged

BLOCK = 1024
_encoders: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """The byte-level tokenizer of a rank file, once in each worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("lengths", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_lengths(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every document."""
    path = path or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(t)) for t in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return id_text(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs, docs_from, tokens_from, tokens_cut): the last three for the limit L = n_tokens are the
    documents with at least L tokens, the tokens in those, and all tokens left when every document is cut at L."""
    hist = staged(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("block", F.expr(f"n_tokens div {BLOCK}")))
    by = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each block of lengths
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.expr("n_docs * n_tokens")).alias("t"))
    total = blocks.agg(F.sum("t").alias("total"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(by), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(by), F.lit(0)).alias("tokens_after"))
    inner = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = hist.join(blocks, "block").crossJoin(F.broadcast(total))
    out = out.withColumn("docs_from", F.sum("n_docs").over(inner) + F.col("docs_after")).withColumn("tokens_from", F.sum(F.expr("n_docs * n_tokens")).over(inner) + F.col("tokens_after"))
    return out.select("n_tokens", "n_docs", "docs_from", "tokens_from", F.expr("total - tokens_from + n_tokens * docs_from").alias("tokens_cut"))


def cut_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens left for any list of limits, whether or not a document has that length."""
    rows = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit")
    return histogram.select("n_tokens", "n_docs", rows).groupBy("limit").agg(F.sum(F.expr("n_docs * least(n_tokens, limit)")).alias("tokens"), F.sum(F.expr("if(n_tokens > limit, n_docs, 0)")).alias("docs_cut"))


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """The least length L such that at least the share of all documents has L tokens or fewer."""
    total = histogram.agg(F.sum("n_docs").alias("total"))
    share = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    ranked = histogram.crossJoin(F.broadcast(total)).select("n_tokens", F.expr("total - docs_from + n_docs").alias("rank"), "total", share)
    return ranked.where(F.col("rank") >= F.col("share") * F.col("total")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op7_token_counts(docs: DataFrame) -> DataFrame:
    return length_histogram(token_lengths(docs))
