"""Corpus cleaning in four stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

In every stage a row stands or falls by its own text, whatever its id: ids may be missing or repeated, and other columns
pass through. An empty table gives an empty result. Whole texts are read, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import staged, table, unused
from framelake.llm.curve_packing import pack_along_curve
from framelake.llm.jaccard_join import jaccard_components
from framelake.llm.quality_rules import judge_quality
from framelake.llm.secret_scan import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Every row carries its own verdict, whatever its id. A null or empty text has
    no words and goes; a null language is a stratum of its own; repeated rows get one verdict each, all the same."""
    return judge_quality(docs, table(spark, sf_dir, "labels"), carry=True).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by shingle likeness: the one with the least id (none comes last), then by its text.

    Rows are linked by a key of their own, written with them, so that an id may be missing or repeated. Repeated rows are
    copies, of which one stays; null and empty texts are linked with nothing, so all of them stay."""
    key = unused(docs, "row")
    rows = staged(docs.withColumn(key, F.monotonically_increasing_id()))
    linked = jaccard_components(rows, id_col=key).select(F.col("doc_id").alias(key), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text"), F.col(key).alias("row"))
    first = rows.select(key, order.alias("place")).join(linked, key).groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.row").alias(key))
    return rows.join(first, key, "left_semi").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; a null text stays null. n_chars is that of the new text."""
    done = redact(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens along the curve; a null or empty text is its end id, and repeated rows are packed
    each by itself."""
    return pack_along_curve(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("packing", packing)]

#: Shingle joins, fitted cutoffs and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
