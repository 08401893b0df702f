"""The corpus operators' queries, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroid_clusters import OP11_SQL, op11_centroid_clusters
from .chat_format import OP9_SQL, op9_chat_format
from .common import table
from .curve_packing import op8_packing
from .fingerprint import op2_fingerprints
from .importance_sample import OP13_SQL, op13_importance_sample
from .jaccard_join import op6_jaccard_join
from .license_scan import op4_license_scan
from .main_text import op12_main_text
from .piece_transducer import op3_pieces
from .ppm_score import op5_lm_score
from .quality_rules import op10_quality_rules
from .secret_scan import op1_secret_scan
from .token_counts import op7_token_counts

Query = Callable[[SparkSession, str], DataFrame]


def _over_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scan": _over_documents(op1_secret_scan),
        "op2_fingerprints": _over_documents(op2_fingerprints),
        "op3_pieces": _over_documents(op3_pieces),
        "op4_license_scan": _over_documents(op4_license_scan),
        "op5_lm_score": _over_documents(op5_lm_score),
        "op6_jaccard_join": _over_documents(op6_jaccard_join),
        "op7_token_counts": _over_documents(op7_token_counts),
        "op8_packing": _over_documents(op8_packing),
        "op9_chat_format": lambda spark, sf_dir: op9_chat_format(table(spark, sf_dir, "conversations")),
        "op10_quality_rules": lambda spark, sf_dir: op10_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op11_centroid_clusters": lambda spark, sf_dir: op11_centroid_clusters(table(spark, sf_dir, "embeddings")),
        "op12_main_text": lambda spark, sf_dir: op12_main_text(table(spark, sf_dir, "pages")),
        "op13_importance_sample": lambda spark, sf_dir: op13_importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_chat_format": OP9_SQL, "op11_centroid_clusters": OP11_SQL, "op13_importance_sample": OP13_SQL}
