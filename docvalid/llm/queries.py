"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, mixing, ngram_join, packing, pii, quality, sharding, substrings, toxicity, vptree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_quality": quality.op2_quality,
    "op3_nearest": vptree.op3_nearest,
    "op4_mixing": mixing.op4_mixing,
    "op5_packing": packing.op5_packing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pii": pii.op7_pii,
    "op8_sharding": sharding.op8_sharding,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_html_extraction": html_text.op10_html_extraction,
}

ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard_join": ngram_join.ORACLE_SQL, "op2_quality": quality.ORACLE_SQL, "op4_mixing": mixing.ORACLE_SQL, "op8_sharding": sharding.ORACLE_SQL}
