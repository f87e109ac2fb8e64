"""The queries of the training-data operators, by name: pN_... answers problem N.

``PATHS`` holds what a deployment may set: the tokenizer's file.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import boilerplate, encode, format_dedupe, names, packing, pii, residue, survivor, title_map

PATHS = {"tokenizer": os.environ.get("HARROW_TOKENIZER", encode.DEFAULT_FILE)}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return title_map.found_titles(table(spark, d, "leads"), table(spark, d, "title_hooks"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return title_map.unmatched_titles(table(spark, d, "leads"), table(spark, d, "title_hooks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.spelling_pairs(table(spark, d, "leads"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return names.spelling_classes(table(spark, d, "leads"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found_residue(table(spark, d, "fetch_results"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return format_dedupe.copy_pairs(table(spark, d, "leads"))


def p5_copies(spark: SparkSession, d: str) -> DataFrame:
    return format_dedupe.collapsed(table(spark, d, "leads")).select("row_idx", "copies")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "leads"), table(spark, d, "list_sources"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.found_main(table(spark, d, "fetch_results"), table(spark, d, "site_signals"))


def p7_text(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_text(table(spark, d, "fetch_results", ["fetch_id", "body"]), "body").select("fetch_id", "main_text")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.with_ids(table(spark, d, "documents", ["doc_id", "text"]), file=PATHS["tokenizer"]).select("doc_id", "ids")


def p9_tiers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_tiers(table(spark, d, "documents"), table(spark, d, "call_limits"), file=PATHS["tokenizer"])


def p9_each_capacity(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_each(table(spark, d, "documents"), table(spark, d, "call_limits"), file=PATHS["tokenizer"])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_items(table(spark, d, "documents"), table(spark, d, "leads", ["first_name", "last_name"]))


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "leads", ["first_name", "last_name"])
    return pii.with_masked(table(spark, d, "documents", ["doc_id", "text"]), people).select("doc_id", F.col("masked"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_classes, p3_found, p5_found, p5_copies, p6_found, p7_found, p7_text, p8_ids, p9_tiers, p9_each_capacity, p10_found, p10_masked)}
