"""The queries of the general (not training-data) problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.row_parse import loaded_rows, rejected_rows
from ..sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected_rows(table(spark, d, "raw_leads"), table(spark, d, "lead_files"))


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    names = ["Email", "First name", "Last name", "Job title", "Company name", "Website"]
    return loaded_rows(table(spark, d, "raw_leads"), table(spark, d, "lead_files"), names)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p4_found": p4_found, "p4_loaded": p4_loaded}
