"""What is delivered: of the rows in order, those whose keys no earlier delivered row has used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def first_users(df: DataFrame, order: str, key_a: str, key_b: str) -> DataFrame:
    """(row, a, b): the rows that a walk by ``order`` (unique) takes, which takes a row unless its a or b is used already.

    A row that is passed over uses nothing up. Worked out in rounds, not row by row: of the
    rows still open, those that come first both for their a and for their b are taken, and all
    rows that share a key with them leave. Rows with equal keys are one to begin with. Only
    smallest rows of keys meet, so a key that holds a third of all rows costs its share of an
    aggregation and no more; a round's result is checkpointed.
    """
    rows = df.select(F.col(order).alias("row"), F.col(key_a).alias("a"), F.col(key_b).alias("b"))
    still = checkpointed(rows.where("row IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.min("row").alias("row")))
    taken = None
    while not still.isEmpty():
        by_a = still.groupBy("a").agg(F.min("row").alias("row"))
        by_b = still.groupBy("b").agg(F.min("row").alias("row"))
        now = checkpointed(by_a.join(by_b, "row").select("row", "a", "b"))
        taken = now if taken is None else taken.unionByName(now)
        still = checkpointed(still.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti"))
    return rows.limit(0) if taken is None else taken


def included_held(df: DataFrame, order: str, key_a: str, key_b: str, out: str = "status") -> DataFrame:
    """Add ``included`` for the rows that ``first_users`` takes, else ``held``; a row without order or key is held."""
    first = first_users(df, order, key_a, key_b).select(F.col("row").alias("_hw_row"))
    return df.join(first, F.col(order) == F.col("_hw_row"), "left").withColumn(out, F.when(F.col("_hw_row").isNotNull(), "included").otherwise("held")).drop("_hw_row")


def ledger(df: DataFrame, order: str, key_a: str, key_b: str, required: list[str], names: tuple[str, str] = ("email", "company")) -> DataFrame:
    """(order, status, reason) of every row in a delivery: ``included``, or ``held`` with the first reason that applies.

    Reasons: ``missing:`` and the first of the ``required`` columns that is blank, then
    ``used:`` and the first of ``names`` whose key an earlier delivered row has. A NULL key
    counts as missing. Rows are what they are whatever their order in the table.
    """
    blank = F.lit(None).cast("string")
    for column, label in reversed([*[(F.trim(F.col(c).cast("string")), c) for c in required], (F.col(key_a), names[0]), (F.col(key_b), names[1])]):
        blank = F.when(F.coalesce(column.cast("string"), F.lit("")) == "", F.lit(f"missing:{label}")).otherwise(blank)
    rows = df.select(F.col(order).alias("_hw_o"), F.col(key_a).alias("_hw_a"), F.col(key_b).alias("_hw_b"), blank.alias("_hw_why"))
    first = checkpointed(first_users(rows.where("_hw_why IS NULL"), "_hw_o", "_hw_a", "_hw_b"))
    by_a = first.select(F.col("a").alias("_hw_a"), F.col("row").alias("_hw_ra"))
    by_b = first.select(F.col("b").alias("_hw_b"), F.col("row").alias("_hw_rb"))
    held = rows.join(by_a, "_hw_a", "left").join(by_b, "_hw_b", "left")
    included = F.col("_hw_why").isNull() & F.col("_hw_ra").eqNullSafe(F.col("_hw_o"))
    used = F.when(F.col("_hw_ra") < F.col("_hw_o"), f"used:{names[0]}").when(F.col("_hw_rb") < F.col("_hw_o"), f"used:{names[1]}")
    reason = F.when(included, "").otherwise(F.coalesce("_hw_why", used, F.lit("missing:order")))
    return held.select(F.col("_hw_o").alias(order), F.when(included, "included").otherwise("held").alias("status"), reason.alias("reason"))
