"""Records that differ only in form, collapsed by progressive partition refinement.

Three levels, each finer and costlier than the one before, and each applied only
to rows in classes with several members at the level above:

1. length and letter classes of the two fields stripped of form,
2. their whole letter histogram (the sorted letters),
3. the parsed content of both fields.

A class is a hash; counts per class come from map-side combined aggregation, and
rows of a hot class are spread over tasks (see join_counted). Two rows are joined only
if their parsed contents are equal, so a coincidence of hashes cannot join them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import settled
from ..operators.skew import join_counted
from ..session import checkpointed
from .contact_forms import with_contact


def _stripped(email: Column, website: Column) -> Column:
    """The letters of both fields that no optional piece of an address (mailto:, http(s)://, www.) can bring in."""
    plain = F.lower(F.concat(email, website))
    plain = F.when(plain.contains("mailto:"), F.regexp_replace(plain, "mailto:", "")).otherwise(plain)
    return F.translate(F.regexp_replace(plain, "[^a-z]", ""), "htpsw", "")


def cheap_class(text: Column) -> Column:
    """Level 1 of the stripped fields: their length and how many letters of a few classes they have.

    Independent of form, of the order of parts and of the order of the two fields.
    """
    kinds = [F.length(F.translate(text, letters, "")) for letters in ("ae", "io", "bcd", "fg", "km", "ln", "ruv")]
    return F.xxhash64(F.length(text), *kinds)


def histogram_class(text: Column) -> Column:
    """Level 2: the stripped letters, sorted."""
    return F.xxhash64(F.array_join(F.array_sort(F.split(text, "")), ""))


def _several(df: DataFrame, key: str) -> DataFrame:
    """The rows of classes with two or more members."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return join_counted(df, counts.select(key), key)


def with_group(df: DataFrame, row_id: str = "row_idx", email: str = "email", website: str = "website") -> DataFrame:
    """(row_id, first_row, copies) of the rows that share email and website content with another row.

    ``first_row`` is the smallest row_id of the group and ``copies`` its number of rows.
    Rows with a NULL, blank or stand-in in either field belong to no group. A NULL row_id
    counts as a copy but never is the smallest. An empty table gives an empty result.
    """
    rows = df.select(F.col(row_id).alias("row_idx"), F.col(email).alias("email"), F.col(website).alias("website")).where("email IS NOT NULL AND website IS NOT NULL")
    letters = _stripped(F.col("email"), F.col("website"))
    level1 = _several(rows.withColumn("t", letters).select("row_idx", "email", "website", cheap_class(F.col("t")).alias("k1")), "k1").drop("k1")
    level1 = level1.withColumn("t", settled(letters)).select("row_idx", "email", "website", histogram_class(F.col("t")).alias("k2"))
    level2 = _several(checkpointed(level1), "k2")  # counted and joined: stripped and classed once
    # Parsing belongs above the joins; the test for NULL keys would else be pushed down to all rows.
    few = level2.select("row_idx", settled(F.col("email")).alias("email"), settled(F.col("website")).alias("website"))
    exact = with_contact(few, mail="mail", web="web").select("row_idx", F.concat(F.col("mail"), F.lit(" "), F.col("web")).alias("k3"))
    exact = checkpointed(exact.where("k3 IS NOT NULL"))  # the costliest key is worked out once
    groups = exact.groupBy("k3").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_row")).where("n > 1")
    return join_counted(exact, groups, "k3").select("row_idx", "first_row", F.col("n").alias("copies"))


def copy_pairs(df: DataFrame) -> DataFrame:
    """(row_idx_a, row_idx_b): the smallest row of each group with each other member."""
    return with_group(df).where("row_idx <> first_row").select(F.col("first_row").alias("row_idx_a"), F.col("row_idx").alias("row_idx_b"))


def collapsed(df: DataFrame, row_id: str = "row_idx") -> DataFrame:
    """One row per record with ``copies``: each group's smallest row, and every row of no group (1).

    All columns of ``df`` stay; ``copies`` replaces a column of that name.
    """
    groups = with_group(df, row_id=row_id)
    first = groups.where("row_idx = first_row").select(F.col("row_idx").alias("_hw_id"), F.col("copies").alias("_hw_copies"))
    other = groups.where("row_idx <> first_row").select(F.col("row_idx").alias("_hw_id"))
    kept = df.join(other, F.col(row_id) == F.col("_hw_id"), "left_anti")
    return kept.join(first, F.col(row_id) == F.col("_hw_id"), "left").withColumn("copies", F.coalesce("_hw_copies", F.lit(1))).drop("_hw_id", "_hw_copies")
