"""Ranks within groups of any size, running totals and assignments built on them.

A plain window over a group runs in one task, which a hot group (or no group at all) would
overfill. Here rows are first put into ordered buckets of bounded size; only bucket counts are
accumulated per group, and rows are numbered inside (group, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that share a bucket, on average.
BUCKET_ROWS = 50_000


def range_bucket(df: DataFrame, order: str, rows: int = BUCKET_ROWS) -> Column:
    """The number of a row's bucket by a whole-number column, NULL last: buckets of equal width, ``rows`` rows each on average.

    The width follows from the column's range over ``df`` (scalar subqueries: one pass, which
    for stored columns reads that column alone), so the number of buckets, which the running
    sums go over, is that of the rows divided by ``rows`` even if numbers are sparse.
    """
    value = F.col(order).cast("decimal(20,0)")
    facts = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n"))
    width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) * rows / F.greatest(F.col("n"), F.lit(1))))
    both = facts.select(F.struct(F.coalesce("lo", F.lit(0)).cast("decimal(20,0)").alias("lo"), F.coalesce(width, F.lit(1)).cast("decimal(20,0)").alias("width")).alias("f")).scalar()
    return F.coalesce(F.floor((value - both["lo"]) / both["width"]).cast("long"), F.lit(2**62))


def ranked(df: DataFrame, group: list[str], bucket: list[Column], order: list[Column], out: str = "rank", size: str | None = None) -> DataFrame:
    """Add the rank (from 1) of each row in its group by (bucket..., order...); ``size`` also adds the group's row count.

    ``bucket`` columns must come before ``order`` in the wanted order and cut groups into pieces
    that one task can hold. Ties must be broken by ``order``.
    """
    names = [f"_hw_b{i}" for i in range(len(bucket))]
    held = df.withColumns(dict(zip(names, bucket, strict=True)))
    per_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    counts = held.groupBy(*group, *names).agg(F.count(F.lit(1)).alias("_hw_n"))
    before = F.sum("_hw_n").over(per_group.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_hw_before", F.coalesce(before, F.lit(0)))
    if size:
        offsets = offsets.withColumn(size, F.sum("_hw_n").over(per_group))
    keys = [*group, *names]
    right = offsets.drop("_hw_n").select(*[F.col(k).alias(f"_hw_r_{k}") for k in keys], "_hw_before", *([size] if size else []))
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    same = [F.col(k).eqNullSafe(F.col(f"_hw_r_{k}")) for k in keys]
    joined = held.withColumn("_hw_in", inner).join(right, same)
    return joined.withColumn(out, (F.col("_hw_before") + F.col("_hw_in")).cast("long")).drop(*names, *[f"_hw_r_{k}" for k in keys], "_hw_before", "_hw_in")


def balanced(keys: DataFrame, key: str, salt: str, n: Column | int, group: list[str] | None = None, out: str = "variant") -> DataFrame:
    """Deal keys to ``n`` variants (0 to n-1) in the order of their salted SHA-256, so that counts differ by one at most.

    ``keys`` has one row per key. The result depends neither on row order nor on partitioning.
    The first three hex digits of the hash are the bucket: 4096 a group.
    """
    hashed = keys.withColumn("_hw_h", F.sha2(F.concat(F.lit(salt), F.col(key)), 256))
    placed = ranked(hashed, group or [], [F.substring("_hw_h", 1, 3)], [F.col("_hw_h")], out="_hw_k")
    return placed.withColumn(out, ((F.col("_hw_k") - 1) % (F.lit(n) if isinstance(n, int) else n)).cast("int")).drop("_hw_h", "_hw_k")


def overflow(pairs: DataFrame, value: str, key: str, salt: str, allowed: int) -> DataFrame:
    """The (value, key) pairs beyond ``allowed`` (one at least) for each value, in the order of a salted SHA-256."""
    hashed = pairs.select(value, key).distinct().withColumn("_hw_h", F.sha2(F.concat(F.lit(salt), F.col(value), F.lit(":"), F.col(key)), 256))
    placed = ranked(hashed, [value], [F.substring("_hw_h", 1, 3)], [F.col("_hw_h")], out="_hw_k")
    return placed.where(F.col("_hw_k") > max(allowed, 1)).select(value, key)


def running_total(df: DataFrame, seq: str, amount: Column, out: str = "total", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add the sum of ``amount`` over all rows up to this one by ``seq`` (unique whole numbers); amounts must be integers."""
    held = df.withColumns({"_hw_a": amount, "_hw_b": range_bucket(df, seq, bucket_rows)})
    totals = held.groupBy("_hw_b").agg(F.sum("_hw_a").alias("_hw_s"))
    before = F.coalesce(F.sum("_hw_s").over(Window.partitionBy(F.lit(0)).orderBy("_hw_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    right = totals.select(F.col("_hw_b").alias("_hw_rb"), before.alias("_hw_before"))
    inner = F.sum("_hw_a").over(Window.partitionBy("_hw_b").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    joined = held.withColumn("_hw_in", inner).join(right, F.col("_hw_b") == F.col("_hw_rb"))
    return joined.withColumn(out, F.col("_hw_before") + F.col("_hw_in")).drop("_hw_a", "_hw_b", "_hw_rb", "_hw_before", "_hw_in")


def split_total(df: DataFrame, group: list[str], order: str, total: int, out: str = "share", over: DataFrame | None = None) -> DataFrame:
    """Deal ``total`` whole units to the rows of each group; the first rows by ``order`` get what does not divide.

    ``over`` may be a cheaper table with about the same range of ``order`` (see ``range_bucket``).
    """
    placed = ranked(df, group, [range_bucket(df if over is None else over, order)], [F.col(order)], out="_hw_k", size="_hw_size")
    share = F.floor(F.lit(total) / F.col("_hw_size")) + F.when(F.col("_hw_k") <= F.lit(total) % F.col("_hw_size"), 1).otherwise(0)
    return placed.withColumn(out, share.cast("long")).drop("_hw_k", "_hw_size")


def chunked(df: DataFrame, order: str, per_call: int, calls_per_wave: int, over: DataFrame | None = None) -> DataFrame:
    """Add ``call_no`` and ``wave_no`` (from 1): rows by ``order`` in calls of a size, calls in waves of a size.

    ``over`` may be a cheaper table with about the same range of ``order`` (see ``range_bucket``).
    """
    placed = ranked(df, [], [range_bucket(df if over is None else over, order)], [F.col(order)], out="_hw_k")
    call = F.floor((F.col("_hw_k") - 1) / per_call)
    return placed.withColumns({"call_no": (call + 1).cast("long"), "wave_no": (F.floor(call / calls_per_wave) + 1).cast("long")}).drop("_hw_k")
