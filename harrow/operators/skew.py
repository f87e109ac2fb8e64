"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot above this fraction of all rows; so at most this many keys are hot.
HOT_KEYS = 1000


def attach_counted(big: DataFrame, counted: DataFrame, key: str, total: int, hot_keys: int = HOT_KEYS, count: str = "n") -> DataFrame:
    """Inner join of ``big`` with ``counted``, which has one row and the row count ``count`` per key.

    Keys that hold more than ``total / hot_keys`` rows are joined by broadcast: there are
    fewer than ``hot_keys`` of them whatever the data, so the broadcast has a proven bound
    and the rows of a hot key stay where they are. The others, each at most that small,
    are joined by hash. Rows with a NULL key have no partner and are left out.
    """
    limit = max(1, total // hot_keys)
    hot = counted.where(F.col(count) > limit)
    cold = counted.where(F.col(count) <= limit)
    marked = big.join(F.broadcast(hot.select(F.col(key), F.lit(True).alias("_hw_hot"))), key, "left")
    busy = marked.where("_hw_hot").drop("_hw_hot").join(F.broadcast(hot), key)
    rest = marked.where("_hw_hot IS NULL").drop("_hw_hot").join(cold, key)
    return busy.unionByName(rest)


def join_counted(big: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """Inner join of ``big`` with ``counted``, which has one row per key, by hash.

    Nothing is aggregated after the shuffle on the key, so adaptive execution may split the
    partition of a hot key among tasks (skew join); ``counted``'s one row is copied to each.
    That needs spark.sql.adaptive.skewJoin.enabled, on by default. Unlike attach_counted it
    evaluates ``big`` once, which matters where its columns are costly.
    """
    spark = big.sparkSession
    if spark.conf.get("spark.sql.adaptive.enabled") != "true" or spark.conf.get("spark.sql.adaptive.skewJoin.enabled") != "true":
        sizes = big.groupBy(key).agg(F.count(F.lit(1)).alias("_hw_n"))
        return attach_counted(big, counted.join(sizes, key), key, big.count(), count="_hw_n").drop("_hw_n")
    return big.join(counted, key)
