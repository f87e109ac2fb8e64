"""Profiles, first and best rows by key, look-ups with expiry, and set operations on keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import is_blank
from ..functions.text import PLACEHOLDERS, plain
from .skew import join_counted


def profile(df: DataFrame, columns: list[str], domain: Column, email: Column) -> DataFrame:
    """One row: rows, blank values of each column, and how many domains and mail addresses there are and repeat.

    Distinct values are counted by their own aggregations, each with map-side combination.
    """
    base = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.count_if(is_blank(F.col(c))).alias(f"blank_{c}") for c in columns])

    def counts(key: Column, name: str) -> DataFrame:
        each = df.select(key.alias("k")).where("k <> ''").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_rows"), F.count(F.lit(1)).alias(f"unique_{name}s"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(f"repeated_{name}_rows"))

    one = F.lit(1).alias("_hw_one")
    out = base.select(one, "*")
    for key, name in ((domain, "domain"), (email, "email")):
        out = out.join(counts(key, name).select(one, "*"), "_hw_one")
    return out.drop("_hw_one")


def first_per_key(df: DataFrame, key: str, order: Column, values: list[str]) -> DataFrame:
    """One row per non-NULL key with the values of its first row by ``order`` (ties: smallest values)."""
    row = F.struct(order.alias("_hw_o"), *values)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("_hw_r")).select(key, *[F.col(f"_hw_r.{v}").alias(v) for v in values])


def with_winner(df: DataFrame, key: str, best: Column, row_id: str = "row_idx") -> DataFrame:
    """The rows of keys that occur more than once, with ``winner`` (the id with the largest ``best``) and ``copies``."""
    groups = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row_id, best).alias("winner"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return join_counted(df, groups, key)


def _micros(at: Column) -> Column:
    """Microseconds since 1970 of a time with or without zone (without: UTC session)."""
    return F.unix_micros(at.cast("timestamp"))


def latest_valid(entries: DataFrame, keys: list[str], stored_at: str, now: Column, ttl_hours: float, values: list[str]) -> DataFrame:
    """The latest entry of each key that is at most ``ttl_hours`` old; a negative time never expires."""
    valid = entries if ttl_hours < 0 else entries.where(_micros(now) - _micros(F.col(stored_at)) <= int(ttl_hours * 3_600_000_000))
    row = F.struct(stored_at, *values)
    return valid.groupBy(*keys).agg(F.max(row).alias("_hw_r")).select(*keys, F.col(f"_hw_r.{stored_at}").alias(stored_at), *[F.col(f"_hw_r.{v}").alias(v) for v in values])


def expired(entries: DataFrame, stored_at: str, now: Column, ttl_hours: float) -> DataFrame:
    """The entries that pruning would delete: older than the time, or without one."""
    age = _micros(now) - _micros(F.col(stored_at))
    return entries.where(age.isNull() | (age > int(ttl_hours * 3_600_000_000)))


def unpivoted(df: DataFrame, row_id: str, fields: list[tuple[str, float]]) -> DataFrame:
    """(row_id, pos, header, value, confidence) of the configured columns that hold more than a placeholder, in order."""
    cells = F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit(h).alias("header"), plain(F.col(h).cast("string")).alias("value"), F.lit(c).alias("confidence")) for i, (h, c) in enumerate(fields)])
    kept = F.filter(cells, lambda c: c["value"].isNotNull() & (c["value"] != "") & ~F.lower(c["value"]).isin(*PLACEHOLDERS))
    return df.select(row_id, F.inline(kept))


def pooled(df: DataFrame, label: Column, pools: list[tuple[str, tuple[str, ...]]], out: str = "pool") -> DataFrame:
    """Add the names of the variants whose labels include ``label``, else of those for ``*``; joined by commas."""
    exact = F.array_compact(F.array(*[F.when(label.isin(*labels), F.lit(name)) for name, labels in pools]))
    rest = F.array(*[F.lit(name) for name, labels in pools if "*" in labels]).cast("array<string>")
    return df.withColumn(out, F.array_join(F.when(F.size(exact) > 0, exact).otherwise(rest), ","))


def cached(df: DataFrame, path: str, namespace: str, key: Column, stored_at: Column) -> None:
    """Append entries to a cache in Parquet, one folder for each namespace: all columns, their key's SHA-256 and the time they were stored.

    An entry is never changed; ``latest_valid`` reads the latest one of a key.
    """
    entries = df.withColumns({"key_hash": F.sha2(key, 256), "stored_at": stored_at, "namespace": F.lit(namespace)})
    entries.write.mode("append").partitionBy("namespace").parquet(path)


def compacted(df: DataFrame, keys: list[str], stored_at: str) -> DataFrame:
    """The latest entry of each key of a cache, as one row with all columns."""
    row = F.struct(stored_at, *[c for c in df.columns if c != stored_at and c not in keys])
    return df.groupBy(*keys).agg(F.max(row).alias("_hw_r")).select(*keys, *[F.col(f"_hw_r.`{c}`").alias(c) for c in df.columns if c not in keys])
