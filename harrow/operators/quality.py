"""Whether a batch repeats itself: shares of values over keys, what exceeds them, and the rows that are flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .skew import join_counted
from .tables import first_per_key


def representatives(df: DataFrame, key: str, order: str, values: dict[str, Column]) -> DataFrame:
    """(key, values): the first row of each non-blank key stands for it."""
    held = df.where(F.col(key) != "").select(key, order, *[v.alias(n) for n, v in values.items()])
    return first_per_key(held, key, F.col(order), list(values))


def value_shares(keys: DataFrame, key: str, limits: dict[str, float]) -> DataFrame:
    """(kind, value, n, total, allowed): for each kind (a column of ``keys``) its non-blank values, lower case, with their
    number of keys, the number of all keys, and how many keys the kind's share limit allows.

    ``keys`` has one row for each key. Kinds are unpivoted, so all are counted in one aggregation.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.lower(F.col(k)).alias("value"), F.lit(float(v)).alias("cap")) for k, v in limits.items()])
    counts = keys.select(F.inline(cells)).where("value <> ''").groupBy("kind", "value", "cap").agg(F.count(F.lit(1)).alias("n"))
    total = keys.agg(F.count(F.lit(1)).alias("total")).scalar()
    held = counts.withColumn("total", total)
    return held.select("kind", "value", "n", "total", F.floor(F.col("total") * F.col("cap")).cast("long").alias("allowed"), (F.col("n") / F.col("total") > F.col("cap")).alias("over"))


def pitch_capacity(keys: DataFrame, value: str, angle: str, templates: dict[str, int], limit: float, kind: str = "exact-pitch") -> DataFrame:
    """As ``value_shares`` for exact repetitions: allowed is what the limit gives or, if more, the share of one of the
    templates that the value's angle has. Angles are a configured list and those without templates count as one.

    A value's angle is that of its first key.
    """
    own = keys.where(F.col(value) != "").select("key", F.lower(F.col(value)).alias("value"), F.coalesce(F.col(angle), F.lit("")).alias("angle"))
    counts = own.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min_by("angle", "key").alias("angle"))
    angles = keys.groupBy(F.coalesce(F.col(angle), F.lit("")).alias("angle")).agg(F.count(F.lit(1)).alias("angle_keys"))
    total = keys.agg(F.count(F.lit(1)).alias("total")).scalar()
    number = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in templates.items() for x in pair]), F.col("angle")), F.lit(1)) if templates else F.lit(1)
    share = F.ceil(F.col("angle_keys") / F.greatest(number, F.lit(1)))
    held = counts.join(angles, "angle").withColumn("total", total)
    held = held.withColumn("allowed", F.greatest(F.floor(F.col("total") * limit + 1e-12), share).cast("long"))
    return held.select(F.lit(kind).alias("kind"), "value", "n", "total", "allowed", (F.col("n") > F.greatest("allowed", F.lit(1))).alias("over"))


def overflow_keys(keys: DataFrame, key: str, kinds: dict[str, str], shares: DataFrame) -> DataFrame:
    """(key, kind, value) beyond what ``shares`` allows (one at least) for values that are over, in the order of a salted SHA-256.

    ``kinds`` gives the column of each kind. Only keys of such values are ranked, in buckets by their hash.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.lower(F.col(c)).alias("value")) for k, c in kinds.items()])
    over = shares.where("over").select("kind", "value", F.greatest("allowed", F.lit(1)).alias("_hw_allowed"))
    cells_of = keys.select(key, F.inline(cells)).where("value <> ''")
    pairs = cells_of.join(over, ["kind", "value"])
    hashed = pairs.withColumn("_hw_h", F.sha2(F.concat(F.lit("quality-overflow:"), "kind", F.lit(":"), "value", F.lit(":"), key), 256))
    placed = ranked(hashed, ["kind", "value"], [F.substring("_hw_h", 1, 3)], [F.col("_hw_h")], out="_hw_k")
    return placed.where("_hw_k > _hw_allowed").select(key, "kind", "value")


def flagged(df: DataFrame, key: str, overflow: DataFrame, order: list[str], out: str = "flags") -> DataFrame:
    """The rows of ``df`` whose key has an overflow, with the kinds that do, in the given order, joined by ``; ``.

    A key has as many flags as kinds at most; a hot key's rows are not gathered.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    flags = overflow.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct(place.alias("p"), "kind"))), lambda x: x["kind"]), "; ").alias(out))
    return join_counted(df, flags, key)
