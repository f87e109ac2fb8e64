"""Documents packed into calls of fixed capacities, measured in tokens.

Documents are routed to tiers: each goes to the smallest capacity that holds it whole; only
a text longer than the largest capacity is divided, into full calls and a rest. Tiers are
packed from the longest down. What a tier's own documents leave open is filled from shorter
tiers, largest fit first. Calls of a tier are dealt to step groups so that groups hold about
equally many tokens.

Sizes are whole numbers up to the largest capacity, so the packing is planned on their
histogram: at most as many numbers as the capacity, whatever the corpus. The plan is a list
of patterns (how many items of which sizes make a call) with how often each is used; it has
about as many entries as there are sizes, and is broadcast. Every document then finds its
call from its size and its rank among documents of that size. Ranks are counted in hashed
buckets with running offsets, so a size that a third of all documents share is ranked by
many tasks. Nothing depends on partitioning: the same corpus gives the same packing.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .encode import DEFAULT_FILE, with_size

#: Items that one ranking task gets on average at most.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class Tier:
    """A call kind: its id and its capacity in tokens."""

    limit_id: int
    capacity: int


@dataclass
class Pattern:
    """``times`` calls of one tier that each hold ``items`` (size: how many)."""

    tier: int
    items: dict[int, int]
    times: int

    @property
    def used(self) -> int:
        return sum(s * k for s, k in self.items.items())


def _filled(sizes: list[int], left: dict[int, int], gap: int) -> dict[int, int]:
    """Items that fill a gap: largest fit first, the last two chosen together for the fullest sum."""
    items: dict[int, int] = {}

    def free(s: int) -> int:
        return left[s] - items.get(s, 0)

    while gap > 0:
        i = bisect_right(sizes, gap) - 1
        while i >= 0 and free(sizes[i]) == 0:
            i -= 1
        if i < 0:
            break
        first = sizes[i]
        rest = gap - first
        j = bisect_right(sizes, rest) - 1
        while j >= 0 and free(sizes[j]) - (sizes[j] == first) <= 0:
            j -= 1
        best, pair = first + (sizes[j] if j >= 0 else 0), None
        if best < gap and (j < 0 or rest - sizes[j] < sizes[0]):
            # Nothing would fit any more: look for two sizes, or one, that leave less room.
            pair = _fullest_pair([s for s in sizes[: bisect_right(sizes, gap)] if free(s) > 0], free, gap, best)
        for s in pair or (first,):
            items[s] = items.get(s, 0) + 1
            gap -= s
    return items


def _fullest_pair(sizes: list[int], free, gap: int, least: int) -> tuple[int, int] | None:
    """Two items whose sum is the largest up to ``gap``, if above ``least``; each size with the largest that fits beside it."""
    there = np.array(sizes, dtype=np.int64)
    if not len(there):
        return None
    at = np.searchsorted(there, gap - there, side="right") - 1
    single = np.array([free(s) < 2 for s in sizes])
    at = np.where(single & (at == np.arange(len(there))), at - 1, at)  # an item does not go with itself
    sums = np.where(at >= 0, there + there[at], 0)
    k = int(sums.argmax())
    return (int(there[k]), int(there[at[k]])) if sums[k] > least else None


def plan(histogram: dict[int, int], tiers: list[Tier]) -> list[Pattern]:
    """Patterns that hold every item of a histogram (size: count), sizes being at most the largest capacity."""
    left = {s: n for s, n in histogram.items() if s > 0 and n > 0}
    sizes = sorted(left)
    order = sorted(tiers, key=lambda t: t.capacity)
    patterns: list[Pattern] = []
    for k in range(len(order) - 1, -1, -1):
        floor = order[k - 1].capacity if k else 0
        while sizes and sizes[-1] > floor:
            first = sizes[-1]
            left[first] -= 1
            items = _filled(sizes, left, order[k].capacity - first)
            left[first] += 1
            items[first] = items.get(first, 0) + 1
            times = min(left[s] // n for s, n in items.items())
            patterns.append(Pattern(k, items, times))
            for s, n in items.items():
                left[s] -= n * times
                if not left[s]:
                    sizes.remove(s)
    return patterns


def _slots(patterns: list[Pattern], tiers: list[Tier], group_calls: int) -> pd.DataFrame:
    """For each size the ranges of ranks and the calls they go to."""
    order = sorted(tiers, key=lambda t: t.capacity)
    rows, upto = [], {}
    for k, tier in enumerate(order):
        own = sorted((p for p in patterns if p.tier == k), key=lambda p: -p.used)
        calls = sum(p.times for p in own)
        groups = max(1, -(-calls // group_calls))
        base = 0
        for p in own:
            for s, n in sorted(p.items.items()):
                start = upto.get(s, 0)
                rows.append((s, start, base, p.times, tier.limit_id, groups))
                upto[s] = start + n * p.times
            base += p.times
    return pd.DataFrame(rows, columns=["size", "start", "base", "times", "limit_id", "groups"]).sort_values(["size", "start"], ignore_index=True)


def pack(sizes: DataFrame, tiers: list[Tier], doc_id: str = "doc_id", tokens: str = "tokens", group_calls: int = 8, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each document's call: limit_id, call_no (from 1 in its limit), step_group, doc_id, part_no, tokens.

    ``part_no`` is 1 unless the text is longer than the largest capacity; then its parts are
    full calls and a rest. A document of no tokens (NULL or empty text) takes no room: it comes
    out with NULL limit_id, call_no and step_group. Rows with equal or NULL ids are packed each
    for itself. An empty table gives an empty result. ``sizes`` is read more than once, so it
    should be stored.
    """
    if not tiers or min(t.capacity for t in tiers) < 1:
        raise ValueError("capacities must be positive")
    largest = max(t.capacity for t in tiers)
    base = sizes.select(F.col(doc_id).alias("doc_id"), F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias("t"))
    parts = base.where("t > 0").select("doc_id", "t", F.explode(F.sequence(F.lit(1), F.ceil(F.col("t") / largest).cast("int"))).alias("part_no"))
    items = parts.select("doc_id", "part_no", F.least(F.lit(largest), F.col("t") - (F.col("part_no") - 1) * F.lit(largest)).alias("size"))
    counted = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `largest` rows
    none = base.where("t = 0").select(
        F.lit(None).cast("int").alias("limit_id"), F.lit(None).cast("long").alias("call_no"), F.lit(None).cast("long").alias("step_group"),
        "doc_id", F.lit(1).alias("part_no"), F.lit(0).cast("long").alias("tokens"),
    )
    if not counted:
        return none
    table = _slots(plan(counted, tiers), tiers, group_calls)
    spark = sizes.sparkSession
    shared = spark.sparkContext.broadcast(table)
    # Only sizes of many items are cut into buckets, so the offsets are about as many as sizes, whatever the corpus.
    hot = [(s, -(-n // bucket_rows)) for s, n in counted.items() if n > bucket_rows]
    split = spark.createDataFrame(hot, "size long, buckets long")
    held = items.withColumn("size", F.col("size").cast("long")).join(F.broadcast(split), "size", "left")
    held = held.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part_no"), F.coalesce("buckets", F.lit(1))).cast("int")).drop("buckets")
    offsets = held.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = held.withColumn("within", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "part_no"))).join(offsets, ["size", "bucket"])
    ranked = ranked.select("doc_id", "part_no", F.col("size").cast("long").alias("size"), (F.col("before") + F.col("within") - 1).cast("long").alias("rank"))

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = shared.value
        start = slots["start"].to_numpy()
        keys = slots["size"].to_numpy().astype(np.int64) * (1 << 40) + start
        times, first = slots["times"].to_numpy(), slots["base"].to_numpy()
        limit, groups = slots["limit_id"].to_numpy(), slots["groups"].to_numpy()
        for part in parts:
            rank = part["rank"].to_numpy()
            at = np.searchsorted(keys, part["size"].to_numpy() * (1 << 40) + rank, side="right") - 1
            number = first[at] + (rank - start[at]) % times[at]
            turn, place = number // groups[at], number % groups[at]
            group = np.where(turn % 2 == 0, place, groups[at] - 1 - place)
            yield pd.DataFrame({"limit_id": limit[at].astype("int32"), "call_no": number + 1, "step_group": group + 1, "doc_id": part["doc_id"], "part_no": part["part_no"], "tokens": part["size"]})

    schema = f"limit_id int, call_no long, step_group long, doc_id {dict(base.dtypes)['doc_id']}, part_no int, tokens long"
    return ranked.mapInPandas(call, schema).unionByName(none)


def read_tiers(limits: DataFrame, bound: int = 1000) -> list[Tier]:
    """The call kinds of a limits table (bounded); rows without a positive capacity are passed over."""
    rows = limits.select("limit_id", "capacity_tokens").where("capacity_tokens > 0 AND limit_id IS NOT NULL").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} call kinds")
    return sorted((Tier(int(r.limit_id), int(r.capacity_tokens)) for r in rows), key=lambda t: (t.capacity, t.limit_id))


def token_sizes(documents: DataFrame, file: str = DEFAULT_FILE) -> DataFrame:
    """(doc_id, tokens) of every document, stored (checkpoint) so that texts are encoded once."""
    return checkpointed(with_size(documents.select("doc_id", "text"), file=file).select("doc_id", "tokens"))


def packed_tiers(documents: DataFrame, limits: DataFrame, file: str = DEFAULT_FILE) -> DataFrame:
    """Every document in one call of the tier that suits it, all capacities side by side."""
    return pack(token_sizes(documents, file), read_tiers(limits))


def packed_each(documents: DataFrame, limits: DataFrame, file: str = DEFAULT_FILE) -> DataFrame:
    """Every document in a call of each capacity: the corpus packed once for each kind of call."""
    sizes = token_sizes(documents, file)
    out = None
    for tier in read_tiers(limits):
        own = pack(sizes, [tier]).withColumn("limit_id", F.lit(tier.limit_id))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no call kind")
    return out
