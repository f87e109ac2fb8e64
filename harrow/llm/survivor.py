"""The best record of each group of duplicates, field by field, by reasoning on currency.

A field's value comes from the rows with the lowest trust rank of those that have one; of
these from the most current, then from the smallest row number. How current values are is a
partial order in each group:

* dated values follow each other by their times;
* from all dated rows of all groups it is learned how often one value came directly after
  another; a value precedes another if that was seen more often than the reverse. Between
  values of which one at least has no time, this precedence is the group's order.

The topologically latest values are those that none in the group follows (where precedence
runs in a circle, all of the circle). Of several the latest dated one counts, then the
smallest row.

No group is gathered: what all groups need are states of constant size, combined on the map
side; consecutive values are found in time buckets with their edges carried over; and the
orders of groups with undated rows are built by joins with the learned precedences, not by
comparing the rows of a group with each other. One plan serves all groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import range_bucket
from ..session import checkpointed
from .contact_forms import cut_off, real_text, with_contact

#: Rank of rows whose source is NULL or not in the list of sources.
NO_TRUST = 2**31 - 1


def prepared(leads: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with an e-mail: k (content of the e-mail), row_idx, trust, at, title and web (NULL unless real)."""
    rows = with_contact(leads, mail="_hw_k", web="_hw_web")
    trust = sources.where("list_source IS NOT NULL").groupBy(F.col("list_source").alias("_hw_source")).agg(F.min("trust_rank").cast("int").alias("_hw_trust"))
    rows = rows.where("_hw_k IS NOT NULL").join(F.broadcast(trust), F.col("list_source") == F.col("_hw_source"), "left")
    title = F.when(real_text(F.col("job_title")), F.regexp_replace(F.lower("job_title"), r"[^\p{L}\p{N}]+", " "))
    source = F.when(F.col("website").contains("@"), F.col("email")).otherwise(F.col("website"))
    web = F.when(~cut_off(source), F.col("_hw_web"))
    return rows.select(
        F.col("_hw_k").alias("k"), "row_idx", F.coalesce("_hw_trust", F.lit(NO_TRUST)).alias("trust"),
        F.unix_micros(F.col("updated_at").cast("timestamp")).alias("at"), title.alias("title"), web.alias("web"),
    )


def transitions(rows: DataFrame, value: str) -> DataFrame:
    """(before, after, n): how often ``after`` came directly after ``before`` among the dated rows of a group, by time and row."""
    dated = rows.where(F.col("at").isNotNull() & F.col(value).isNotNull()).select("k", "at", "row_idx", F.col(value).alias("v"))
    dated = dated.withColumn("b", range_bucket(rows, "at"))
    within = dated.select(F.lag("v").over(Window.partitionBy("k", "b").orderBy("at", "row_idx")).alias("before"), F.col("v").alias("after"))
    row = F.struct("at", "row_idx", "v")
    edges = dated.groupBy("k", "b").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    across = edges.select(F.lag("last.v").over(Window.partitionBy("k").orderBy("b")).alias("before"), F.col("first.v").alias("after"))
    return within.unionByName(across).where("before <> after").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def precedence(moves: DataFrame) -> DataFrame:
    """(before, after): the pairs that were seen more often in this order than in the other."""
    both = moves.unionByName(moves.select(F.col("after").alias("before"), F.col("before").alias("after"), (-F.col("n")).alias("n")))
    return both.groupBy("before", "after").agg(F.sum("n").alias("n")).where("n > 0").select("before", "after")


def _winner(kind: str, dated: bool) -> Column:
    """The smallest (trust, -time, row) of the rows with a value, dated or undated ones."""
    there = F.col(kind).isNotNull() & (F.col("at").isNotNull() if dated else F.col("at").isNull())
    return F.min(F.when(there, F.struct("trust", (-F.col("at")).alias("at"), "row_idx")))


def latest(rows: DataFrame, value: str, groups: DataFrame, before: DataFrame) -> DataFrame:
    """(k, row): the row of the topologically latest value in each of ``groups`` (k, trust), rows of that trust alone.

    ``before`` has the learned precedences. Values are nodes; of a value's rows the latest
    dated one stands for it, else the smallest.
    """
    late = F.coalesce(-F.col("at"), F.lit(2**63 - 1))
    nodes = rows.where(F.col(value).isNotNull()).join(groups, ["k", "trust"]).groupBy("k", F.col(value).alias("v")).agg(F.min(F.struct(late.alias("late"), "row_idx")).alias("r"))
    nodes = checkpointed(nodes.select("k", "v", "r.late", F.col("r.row_idx").alias("row_idx"), (F.col("r.late") == 2**63 - 1).alias("undated")))
    other = nodes.select("k", F.col("v").alias("after"), F.col("undated").alias("other_undated"))
    follows = nodes.join(before, F.col("v") == F.col("before")).drop("before").join(other, ["k", "after"]).where("undated OR other_undated")
    passed = follows.select("k", "v", F.lit(True).alias("passed")).distinct()
    # Of the dated values only the latest is not followed by another dated one; "late" sorts it first among them.
    marked = nodes.join(passed, ["k", "v"], "left").select("k", F.struct(F.coalesce("passed", F.lit(False)).alias("passed"), "late", "row_idx", "undated").alias("o"))
    sides = marked.groupBy("k").agg(F.min(F.when(~F.col("o.undated"), F.struct(F.col("o.late").alias("late"), F.col("o.row_idx").alias("row_idx"), F.col("o.passed").alias("passed")))).alias("d"), F.min(F.when(F.col("o.undated"), F.col("o"))).alias("u"))
    dated_stays = F.col("d").isNotNull() & (F.col("u").isNull() | ~F.col("d.passed") | F.col("u.passed"))
    return sides.select("k", F.when(dated_stays, F.col("d.row_idx")).otherwise(F.col("u.row_idx")).alias("row"))


def survivors(leads: DataFrame, sources: DataFrame) -> DataFrame:
    """(row_idx, title_row_idx, website_row_idx) of each group of two or more rows with the same e-mail.

    ``row_idx`` is the group's smallest; the others name the rows that supply a real title and
    website, 0 if no row of the group has one. Rows without an e-mail belong to no group; an
    empty table gives an empty result. Titles and websites are ties only on equal trust and
    time; then the smallest row_idx supplies them. Rows without a time take part by the learned
    order of values (see above).
    """
    rows = checkpointed(prepared(leads, sources))
    groups = rows.groupBy("k").agg(
        F.count(F.lit(1)).alias("size"), F.min("row_idx").alias("first"),
        *[_winner(kind, dated).alias(f"{kind}_{'d' if dated else 'u'}") for kind in ("title", "web") for dated in (True, False)],
    ).where("size > 1")
    groups = checkpointed(groups)
    out = groups
    for kind in ("title", "web"):
        d, u = F.col(f"{kind}_d"), F.col(f"{kind}_u")
        contested = groups.where(u.isNotNull() & (d.isNull() | (u["trust"] <= d["trust"]))).select("k", u["trust"].alias("trust"))
        ordered = latest(rows, kind, contested, precedence(transitions(rows, kind))).withColumnRenamed("row", f"{kind}_row")
        out = out.join(ordered, "k", "left")
    return out.select(F.col("first").alias("row_idx"), *[F.coalesce(f"{kind}_row", f"{kind}_d.row_idx", F.lit(0)).alias(name) for kind, name in (("title", "title_row_idx"), ("web", "website_row_idx"))])
