"""Focus rules: what a fact says a business does, mapped by prioritized patterns, else cut to a category; and which fact counts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import settled
from ..functions.phrases import buyer_phrase, focus_flaw, generic_focus, phrase_flaw
from .rules import MAX_RULES

#: The columns of a rule table, the tiers, and the rule and priority of what no rule maps.
COLUMNS = ("id", "priority", "pattern", "signal_types", "fit_tier", "focus", "buyer_phrase")
TIERS = ("core", "secondary", "exclude")
GENERIC, GENERIC_PRIORITY = "generic-compression", 1_000_000
#: Most words of a rule's focus and buyer phrase.
RULE_WORDS = (12, 16)


@dataclass(frozen=True)
class FocusRule:
    """A pattern for facts of some kinds (``*``: all), the tier it gives, and its phrases."""

    rule_id: str
    priority: int
    pattern: str
    kinds: tuple[str, ...]
    tier: str
    focus: str
    buyer: str


def read_focus_rules(rules: DataFrame) -> list[FocusRule]:
    """The rules of a table with exactly COLUMNS (or those and ``position``), by priority, then position.

    An unknown or missing column, a blank or repeated id, a priority that is no whole number, a
    pattern that does not compile, no kinds, another tier, an unfit phrase, no rule at all or
    more than MAX_RULES are errors.
    """
    if set(rules.columns) - {"position"} != set(COLUMNS):
        raise ValueError("focus rules need exactly the columns " + ", ".join(COLUMNS))
    position = F.col("position") if "position" in rules.columns else F.monotonically_increasing_id()
    checked = rules.select(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in COLUMNS], position.alias("_hw_at"))
    checked = checked.withColumns({"_hw_focus": phrase_flaw(F.col("focus"), RULE_WORDS[0]), "_hw_buyer": phrase_flaw(F.col("buyer_phrase"), RULE_WORDS[1])})
    rows = checked.limit(MAX_RULES + 1).collect()
    if not 0 < len(rows) <= MAX_RULES:
        raise ValueError(f"there must be 1 to {MAX_RULES} focus rules")
    found: list[tuple[int, int, FocusRule]] = []
    for r in rows:
        kinds = tuple(k.strip() for k in r.signal_types.split(";") if k.strip())
        problems = [
            ("id", not r.id or any(f.rule_id == r.id for _, _, f in found)), ("priority", not re.fullmatch(r"[+-]?\d+", r.priority)), ("signal_types", not kinds),
            ("fit_tier", r.fit_tier.lower() not in TIERS), (f"focus ({r._hw_focus})", r._hw_focus != ""), (f"buyer_phrase ({r._hw_buyer})", r._hw_buyer != ""),
        ]
        if bad := [name for name, wrong in problems if wrong]:
            raise ValueError(f"focus rule '{r.id}': bad {', '.join(bad)}")
        re.compile(r.pattern)
        found.append((int(r.priority), r._hw_at, FocusRule(r.id, int(r.priority), r.pattern, kinds, r.fit_tier.lower(), r.focus, r.buyer_phrase)))
    return [f for _, _, f in sorted(found, key=lambda x: x[:2])]


def first_focus_rule(kind: Column, focus: Column, evidence: Column, rules: list[FocusRule]) -> Column:
    """The index of the first rule whose kinds hold the fact's and whose pattern is in its focus or evidence; NULL if none.

    One chain of tests on each row: no join of facts with rules, no shuffle. The company's name
    is never searched.
    """
    text = F.concat_ws(" | ", focus, evidence)
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        fits = text.rlike("(?i)" + rule.pattern)
        out = F.when(fits if "*" in rule.kinds else kind.isin(*rule.kinds) & fits, F.lit(i)).otherwise(out)
    return out


def resolved(facts: DataFrame, rules: list[FocusRule], focus_words: int = 12, buyer_words: int = 16, kind: str = "signal_type", focus: str = "focus", evidence: str = "evidence", company: str = "company_name", out: str = "resolved") -> DataFrame:
    """Add what a fact resolves to: struct (rule_id, priority, tier, focus, buyer, error).

    A fact that a rule maps takes its phrases; if they exceed the limits the fact fails, the next
    rule is not tried. Others are cut to one category and checked. ``error`` is '' or says
    what failed; the other fields of a failed fact are NULL.
    """
    index = first_focus_rule(F.col(kind), F.col(focus), F.col(evidence), rules)
    value = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("rule_id", "string"), ("priority", "int"), ("tier", "string"), ("focus", "string"), ("buyer", "string"))])
    table = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.priority).alias("priority"), F.lit(r.tier).alias("tier"), F.lit(r.focus).alias("focus"), F.lit(r.buyer).alias("buyer")) for r in rules])
    held = facts.withColumns({"_hw_rule": settled(index), "_hw_own": settled(generic_focus(F.col(focus), focus_words))})
    held = held.withColumn("_hw_cut", F.struct(F.lit(GENERIC).alias("rule_id"), F.lit(GENERIC_PRIORITY).alias("priority"), F.lit("exclude").alias("tier"), F.col("_hw_own.value").alias("focus"), buyer_phrase(F.col(kind), F.col("_hw_own.value"), buyer_words).alias("buyer")))
    made = F.col("_hw_rule").isNull()
    held = held.withColumn("_hw_is", F.when(made, F.col("_hw_cut")).otherwise(F.get(table, F.col("_hw_rule"))))
    flaw = F.coalesce(F.when(made, F.coalesce(F.nullif("_hw_own.error", F.lit("")), F.nullif(focus_flaw(F.col(company), F.col("_hw_is.focus")), F.lit("")))), F.nullif(F.concat(F.lit("focus "), F.nullif(phrase_flaw(F.col("_hw_is.focus"), focus_words), F.lit(""))), F.lit("")), F.nullif(F.concat(F.lit("buyer "), F.nullif(phrase_flaw(F.col("_hw_is.buyer"), buyer_words), F.lit(""))), F.lit("")), F.lit(""))
    held = held.withColumn("_hw_flaw", settled(flaw)).withColumn("_hw_is", F.when(F.col("_hw_flaw") == "", F.col("_hw_is")).otherwise(value))
    fields = [F.col(f"_hw_is.{n}").alias(n) for n in ("rule_id", "priority", "tier", "focus", "buyer")]
    return held.withColumn(out, F.struct(*fields, F.col("_hw_flaw").alias("error"))).drop("_hw_rule", "_hw_own", "_hw_cut", "_hw_is", "_hw_flaw")


def _first(items: Column, order) -> Column:
    """The item of an array with the smallest ``order``; NULL of an empty one."""
    return F.get(F.array_sort(F.transform(items, lambda c: F.struct(order(c).alias("o"), c.alias("c")))), F.lit(0))["c"]


def chosen(candidates: Column, website_there: Column, approved: list[str], agreeing: int = 2) -> Column:
    """Which of a row's candidates counts: struct (candidate, fields); both NULL and empty if none does.

    A candidate is a struct with at, source, confidence, rule_id, priority and tier. Facts of
    the website (mapped ones, else any) come first, by priority, confidence and place. Where a
    website was there but gave none, there is no choice. Else facts of approved input fields
    (``input:`` and the field's name) count whose rule is met by ``agreeing`` fields; else the first of all.
    ``fields`` are the input fields behind the choice. An array's few entries are looked at in their row.
    """
    own = F.filter(candidates, lambda c: ~c["source"].startswith("input:"))
    mapped = F.filter(own, lambda c: c["rule_id"] != GENERIC)
    by_rank = lambda c: F.struct(c["priority"], -c["confidence"], c["at"])
    field = lambda c: F.lower(F.regexp_replace(c["source"], "^input:", ""))
    inputs = F.filter(candidates, lambda c: c["source"].startswith("input:") & field(c).isin(*[a.lower() for a in approved]) & (c["rule_id"] != GENERIC) & (c["tier"] != "exclude"))
    rules = F.array_distinct(F.transform(inputs, lambda c: c["rule_id"]))
    groups = F.transform(rules, lambda rule: F.filter(inputs, lambda c: c["rule_id"] == rule))
    firm = F.filter(groups, lambda g: F.size(F.array_distinct(F.transform(g, lambda c: F.lower(c["source"])))) >= agreeing)
    group = _first(firm, lambda g: F.struct(F.array_min(F.transform(g, lambda c: c["at"])), F.array_min(F.transform(g, lambda c: c["priority"]))))
    by_place = lambda c: F.struct(c["at"], c["priority"])
    names = lambda g: F.array_distinct(F.transform(F.array_sort(F.transform(g, lambda c: F.struct(c["at"].alias("at"), c["source"].alias("source")))), lambda c: F.regexp_replace(c["source"], "^input:", "")))
    any_first = _first(candidates, by_place)
    none = F.array().cast("array<string>")

    def found(candidate: Column, fields: Column) -> Column:
        return F.struct(candidate.alias("candidate"), fields.alias("fields"))

    return (
        F.when(F.size(mapped) > 0, found(_first(mapped, by_rank), none))
        .when(F.size(own) > 0, found(_first(own, by_rank), none))
        .when(F.coalesce(website_there, F.lit(False)), found(F.when(F.lit(False), any_first), none))
        .when(F.size(firm) > 0, found(_first(group, by_place), names(group)))
        .otherwise(found(any_first, F.when(any_first["source"].startswith("input:"), F.array(F.regexp_replace(any_first["source"], "^input:", ""))).otherwise(none)))
    )


def corroborated(candidates: DataFrame, row_id: str, sources: int = 2) -> DataFrame:
    """(row_id, rule_id, n_sources) of the rules that facts of ``sources`` different columns of a row meet."""
    distinct = candidates.where("rule_id IS NOT NULL").groupBy(row_id, "rule_id", F.lower("source").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy(row_id, "rule_id").agg(F.count(F.lit(1)).alias("n_sources")).where(F.col("n_sources") >= sources)
