"""Prioritized rule tables: the first rule whose pattern a text matches."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest rule table; rules are configuration and become part of the plan.
MAX_RULES = 2_000


@dataclass(frozen=True)
class Rule:
    """Priority, pattern (searched without regard to case) and what the rule says."""

    priority: int
    pattern: str
    values: tuple[str, ...]


def read_rules(rules: DataFrame, values: list[str], priority: str = "priority", pattern: str = "title_pattern") -> list[Rule]:
    """The rules of a table by priority; a blank or invalid pattern, an empty table and one above MAX_RULES are errors."""
    rows = rules.select(priority, pattern, *values).limit(MAX_RULES + 1).collect()
    if not rows:
        raise ValueError("the rule table is empty")
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = []
    for r in rows:
        if r[0] is None or not (r[1] or "").strip():
            raise ValueError("a rule lacks its priority or pattern")
        re.compile(r[1])
        out.append(Rule(int(r[0]), r[1], tuple("" if v is None else str(v) for v in r[2:])))
    return sorted(out, key=lambda r: r.priority)


def first_rule(text: Column, rules: list[Rule]) -> Column:
    """The priority of the first matching rule; NULL if none matches. One chain of tests on each row: no join, no shuffle."""
    out = F.lit(None).cast("int")
    for rule in sorted(rules, key=lambda r: r.priority, reverse=True):
        out = F.when(text.rlike("(?i)" + rule.pattern), F.lit(rule.priority)).otherwise(out)
    return out


def with_rule(df: DataFrame, text: Column, rules: list[Rule], names: list[str]) -> DataFrame:
    """Add ``rule_priority`` and the matching rule's values as columns ``names`` (NULL without a match)."""
    found = df.withColumn("rule_priority", first_rule(text, rules))
    table = F.create_map(*[x for r in rules for x in (F.lit(r.priority), F.array(*map(F.lit, r.values)))])
    return found.withColumns({n: F.element_at(F.try_element_at(table, F.col("rule_priority")), i + 1) for i, n in enumerate(names)})
