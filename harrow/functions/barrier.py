"""Keeping costly expressions where they were put."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settled(col: Column) -> Column:
    """The same value as an expression that the optimizer neither moves below a join nor copies into a filter.

    The id is never negative, so the value is unchanged; not being deterministic it fixes the
    projection's place in the plan.
    """
    return F.when(F.monotonically_increasing_id() >= 0, col)


def once(udf):
    """The same Python function, not evaluated again in filters that the optimizer derives from its result."""
    return udf.asNondeterministic()
