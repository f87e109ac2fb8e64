"""Values that stand for a missing value, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words typed in place of a missing value, lower case, without outer punctuation.
STAND_INS = (
    "n/a", "n.a", "na", "none", "null", "nil", "nan", "unknown", "tbd", "tba", "tbc", "x", "xx", "xxx",
    "to be confirmed", "to be announced", "to be determined", "not available", "not applicable",
    "not provided", "not known", "missing", "empty", "blank", "undefined", "no value", "no data",
)

#: White space and characters without width, for use inside a Java character class.
INVISIBLE = r"\s\p{Z}\p{Cf}\x{0085}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}"


def visible(col: Column) -> Column:
    """The text with outer white space, also invisible characters, removed; NULL stays NULL."""
    return F.regexp_replace(col, rf"\A[{INVISIBLE}]+|[{INVISIBLE}]+\z", "")


def is_blank(col: Column) -> Column:
    """True for NULL and for text without a visible character."""
    return col.isNull() | (visible(col) == "")


def is_stand_in(col: Column) -> Column:
    """True for blank text, text without a letter or digit, and the words of STAND_INS."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(col, rf"[{INVISIBLE}]+", " "), r"\A[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", ""))
    return col.isNull() | (bare == "") | bare.isin(*STAND_INS) | F.regexp_replace(bare, " ", "").isin(*[w.replace(" ", "") for w in STAND_INS])
