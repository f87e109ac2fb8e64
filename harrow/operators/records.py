"""Records as maps and JSON, look-ups by configured lists, and choices among attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.barrier import once
from ..functions.text import header_key


def context(df: DataFrame, columns: dict[str, Column], out: str = "context") -> DataFrame:
    """Add a map of all columns by their normalized names, overridden by ``columns``; NULL as ''. Of names that become one the last counts."""
    own = [x for c in df.columns for x in (header_key(F.lit(c)), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))]
    given = [x for n, v in columns.items() for x in (F.lit(n), F.coalesce(v.cast("string"), F.lit("")))]
    pairs = F.array(*[F.struct(k.alias("key"), v.alias("value")) for k, v in zip((own + given)[::2], (own + given)[1::2], strict=True)])
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return df.withColumn(out, F.map_from_entries(last))


def parsed_records(text: Column, schema: str, required: list[str]) -> Column:
    """A JSON object as a struct; NULL for anything but an object and for one that lacks a required field."""
    whole = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    is_object = text.rlike(r"(?s)^\s*\{.*\}\s*$") & whole.isNotNull()
    return F.when(is_object & F.coalesce(_all_there(whole, required), F.lit(True)), whole)


def _all_there(whole: Column, required: list[str]) -> Column | None:
    out = F.lit(True)
    for name in required:
        out = out & whole[name].isNotNull()
    return out


def clamped(value: Column) -> Column:
    """A number within 0 and 1; what is no number counts as 0."""
    number = value.try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(F.isnan(number), None).otherwise(number), F.lit(0.0))))


@F.pandas_udf(StringType())
def _two_decimals(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda x: "" if pd.isna(x) else f"{x:.2f}")


def two_decimals(value: Column) -> Column:
    """A number as text with two decimals, rounded from its exact binary value (the JVM rounds its decimal form); '' for NULL."""
    return once(_two_decimals)(value.cast("double"))


def cache_key(parts: list[Column], payload: dict[str, Column]) -> Column:
    """Parts joined by bars, and the SHA-256 of a payload's JSON with sorted names."""
    body = F.to_json(F.struct(*[payload[k].alias(k) for k in sorted(payload)]), {"ignoreNullFields": "false"})
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts], F.sha2(body, 256))


def listed(label: Column, options: list[tuple[str, tuple[str, ...]]], last_open: bool = False) -> Column:
    """The first option that lists ``label``; else the first (or last) one that lists ``*``; else NULL."""
    out = F.lit(None).cast("string")
    open_ones = [name for name, labels in options if "*" in labels]
    if open_ones:
        out = F.lit(open_ones[-1] if last_open else open_ones[0])
    for name, labels in reversed(options):
        out = F.when(label.isin(*labels), F.lit(name)).otherwise(out)
    return out


def all_listed(label: Column, options: list[tuple[str, tuple[str, ...]]]) -> Column:
    """All options that list ``label``, else all that list ``*``, as an array in their order."""
    exact = F.array_compact(F.array(*[F.when(label.isin(*labels), F.lit(name)) for name, labels in options]))
    rest = F.array(*[F.lit(name) for name, labels in options if "*" in labels]).cast("array<string>")
    return F.when(F.size(exact) > 0, exact).otherwise(rest)


def first_success(attempts: DataFrame, key: str, number: Column, success: Column, values: list[str]) -> DataFrame:
    """(key, attempt_no, values, found): of each key the first successful attempt, else the last one. Constant state for each key."""
    row = F.struct(number.alias("attempt_no"), *values)
    grouped = attempts.where(F.col(key).isNotNull() & number.isNotNull()).groupBy(key).agg(F.min(F.when(success, row)).alias("good"), F.max(row).alias("last"))
    pick = F.coalesce("good", "last")
    return grouped.select(key, *[pick[n].alias(n) for n in ("attempt_no", *values)], F.col("good").isNotNull().alias("found"))


def matched(requests: DataFrame, entries: DataFrame, key: str, order: str, values: list[str], missing: str = "not in the response") -> DataFrame:
    """Each request with the first entry (by ``order``) of its key, without regard to case; without one ``error`` says so."""
    folded = F.lower(F.trim(F.col(key)))
    row = F.struct(F.col(order).alias("_hw_o"), *values)
    first = entries.where(F.col(key).isNotNull()).groupBy(folded.alias("_hw_k")).agg(F.min(row).alias("_hw_r"))
    out = requests.join(first, folded == F.col("_hw_k"), "left")
    return out.select(*requests.columns, *[F.col(f"_hw_r.{v}").alias(v) for v in values], F.when(F.col("_hw_k").isNull(), missing).otherwise("").alias("error"))


def evidence_text(status: Column, digest: Column, evidence: Column, facts: Column) -> Column:
    """The text that may be judged: a digest with a letter or digit besides addresses, else (status ok) the distinct evidence; ''."""
    readable = F.regexp_replace(F.coalesce(digest, F.lit("")), r"https?://[^\s\]<>]+", "").rlike(r"[\p{L}\p{N}]")
    own = F.filter(F.coalesce(facts, F.array().cast("array<string>")), lambda f: f != "")
    joined = F.array_join(F.array_distinct(F.when(F.size(own) > 0, own).otherwise(F.filter(F.array(evidence), lambda e: e != ""))), "\n")
    return F.when(~F.coalesce(status.isin("ok", "no_signal", "redirect_mismatch"), F.lit(False)), "").when(readable, digest).when(status == "ok", joined).otherwise("")
