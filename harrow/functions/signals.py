"""Sentences of a business about itself: shortened, and brought to a kind, a focus and an observation."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .barrier import once, settled
from .text import plain

#: Words that cannot end a shortened phrase, and a shortened clause.
WEAK_WORDS = ("a", "an", "and", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")
WEAK_CLAUSE_WORDS = ("a", "an", "and", "for", "in", "of", "or", "the", "to", "with")
#: Openings of a sentence, the observation's opening, the kind of signal, what the focus begins with.
OPENINGS = (
    (r"we\s+help\b", "your team helps", "audience", "helping "),
    (r"we\s+support\b", "your team supports", "audience", "supporting "),
    (r"we\s+provide\b", "your team provides", "service", ""),
    (r"we\s+offer\b", "your team offers", "product", ""),
    (r"we\s+work\s+with\b", "your team works with", "audience", "working with "),
    (r"we\s+speciali[sz]e\s+in\b", "your team specializes in", "specialism", ""),
    (r"our\s+(?:firm|company|team)\s+helps\b", "your team helps", "audience", "helping "),
    (r"our\s+(?:firm|company|team)\s+provides\b", "your team provides", "service", ""),
)
#: Verbs behind a company's name and the kinds they speak of, with what the focus begins with.
TEAM_VERBS = {
    "helps": ("audience", "helping "), "supports": ("audience", "supporting "), "serves": ("audience", "serving "), "offers": ("product", ""),
    "provides": ("service", ""), "advises": ("service", ""), "manages": ("service", ""), "builds": ("service", ""), "delivers": ("service", ""), "enables": ("service", ""),
}
_NAME_WORD = r"[A-Z][\p{L}\p{M}\p{N}_&'.-]+"
SIGNAL_TYPE = "struct<signal_type:string,focus:string,observation:string>"


@F.pandas_udf(StringType())
def _decoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda t: html.unescape(t) if t and "&" in t else t)


def plain_text(col: Column) -> Column:
    """As ``plain``, with character references decoded first (all of HTML's, in Arrow batches)."""
    return plain(F.regexp_replace(once(_decoded)(col), r"[\p{Z}\x{85}\x{1C}-\x{1F}]+", " "))


def _kept(words: Column, least: int, weak: tuple[str, ...], outer: str) -> Column:
    """How many of an array's words are left when weak ones are taken off its end, down to ``least``."""
    strong = F.transform(words, lambda w, i: F.when(F.lower(F.regexp_replace(w, f"^[{outer}]+|[{outer}]+$", "")).isin(*weak), 0).otherwise(i + 1))
    return F.least(F.size(words), F.greatest(F.lit(least), F.coalesce(F.array_max(strong), F.lit(0))))


def shortened(col: Column, most: int) -> Column:
    """The first ``most`` words without weak ones at the end (two words stay) and closing punctuation; a shorter text as it is."""
    words = F.filter(F.split(col, r"[\s\p{Z}]+"), lambda w: w != "")
    few = F.slice(words, 1, most)
    cut = F.regexp_replace(F.array_join(F.slice(few, F.lit(1), _kept(few, 2, WEAK_WORDS, ",;:.-")), " "), "[,;:.-]+$", "")
    return F.when(F.size(words) <= most, col).otherwise(cut)


def shortened_clause(col: Column, most: int = 15) -> Column:
    """A sentence of ``most`` words at most: itself, else its first clause of five words or more that fits, else its beginning."""
    text = F.regexp_replace(plain(col), "[.!?]+$", "")
    words = F.filter(F.split(text, r"[\s\p{Z}]+"), lambda w: w != "")
    clauses = F.transform(F.split(text, r"\s*(?:[;:]|\s+[–—]\s+|\s+(?:that|which|while|whereas)\s+)\s*"), lambda c: F.filter(F.split(plain(c), r"[\s\p{Z}]+"), lambda w: w != ""))
    fitting = F.filter(clauses, lambda c: F.size(c).between(5, most))
    few = F.slice(words, 1, most)
    cut = F.regexp_replace(F.array_join(F.slice(few, F.lit(1), _kept(few, 5, WEAK_CLAUSE_WORDS, ",;:-")), " "), "[,;:-]+$", "")
    return F.when(F.size(words) <= most, text).when(F.size(fitting) > 0, F.array_join(F.get(fitting, F.lit(0)), " ")).otherwise(cut)


def _rough(t: Column) -> Column:
    """(signal_type, focus, observation) of a tidied sentence, before shortening; the first form that it has."""

    def said(kind: str | Column, focus: Column, observation: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("signal_type"), focus.alias("focus"), observation.alias("observation"))

    def part(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(t, pattern, group)

    forms: list[tuple[str, Column]] = []
    for opening, begins, kind, prefix in OPENINGS:
        rest = part(f"(?i)^{opening}(.*)$")
        forms.append((f"(?i)^{opening}", said(kind, F.concat(F.lit(prefix), plain(rest)), F.concat(F.lit(begins), rest))))
    supplied = r"(?i)^supplier\s+(?:to|of)\s+(.+)$"
    forms.append((supplied, said("product", part(supplied), F.concat(F.lit("your team supplies "), part(supplied)))))
    helped = r"(?i)^discover\s+how\s+we\s+help\s+(.+)$"
    forms.append((helped, said("audience", F.concat(F.lit("helping "), part(helped)), F.concat(F.lit("your team helps "), part(helped)))))
    offered = r"(?i)^discover\s+(.+?)(?:\s+at\s+[A-Z].+|\s+in\s+[A-Z].+)$"
    forms.append((offered, said("product", part(offered), F.concat(F.lit("your team offers "), part(offered)))))
    provided = r"(?i)\b(?:ability\s+to\s+|designed\s+to\s+)?provides?\s+(.+)$"
    forms.append((provided, said("service", part(provided), F.concat(F.lit("your team provides "), part(provided)))))
    team = rf"^{_NAME_WORD}(?:\s+{_NAME_WORD}){{0,3}}\s+(?:{'|'.join(TEAM_VERBS)})\b"
    verb, rest = part(team.replace("(?:helps", "(helps")), part(rf"{team}(.*)$")
    kinds = F.create_map(*[F.lit(x) for v, (kind, _) in TEAM_VERBS.items() for x in (v, kind)])
    prefixes = F.create_map(*[F.lit(x) for v, (_, prefix) in TEAM_VERBS.items() for x in (v, prefix)])
    forms.append((team, said(F.try_element_at(kinds, verb), F.concat(F.try_element_at(prefixes, verb), plain(rest)), F.concat(F.lit("your team "), verb, rest))))
    described = r"(?i)^.+?\s+is\s+((?:an?|the)\s+.+?)(?:\s+that\b|\s+which\b|$)"
    description = shortened_clause(part(described))
    forms.append((described, said("positioning", F.regexp_replace(description, r"(?i)^(?:an?|the)\s+", ""), F.concat(F.lit("your team is "), description))))
    lowered = F.concat(F.lower(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))
    out = said("specialism", lowered, F.concat(F.lit("your site highlights "), lowered))
    for pattern, value in reversed(forms):
        out = F.when(t.rlike(pattern), value).otherwise(out)
    return F.when(t.isNotNull(), out)


def with_company_signal(df: DataFrame, text: str, out: str = "signal") -> DataFrame:
    """Add what a sentence says of a business: struct (signal_type, focus, observation); NULL for NULL.

    ``text`` has its character references decoded (see ``plain_text``). All in the JVM.
    """
    tidied = F.regexp_replace(F.regexp_replace(plain(F.col(text)), "[.!?]+$", ""), r"(?i)^(?:world[- ]class|premier|industry[- ]leading)\s+", "")
    held = df.withColumn("_hw_t", settled(tidied)).withColumn("_hw_r", settled(_rough(F.col("_hw_t"))))
    parts = {f"_hw_{p}": settled(shortened_clause(F.col(f"_hw_r.{p}"))) for p in ("focus", "observation")}
    held = held.withColumns(parts)
    signal = F.when(F.col("_hw_r").isNotNull(), F.struct(F.col("_hw_r.signal_type").alias("signal_type"), F.col("_hw_focus").alias("focus"), F.col("_hw_observation").alias("observation")))
    return held.withColumn(out, signal).drop("_hw_t", "_hw_r", "_hw_focus", "_hw_observation")
