"""Short phrases for a business's focus: made from a sentence's focus, and checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .signals import shortened
from .text import lower_but_acronyms, name_leaks, tidy, words

#: Promotional words and their like.
PROMOTIONAL = r"(?i)\b(?:best|world[- ]class|industry[- ]leading|market[- ]leading|premier|unique|delicious|forward[- ]thinking|innovative|trusted|leading)\b"
TRAILING_PROMOTION = r"(?i)\s+with confidence\b"
SUPERLATIVE = r"(?i)\b(?:the\s+)?best\b"
#: What is taken out of a focus, in this order.
TAKEN_OUT = (
    r"(?i)\b(?:since|est(?:ablished)?\.?)\s+(?:18|19|20)\d{2}\b", r"(?i)(?:,?\s*(?:&|and)\s+more)\b", PROMOTIONAL, TRAILING_PROMOTION,
    r"(?i)^(?:helping|partner(?:ing)? with|supporting|working with|providing|offering|speciali[sz]ing in)\s+",
)
#: Forms that a made focus must not have, with their names, and the one it must have.
UNSAFE = (
    ("leading", r"(?i)^(?:[\"'“”]|we\b|our\b|your\b|my\b|i\b|so\b|for\b|from\b|has\b|have\b|is\b|are\b|was\b|were\b|what\b|why\b|where\b|when\b|whether\b|maybe\b|discover\b|get\b|an?\s+ability\b)"),
    ("sentence", r"(?i)\b(?:we|our|your|my|i|us|is|are|was|were|has|have|had|would|could|should|been|being|offers?|provides?|delivers?|serves?|help(?:s|ing)?|hear|located|focused|specifically|trusted|success)\b"),
    ("trailing", r"(?i)\b(?:a|an|and|about|by|for|from|in|inspired|of|on|or|our|specifically|the|their|to|with|your)\s*$"),
)
AMBIGUOUS_BUYER = r"(?i)^(?:business\s+)?(?:owners?|companies|businesses|customers)\s+with\s+.*\b(?:advice|advisory|planning|services?|solutions?|support|valuations?)\b"
SAFE_CATEGORY = (
    r"(?i)\b(?:accounting|advisory|advice|brokerage|bookkeeping|capital|consulting|construction|distribution|equipment|finance|financing|flooring|funding|investment|parts?|personal care|planning|platform|"
    r"printing|products?|remodeling|rentals?|restoration|services?|skincare|software|solutions?|systems?|tequila|tools?|valuation|valuations|wholesale)\b"
)
#: Words too vague to name a category.
VAGUE_WORDS = (
    "actionable", "advice", "advisory", "business", "businesses", "companies", "company", "expert", "general", "guidance", "help", "owner", "owners", "planning", "practical", "process", "processes",
    "professional", "service", "services", "solution", "solutions", "strategic", "support",
)
#: Beginnings of a phrase that names buyers.
BUYERS = (
    "buyers", "businesses", "companies", "customers", "distributors", "event planners", "firms", "founders", "homeowners", "investors", "laboratories", "manufacturers", "organisations", "organizations",
    "owners", "property owners", "retailers", "teams",
)


def generic_focus(col: Column, most: int) -> Column:
    """A focus cut to one category: struct (value, error); ``error`` is '' or ``superlative`` or ``thin``."""
    value = col
    for pattern in TAKEN_OUT:
        value = F.regexp_replace(value, pattern, "")
    first = F.regexp_extract(tidy(value), "^([^,;]*)", 1)
    one = F.regexp_replace(first, r"(?is)\s+(?:and|&)\s+.*$", "")
    made = lower_but_acronyms(shortened(tidy(one), most))
    error = F.when(col.rlike(SUPERLATIVE), "superlative").when(F.size(words(made)) < 2, "thin").otherwise("")
    return F.when(col.isNotNull(), F.struct(F.when(error == "", made).otherwise("").alias("value"), error.alias("error")))


def focus_flaw(company: Column, focus: Column) -> Column:
    """The first reason why a made focus is unsafe to use: name, leading, sentence, trailing, vague, buyer, category; '' if none."""
    specific = F.size(F.array_except(F.transform(words(focus), F.lower), F.array(*map(F.lit, VAGUE_WORDS)))) > 0
    out = F.when(name_leaks(F.coalesce(company, F.lit("")), focus), "name")
    for name, pattern in UNSAFE:
        out = out.when(focus.rlike(pattern), name)
    return F.when(focus.isNotNull(), out.when(~specific, "vague").when(focus.rlike(AMBIGUOUS_BUYER), "buyer").when(~focus.rlike(SAFE_CATEGORY), "category").otherwise(""))


def phrase_flaw(col: Column, most: int) -> Column:
    """The first reason why a phrase cannot be used: blank, long, filler, stacked, promotion; '' if none."""
    t = tidy(F.coalesce(col, F.lit("")))
    return (
        F.when(t == "", "blank")
        .when(F.size(words(t)) > most, "long")
        .when(F.lower(t).rlike("& more|and more|since 19|since 20"), "filler")
        .when(t.rlike("[,;]"), "stacked")
        .when(t.rlike(PROMOTIONAL) | t.rlike(TRAILING_PROMOTION), "promotion")
        .otherwise("")
    )


def buyer_phrase(kind: Column, focus: Column, most: int) -> Column:
    """Who buys: the focus itself if it begins with buyers, else buyers (of a product) or companies looking for it; shortened."""
    named = F.lower(focus).rlike("^(?:" + "|".join(BUYERS) + ")")
    return shortened(F.when(named, focus).otherwise(F.concat(F.when(kind == "product", F.lit("buyers looking for ")).otherwise(F.lit("companies looking for ")), focus)), most)


def has_long_dash(col: Column) -> Column:
    """Whether a text holds an em dash."""
    return F.coalesce(col.contains("—"), F.lit(False))
