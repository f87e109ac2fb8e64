"""Signals, phrases, focus rules, choices, shares and deliveries against written-down results and plain walks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from harrow.functions.phrases import buyer_phrase, focus_flaw, generic_focus, phrase_flaw
from harrow.functions.signals import plain_text, shortened, with_company_signal
from harrow.operators.delivery import first_users, ledger
from harrow.operators.focus import chosen, read_focus_rules, resolved
from harrow.operators.quality import overflow_keys, value_shares
from harrow.operators.ranks import range_bucket, ranked
from harrow.operators.tables import cached, compacted
from harrow.functions.text import unfenced
from harrow.operators.records import clamped, first_success, listed, parsed_records, two_decimals

SIGNALS = {
    "We help hotels find staff.": ("audience", "helping hotels find staff", "your team helps hotels find staff"),
    "We offer tinned pulses": ("product", "tinned pulses", "your team offers tinned pulses"),
    "Our company provides loft conversions!": ("service", "loft conversions", "your team provides loft conversions"),
    "Supplier of pallets to farms": ("product", "pallets to farms", "your team supplies pallets to farms"),
    "Discover how we help bakers": ("audience", "helping bakers", "your team helps bakers"),
    "Discover fresh bread at Acme": ("product", "fresh bread", "your team offers fresh bread"),
    "A tool designed to provide payroll runs": ("service", "payroll runs", "your team provides payroll runs"),
    "Acme Foods serves schools": ("audience", "serving schools", "your team serves schools"),
    "Acme builds vans": ("service", "vans", "your team builds vans"),
    "Acme is a maker of vans that last": ("positioning", "maker of vans", "your team is a maker of vans"),
    "Premier Vans and more": ("specialism", "vans and more", "your site highlights vans and more"),
    "": ("specialism", "", "your site highlights"),
}


def test_signals(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*SIGNALS, None])], "i int, t string, signal_type string")
    got = [r.s for r in with_company_signal(df, "t", "s").orderBy("i").collect()]
    assert [tuple(s) if s else None for s in got] == [*SIGNALS.values(), None]
    long = spark.createDataFrame([("We help " + "hotels find staff and keep them for years, " * 5000,), ("we help " + "one two three four five six seven eight; " * 3,)], "t string")
    assert [len(r.s.focus.split()) <= 15 for r in with_company_signal(long, "t", "s").collect()] == [True, True]


def test_phrases(spark):
    cases = {
        "We support Cold Storage since 1998, and more": ("we support cold storage", "leading"), "Helping IT Consulting and payroll": ("IT consulting", ""), "the best vans": (None, None), "vans": (None, None),
        "owners with sound advice": ("owners with sound advice", "buyer"), "general support services": ("general support services", "vague"), "green hats": ("green hats", "category"),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").withColumn("g", generic_focus(F.col("t"), 6))
    rows = df.select("i", "g", focus_flaw(F.lit(None).cast("string"), F.col("g.value")).alias("f")).orderBy("i").collect()
    assert [(r.g.value or None, r.f if r.g.value else None) for r in rows] == list(cases.values())
    one = spark.range(1)
    flaws = [one.select(phrase_flaw(F.lit(t).cast("string"), 4).alias("f")).first().f for t in (None, " .", "a b c d e", "vans and more", "a, b", "trusted vans", "vans")]
    assert flaws == ["blank", "blank", "long", "filler", "stacked", "promotion", ""]
    said = one.select(buyer_phrase(F.lit("product"), F.lit("old vans"), 9).alias("a"), buyer_phrase(F.lit("x"), F.lit("old vans of the"), 5).alias("b"), buyer_phrase(F.lit("x"), F.lit("Teams at sea"), 5).alias("c"), shortened(F.lit("one two of the"), 3).alias("d")).first()
    assert tuple(said) == ("buyers looking for old vans", "companies looking for old vans", "Teams at sea", "one two")
    assert one.select(plain_text(F.lit(" a&nbsp;&eacute; |")).alias("t")).first().t == "a é"


RULE = "position int, id string, priority string, pattern string, signal_types string, fit_tier string, focus string, buyer_phrase string"
RULES = [(0, "late", "20", "van", "*", "core", "vans", "van buyers"), (1, "first", "10", "van", "product", "Secondary", "one two three four", "buyers"), (2, "same", "20", "van", "*", "exclude", "others", "others")]


def test_focus_rules(spark):
    rules = read_focus_rules(spark.createDataFrame(RULES, RULE))
    assert [r.rule_id for r in rules] == ["first", "late", "same"]
    for i, bad in ((1, ""), (1, "first"), (2, "x"), (4, " ; "), (5, "best"), (6, "a, b"), (7, "")):
        row = list(RULES[0])
        row[i] = bad
        with pytest.raises(ValueError):
            read_focus_rules(spark.createDataFrame([RULES[1], tuple(row)], RULE))
    with pytest.raises(ValueError):
        read_focus_rules(spark.createDataFrame(RULES, RULE).drop("focus"))
    facts = [(1, "service", "old VANS", "x", None, "clash"), (2, "product", "x", "a van", None, ""), (3, "audience", "cold storage systems", None, "Acme", ""), (4, None, None, None, None, None)]
    df = spark.createDataFrame(facts, "i int, signal_type string, focus string, evidence string, company_name string, tier string")
    got = {r.i: r.resolved for r in resolved(df, rules, focus_words=3).collect()}
    assert (got[1].rule_id, got[1].tier, got[1].error) == ("late", "core", "")
    assert (got[2].rule_id, got[2].error) == (None, "focus long")  # a mapped fact that fails is not passed to the next rule
    assert (got[3].rule_id, got[3].focus, got[3].buyer, got[3].priority) == ("generic-compression", "cold storage systems", "companies looking for cold storage systems", 1_000_000)
    assert got[4].rule_id is None


def test_choice(spark):
    none, kind = [], "i int, there boolean, c array<struct<at:int,source:string,confidence:double,rule_id:string,priority:int,tier:string>>"
    site, generic, a, b, c = (0, "web", 0.5, "r", 5, "core"), (1, "web", 0.9, "generic-compression", 9, "exclude"), (2, "input:A", 0.5, "q", 7, "core"), (3, "input:B", 0.5, "q", 7, "core"), (4, "input:C", 0.5, "p", 1, "core")
    rows = [(1, True, [generic, site, a]), (2, True, [generic, a, b]), (3, True, [a, b]), (4, False, [c, b, a]), (5, None, [c, a]), (6, False, none), (7, False, None), (8, False, [a, (5, "input:a", 0.5, "q", 7, "core")])]
    got = {r.i: ((r.p.candidate or {"source": None})["source"], r.p.fields) for r in spark.createDataFrame(rows, kind).withColumn("p", chosen(F.col("c"), F.col("there"), ["a", "b", "C"])).collect() if r.p}
    assert got[1] == ("web", []) and got[2] == ("web", []) and got[3] == (None, []) and got[4] == ("input:A", ["A", "B"]) and got[5] == ("input:A", ["A"]) and got[6][0] is None and got[8][0] == "input:A"


def test_deliveries_follow_the_walk(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([f"m{rng.randrange(60)}", None]) if rng.random() < 0.1 else f"m{rng.randrange(60)}", "hot" if rng.random() < 0.3 else f"d{rng.randrange(40)}", rng.choice(["x", "x", "x", " "])) for i in range(400)]
    mails, hosts, taken, why = set(), set(), [], {}
    for i, m, h, x in rows:
        why[i] = "missing:x" if x == " " else "missing:email" if m is None else "used:email" if m in mails else "used:company" if h in hosts else ""
        if not why[i]:
            mails.add(m)
            hosts.add(h)
            taken.append(i)
    df = spark.createDataFrame(rows, "i long, m string, h string, x string")
    assert {r.i: (r.status, r.reason) for r in ledger(df, "i", "m", "h", ["x"]).collect()} == {i: ("held" if w else "included", w) for i, w in why.items()}
    assert sorted(r.row for r in first_users(df.where("x = 'x'"), "i", "m", "h").collect()) == taken
    assert first_users(df.limit(0), "i", "m", "h").count() == 0


def test_shares_and_overflow(spark):
    keys = spark.createDataFrame([(f"k{i:02d}", "Big" if i < 6 else f"v{i}", None if i % 2 else " x") for i in range(10)], "key string, a string, b string")
    shares = value_shares(keys, "key", {"a": 0.35, "b": 0.9})
    assert {(r.kind, r.value, r.n, r.allowed) for r in shares.where("over").collect()} == {("a", "big", 6, 3)}
    over = overflow_keys(keys, "key", {"a": "a"}, shares)
    assert over.count() == 3 and set(r.key for r in over.collect()) < {f"k{i:02d}" for i in range(6)}


def test_records(spark):
    one = spark.range(1)
    texts = ["{\"a\": 1, \"b\": \"x\"}", "{\"b\": \"x\"}", "[1]", "{broken", "3", "", None]
    got = [one.select(parsed_records(F.lit(t).cast("string"), "a int, b string", ["a"]).alias("r")).first().r for t in texts]
    assert [r and tuple(r) for r in got] == [(1, "x"), None, None, None, None, None, None]
    assert [one.select(clamped(F.lit(v).cast("string")).alias("v")).first().v for v in ("0.5", "7", "-1", "x", None, "NaN")] == [0.5, 1.0, 0.0, 0.0, 0.0, 0.0]
    assert [one.select(two_decimals(F.lit(v).cast("double")).alias("v")).first().v for v in (0.125, 2.675, 1.0, None)] == ["0.12", "2.67", "1.00", ""]
    options = [("a", ("x",)), ("b", ("*",)), ("c", ("*", "y"))]
    assert [one.select(listed(F.lit(v).cast("string"), options, True).alias("v")).first().v for v in ("x", "y", "z", None)] == ["a", "c", "c", "c"]
    df = spark.createDataFrame([("d", 1, False, "p"), ("d", 2, True, "q"), ("d", 3, True, "r"), ("e", 1, False, "s"), ("e", 2, None, "t"), (None, 1, True, "u")], "k string, n int, ok boolean, v string")
    assert {(r.k, r.v, r.found) for r in first_success(df, "k", F.col("n"), F.coalesce("ok", F.lit(False)), ["v"]).collect()} == {("d", "q", True), ("e", "t", False)}


def test_sparse_numbers_share_buckets(spark):
    df = spark.range(1000).select((F.col("id") * 10**12).alias("n"), F.lit("hot").alias("g")).withColumn("b", range_bucket(spark.range(1000).select((F.col("id") * 10**12).alias("n")), "n", 100))
    assert df.select("b").distinct().count() in (10, 11)
    placed = ranked(df.drop("b"), ["g"], [range_bucket(df, "n", 100)], [F.col("n")], out="k")
    assert placed.where("k <> n / 1000000000000 + 1").count() == 0
    assert ranked(df.drop("b").limit(0), ["g"], [range_bucket(df.limit(0), "n")], [F.col("n")], out="k").count() == 0


def test_cache_keeps_the_latest(spark, tmp_path):
    path = str(tmp_path / "cache")
    for v, at in (("a", "2024-01-01 00:00:00"), ("b", "2024-01-02 00:00:00")):
        cached(spark.createDataFrame([("k", v), (None, v)], "k string, v string"), path, "pages", F.col("k"), F.lit(at).cast("timestamp_ntz"))
    entries = spark.read.parquet(path)
    assert entries.count() == 4 and {(r.k, r.v, r.namespace) for r in compacted(entries, ["k"], "stored_at").collect()} == {("k", "b", "pages"), (None, "b", "pages")}
    assert [spark.range(1).select(unfenced(F.lit(t)).alias("t")).first().t for t in ("```json\n{}\n```", " x ", "```\ny```")] == ["{}", "x", "y"]
