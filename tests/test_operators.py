from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from harrow.operators import html, ranks, rules, skew, tables

PAGE = """<html><head><title>Acme | Pumps</title><meta property="og:description" content="We repair &amp; rent pumps for farms across the county. "></head><body>
<nav><a href="/services/x">Services</a><p>gone</p></nav><h1>Pump repair</h1><p>We provide pump repair to farms and mills in the valley.</p>
<p>See <a href="/about/#team">about us</a> and <a href="https://other.example/about">them</a><a href="mailto:a@b">m</a><a href="/about/">a</a></p><h2>Pump repair</h2><p>never closed"""


def test_page(spark):
    title, description, headings, paragraphs, links = html.read_page(PAGE)
    assert title == "Acme | Pumps"
    assert description == "We repair & rent pumps for farms across the county."
    assert headings == ["Pump repair"]
    assert paragraphs == ["We provide pump repair to farms and mills in the valley.", "See about us and them m a"]
    ranked = html.ranked_links(F.lit("https://acme.example/"), F.array(*map(F.lit, links)), F.lit("acme.example"), 5)
    assert spark.range(1).select(ranked.alias("r")).first().r == ["https://acme.example/about"]
    assert html.read_page(None)[4] == [] and html.read_page("<<<p>")[0] == ""


def test_candidates(spark):
    df = spark.createDataFrame([(1, "https://acme.example/about", PAGE), (2, None, None)], "fetch_id int, final_url string, body string")
    found = html.top_candidates(html.with_page(df), 2).orderBy("rank").collect()
    assert [(r.kind, round(r.score, 2)) for r in found] == [("meta", 0.92), ("paragraph", 0.82)]


def test_digest_keeps_order(spark):
    df = spark.createDataFrame([("d", i, f"https://d.example/{i}", f"<title>T{i}</title><p>text {i}</p>") for i in range(3)], "domain string, n int, final_url string, body string")
    text = html.digest(html.with_page(df), "domain", "n", limit=60).first().digest
    assert text.startswith("[https://d.example/0]\nTitle: T0\ntext 0\n[https://d.example/1]") and len(text) == 60


def test_ranked_splits_groups(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"), (F.col("id") % 7).alias("v"))
    got = ranks.ranked(df, ["g"], [F.col("v")], [F.col("id")], size="n").collect()
    for g in (0, 1):
        mine = sorted((r.v, r.id, r["rank"], r.n) for r in got if r.g == g)
        assert [m[2] for m in mine] == list(range(1, len(mine) + 1)) and {m[3] for m in mine} == {len(mine)}


def test_balanced(spark):
    keys = spark.range(50).select(F.col("id").cast("string").alias("k"))
    got = {r.k: r.variant for r in ranks.balanced(keys, "k", "s:", 6).collect()}
    assert max(Counter(got.values()).values()) - min(Counter(got.values()).values()) <= 1
    assert got == {r.k: r.variant for r in ranks.balanced(keys.orderBy(F.desc("k")).repartition(3), "k", "s:", 6).collect()}


def test_running_total_and_split(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "seq")
    got = {r.seq: r.total for r in ranks.running_total(df, "seq", F.col("seq"), bucket_rows=7).collect()}
    assert got == {i: i * (i + 1) // 2 for i in range(1, 101)}
    shares = [r.share for r in ranks.split_total(df.withColumn("g", F.lit(None).cast("int")), ["g"], "seq", 1003).orderBy("seq").collect()]
    assert sum(shares) == 1003 and shares == sorted(shares, reverse=True) and shares[0] - shares[-1] == 1


def test_rules(spark):
    table = spark.createDataFrame([(20, "chief|head", "b"), (10, "head of it", "a"), (99, ".*", "z")], "priority int, title_pattern string, persona string")
    found = rules.read_rules(table, ["persona"])
    df = spark.createDataFrame([("Head of IT",), ("HEAD",), ("cook",), (None,)], "t string")
    assert [(r.rule_priority, r.persona) for r in rules.with_rule(df, F.col("t"), found, ["persona"]).collect()] == [(10, "a"), (20, "b"), (99, "z"), (None, None)]
    with pytest.raises(ValueError):
        rules.read_rules(table.limit(0), ["persona"])
    with pytest.raises(Exception, match="unterminated|missing"):
        rules.read_rules(spark.createDataFrame([(1, "(", "x")], table.schema), ["persona"])


def test_joins_on_hot_keys(spark):
    big = spark.range(300).select("id", F.when(F.col("id") < 200, "hot").otherwise(F.col("id").cast("string")).alias("key")).unionByName(spark.createDataFrame([(999, None)], "id long, key string"))
    counted = big.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    for got in (skew.attach_counted(big, counted, "key", 301, hot_keys=10), skew.join_counted(big, counted, "key")):
        rows = got.collect()
        assert len(rows) == 300 and {r.n for r in rows if r.key == "hot"} == {200}


def test_tables(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, None, 1), (4, "b", 2)], "row_idx long, key string, v int")
    assert {(r.row_idx, r.winner) for r in tables.with_winner(df, "key", F.col("v")).collect()} == {(1, 2), (2, 2)}
    assert {(r.key, r.v) for r in tables.first_per_key(df, "key", F.col("row_idx"), ["v"]).collect()} == {("a", 5), ("b", 2)}
    cells = spark.createDataFrame([(1, " x ", "N/A"), (2, None, "y")], "row_idx long, a string, b string")
    assert [(r.row_idx, r.pos, r.value) for r in tables.unpivoted(cells, "row_idx", [("a", 0.5), ("b", 0.4)]).collect()] == [(1, 1, "x"), (2, 2, "y")]
