from __future__ import annotations

import pytest

from harrow.plans import core_queries, core_sql, focus_queries, focus_sql, reference_queries, reference_sql

from checks import against_sql

QUERIES = core_queries.queries() | reference_queries.queries() | focus_queries.queries()
SQL = core_sql.oracle_sql() | reference_sql.oracle_sql() | focus_sql.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, name):
    against_sql(QUERIES[name](spark, data), SQL[name], data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd_data, name):
    assert QUERIES[name](spark, odd_data).count() >= 1 or name in ("share_overflow", "exact_pitch_capacity", "corroborated_rules")


@pytest.mark.parametrize("name", ["p4_found", "p4_loaded", "contact_ranking", "pool_balanced_variants", "running_budget", "facts_concat_distinct", "page_candidates", "page_digest", "lead_profile", "share_overflow", "delivery_ledger", "quality_flags", "batch_shares", "domain_top_facts", "candidate_selection", "included_held_split", "chunk_waves", "focus_gaps", "usage_sums"])
def test_empty_tables(spark, empty_data, name):
    assert QUERIES[name](spark, empty_data).count() == (1 if name in ("lead_profile", "usage_sums") else 0)


@pytest.mark.parametrize("name", ["pool_balanced_variants", "contact_ranking", "chunk_waves", "running_budget"])
def test_partitioning_does_not_matter(spark, data, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, QUERIES[name](spark, data).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
