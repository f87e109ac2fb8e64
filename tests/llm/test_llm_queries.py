from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks import against_sql  # noqa: E402

from harrow.llm import queries as Q  # noqa: E402
from harrow.llm import sql as S  # noqa: E402

QUERIES = Q.queries()
COLUMNS = {
    "p1_found": ["row_idx", "priority"], "p2_found": ["name_a", "name_b"], "p3_found": ["fetch_id"], "p5_found": ["row_idx_a", "row_idx_b"],
    "p6_found": ["row_idx", "title_row_idx", "website_row_idx"], "p7_found": ["rec", "rec_id", "line_no"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "kind", "pii_text"],
}


@pytest.mark.parametrize("name", sorted(S.oracle_sql()))
def test_against_sql(spark, data, name):
    against_sql(QUERIES[name](spark, data), S.oracle_sql()[name], data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd_data, name):
    got = QUERIES[name](spark, odd_data)
    assert got.columns == COLUMNS.get(name, got.columns)
    assert got.count() >= 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_data, name):
    assert QUERIES[name](spark, empty_data).count() == 0


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p5_found", "p9_tiers"])
def test_partitioning_does_not_matter(spark, data, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(str, QUERIES[name](spark, data).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join(spark, data, name, capsys):
    QUERIES[name](spark, data).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
