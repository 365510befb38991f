"""Registered queries: names, SQL twins and a sample run next to DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import catalog
from verify import TABLES, rows_of

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = ["a1_dataset_profile", "a9_descriptive_statistics", "c5_imr_chart", "f2_full_analysis", "f6_manual_check", "p6_duplicate_flag",
          "j5_context_resolution", "w6_time_window_subgroups", "w12_rule_set"]


def test_every_query_has_sql():
    assert set(catalog.ORACLE) == set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    assert rows_of(entry.queries()[name](spark, SF_DIR).toPandas()) == rows_of(con.execute(entry.oracle_sql()[name]).df())
