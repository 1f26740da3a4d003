"""Every registered query against its SQL oracle, and the plans of the ones whose plan matters."""

import datetime
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    try:
        return round(float(value), 6)
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(registry.ORACLES[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(plain(r[c]) for c in columns) for r in got.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    assert "TakeOrderedAndProject" in plan(registry.QUERIES["search_by_product"](spark, SF))
    assert "WindowGroupLimit" in plan(registry.QUERIES["latest_snapshot_per_source"](spark, SF))
    assert "WindowGroupLimit" in plan(registry.QUERIES["batch_topk"](spark, SF))
    for name in ("domain_coverage_stats", "keyword_bm25", "md_sections", "line_metrics"):
        assert "Python" not in plan(registry.QUERIES[name](spark, SF))
    assert "bucket" in plan(registry.QUERIES["keyword_bm25"](spark, SF)).split("PartitionFilters: [")[1].split("]")[0]
    assert "ollect" not in plan(registry.QUERIES["merkle_dir_hash"](spark, SF))
    assert "PushedFilters: [IsNotNull(conv_id)" in plan(registry.QUERIES["context_window"](spark, SF))
    assert "text:string" not in plan(registry.QUERIES["language_histogram"](spark, SF))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
