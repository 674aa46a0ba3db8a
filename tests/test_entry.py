import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["top_k", "zip_left_orphans", "agg_first_last", "validate_all", "baseline_percentiles", "graph_related_contracts", "rollup_hourly", "vector_top_k", "bm25_top_k", "zip_inferred_left", "json_exists_or", "agg_expression", "fulltext_search", "fulltext_search_filtered", "anomaly_update", "system_stats", "baseline_rolling_90d"]


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 10


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_against_duckdb(spark, name):
    c = duckdb.connect()
    for t in "lineitem orders customer events documents embeddings".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    text = lambda r, names: sorted(str([str(r_[names.index(k)]).removesuffix("+00:00") for k in columns]) for r_ in r)
    assert text([tuple(x) for x in got.collect()], got.columns) == text(want.fetchall(), want.columns)


def test_traverse_sees_all_invoices(spark):
    got = entry.queries()["graph_traverse_depth2"](spark, SF)
    assert got.count() == entry.queries()["count_rows"](spark, SF).first().n
    test_against_duckdb(spark, "graph_traverse_depth2")
