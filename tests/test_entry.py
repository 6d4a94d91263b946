"""The driver's contract: names, and results equal to DuckDB's for some queries of each kind."""

import glob
import os

import pytest

import __spark_entry__ as entry

SOME = ("scan_ip", "dv_titulo", "rule_cep", "vote", "dedup_names", "dedup_phones", "threshold_filter", "logodds", "overlap_islands", "feedback_rates", "calib_bins", "conf_stats", "rate_window", "export_rows")


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


@pytest.mark.parametrize("name", SOME)
def test_against_duckdb(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    text = lambda df: sorted(tuple("~" if v != v or v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))
    assert text(got) == text(want)
