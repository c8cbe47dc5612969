"""Spark results against DuckDB on the same tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

SQL = contract.oracle_sql()
QUERIES = contract.queries()
QUICK = [
    "read_submissions",
    "write_table",
    "add_row_id",
    "clean_survey",
    "demographics_table",
    "waves_table",
    "prevalence_cells",
    "prediction_grid",
    "attach_covariates",
    "poststratify",
    "prevalence_summary",
    "fit_mrp_saturated",
    "delay_cells",
    "impossible_delays",
    "draw_duration_ordered",
    "mean_duration_table",
    "trim_common_support",
    "deconvolve_two_steps",
    "deconvolution_status",
    "fit_mrp_window",
    "relative_difference",
    "trend_features",
    "growth_figure_data",
    "cross_correlation",
    "max_lag_table_growth",
    "max_ccf_2d",
    "format_interval",
]
NAMES = sorted(SQL) if os.environ.get("SYMPTRA_ALL_ORACLES") else QUICK


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "-"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.6f}".replace("-0.000000", "0.000000")
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(SQL[name])
    want_columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(want_columns)
    assert rows(got.columns, got.collect()) == rows(want_columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    assert contract.entry(spark).limit(5).count() == 5
