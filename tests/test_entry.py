"""Registered queries against their DuckDB equivalents on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Pairs that every run compares; all of them where ALL_PAIRS is set.
SAMPLE = ("d_elementwise", "l1_kbar", "l7_labels", "a2_panel", "b7_shift", "c2_restrict", "c5_mask_to_spans", "n13_cs_rank", "p1_ic", "p6_long_short", "q10_status", "q19_brinson", "r7_orders", "s2_covariance", "t4_adjust", "u5_distinct", "v5_refresh", "i1_known_value", "i3_period_mean", "h1_resample",
    "e_rolling", "e_positions", "e_expanding", "k1_registered", "e23_time_function", "m1_features", "m3_nested_load", "n9_zscore", "n10_robust", "n12_cs_robust", "x1_linear", "s3_correlation", "s5_lw_const_corr", "s6_structured", "s7_poet",
    "l8_intraday_normalised", "l9_intraday_execution", "l10_order_book", "l10_intensity", "l10_lagged_change", "l10_change_rate", "m10_refit_per_fold", "n15_section_norm", "o2_filled_sequences", "o9_weights", "g6_select", "p15_ic_matrix", "a9_compare", "r11_base_price", "h4_range_agg",
)
if os.environ.get("ALL_PAIRS"):
    SAMPLE = tuple(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline")))


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return repr(float(v))
    if isinstance(v, str):
        return v
    if hasattr(v, "year"):
        return str(pd.Timestamp(v))
    try:
        return repr(float(v))
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["instrument", "datetime", "KMID", "ROC5", "MA5", "STD5", "CORR5"]
    assert df.count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_need_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and e.oracle_sql()"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
