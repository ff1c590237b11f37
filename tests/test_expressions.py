"""Expressions against plain pandas on small panels with gaps, infinities, ties and one-row instruments."""

import numpy as np
import pandas as pd
import pytest

from tidepanel.functions import expressions as E


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    rows = []
    for name, n in (("a", 40), ("b", 25), ("c", 1)):
        x = rng.normal(10, 2, n).round(1)
        for i, t in enumerate(pd.date_range("2024-01-01", periods=n)):
            rows.append((name, t.to_pydatetime(), None if i % 7 == 3 else float(x[i]), float(i % 3)))
    return spark.createDataFrame(rows, "instrument string, datetime timestamp, close double, volume double")


def by_pandas(panel, f):
    df = panel.toPandas().sort_values(["instrument", "datetime"])
    return pd.concat([f(g.set_index("datetime")) for _, g in df.groupby("instrument")]).to_numpy(dtype=float)


def spark_values(panel, e):
    return E.evaluate(panel, {"x": e}).toPandas().sort_values(["instrument", "datetime"])["x"].to_numpy(dtype=float)


C = E.feature("close")
CASES = {
    "mean": (E.mean(C, 5), lambda g: g.close.rolling(5, min_periods=1).mean()),
    "std": (E.std(C, 5), lambda g: g.close.rolling(5, min_periods=1).std()),
    "skew": (E.skew(C, 6), lambda g: g.close.rolling(6, min_periods=1).skew()),
    "kurt": (E.kurt(C, 6), lambda g: g.close.rolling(6, min_periods=1).kurt()),
    "quantile": (E.quantile(C, 5, 0.8), lambda g: g.close.rolling(5, min_periods=1).quantile(0.8)),
    "rank": (E.rank(C, 5), lambda g: g.close.rolling(5, min_periods=1).rank(pct=True)),
    "corr": (E.corr(C, E.feature("volume"), 8), lambda g: g.close.rolling(8, min_periods=1).corr(g.volume)),
    "ema": (E.ema(C, 5), lambda g: g.close.ewm(span=5, min_periods=1).mean()),
    "mad": (E.mad(C, 5), lambda g: g.close.rolling(5, min_periods=1).apply(lambda x: np.nanmean(np.abs(x - np.nanmean(x))), raw=True)),
    "delta": (C - E.ref(C, 2), lambda g: g.close - g.close.shift(2)),
    "share": (E.mean(C > E.ref(C, 1), 4), lambda g: (g.close > g.close.shift(1)).astype(float).rolling(4, min_periods=1).mean()),
    "nested": (E.mean(E.max_(C, 3), 4), lambda g: g.close.rolling(3, min_periods=1).max().rolling(4, min_periods=1).mean()),
}


@pytest.mark.parametrize("name", CASES)
def test_rolling_equals_pandas(panel, name):
    e, f = CASES[name]
    np.testing.assert_allclose(spark_values(panel, e), by_pandas(panel, f), rtol=1e-7, atol=1e-8, equal_nan=True)


def test_ieee_and_comparison_rules(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 0.0), ("a", 2, -1.0, 0.0), ("a", 3, 0.0, 0.0), ("a", 4, 1.0, None), ("a", 5, None, 1.0)], "instrument string, datetime int, x double, y double")
    x, y = E.feature("x"), E.feature("y")
    out = E.evaluate(df, {"d": x / y, "g": x > y, "n": E.ne(x, y), "m": E.greater(x, y), "i": E.is_inf(x / y), "l": E.log(y)}).orderBy("datetime").collect()
    assert [r["d"] for r in out] == [float("inf"), float("-inf"), None, None, None]
    assert [r["g"] for r in out] == [True, False, False, False, False]
    assert [r["n"] for r in out] == [True, True, False, True, True]
    assert [r["m"] for r in out] == [1.0, 0.0, 0.0, None, None]
    assert [r["i"] for r in out] == [True, True, False, False, False]
    assert [r["l"] for r in out] == [float("-inf")] * 3 + [None, 0.0]


def test_reach():
    assert E.reach({"a": E.mean(E.ref(C, 3), 5), "b": E.ref(C, -2)}) == (7, 2)
    assert E.reach({"a": E.mean(C, 0)})[0] is None


def test_division_follows_ieee_and_nesting_stays_small(spark):
    inf = float("inf")
    cases = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 0.0), (1.0, None), (inf, inf), (inf, 0.0)]
    df = spark.createDataFrame([("a", i, x, y) for i, (x, y) in enumerate(cases)], "instrument string, datetime int, x double, y double")
    x, y = E.feature("x"), E.feature("y")
    got = [r["q"] for r in E.evaluate(df, {"q": x / y}).orderBy("datetime").collect()]
    assert got == [inf, -inf, None, 1.5, None, None, None, inf]
    deep = x
    for _ in range(12):
        deep = deep / (y + 1)
    plan = E.evaluate(df, {"q": deep})._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000
