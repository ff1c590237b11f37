"""Order statistics over frames, users' operators, the stored panel and blocked products against plain definitions."""

import time
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import expressions as E
from tidepanel.functions import ordered, registry
from tidepanel.operators import datasets, gram, risk
from tidepanel.sources.store import open_panel, save_panel


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=1500), 1)
    x[rng.random(1500) < 0.2] = np.nan
    x[:3] = np.nan
    return x


def plain(kind, x, n, q=0.8):
    out = []
    for t in range(len(x)):
        w = x[max(0, t + 1 - n) if n else 0 : t + 1]
        v = w[~np.isnan(w)]
        if kind == "ema":
            keep = 1 - 2 / (2 + t)
            weights = keep ** np.arange(t, -1, -1.0)
            out.append((np.nan_to_num(w) * weights).sum() / weights.sum())
        elif not len(v) or kind == "rank" and np.isnan(x[t]):
            out.append(np.nan)
        elif kind == "quantile":
            out.append(np.quantile(v, q))
        elif kind == "mad":
            out.append(np.abs(v - v.mean()).mean())
        else:
            out.append((0.5 + (v < x[t]).sum() + 0.5 * (v == x[t]).sum()) / len(v))
    return np.array(out)


STATES = {
    ("quantile", 1): lambda: ordered.Quantile(1, 0.8), ("quantile", 10): lambda: ordered.Quantile(10, 0.8), ("quantile", 400): lambda: ordered.Quantile(400, 0.8),
    ("quantile", 0): lambda: ordered.ExpandingQuantile(0.8), ("rank", 10): lambda: ordered.Rank(10), ("rank", 0): ordered.ExpandingRank,
    ("mad", 10): lambda: ordered.Mad(10), ("mad", 0): ordered.ExpandingMad, ("ema", 0): ordered.WholeEma,
}


@pytest.mark.parametrize("case", STATES, ids=str)
def test_states_equal_definitions(series, case):
    state = STATES[case]()
    for again in range(2):
        parts = [state.feed(p) for p in np.split(series, [0, 1, 2, 70, 700, 1333])]
        assert np.concatenate(parts) == pytest.approx(plain(case[0], series, case[1]), rel=1e-9, abs=1e-9, nan_ok=True)
        state.reset()
    assert len(state.feed(np.zeros(0))) == 0


@pytest.mark.parametrize("case", [c for c in STATES if c[1] in (0, 400)], ids=str)
def test_long_histories_take_little_more_than_linear_time(case):
    x = np.random.default_rng(0).normal(size=100_000)
    state, began = STATES[case](), time.time()
    for part in np.split(x, 10):
        state.feed(part)
    assert time.time() - began < 20  # a second or two; a quadratic pass takes minutes


def panel_of(spark, rows):
    return spark.createDataFrame(rows, "instrument string, datetime timestamp, idx long, close double, volume double")


def test_evaluated_states(spark, series):
    """States in the middle of other operators, over several instruments."""
    from datetime import datetime, timedelta

    rows = [(f"i{k}", datetime(2020, 1, 1) + timedelta(days=t), t, None if np.isnan(x) else float(x) + k, 1.0) for k in range(3) for t, x in enumerate(series[:200])]
    x = E.feature("close")
    found = E.evaluate(panel_of(spark, rows), {"a": E.mean(E.rank(x, 5), 3), "b": E.med(x, 7) - E.mean(x, 7), "c": E.quantile(E.mad(x, 4), 0, 0.8)})
    for k in range(3):
        own = found.where(f"instrument = 'i{k}'").orderBy("datetime").toPandas()
        r, y = plain("rank", series[:200], 5), series[:200] + k
        mean = lambda v, n: np.array([np.nanmean(w) if (~np.isnan(w := v[max(0, t + 1 - n) : t + 1])).any() else np.nan for t in range(len(v))])
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            assert own["a"].to_numpy(float) == pytest.approx(mean(r, 3), nan_ok=True)
            assert own["b"].to_numpy(float) == pytest.approx(plain("quantile", y, 7, 0.5) - mean(y, 7), nan_ok=True)
            assert own["c"].to_numpy(float) == pytest.approx(plain("quantile", plain("mad", y, 4), 0), nan_ok=True)


def test_registered_operators(spark):
    x = E.feature("close")
    try:
        registry.register("Twice", lambda a: a * 2.0)
        with pytest.warns(UserWarning, match="Mean"):
            registry.register("Mean", registry.over_frame("Mean", lambda v: v.iloc[0]))
        with pytest.raises(KeyError):
            registry.operator("Nothing")
        with pytest.raises(ValueError):
            registry.register("not a name", E.mean)
        rows = [("a", f"2020-01-0{t}", t, v, 1.0) for t, v in ((1, 3.0), (2, None), (3, 5.0), (4, 6.0))]
        df = spark.createDataFrame(rows, "instrument string, datetime string, idx long, close double, volume double")
        found = E.evaluate(df, {"t": registry.operator("Twice")(x), "f": registry.operator("Mean")(x, 2), "g": registry.over_frame("G", lambda a, b: float((a * b).sum()))(x, E.ref(x, 1), 2)})
        assert [(r["t"], r["f"], r["g"]) for r in found.orderBy("datetime").collect()] == [(6.0, 3.0, None), (None, 3.0, None), (10.0, 5.0, None), (12.0, 5.0, 30.0)]
    finally:
        registry.reset()
    assert registry.operator("Mean") is E.mean


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    from datetime import datetime, timedelta

    rng = np.random.default_rng(3)
    rows = [(f"i{k}", datetime(2019, 6, 1) + timedelta(days=t), float(rng.normal()), 1.0) for k in range(5) for t in range(0 if k else 90, 500) if rng.random() < 0.8]
    bars = spark.createDataFrame(rows, "instrument string, datetime timestamp, close double, volume double")
    return bars, save_panel(bars, f"{tmp_path_factory.mktemp('spark')}/panel", 3)


def test_stored_panels_are_pruned_and_need_no_exchange(spark, kept):
    bars, store = kept
    x = E.feature("close")
    e = {"m": E.mean(x, 5), "f": E.ref(x, -1), "q": E.med(x, 3)}
    for panel in (store, open_panel(spark, store.path)):
        got = datasets.features(panel.rows(), panel.calendar(), e, "2020-02-01", "2020-03-01")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert "PartitionFilters: [isnotnull(period" in plan and "GreaterThanOrEqual(datetime" in plan
        whole = E.evaluate(panel.panel(), e).where("datetime BETWEEN '2020-02-01' AND '2020-03-01'")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    # no window asks for the buckets here
    alone = {"q": E.med(x, 3), "r": E.rank(x, 0)}
    assert sorted(map(tuple, E.evaluate(store.rows(), alone).collect()), key=str) == sorted(map(tuple, E.evaluate(store.panel().repartition(7), alone).collect()), key=str)
    late = datasets.features(store.rows(), store.calendar(), e, "2030-01-01", "2030-03-01")
    assert late.count() == 0 and late.columns == ["instrument", "datetime", "m", "f", "q"]


def test_stored_panels_hold_every_slot(spark, kept):
    bars, store = kept
    assert store.bars().count() == bars.count()
    dates = [r[0] for r in bars.select("datetime").distinct().orderBy("datetime").collect()]
    for r in store.spans().collect():
        rows = store.rows().where(F.col("instrument") == r["instrument"]).orderBy("idx").collect()
        assert [x["datetime"] for x in rows] == dates[dates.index(r["start"]) : dates.index(r["end"]) + 1]
        assert [x["_slot"] for x in rows] == list(range(1, len(rows) + 1))


@pytest.fixture(scope="module")
def ragged(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 11)) @ rng.normal(size=(11, 11))
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = [(f"i{j:02d}", t, None if np.isnan(x[t, j]) else float(x[t, j])) for t in range(90) for j in range(11)]
    return x, spark.createDataFrame([*rows, (None, 3, 1.0), ("i00", None, 1.0), ("i01", 5, float("inf")) if np.isnan(x[5, 1]) else (None, 5, 1.0)], "instrument string, datetime int, x double")


def test_blocked_products_equal_pairs(ragged, monkeypatch):
    x, df = ragged
    monkeypatch.setattr(gram, "SLICE", 20)
    found = {(r["inst_i"], r["inst_j"]): r["cov"] for r in risk.covariance(df).collect()}
    assert len(found) == 121
    for i in range(11):
        for j in range(11):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert found[f"i{i:02d}", f"i{j:02d}"] == pytest.approx((x[both, i] * x[both, j]).mean())


def test_no_returns(spark):
    df = spark.createDataFrame([], "instrument string, datetime int, x double")
    assert risk.covariance(df).count() == 0


def test_many_series_span_blocks(spark):
    """600 series make three blocks; axes against numpy."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 600)) * 3 + rng.normal(size=(40, 600))
    rows = spark.createDataFrame([(f"s{j:03d}", t, float(x[t, j])) for t in range(40) for j in range(600)], "instrument string, datetime int, x double")
    cov = risk.covariance(rows).toPandas().pivot(index="inst_i", columns="inst_j", values="cov").to_numpy()
    assert cov == pytest.approx(x.T @ x / 40)
    got = risk.structured_covariance(rows, 3).toPandas().pivot(index="inst_i", columns="inst_j", values="cov").to_numpy()
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    f = v[:3].T
    assert got == pytest.approx(f @ np.cov((x @ f).T) @ f.T + np.diag((x - x @ f @ f.T).var(0)), abs=1e-7)
