"""Operators that cut long series, ranges and fits into parts, against plain definitions on small tables."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import datasets, execution, pit, prepare, processors, selection

T0 = datetime(2021, 3, 1)


@pytest.fixture(scope="module")
def ticks(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(3):
        at = np.sort(rng.choice(5000, 150, replace=False)) * (k + 1)
        rows += [(f"i{k}", T0 + timedelta(seconds=int(s)), None if rng.random() < 0.1 else float(np.round(rng.normal(), 2))) for s in at]
    return rows, spark.createDataFrame(rows, "instrument string, datetime timestamp, value double")


@pytest.mark.parametrize("seconds", [1, 40, 10_000])
def test_time_windows_cross_slices(ticks, seconds):
    rows, df = ticks
    found = pit.time_window(df, seconds, {"n": F.count, "top": F.max})
    assert found.columns == ["instrument", "datetime", "value", "n", "top"]
    want = set()
    for i, t, v in rows:
        w = [x for j, s, x in rows if j == i and t - timedelta(seconds=seconds) < s <= t and x is not None]
        want.add((i, t, v, len(w), max(w, default=None)))
    assert {tuple(r) for r in found.collect()} == want


def test_buckets_carry_values_over_slices(ticks, monkeypatch):
    rows, df = ticks
    found = pit.resample(df, "7 SECONDS", {"p": F.max_by("value", F.when(F.col("value").isNotNull(), F.col("datetime")))}, ("p",))
    monkeypatch.setattr(pit, "_seconds", lambda width: 0.03)
    again = pit.resample(df, "7 SECONDS", {"p": F.max_by("value", F.when(F.col("value").isNotNull(), F.col("datetime")))}, ("p",))
    got = sorted(map(tuple, found.collect()), key=lambda r: r[:2])
    assert got == sorted(map(tuple, again.collect()), key=lambda r: r[:2])
    for i in ("i0", "i1", "i2"):
        own = [r for r in got if r[0] == i]
        assert all((b[1] - a[1]).seconds == 7 for a, b in zip(own, own[1:], strict=False))
        for _, t, p in own:
            seen = [v for j, s, v in rows if j == i and s < t + timedelta(seconds=7) and v is not None]
            assert p == (seen[-1] if seen else None)


def test_no_ticks(spark):
    df = spark.createDataFrame([], "instrument string, datetime timestamp, value double")
    assert pit.time_window(df, 5, {"n": F.count}).count() == 0
    assert pit.resample(df, "5 SECONDS", {"p": F.max("value")}, ("p",)).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 1.0])
def test_quantiles_are_exact(spark, q):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=4000) * 10.0 ** rng.integers(-9, 9, 4000), np.full(1000, 0.25), [1e300, -1e300]])
    df = spark.createDataFrame([(float(v), None if i % 3 else float(v), None, 7.0) for i, v in enumerate(x)], "a double, b double, c double, d double")
    found = selection.quantiles(df, {k: F.col(k) for k in "abcd"} | {"e": F.abs("a")}, q, listed=40)
    want = {"a": x, "b": x[::3], "d": np.array([7.0]), "e": np.abs(x)}
    for k, v in want.items():
        assert found[k] == pytest.approx(np.quantile(v, q), rel=1e-12)
    assert found["c"] is None


def test_robust_norm(spark):
    rows = [("a", T0 + timedelta(days=i), float(i * i), None) for i in range(50)]
    df = spark.createDataFrame(rows, "instrument string, datetime timestamp, x double, y double")
    got = processors.robust_norm(df, ["x", "y"], "2021-03-01", "2021-04-01", clip=False).orderBy("datetime").toPandas()
    v = np.arange(32.0) ** 2
    m = np.median(v)
    assert got["x"].to_numpy(float) == pytest.approx((np.arange(50.0) ** 2 - m) / ((np.median(np.abs(v - m)) + 1e-12) * 1.4826))
    assert got["y"].isna().all()


def test_range_totals_equal_spread_ranges(spark):
    rng = np.random.default_rng(7)
    quotes = [(f"i{k}", T0 + timedelta(hours=int(h)), None if rng.random() < 0.2 else float(np.round(rng.normal(), 2)), bool(rng.random() < 0.9)) for k in range(3) for h in np.sort(rng.choice(4000, 300, replace=False))]
    df = spark.createDataFrame(quotes, "instrument string, datetime timestamp, x double, ok boolean")
    ranges = []
    for r in range(60):
        a, n = int(rng.integers(-200, 4100)), int(rng.choice([0, 1, 30, 700, 3000]))
        ranges.append((r, f"i{r % 4}", T0 + timedelta(hours=a), T0 + timedelta(hours=a + n)))
    ranges += [(100, "i0", quotes[5][1], quotes[5][1]), (101, "i0", quotes[9][1], quotes[5][1]), (102, "i1", quotes[300][1], quotes[599][1])]
    found = execution.range_totals(df, spark.createDataFrame(ranges, "range_id long, instrument string, start timestamp, `end` timestamp"), {
        "s": ("sum", F.col("x")), "n": ("count", F.col("x")), "m": ("mean", F.col("x")), "l": ("last", F.col("x")), "a": ("all", F.col("ok"))})
    got = {r["range_id"]: r for r in found.collect()}
    assert len(got) == len(ranges)
    for i, k, a, b in ranges:
        own = [q for q in quotes if q[0] == k and a <= q[1] <= b]
        x = [q[2] for q in own if q[2] is not None]
        r = got[i]
        assert r["a"] == (all(q[3] for q in own) if own else None)
        assert (r["n"], r["l"]) == (len(x) or None, x[-1] if x else None)
        assert (r["s"], r["m"]) == ((pytest.approx(sum(x)), pytest.approx(np.mean(x))) if x else (None, None))


@pytest.mark.parametrize("expanding", [False, True])
def test_folds_are_fitted_from_moments(spark, expanding):
    rng = np.random.default_rng(9)
    x = {(k, t): 1e6 + rng.normal() for k in range(4) for t in range(60) if rng.random() < 0.7 and t != 13}
    raw = spark.createDataFrame([(f"i{k}", T0 + timedelta(days=t), t, float(v)) for (k, t), v in x.items()], "instrument string, datetime timestamp, idx long, x double")
    folds = datasets.rolling_splits(spark.range(60).select(F.col("id").alias("idx")), (0, 19), (20, 24), (25, 29), 10, expanding)
    fits = {f"p_{k}": (k, "x") for k in datasets.FITS}
    found = datasets.refit_per_fold(raw, folds, fits, {f"f_{k}": F.col(f"p_{k}") for k in datasets.FITS}, segments=("test",)).toPandas()
    for fold, own in found.groupby("fold"):
        a, b = (0 if expanding else fold * 10), fold * 10 + 19
        v = np.array([y for (_, t), y in x.items() if a <= t <= b])
        want = {"count": len(v), "mean": v.mean(), "std": v.std(ddof=1), "std_pop": v.std(), "min": v.min(), "max": v.max()}
        for k, y in want.items():
            assert own[f"f_{k}"].to_numpy(float) == pytest.approx(np.full(len(own), y), rel=1e-7)
        assert set(own["idx"]) == {t for _, t in x if fold * 10 + 25 <= t <= fold * 10 + 29}
    assert set(found["segment"]) == {"test"}


def test_units_are_repaired_to_the_end(spark):
    good = {"a": [10.0, 11.0, 12.0, 11.0, 10.0, 10.5], "b": [5.0, 5.1, 5.2, 5.0, 5.1, 5.2]}
    off = {"a": [1, 1, 100, 100, 100, 1], "b": [1] * 6}
    rows = [(k, T0 + timedelta(days=t), v * off[k][t], v * off[k][t]) for k in good for t, v in enumerate(good[k])]
    df = spark.createDataFrame(rows, "instrument string, datetime timestamp, close double, adjclose double")
    got = {(r["instrument"], r["datetime"]): (r["close"], r["adjclose"]) for r in prepare.repair_units(df).collect()}
    assert got == {(k, T0 + timedelta(days=t)): (pytest.approx(v), pytest.approx(v)) for k in good for t, v in enumerate(good[k])}
    with pytest.warns(UserWarning, match="rounds"):
        assert prepare.repair_units(df, 2).count() == len(rows)
    assert prepare.repair_units(df.limit(0)).count() == 0


def test_streams_go_on_where_they_ended(spark, tmp_path):
    """Late ticks within the watermark count; buckets behind it are final and come once."""
    from tidepanel.streaming.ticks import read_stream, resample_stream, run_to_end

    schema = "instrument string, datetime timestamp, value double"
    day = lambda rows: spark.createDataFrame([("a", T0 + timedelta(hours=h), v) for h, v in rows], schema).coalesce(1)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def final():
        made = resample_stream(read_stream(spark, source), "6 HOURS", "12 HOURS", {"total": F.sum("value")})
        return sorted((r["datetime"], r["total"]) for r in run_to_end(made, out).collect())

    day([(0, 1.0), (7, 2.0), (30, 4.0)]).write.parquet(source)
    assert final() == [(T0, 1.0), (T0 + timedelta(hours=6), 2.0)]
    day([(1, 100.0), (19, 8.0), (60, 16.0)]).write.mode("append").parquet(source)
    assert final() == [(T0, 1.0), (T0 + timedelta(hours=6), 2.0), (T0 + timedelta(hours=18), 8.0), (T0 + timedelta(hours=30), 4.0)]
