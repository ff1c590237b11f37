"""Trailing time frames whose cost doesn't grow with the rows that a frame holds, against plain definitions."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import pit

T0 = datetime(2021, 3, 1)


@pytest.fixture(scope="module")
def ticks(spark):
    """Times that repeat, gaps of several frames, missing and infinite values."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(2):
        at = np.sort(np.concatenate([rng.choice(300, 80), 5000 + rng.choice(400, 80), [5000] * 9]))
        for s in at:
            v = None if rng.random() < 0.1 else float(np.round(rng.normal(), 2))
            rows.append((len(rows), f"i{k}", T0 + timedelta(seconds=int(s)), v))
    return rows, spark.createDataFrame(rows, "event_id long, instrument string, datetime timestamp, value double")


def inside(rows, row, seconds):
    return [x for x in rows if x[1] == row[1] and row[2] - timedelta(seconds=seconds) < x[2] <= row[2]]


def sliding(df) -> bool:
    """Whether the plan has a frame that Spark adds up anew for each row."""
    return "specifiedwindowframe(RangeFrame, -" in df._jdf.queryExecution().optimizedPlan().toString()


def test_intensity_costs_no_frame_a_row(spark, ticks):
    rows, df = ticks
    found = pit.intensity(df, {"even": F.expr("event_id % 2 = 0"), "big": F.col("value") > 0.5}, "1 MINUTE", 7, 50)
    assert not sliding(found)
    want = {}
    for r in rows:
        own = []
        for hit in (lambda x: x[0] % 2 == 0, lambda x: x[3] is not None and x[3] > 0.5):
            short, long = (np.mean([hit(x) for x in inside(rows, r, s)]) for s in (7, 50))
            own += [short, float(short > long)]
        want.setdefault((r[1], r[2].replace(second=0)), []).append(own)
    got = {(r["instrument"], r["datetime"]): [r["even_intensity"], r["even_relative"], r["big_intensity"], r["big_relative"]] for r in found.collect()}
    assert got == {k: pytest.approx(np.mean(v, axis=0).tolist()) for k, v in want.items()}
    assert pit.intensity(df.limit(0), {"even": F.lit(True)}, "1 MINUTE", 7, 50).count() == 0


def test_every_tick_of_a_time_counts(spark, ticks):
    rows, df = ticks
    found = pit.change_rate(df, 20, order=("event_id",))
    assert found.columns == ["instrument", "datetime", "value", "change", "depth", "intensity"] and not sliding(found)
    want = []
    for r in rows:
        own = inside(rows, r, 20)
        v, first = [x[3] for x in own if x[3] is not None], min(own, key=lambda x: (x[2], x[0]))[3]
        change = r[3] / first - 1 if r[3] is not None and first else None
        want.append((r[1], r[2], r[3], change, np.mean(v) if v else None, len(v)))
    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3] is None, r[3] or 0)
    for g, w in zip(sorted(map(tuple, found.collect()), key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and g[5] == w[5]
        assert g[3:5] == tuple(x if x is None else pytest.approx(x) for x in w[3:5])


def test_change_rate_equals_its_sql_where_times_repeat(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    more = events.withColumns({"event_id": F.col("event_id") + 1_000_000, "value": F.col("value") + 0.25})
    events.union(more).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("l10_change_rate", "e23_time_window"):
        columns = con.sql(entry.oracle_sql()[name]).columns
        got = entry.queries()[name](spark, str(tmp_path)).select(*columns).toPandas()
        want = con.sql(entry.oracle_sql()[name]).df()
        got, want = (x.sort_values(list(columns)).astype({"datetime": "datetime64[us]"}).reset_index(drop=True) for x in (got, want))
        assert got.equals(want)


def test_named_totals_of_time_frames(spark, ticks):
    rows, df = ticks
    inf = df.withColumn("value", F.when(F.col("event_id") % 17 == 0, float("inf")).otherwise(F.col("value")))
    kinds = {"m": "mean", "s": "sum", "n": "count", "lo": "min", "hi": "max", "sd": F.stddev_pop}
    for seconds in (1, 30, 4000):
        found = pit.time_window(inf, seconds, kinds)
        assert found.columns == [*df.columns, *kinds]
        for r in found.collect():
            v = [x[3] for x in inside(rows, rows[r["event_id"]], seconds) if x[3] is not None and x[0] % 17]
            assert r["n"] == len(v)
            want = (np.mean(v), sum(v), min(v), max(v), np.std(v)) if v else (None,) * 5
            assert (r["m"], r["s"], r["lo"], r["hi"], r["sd"]) == tuple(x if x is None else pytest.approx(x, abs=1e-9) for x in want)


def test_functions_of_time_frames_run_once_a_time(spark, ticks):
    rows, df = ticks
    calls = spark.sparkContext.accumulator(0)

    def spread(x):
        calls.add(1)
        return x.max() - x.min()

    found = pit.time_function(df, 30, {"d": spread})
    assert found.columns == [*df.columns, "d"]
    for r in found.collect():
        v = [x[3] for x in inside(rows, rows[r["event_id"]], 30) if x[3] is not None]
        assert r["d"] == (max(v) - min(v) if v else None)
    assert calls.value == len({x[1:3] for x in rows})
    assert pit.time_function(df.limit(0), 30, {"d": spread}).count() == 0
