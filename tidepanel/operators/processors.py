"""Processors: fit on a range, transform a panel (N)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.nulls import INF, finite, ieee_log, no_nan
from tidepanel.operators.selection import quantiles
from tidepanel.sources.scratch import written

def by_day():
    return W.partitionBy("datetime")

#: Fixed values of the robust norms.
MAD_SCALE, EPS = 1.4826, 1e-12


def dropna(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with none of ``cols`` missing."""
    return df.dropna(subset=cols)


def drop_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    """N3."""
    return df.drop(*cols)


def filter_cols(df: DataFrame, group: list[str], keep: list[str]) -> DataFrame:
    """The listed columns of a group, and all columns outside it."""
    return df.select(*[c for c in df.columns if c not in group or c in keep])


def tanh(df: DataFrame, cols: list[str]) -> DataFrame:
    """N5."""
    return df.withColumns({c: F.tanh(F.col(c) - 1) for c in cols})


def process_inf(df: DataFrame, cols: list[str]) -> DataFrame:
    """Infinities become the day's mean of the finite values."""
    return df.withColumns({c: F.when(F.abs(c) == F.lit(INF), F.avg(finite(F.col(c))).over(by_day())).otherwise(F.col(c)) for c in cols})


def fillna(df: DataFrame, cols: list[str], value: float = 0.0) -> DataFrame:
    """N7."""
    return df.fillna(value, subset=cols)


def _fit(df: DataFrame, start, end, aggregates: dict[str, Column]) -> DataFrame:
    """One row of parameters over a fit range."""
    return df.where(F.col("datetime").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).agg(*[a.alias(n) for n, a in aggregates.items()])


def _apply(df: DataFrame, params: DataFrame, cols: list[str], make: Callable[[str], Column]) -> DataFrame:
    out = df.crossJoin(F.broadcast(params)).withColumns({c: make(c) for c in cols})
    return out.select(*df.columns)


def min_max_norm(df: DataFrame, cols: list[str], start, end) -> DataFrame:
    """A constant column is unchanged."""
    params = _fit(df, start, end, {f"_lo_{c}": F.min(c) for c in cols} | {f"_hi_{c}": F.max(c) for c in cols})
    flat = lambda c: F.col(f"_lo_{c}") == F.col(f"_hi_{c}")
    return _apply(df, params, cols, lambda c: F.when(flat(c), F.col(c)).otherwise((F.col(c) - F.col(f"_lo_{c}")) / F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0.0))))


def zscore_norm(df: DataFrame, cols: list[str], start, end) -> DataFrame:
    """Population deviation; 0 leaves the column."""
    params = _fit(df, start, end, {f"_m_{c}": F.avg(c) for c in cols} | {f"_s_{c}": F.stddev_pop(c) for c in cols})
    return _apply(df, params, cols, lambda c: F.when(F.col(f"_s_{c}") == 0, F.col(c)).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))))


def robust_norm(df: DataFrame, cols: list[str], start, end, clip: bool = True) -> DataFrame:
    """Exact medians over the fit range by selection (``quantiles``), first of the values, then of their distances; a column without values becomes missing."""
    inside = df.where(F.col("datetime").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    middle = quantiles(inside, {c: F.col(c) for c in cols})
    apart = quantiles(inside, {c: F.abs(F.col(c) - F.lit(m)) for c, m in middle.items() if m is not None})

    def make(c: str) -> Column:
        x = (F.col(c) - F.lit(middle[c])) / ((F.lit(apart[c]) + EPS) * MAD_SCALE)
        return F.when(x.isNotNull(), F.greatest(F.lit(-3.0), F.least(F.lit(3.0), x))) if clip else x

    return df.withColumns({c: make(c) if c in apart else F.lit(None).cast("double") for c in cols})


def cs_zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per day, sample deviation."""
    return df.withColumns({c: (F.col(c) - F.avg(c).over(by_day())) / F.nullif(F.stddev_samp(c).over(by_day()), F.lit(0.0)) for c in cols})


def cs_robust(df: DataFrame, cols: list[str], clip: bool = True, again: bool = False) -> DataFrame:
    """Per day median and MAD, by two grouped passes; ``again`` takes the day's z-score of the result."""
    medians = df.groupBy("datetime").agg(*[F.median(c).alias(f"_m_{c}") for c in cols])
    df1 = df.join(medians, "datetime")
    mads = df1.groupBy("datetime").agg(*[F.median(F.abs(F.col(c) - F.col(f"_m_{c}"))).alias(f"_d_{c}") for c in cols])

    def make(c: str) -> Column:
        x = (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_d_{c}") * MAD_SCALE, F.lit(0.0))
        return F.when(x.isNotNull(), F.greatest(F.lit(-3.0), F.least(F.lit(3.0), x))) if clip else x

    out = df1.join(mads, "datetime").withColumns({c: make(c) for c in cols}).select(*df.columns)
    return cs_zscore(out, cols) if again else out


def average_rank(c: str, *by: str) -> Column:
    """Rank from 1 within groups, ties averaged; missing values have none."""
    w = W.partitionBy(*by)
    return F.when(F.col(c).isNotNull(), F.rank().over(w.orderBy(F.asc_nulls_last(c))) + (F.count("*").over(W.partitionBy(*by, c)) - 1) / 2)


def cs_rank(df: DataFrame, cols: list[str]) -> DataFrame:
    """(percent rank - 0.5) * 3.46 per day."""
    return df.withColumns({c: (average_rank(c, "datetime") / F.count(c).over(by_day()) - 0.5) * 3.46 for c in cols})


def cs_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing values become the day's mean."""
    return df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(by_day())) for c in cols})


#: Transforms by name prefix, in this order; later prefixes apply on top where several match (fixed values).
SECTION_STEPS: tuple[tuple[tuple[str, ...], Callable[[Column], Column]], ...] = (
    (("KLEN", "KLOW", "KUP"), lambda x: F.when(x >= 0, F.pow(x, F.lit(0.25)))),
    (("KLOW2", "KUP2"), lambda x: F.when(x >= 0, F.pow(x, F.lit(0.5)))),
    (("KMID", "KSFT", "OPEN", "HIGH", "LOW", "CLOSE", "VWAP", "ROC", "MA", "BETA", "RESI", "QTLU", "QTLD", "RSV", "SUMP", "SUMN", "SUMD", "VSUMP", "VSUMN", "VSUMD"), lambda x: x),
    (("STD", "VOLUME", "VMA", "VSTD"), ieee_log),
    (("RSQR",), lambda x: F.coalesce(x, F.lit(0.0))),
    (("MAX", "HIGH0"), lambda x: F.when(x >= 1, F.pow(x - 1, F.lit(0.5)))),
    (("MIN", "LOW0"), lambda x: F.when(x <= 1, F.pow(1 - x, F.lit(0.5)))),
    (("CORR", "CORD"), F.exp),
    (("WVMA",), F.log1p),
)
#: Columns that the step without a transform leaves to their own steps.
SECTION_APART = ("HIGH0", "LOW0")


def section_norm(df: DataFrame, features: list[str], labels: list[str]) -> DataFrame:
    """Prefix transforms, each followed by the day's robust norm with values beyond 3 shrunk and missing ones 0; labels by day z-score, missing ones 0.

    Every step's rows are written: in one plan all steps run in the same tasks, whose memory grows with each of their sorts.
    """
    for prefixes, change in SECTION_STEPS:
        cols = [c for c in features if c.startswith(prefixes) and not ("OPEN" in prefixes and c in SECTION_APART)]
        if cols:
            fields = df.columns
            df = written(cs_robust(written(df.withColumns({c: change(F.col(c)) for c in cols})), cols, clip=False))
            ends = df.groupBy("datetime").agg(*[x for c in cols for x in (F.max(c).alias(f"_t_{c}"), F.min(c).alias(f"_l_{c}"))])
            shrink = lambda c: F.when(F.col(c) > 3, 3 + (F.col(c) - 3) / F.nullif(F.col(f"_t_{c}") - 3, F.lit(0.0)) * 0.5).when(F.col(c) < -3, -3 - (F.col(c) + 3) / F.nullif(F.col(f"_l_{c}") + 3, F.lit(0.0)) * 0.5).otherwise(F.col(c))
            df = df.join(ends, "datetime").withColumns({c: F.coalesce(no_nan(shrink(c)), F.lit(0.0)) for c in cols}).select(*fields)
    return fillna(cs_zscore(df, labels), labels) if labels else df


def high_freq_norm(df: DataFrame, groups: dict[str, list[str]], start, end) -> DataFrame:
    """Per block of columns one mean, and one deviation of |x - mean|; volumes by log1p first; missing values 0."""
    logged = df.withColumns({c: F.log1p(F.col(c)) for g, cols in groups.items() if g.endswith("volume") for c in cols})
    inside = logged.where(F.col("datetime").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    long = lambda cols: F.explode(F.array(*cols)).alias("x")
    for g, cols in groups.items():
        mean = inside.select(long(cols)).agg(F.avg("x").alias("_m"))
        spread = inside.select(long(cols)).crossJoin(F.broadcast(mean)).agg(F.stddev_pop(F.abs(F.col("x") - F.col("_m"))).alias("_s"), F.first("_m").alias("_m"))
        logged = _apply(logged, spread, cols, lambda c: F.coalesce((F.col(c) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)), F.lit(0.0)))
    return logged


def cast(df: DataFrame, cols: list[str], dtype: str) -> DataFrame:
    """N17."""
    return df.withColumns({c: F.col(c).cast(dtype) for c in cols})


def pipeline(df: DataFrame, shared=(), infer=(), learn=(), mode: str = "append") -> tuple[DataFrame, DataFrame]:
    """(infer frame, learn frame); learn steps follow the infer steps (append) or the shared ones (independent)."""
    for step in shared:
        df = step(df)
    out = df
    for step in infer:
        if getattr(step, "learn_only", False):
            raise ValueError("a learn-only processor cannot run for inference")
        out = step(out)
    train = out if mode == "append" else df
    for step in learn:
        train = step(train)
    return out, train


def per_instrument(df: DataFrame, f, schema: str) -> DataFrame:
    """A user function of one instrument's frame; an instrument's history is bounded by the calendar."""
    return df.groupBy("instrument").applyInPandas(f, schema)


def per_day(df: DataFrame, f, schema: str) -> DataFrame:
    """A user function of one day's frame; a day is bounded by the universe."""
    return df.groupBy("datetime").applyInPandas(f, schema)
