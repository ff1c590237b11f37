"""Returns, positions and attribution (Q).  Series have a row per date, so windows over whole series are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.nulls import safe_corr

#: Periods in a year by frequency (fixed values).
PERIODS = {"minute": 240 * 238, "day": 238, "week": 50, "month": 12}
def so_far():
    return W.orderBy("datetime").rowsBetween(W.unboundedPreceding, 0)



def drawdown(series: DataFrame, col: str) -> DataFrame:
    total = series.withColumn("_c", F.sum(col).over(so_far()))
    return total.withColumn("drawdown", F.col("_c") - F.max("_c").over(so_far())).withColumnRenamed("_c", "cum")


def risk_analysis(series: DataFrame, col: str = "return", freq: str = "day", mode: str = "sum") -> DataFrame:
    """Q1, Q2: mean, std, annualized_return, information_ratio, max_drawdown of (datetime, return)."""
    n = PERIODS[freq]
    if mode == "sum":
        d = drawdown(series, col)
        mean, std = F.avg(col), F.stddev_samp(col)
        return d.agg(mean.alias("mean"), std.alias("std"), (mean * n).alias("annualized_return"), (mean / F.nullif(std, F.lit(0.0)) * F.sqrt(F.lit(n))).alias("information_ratio"), F.min("drawdown").alias("max_drawdown"))
    wealth = series.withColumn("_l", F.log1p(F.col(col))).withColumn("_w", F.exp(F.sum("_l").over(so_far())))
    wealth = wealth.withColumn("_d", F.col("_w") / F.max("_w").over(so_far()) - 1)
    mean, std = F.exp(F.avg("_l")) - 1, F.stddev_samp("_l")
    annual = F.exp(F.avg("_l") * n) - 1
    return wealth.agg(mean.alias("mean"), std.alias("std"), annual.alias("annualized_return"), (F.avg("_l") / F.nullif(std, F.lit(0.0)) * F.sqrt(F.lit(n))).alias("information_ratio"), F.min("_d").alias("max_drawdown"))


def monthly_risk(series: DataFrame, col: str = "return", least: int = 3) -> DataFrame:
    """Q3: Q1 by month, months with fewer rows left out."""
    month = F.trunc("datetime", "month")
    w = W.partitionBy("month").orderBy("datetime").rowsBetween(W.unboundedPreceding, 0)
    d = series.withColumn("month", month).withColumn("_c", F.sum(col).over(w)).withColumn("_d", F.col("_c") - F.max("_c").over(w))
    mean, std, n = F.avg(col), F.stddev_samp(col), PERIODS["day"]
    out = d.groupBy("month").agg(F.count("*").alias("_n"), mean.alias("mean"), std.alias("std"), (mean * n).alias("annualized_return"), (mean / F.nullif(std, F.lit(0.0)) * F.sqrt(F.lit(n))).alias("information_ratio"), F.min("_d").alias("max_drawdown"))
    return out.where(F.col("_n") >= least).drop("_n")


def report_curves(report: DataFrame) -> DataFrame:
    """Q4: cumulative and drawdown curves of (datetime, return, cost, bench, turnover)."""
    total = lambda c: F.sum(c).over(so_far())
    out = report.select(
        "datetime", total("bench").alias("cum_bench"), total("return").alias("cum_return_wo_cost"), total(F.col("return") - F.col("cost")).alias("cum_return_w_cost"),
        total(F.col("return") - F.col("bench")).alias("cum_ex_return_wo_cost"), total(F.col("return") - F.col("bench") - F.col("cost")).alias("cum_ex_return_w_cost"), "turnover",
    )
    low = lambda c: F.col(c) - F.max(c).over(so_far())
    return out.withColumns({"return_wo_mdd": low("cum_return_wo_cost"), "return_w_mdd": low("cum_return_w_cost"), "ex_return_w_mdd": low("cum_ex_return_w_cost")})


def drawdown_interval(series: DataFrame, col: str = "return") -> DataFrame:
    """Q5: (start, end) of the largest drawdown."""
    d = drawdown(series, col)
    end = d.agg(F.min_by("datetime", F.struct("drawdown", "datetime")).alias("end"))
    before = d.crossJoin(F.broadcast(end)).where(F.col("datetime") <= F.col("end"))
    return before.groupBy("end").agg(F.max_by("datetime", F.struct("cum", -F.unix_micros(F.col("datetime").cast("timestamp")))).alias("start")).select("start", "end")


def position_value(positions: DataFrame, cash: DataFrame, price: str = "price") -> DataFrame:
    """Q6: value of (datetime, instrument, amount, price) with (datetime, cash)."""
    held = positions.groupBy("datetime").agg(F.sum(F.col("amount") * F.col(price)).alias("_v"))
    return cash.join(held, "datetime", "left").select("datetime", (F.coalesce("_v", F.lit(0.0)) + F.col("cash")).alias("value"))


def daily_returns(values: DataFrame, initial: float) -> DataFrame:
    """Q7."""
    before = F.coalesce(F.lag("value").over(W.orderBy("datetime")), F.lit(float(initial)))
    return values.select("datetime", (F.col("value") / before - 1).alias("return"))


def performance(series: DataFrame, days: int = 250) -> DataFrame:
    """Q8: of (datetime, return, bench); the Sharpe ratio is divided by the root of the days, as the measure is defined there."""
    beta = F.covar_samp("return", "bench") / F.nullif(F.var_pop("bench"), F.lit(0.0))
    annual = F.avg("return") * days
    return drawdown(series, "return").agg(
        annual.alias("annual_return"), (F.avg("return") / F.nullif(F.stddev_samp("return"), F.lit(0.0)) / F.sqrt(F.lit(days))).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), beta.alias("beta"), (annual - beta * F.avg("bench") * days).alias("alpha"), (F.stddev_samp("return") * F.sqrt(F.lit(days))).alias("volatility"),
    )


def table_ic(df: DataFrame, a: str, b: str) -> DataFrame:
    """Q9: Pearson correlation of two whole columns."""
    return df.agg(safe_corr(F.col(a), F.col(b)).alias("ic"))


def position_status(held: DataFrame) -> DataFrame:
    """Q10: 1 bought today, 0 held, -1 gone today (dated by today), of rows (datetime, instrument)."""
    dates = held.select("datetime").distinct().withColumn("_next", F.lead("datetime").over(W.orderBy("datetime"))).withColumn("_before", F.lag("datetime").over(W.orderBy("datetime")))
    now = held.select("datetime", "instrument", F.lit(True).alias("_now"))
    was = held.join(dates.select("datetime", "_next"), "datetime").where("_next IS NOT NULL").select(F.col("_next").alias("datetime"), "instrument", F.lit(True).alias("_was"))
    status = F.when(F.col("_now") & F.col("_was").isNull(), 1).when(F.col("_now"), 0).otherwise(-1)
    return now.join(was, ["datetime", "instrument"], "full").select("datetime", "instrument", status.alias("status"))


def label_rank(labels: DataFrame, status: DataFrame) -> DataFrame:
    """Q11: mean rank ratio (percent, falling labels) and label excess by (datetime, status)."""
    day = W.partitionBy("datetime")
    ranked = labels.withColumns({"_r": F.rank().over(day.orderBy(F.desc("label"))) / F.count("*").over(day) * 100, "_x": F.col("label") - F.avg("label").over(day)})
    return status.join(ranked, ["datetime", "instrument"]).groupBy("datetime", "status").agg(F.avg("_r").alias("rank_ratio"), F.avg("_x").alias("excess"))


def add_bench(df: DataFrame, bench: DataFrame) -> DataFrame:
    """Q12: the next slot's benchmark return at each date."""
    return df.join(bench.select("datetime", F.lead("bench").over(W.orderBy("datetime")).alias("bench")), "datetime", "left")


def status_returns(df: DataFrame) -> DataFrame:
    """Q13: weighted excess labels of held, bought and sold rows (datetime, status, weight, label, bench), and their sums so far."""
    gain = lambda s: F.sum(F.when(F.col("status") == s, F.col("weight") * (F.col("label") - F.col("bench"))).otherwise(0.0))
    daily = df.groupBy("datetime").agg(gain(0).alias("hold"), gain(1).alias("buy"), gain(-1).alias("sell"))
    return daily.withColumns({f"cum_{c}": F.sum(c).over(so_far()) for c in ("hold", "buy", "sell")})


def bench_return(panel: DataFrame) -> DataFrame:
    """Q14: mean over instruments of close / previous close - 1, missing as 0."""
    change = F.coalesce(F.col("close") / F.nullif(F.lag("close").over(W.partitionBy("instrument").orderBy("datetime")), F.lit(0.0)) - 1, F.lit(0.0))
    return panel.withColumn("_c", change).groupBy("datetime").agg(F.avg("_c").alias("bench"))


def stock_weights(positions: DataFrame, cash: DataFrame | None = None) -> DataFrame:
    """Q15: amount * price over the day's stock value, or with cash over all."""
    value = F.col("amount") * F.col("price")
    total = F.sum(value).over(W.partitionBy("datetime"))
    if cash is not None:
        positions, total = positions.join(cash, "datetime"), total + F.col("cash")
    return positions.select("datetime", "instrument", (value / F.nullif(total, F.lit(0.0))).alias("weight"))


def bench_weights(df: DataFrame, index: str) -> DataFrame:
    """Q16: (date, code, index, weight in percent) to mean weights per date and code."""
    return df.where(F.col("index") == index).groupBy("date", "code").agg((F.avg("weight") / 100).alias("weight"))


def stock_groups(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """Q17: a group by a forward-filled category, or by exact percentiles of the day, numbered bins..1."""
    if bins is None:
        return df.withColumn("group", F.last(col, True).over(W.partitionBy("instrument").orderBy("datetime").rowsBetween(W.unboundedPreceding, 0)))
    cuts = df.groupBy("datetime").agg(F.percentile(col, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("_cuts"))
    above = F.aggregate("_cuts", F.lit(0), lambda a, c: a + F.when(F.col(col) > c, 1).otherwise(0))
    return df.join(cuts, "datetime").withColumn("group", F.when(F.col(col).isNotNull(), bins - above)).drop("_cuts")


def decompose(df: DataFrame) -> DataFrame:
    """Q18: rows (datetime, group, weight, ret) to group weights and returns; missing where the weight is 0."""
    w = F.sum("weight")
    return df.groupBy("datetime", "group").agg(w.alias("weight"), (F.sum(F.col("weight") * F.col("ret")) / F.nullif(w, F.lit(0.0))).alias("ret"))


def brinson(portfolio: DataFrame, bench: DataFrame) -> DataFrame:
    """Q19: allocation, selection, interaction and total per day of two Q18 tables."""
    p = portfolio.select("datetime", "group", F.col("weight").alias("wp"), F.col("ret").alias("rp"))
    b = bench.select("datetime", "group", F.col("weight").alias("wb"), F.col("ret").alias("rb"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = p.join(b, ["datetime", "group"], "full")
    q = both.groupBy("datetime").agg(F.sum(z("wb") * z("rb")).alias("q1"), F.sum(z("wp") * z("rb")).alias("q2"), F.sum(z("wb") * z("rp")).alias("q3"), F.sum(z("wp") * z("rp")).alias("q4"))
    return q.selectExpr("datetime", "q2 - q1 AS allocation", "q3 - q1 AS selection", "q4 - q3 - q2 + q1 AS interaction", "q4 - q1 AS total")


def weighted_mean(x: str, w: str | None) -> Column:
    if w is None:
        return F.avg(x)
    have = F.when(F.col(x).isNotNull(), F.col(w))
    return F.sum(F.col(x) * F.col(w)) / F.nullif(F.sum(have), F.lit(0.0))


def trade_indicators(df: DataFrame) -> DataFrame:
    """Fill rate and price advantage weighted by count, amount and value, share of positive advantages, and sums by step."""
    aggs = [weighted_mean(c, w).alias(f"{c}_{n}") for c in ("ffr", "pa") for n, w in (("mean", None), ("amount", "deal_amount"), ("value", "value"))]
    return df.groupBy("datetime").agg(*aggs, F.avg((F.col("pa") > 0).cast("double")).alias("pos"), F.sum("deal_amount").alias("deal_amount"), F.sum("value").alias("value"), F.count("*").alias("count"))
