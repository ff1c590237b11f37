"""Evaluation of scores against labels (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.nulls import safe_corr
from tidepanel.operators.processors import average_rank

def by_day():
    return W.partitionBy("datetime")



def calc_ic(df: DataFrame, pred: str = "score", label: str = "label", by: tuple[str, ...] = ("datetime",)) -> DataFrame:
    """Per day Pearson (ic) and Spearman (ric) over rows with both values."""
    both = df.where(F.col(pred).isNotNull() & F.col(label).isNotNull())
    both = both.withColumns({"_rp": average_rank(pred, *by), "_rl": average_rank(label, *by)})
    return both.groupBy(*by).agg(safe_corr(F.col(pred), F.col(label)).alias("ic"), safe_corr(F.col("_rp"), F.col("_rl")).alias("ric"))


def calc_all_ic(df: DataFrame, preds: list[str], label: str = "label") -> DataFrame:
    """P1 for many predictors in one grouping, by (name, datetime)."""
    long = df.select("datetime", label, F.explode(F.array(*[F.struct(F.lit(p).alias("name"), F.col(p).alias("score")) for p in preds])).alias("p"))
    return calc_ic(long.select("datetime", label, "p.name", "p.score"), "score", label, ("name", "datetime"))


def ic_summary(ic: DataFrame, *by: str) -> DataFrame:
    """Means and their ratios to the sample deviation."""
    ratio = lambda c: F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0))
    return ic.groupBy(*by).agg(F.avg("ic").alias("ic"), ratio("ic").alias("icir"), F.avg("ric").alias("rank_ic"), ratio("ric").alias("rank_icir"))


def mse(df: DataFrame, pred: str = "score", label: str = "label") -> DataFrame:
    """P5."""
    square = F.avg(F.pow(F.col(pred) - F.col(label), F.lit(2)))
    return df.agg(square.alias("mse"), F.sqrt(square).alias("rmse"))


def tails(df: DataFrame, q: float, pred: str = "score") -> DataFrame:
    """Flags _top and _bottom of each day's int(n * q) rows by score; n counts missing scores, which are never picked; ties go by instrument."""
    n = F.floor(F.count("*").over(by_day()) * F.lit(q))
    top = F.row_number().over(by_day().orderBy(F.desc_nulls_last(pred), "instrument"))
    low = F.row_number().over(by_day().orderBy(F.asc_nulls_last(pred), "instrument"))
    have = F.col(pred).isNotNull()
    return df.withColumns({"_top": (top <= n) & have, "_bottom": (low <= n) & have})


def long_short_return(df: DataFrame, q: float = 0.2, label: str = "label") -> DataFrame:
    """(long - short) / 2 and the day's average label."""
    t = tails(df, q)
    mean = lambda f: F.avg(F.when(F.col(f), F.col(label)))
    return t.groupBy("datetime").agg(((mean("_top") - mean("_bottom")) / 2).alias("long_short"), F.avg(label).alias("long_avg"))


def long_short_precision(df: DataFrame, q: float = 0.2, label: str = "label", alpha: bool = False) -> DataFrame:
    """Share of positive labels on top and of negative ones at the bottom."""
    if alpha:
        df = df.withColumn(label, F.col(label) - F.avg(label).over(by_day()))
    t = tails(df, q)
    share = lambda f, test: F.sum(F.when(F.col(f) & test, 1).otherwise(0)) / F.nullif(F.sum(F.col(f).cast("int")), F.lit(0))
    return t.groupBy("datetime").agg(share("_top", F.col(label) > 0).alias("long_prec"), share("_bottom", F.col(label) < 0).alias("short_prec"))


def annualised(daily: DataFrame, col: str = "long_short", days: int = 252) -> DataFrame:
    """P8."""
    return daily.agg((F.avg(col) * days).alias("annual"), (F.avg(col) / F.nullif(F.stddev_samp(col), F.lit(0.0)) * F.sqrt(F.lit(days))).alias("sharpe"))


def shifted_by_date(df: DataFrame, lag: int, *cols: str) -> DataFrame:
    """Rows whose columns are those of the same instrument ``lag`` dates earlier, as prev_*."""
    dates = df.select("datetime").distinct().withColumn("_i", F.row_number().over(W.orderBy("datetime")))
    at = df.join(dates, "datetime")
    before = at.select("instrument", (F.col("_i") + lag).alias("_i"), *[F.col(c).alias(f"prev_{c}") for c in cols])
    return at.join(before, ["instrument", "_i"], "left").drop("_i")


def pred_autocorr(df: DataFrame, lag: int = 1, pred: str = "score") -> DataFrame:
    """Per date correlation with the scores ``lag`` dates earlier."""
    return shifted_by_date(df, lag, pred).groupBy("datetime").agg(safe_corr(F.col(pred), F.col(f"prev_{pred}")).alias("autocorr"))


def rank_autocorr(df: DataFrame, lag: int = 1, pred: str = "score") -> DataFrame:
    """P10: the same of percent ranks, with the instrument's own lagged rows."""
    prev = df.withColumn("prev", F.lag(pred, lag).over(W.partitionBy("instrument").orderBy("datetime")))
    return prev.withColumns({"_a": average_rank(pred, "datetime"), "_b": average_rank("prev", "datetime")}).groupBy("datetime").agg(safe_corr(F.col("_a"), F.col("_b")).alias("autocorr"))


def group_return(df: DataFrame, n: int = 5, pred: str = "score", label: str = "label") -> DataFrame:
    """Mean labels of n slots of equal size by falling score, with long-short and long-average."""
    rows = df.where(F.col(label).isNotNull() & F.col(pred).isNotNull())
    size = F.floor(F.count("*").over(by_day()) / n)
    at = F.row_number().over(by_day().orderBy(F.desc(pred), "instrument")) - 1
    slot = rows.withColumn("_g", F.when(size > 0, F.floor(at / size) + 1))
    mean = lambda i: F.avg(F.when(F.col("_g") == i, F.col(label)))
    out = slot.groupBy("datetime").agg(*[mean(i).alias(f"group{i}") for i in range(1, n + 1)], F.avg(label).alias("average"))
    return out.withColumns({"long_short": F.col("group1") - F.col(f"group{n}"), "long_average": F.col("group1") - F.col("average")})


def pred_turnover(df: DataFrame, n: int = 5, lag: int = 1, pred: str = "score") -> DataFrame:
    """One minus the overlap of the day's top (bottom) share with that of the lagged score."""
    prev = df.withColumn("_prev", F.lag(pred, lag).over(W.partitionBy("instrument").orderBy("datetime")))
    k = F.floor(F.count("*").over(by_day()) / n)
    place = lambda c, order: F.row_number().over(by_day().orderBy(order(c), "instrument")) <= k
    flags = prev.withColumns({
        "_t": place(pred, F.desc_nulls_last), "_pt": place("_prev", F.desc_nulls_last), "_b": place(pred, F.asc_nulls_last), "_pb": place("_prev", F.asc_nulls_last), "_k": k,
    })
    share = lambda a, b: 1 - F.sum((F.col(a) & F.col(b)).cast("int")) / F.nullif(F.max("_k"), F.lit(0))
    return flags.groupBy("datetime").agg(share("_t", "_pt").alias("top"), share("_b", "_pb").alias("bottom"))


def monthly_ic(ic: DataFrame) -> DataFrame:
    """Mean ic by (year, month) with a row for every month between the first and the last."""
    months = ic.groupBy(F.trunc("datetime", "month").alias("m")).agg(F.avg("ic").alias("ic"))
    spine = months.agg(F.explode(F.sequence(F.min("m"), F.max("m"), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    return spine.join(months, "m", "left").select(F.year("m").alias("year"), F.month("m").alias("month"), "ic")


def tail_metrics(df: DataFrame, q: float = 0.2, least: int = 10, label: str = "label") -> DataFrame:
    """Precision and mean of day-demeaned labels in both tails, for days with ``least`` rows per tail."""
    t = tails(df.withColumn("_y", F.col(label) - F.avg(label).over(by_day())), q)
    n = F.sum(F.col("_top").cast("int"))
    return t.groupBy("datetime").agg(
        n.alias("_n"), F.avg(F.when(F.col("_top"), (F.col("_y") > 0).cast("double"))).alias("top_prec"), F.avg(F.when(F.col("_top"), F.col("_y"))).alias("top_mean"),
        F.avg(F.when(F.col("_bottom"), (F.col("_y") < 0).cast("double"))).alias("bottom_prec"), F.avg(F.when(F.col("_bottom"), F.col("_y"))).alias("bottom_mean"),
    ).where(F.col("_n") >= least).drop("_n")


def rank_ic_matrix(df: DataFrame, by: str = "segment", fill: str = "max") -> DataFrame:
    """Rank IC less the day's mean for every segment and day.

    Missing cells get the day's largest value (``max``), zero, or a value of their segment (``maxseg``): over the days that the segment
    lacks, the largest mean of the segments that have all of them.  What is still missing is 0.
    """
    ic = calc_ic(df, by=(by, "datetime")).select(by, "datetime", "ric")
    ic = ic.withColumn("ric", F.col("ric") - F.avg("ric").over(by_day()))
    # one row with the segments' names
    names = df.agg(F.collect_set(by).alias("_names"))
    spine = df.select("datetime").distinct().crossJoin(F.broadcast(names)).select("datetime", F.explode("_names").alias(by))
    full = spine.join(ic, [by, "datetime"], "left")
    if fill == "max":
        full = full.withColumn("ric", F.coalesce("ric", F.max("ric").over(by_day())))
    elif fill == "maxseg":
        lacks = full.where("ric IS NULL").select(F.col(by).alias("_lacks"), "datetime")
        others = lacks.join(full, "datetime").groupBy("_lacks", by).agg(F.avg("ric").alias("_m"), F.count("ric").alias("_n"), F.count("*").alias("_all"))
        value = others.where("_n = _all").groupBy(F.col("_lacks").alias(by)).agg(F.max("_m").alias("_fill"))
        full = full.join(value, by, "left").withColumn("ric", F.coalesce("ric", "_fill")).drop("_fill")
    return full.withColumn("ric", F.coalesce("ric", F.lit(0.0))).select(by, "datetime", "ric")


def curve_ratio(df: DataFrame, curve: list[str], by: str = "datetime") -> DataFrame:
    """``ratio``, the mean percent rank of a loss curve's last tenth over that of its first."""
    part = max(1, len(curve) // 10)
    n = F.count("*").over(W.partitionBy(by))
    ranks = df.withColumns({f"_r{i}": average_rank(c, by) / n for i, c in enumerate(curve)})
    mean = lambda places: sum((F.col(f"_r{i}") for i in places), F.lit(0.0)) / part
    out = ranks.withColumn("ratio", mean(range(len(curve) - part, len(curve))) / mean(range(part)))
    return out.drop(*[f"_r{i}" for i in range(len(curve))])


def loss_weights(df: DataFrame, decay: float = 0.5, bins: int = 10, k: int = 1, by: str = "datetime") -> DataFrame:
    """Weight 1 / (decay ** k * the bin's mean + 0.1) of rows (loss, ratio).

    The value of a row is the mean of the percent ranks of its negative loss and of its ratio; bins are of equal width between the
    least and the largest value, closed on the right.  Ranks need a total order over a group, so groups are dates.
    """
    whole = W.partitionBy(by)
    down = df.withColumn("_loss", -F.col("loss"))
    h = (average_rank("_loss", by) + average_rank("ratio", by)) / F.count("*").over(whole) / 2
    v = down.withColumn("_h", h)
    width = (F.max("_h").over(whole) - F.min("_h").over(whole)) / bins
    place = F.ceil(F.round((F.col("_h") - F.min("_h").over(whole)) / F.nullif(width, F.lit(0.0)), 9))
    v = v.withColumn("_bin", F.greatest(F.lit(1), F.coalesce(place, F.lit(1))))
    return v.withColumn("weight", 1 / (F.lit(decay**k) * F.avg("_h").over(W.partitionBy(by, "_bin")) + 0.1)).drop("_h", "_bin", "_loss")
