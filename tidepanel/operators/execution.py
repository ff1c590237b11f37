"""Orders, fills and target holdings (R)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tradability(panel: DataFrame, limit: float | tuple[Column, Column] | None = 0.095) -> DataFrame:
    """Suspended without a close; limit_buy and limit_sell there, and where the change reaches the limit, one of two conditions holds, or nowhere else (None)."""
    suspended = F.col("close").isNull()
    buy, sell = (F.lit(False),) * 2 if limit is None else limit if isinstance(limit, tuple) else (F.col("change") >= limit, F.col("change") <= -limit)
    flag = lambda c: F.coalesce(c.cast("boolean"), F.lit(False)) | suspended
    return panel.withColumns({"suspended": suspended, "limit_buy": flag(buy), "limit_sell": flag(sell)})


def over_ranges(quotes: DataFrame, ranges: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """H4: for each range (range_id, instrument, start, end) any aggregates of the instrument's quotes within it.

    Ranges are spread over the days they touch, so the join is by (instrument, day) and the times are compared after it: for short
    ranges.  ``range_totals`` takes ranges of any length.
    """
    days = ranges.withColumn("_day", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))))
    hit = days.join(quotes.withColumn("_day", F.to_date("datetime")), ["instrument", "_day"]).where(F.col("datetime").between(F.col("start"), F.col("end")))
    found = hit.groupBy("range_id").agg(*[a.alias(n) for n, a in aggregates.items()])
    return ranges.join(found, "range_id", "left")


def range_totals(quotes: DataFrame, ranges: DataFrame, aggregates: dict[str, tuple[str, Column]], block: str = "month") -> DataFrame:
    """H4: sums, counts, means, last present values and conjunctions (``sum``, ``count``, ``mean``, ``last``, ``all``) over ranges of any length.

    The ends of the ranges are sorted among the quotes, which carry running totals within blocks of time; a table of a row a block
    carries them on.  A range's total is what its first block has left, its last block has so far, and the blocks between.  So a
    range costs two rows however long it is, quotes aren't copied, and no task holds an instrument's whole history.

    Totals are of finite values; a range without present values has missing ones, and so has one that ends before it starts.
    """
    makes = {f"_c{i}": c for i, (_, c) in enumerate(aggregates.values())}
    kinds = dict(zip(makes, (k for k, _ in aggregates.values()), strict=True))
    time = F.col("datetime").cast("timestamp")
    # starts come before the quotes of their time, ends after them
    rows = quotes.select("instrument", time.alias("t"), F.lit(1).alias("o"), F.lit(None).cast(ranges.schema["range_id"].dataType).alias("range_id"), *[c.alias(n) for n, c in makes.items()])
    for order, c in ((0, "start"), (2, "end")):
        ends = ranges.where("start <= `end`").select("range_id", "instrument", F.col(c).cast("timestamp").alias("t"), F.lit(order).alias("o"))
        rows = rows.unionByName(ends, allowMissingColumns=True)
    rows = rows.withColumn("block", F.date_trunc(block, "t"))
    sums, lasts = {}, {}
    for n, kind in kinds.items():
        c = F.col(n)
        sums[f"n{n}"] = F.count(c)
        if kind in ("sum", "mean"):
            sums[f"s{n}"] = F.sum(c.cast("double"))
        elif kind == "all":
            sums[f"f{n}"] = F.count(F.when(~c, 1))
        elif kind == "last":
            lasts[f"l{n}"] = F.max(F.when(c.isNotNull(), F.struct("t", c.alias("v"))))
    w = W.partitionBy("instrument", "block").orderBy("t", "o").rowsBetween(W.unboundedPreceding, 0)
    none = lambda c: F.coalesce(c, F.lit(0))
    at = rows.withColumns({k: none(a.over(w)) for k, a in sums.items()} | {k: a.over(w) for k, a in lasts.items()}).where("o <> 1")
    by = W.partitionBy("instrument").orderBy("block")
    whole = rows.groupBy("instrument", "block").agg(*[none(a).alias(k) for k, a in sums.items()], *[a.alias(k) for k, a in lasts.items()])
    whole = whole.withColumns({f"to_{k}": F.sum(k).over(by.rowsBetween(W.unboundedPreceding, 0)) for k in sums})
    before = {f"before_{k}": none(F.lag(f"to_{k}").over(by)) for k in sums} | {f"before_{k}": F.max(k).over(by.rowsBetween(W.unboundedPreceding, -1)) for k in lasts}
    whole = whole.withColumns(before).select("instrument", "block", *[F.col(k).alias(f"all_{k}") for k in sums], *[f"to_{k}" for k in sums], *before)
    at = at.join(whole, ["instrument", "block"])
    start = lambda c: F.max(F.when(F.col("o") == 0, F.col(c)))
    end = lambda c: F.max(F.when(F.col("o") == 2, F.col(c)))
    one = start("block") == end("block")

    def total(k: str) -> Column:
        apart = (start(f"all_{k}") - start(k)) + end(k) + (end(f"before_{k}") - start(f"to_{k}"))
        return F.when(one, end(k) - start(k)).otherwise(apart)

    made = []
    for (name, (kind, _)), n in zip(aggregates.items(), makes, strict=True):
        there = total(f"n{n}")
        if kind == "last":
            value = F.coalesce(end(f"l{n}"), end(f"before_l{n}"))["v"]
        elif kind == "all":
            value = total(f"f{n}") == 0
        else:
            value = there if kind == "count" else total(f"s{n}") / (there if kind == "mean" else F.lit(1.0))
        made.append(F.when(there > 0, value).alias(name))
    return ranges.join(at.groupBy("range_id").agg(*made), "range_id", "left")


def tradable_over(quotes: DataFrame, ranges: DataFrame) -> DataFrame:
    """R2: limited only if all bars are; suspended if no bar has a close."""
    return range_totals(quotes, ranges, {c: ("all", F.col(c)) for c in ("limit_buy", "limit_sell", "suspended")})


def deal_price(quotes: DataFrame, ranges: DataFrame, field: str = "vwap") -> DataFrame:
    """The last present price of the range; missing or tiny ones become the last close."""
    out = range_totals(quotes, ranges, {"_p": ("last", F.col(field)), "_c": ("last", F.col("close"))})
    return out.withColumn("deal_price", F.when(F.col("_p") > 1e-8, F.col("_p")).otherwise(F.col("_c"))).drop("_p", "_c")


def extra_quotes(quotes: DataFrame, extra: DataFrame) -> DataFrame:
    """More rows; columns they lack are missing, flags false."""
    for c in ("limit_buy", "limit_sell", "suspended"):
        if c in quotes.columns and c not in extra.columns:
            extra = extra.withColumn(c, F.lit(False))
    return quotes.unionByName(extra, allowMissingColumns=True)


def weights_to_amounts(df: DataFrame, cash: float) -> DataFrame:
    """(datetime, instrument, weight, price, tradable): the day's tradable weights share the cash; weights outside 0 to 1, or over 1 in sum, are an error."""
    day = W.partitionBy("datetime")
    bad = (F.col("weight") < 0) | (F.col("weight") > 1) | (F.sum("weight").over(day) > 1 + 1e-5)
    share = F.when(F.col("tradable"), F.col("weight")).otherwise(0.0)
    amount = F.floor(F.lit(float(cash)) * share / F.nullif(F.sum(share).over(day), F.lit(0.0)) / F.col("price"))
    return df.withColumn("amount", F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("weights must be in 0 to 1 and sum to 1 at most"))).otherwise(amount).cast("double"))


def target_amounts(df: DataFrame, value: float, risk: float = 0.95) -> DataFrame:
    """Risk * value * weight / close; untradable held stock goes by its held price."""
    price = F.when(F.col("tradable"), F.col("close")).otherwise(F.coalesce("held_price", "close"))
    return df.withColumn("target", F.lit(float(value) * risk) * F.col("weight") / F.nullif(price, F.lit(0.0)))


def round_unit(amount: Column, factor: Column, unit: float = 100.0) -> Column:
    """R8."""
    return F.floor((amount * factor + 0.1) / unit) * unit / factor


def order_deltas(target: DataFrame, current: DataFrame, unit: float = 100.0) -> DataFrame:
    """(instrument, target, factor, tradable) against (instrument, amount): orders, sells first; a target of 0 sells everything."""
    both = target.join(current, "instrument", "full")
    to, have = F.coalesce("target", F.lit(0.0)), F.coalesce("amount", F.lit(0.0))
    rounded = F.signum(to - have) * round_unit(F.abs(to - have), F.coalesce("factor", F.lit(1.0)), unit)
    delta = F.when(to == 0, -have).otherwise(rounded)
    out = both.where(F.coalesce("tradable", F.lit(True))).withColumn("delta", delta).where("delta <> 0")
    return out.select("instrument", F.abs("delta").alias("amount"), F.when(F.col("delta") < 0, "sell").otherwise("buy").alias("direction"), F.when(F.col("delta") < 0, 0).otherwise(1).alias("priority"))


def fill_rates(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """deal_amount / amount, without fills 0."""
    done = fills.groupBy("order_id").agg(F.sum("deal_amount").alias("deal_amount"))
    return orders.join(done, "order_id", "left").withColumn("ffr", F.coalesce(F.col("deal_amount") / F.nullif(F.col("amount"), F.lit(0.0)), F.lit(0.0)))


def aggregate_fills(fills: DataFrame) -> DataFrame:
    """Sums by (order_id, instrument), price by amount, the direction's sign."""
    amount = F.sum("deal_amount")
    return fills.groupBy("order_id", "instrument").agg(
        amount.alias("deal_amount"), F.sum("value").alias("value"), F.sum("cost").alias("cost"),
        (F.sum(F.col("deal_amount") * F.col("price")) / F.nullif(amount, F.lit(0.0))).alias("trade_price"), F.signum(F.sum(F.col("deal_amount") * F.col("direction"))).alias("direction"),
    )


def base_price(quotes: DataFrame, ranges: DataFrame) -> DataFrame:
    """TWAP and VWAP of prices over 1e-8 in each range."""
    good = F.when(F.col("price") > 1e-8, F.col("price"))
    volume = F.when(F.col("price") > 1e-8, F.col("volume"))
    out = range_totals(quotes, ranges, {"twap": ("mean", good), "_a": ("sum", good * volume), "_v": ("sum", volume)})
    return out.withColumn("vwap", F.col("_a") / F.nullif(F.col("_v"), F.lit(0.0))).drop("_a", "_v")


def price_advantage(direction: Column, trade: Column, base: Column) -> Column:
    """Direction 1 buys, 0 sells."""
    return (1 - 2 * direction) * (trade / F.nullif(base, F.lit(0.0)) - 1)


def paper_returns(df: DataFrame, k: int) -> DataFrame:
    """Top-k and bottom-k of tradable scores, next bar's return (missing 0): long, short, long_short."""
    day = W.partitionBy("datetime")
    nxt = F.coalesce(F.lead("change").over(W.partitionBy("instrument").orderBy("datetime")), F.lit(0.0))
    rows = df.withColumn("_r", nxt).withColumn("_s", F.when(~F.col("suspended"), F.col("score")))
    picked = rows.withColumns({
        "_t": (F.row_number().over(day.orderBy(F.desc_nulls_last("_s"), "instrument")) <= k) & F.col("_s").isNotNull(),
        "_b": (F.row_number().over(day.orderBy(F.asc_nulls_last("_s"), "instrument")) <= k) & F.col("_s").isNotNull(),
    })
    mean = lambda f: F.avg(F.when(f, F.col("_r")))
    m = picked.groupBy("datetime").agg(mean(F.col("_t")).alias("t"), mean(F.col("_b")).alias("b"), mean(~F.col("suspended")).alias("a"))
    return m.selectExpr("datetime", "t - a AS long", "a - b AS short", "t - b AS long_short")


def top_k(df: DataFrame, k: int) -> DataFrame:
    """The first k by score with equal weights."""
    order = W.partitionBy("datetime").orderBy(F.desc("score"), "instrument")
    rows = df.where("score IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return rows.withColumn("weight", 1 / F.count("*").over(W.partitionBy("datetime"))).select("datetime", "instrument", "rank", "weight")


def valuation(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Sum of amount * deal price by date; positions (datetime, instrument, amount)."""
    return positions.join(prices, ["datetime", "instrument"]).groupBy("datetime").agg(F.sum(F.col("amount") * F.col("deal_price")).alias("value"))
