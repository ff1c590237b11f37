"""Queries on signals, returns, execution and risk (P to S, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.nulls import safe_corr
from tidepanel.operators import execution as R
from tidepanel.operators import returns as Q
from tidepanel.operators import risk as S
from tidepanel.operators import signals as P
from tidepanel.queries.base import BARS, MARKET, bars, market, panel, rounded, scores, sql
from tidepanel.sources.scratch import written
from tidepanel.sources.tables import calendar_of, read

QUERIES, ORACLES = {}, {}
KEYS = "instrument datetime"


def add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


_corr = lambda a, b: f"covar_samp({a}, {b}) / nullif(stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END), 0)"
_rk = lambda c, by="datetime": f"(rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0)"
IC = BARS + f", ic AS (SELECT datetime, {_corr('score', 'label')} AS ic, {_corr('rp', 'rl')} AS ric FROM (SELECT *, {_rk('score')} AS rp, {_rk('label')} AS rl FROM scores WHERE label IS NOT NULL) GROUP BY 1)"
add("p1_ic", lambda s, d: rounded(P.calc_ic(scores(s, d))), sql("SELECT * FROM ic", "datetime", "ic ric", IC))
add("p2_all_ic", lambda s, d: rounded(P.calc_all_ic(scores(s, d), ["score", "volume"])), sql(" UNION ALL ".join(f"SELECT '{c}' AS name, datetime, {_corr(c, 'label')} AS ic, {_corr('rp', 'rl')} AS ric FROM (SELECT *, {_rk(c)} AS rp, {_rk('label')} AS rl FROM scores WHERE label IS NOT NULL) GROUP BY 2" for c in ("score", "volume")), "name datetime", "ic ric"))
add("p3_ic_summary", lambda s, d: rounded(P.ic_summary(P.calc_ic(scores(s, d)))), sql("SELECT avg(ic) AS ic, avg(ic) / stddev_samp(ic) AS icir, avg(ric) AS rank_ic, avg(ric) / stddev_samp(ric) AS rank_icir FROM ic", "", "ic icir rank_ic rank_icir", IC))
add("p4_ic_segments", lambda s, d: rounded(P.ic_summary(P.calc_ic(scores(s, d)).withColumn("segment", F.year("datetime").cast("long")), "segment")), sql("SELECT year(datetime) AS segment, avg(ic) AS ic, avg(ic) / stddev_samp(ic) AS icir, avg(ric) AS rank_ic, avg(ric) / stddev_samp(ric) AS rank_icir FROM ic GROUP BY 1", "segment", "ic icir rank_ic rank_icir", IC))
add("p5_mse", lambda s, d: rounded(P.mse(scores(s, d)), 3), sql("SELECT avg(pow(score - label, 2)) AS mse, sqrt(avg(pow(score - label, 2))) AS rmse FROM scores", "", "mse rmse", digits=3))
TAILS = BARS + ", tails AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) <= floor(n * 0.2) AS t, row_number() OVER (PARTITION BY datetime ORDER BY score, instrument) <= floor(n * 0.2) AS b, label - avg(label) OVER (PARTITION BY datetime) AS y FROM (SELECT *, count(*) OVER (PARTITION BY datetime) AS n FROM scores))"
add("p6_long_short", lambda s, d: rounded(P.long_short_return(scores(s, d))), sql("SELECT datetime, (avg(CASE WHEN t THEN label END) - avg(CASE WHEN b THEN label END)) / 2 AS long_short, avg(label) AS long_avg FROM tails GROUP BY 1", "datetime", "long_short long_avg", TAILS))
add("p7_precision", lambda s, d: rounded(P.long_short_precision(scores(s, d))), sql("SELECT datetime, sum((t AND coalesce(label > 0, false))::INT) / nullif(sum(t::INT), 0) AS long_prec, sum((b AND coalesce(label < 0, false))::INT) / nullif(sum(b::INT), 0) AS short_prec FROM tails GROUP BY 1", "datetime", "long_prec short_prec", TAILS))
add("p8_annualised", lambda s, d: rounded(P.annualised(P.long_short_return(scores(s, d))), 4), sql("SELECT avg(x) * 252 AS annual, avg(x) / stddev_samp(x) * sqrt(252) AS sharpe FROM (SELECT (avg(CASE WHEN t THEN label END) - avg(CASE WHEN b THEN label END)) / 2 AS x FROM tails GROUP BY datetime)", "", "annual sharpe", TAILS, digits=4))
NUM = BARS + ", x AS (SELECT scores.*, i, lag(score) OVER (PARTITION BY instrument ORDER BY datetime) AS prev FROM scores JOIN (SELECT datetime, row_number() OVER (ORDER BY datetime) AS i FROM (SELECT DISTINCT datetime FROM scores)) USING (datetime))"
add("p9_autocorr", lambda s, d: rounded(P.pred_autocorr(scores(s, d), 2)), sql(f"SELECT datetime, {_corr('score', 'o')} AS autocorr FROM (SELECT a.datetime, a.score, b.score AS o FROM x a LEFT JOIN x b ON a.instrument = b.instrument AND b.i = a.i - 2) GROUP BY 1", "datetime", "autocorr", NUM))
add("p10_rank_autocorr", lambda s, d: rounded(P.rank_autocorr(scores(s, d))), sql(f"SELECT datetime, {_corr('ra', 'rb')} AS autocorr FROM (SELECT datetime, {_rk('score')} AS ra, CASE WHEN prev IS NOT NULL THEN {_rk('prev')} END AS rb FROM x) GROUP BY 1", "datetime", "autocorr", NUM))
_g = lambda i: f"avg(CASE WHEN g = {i} THEN label END)"
add("p11_group_return", lambda s, d: rounded(P.group_return(scores(s, d), 3)), sql(f"SELECT datetime, {_g(1)} AS group1, {_g(2)} AS group2, {_g(3)} AS group3, avg(label) AS average, {_g(1)} - {_g(3)} AS long_short, {_g(1)} - avg(label) AS long_average FROM (SELECT *, CASE WHEN n // 3 > 0 THEN (row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) - 1) // (n // 3) + 1 END AS g FROM (SELECT *, count(*) OVER (PARTITION BY datetime) AS n FROM scores WHERE label IS NOT NULL)) GROUP BY 1", "datetime", "group1 group2 group3 average long_short long_average"))
_pl = lambda c, o: f"row_number() OVER (PARTITION BY datetime ORDER BY {c} {o} NULLS LAST, instrument) <= k"
add("p12_turnover", lambda s, d: rounded(P.pred_turnover(scores(s, d), 5)), sql(f"SELECT datetime, 1 - sum((a AND b)::INT) / nullif(max(k), 0) AS top, 1 - sum((c AND e)::INT) / nullif(max(k), 0) AS bottom FROM (SELECT datetime, k, {_pl('score', 'DESC')} AS a, {_pl('prev', 'DESC')} AS b, {_pl('score', 'ASC')} AS c, {_pl('prev', 'ASC')} AS e FROM (SELECT *, count(*) OVER (PARTITION BY datetime) // 5 AS k FROM x)) GROUP BY 1", "datetime", "top bottom", NUM))
add("p13_monthly_ic", lambda s, d: rounded(P.monthly_ic(P.calc_ic(scores(s, d)))), sql("SELECT year(m)::INT AS year, month(m)::INT AS month, x.ic FROM (SELECT unnest(generate_series(min(date_trunc('month', datetime)::TIMESTAMP), max(date_trunc('month', datetime)::TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM ic) LEFT JOIN (SELECT date_trunc('month', datetime)::TIMESTAMP AS m, avg(ic) AS ic FROM ic GROUP BY 1) x USING (m)", "year month", "ic", IC))
add("p14_tails", lambda s, d: rounded(P.tail_metrics(scores(s, d), 0.2, 3)), sql("SELECT datetime, avg(CASE WHEN t THEN (y > 0)::INT END) AS top_prec, avg(CASE WHEN t THEN y END) AS top_mean, avg(CASE WHEN b THEN (y < 0)::INT END) AS bottom_prec, avg(CASE WHEN b THEN y END) AS bottom_mean FROM tails GROUP BY 1 HAVING sum(t::INT) >= 3", "datetime", "top_prec top_mean bottom_prec bottom_mean", TAILS))
_seg = lambda s, d: scores(s, d).withColumn("segment", F.when(F.col("instrument") < "Brand#2", "a").when(F.col("instrument") < "Brand#4", "b").otherwise("c"))
SEG = BARS + f", sg AS (SELECT *, CASE WHEN instrument < 'Brand#2' THEN 'a' WHEN instrument < 'Brand#4' THEN 'b' ELSE 'c' END AS segment FROM scores), sr AS (SELECT segment, datetime, {_corr('rp', 'rl')} AS ric FROM (SELECT *, {_rk('score', 'segment, datetime')} AS rp, {_rk('label', 'segment, datetime')} AS rl FROM sg WHERE label IS NOT NULL) GROUP BY 1, 2), fu AS MATERIALIZED (SELECT segment, datetime, ric - avg(ric) OVER (PARTITION BY datetime) AS ric FROM (SELECT DISTINCT datetime FROM sg) CROSS JOIN (SELECT DISTINCT segment FROM sg) LEFT JOIN sr USING (segment, datetime))"
add("p15_ic_matrix", lambda s, d: rounded(P.rank_ic_matrix(_seg(s, d))), sql("SELECT segment, datetime, coalesce(ric, max(ric) OVER (PARTITION BY datetime), 0) AS ric FROM fu", "segment datetime", "ric", SEG))
add("p15_ic_matrix_segments", lambda s, d: rounded(P.rank_ic_matrix(_seg(s, d), fill="maxseg")), sql("SELECT segment, datetime, coalesce(ric, fill, 0) AS ric FROM fu LEFT JOIN (SELECT lacks AS segment, max(m) AS fill FROM (SELECT l.segment AS lacks, f.segment, avg(f.ric) AS m FROM fu l JOIN fu f USING (datetime) WHERE l.ric IS NULL GROUP BY 1, 2 HAVING count(f.ric) = count(*)) GROUP BY 1) USING (segment)", "segment datetime", "ric", SEG))
_pc = lambda c: f"{_rk(c)} / count(*) OVER (PARTITION BY datetime)"
_curve = lambda s, d: P.curve_ratio(scores(s, d).select("instrument", "datetime", F.col("volume").alias("loss"), (F.col("score") + 2).alias("c0"), "close", F.col("volume").alias("c2")), ["c0", "close", "c2"])
add("p16_weights", lambda s, d: rounded(P.loss_weights(_curve(s, d)).select("instrument", "datetime", "loss", "ratio", "weight")), sql(
    f"SELECT instrument, datetime, volume AS loss, ratio, 1 / (0.5 * avg(h) OVER (PARTITION BY datetime, bin) + 0.1) AS weight FROM (SELECT *, greatest(1, coalesce(ceil(round((h - lo) / nullif((hi - lo) / 10, 0), 9)), 1)) AS bin FROM (SELECT *, min(h) OVER (PARTITION BY datetime) AS lo, max(h) OVER (PARTITION BY datetime) AS hi FROM (SELECT *, ({_rk('down')} + {_rk('ratio')}) / count(*) OVER (PARTITION BY datetime) / 2 AS h FROM (SELECT *, -volume AS down, ({_pc('volume')}) / ({_pc('score')}) AS ratio FROM scores))))", KEYS, "loss ratio weight"))

# Q
M = BARS + "," + MARKET + ", dd AS (SELECT *, c - max(c) OVER (ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dr FROM (SELECT *, sum(ret) OVER (ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM market))"
_up = "OVER (ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_risk = "mean std annualized_return information_ratio max_drawdown"
add("q1_risk", lambda s, d: rounded(Q.risk_analysis(market(s, d)), 4), sql("SELECT avg(ret) AS mean, stddev_samp(ret) AS std, avg(ret) * 238 AS annualized_return, avg(ret) / stddev_samp(ret) * sqrt(238) AS information_ratio, min(dr) AS max_drawdown FROM dd", "", _risk, M, 4))
add("q2_risk_product", lambda s, d: rounded(Q.risk_analysis(market(s, d).withColumn("return", F.col("return") / 100), mode="product"), 4), sql(f"SELECT exp(avg(l)) - 1 AS mean, stddev_samp(l) AS std, exp(avg(l) * 238) - 1 AS annualized_return, avg(l) / stddev_samp(l) * sqrt(238) AS information_ratio, min(w / p - 1) AS max_drawdown FROM (SELECT *, max(w) {_up} AS p FROM (SELECT *, exp(sum(l) {_up}) AS w FROM (SELECT datetime, ln(1 + ret / 100) AS l FROM market)))", "", _risk, M, 4))
add("q3_monthly_risk", lambda s, d: rounded(Q.monthly_risk(market(s, d)), 4), sql("SELECT month, avg(ret) AS mean, stddev_samp(ret) AS std, avg(ret) * 238 AS annualized_return, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(238) AS information_ratio, min(x) AS max_drawdown FROM (SELECT *, c - max(c) OVER (PARTITION BY month ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM (SELECT datetime, ret, date_trunc('month', datetime)::DATE AS month, sum(ret) OVER (PARTITION BY date_trunc('month', datetime) ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM market)) GROUP BY 1 HAVING count(*) >= 3", "month", _risk, M, 4))
add("q4_curves", lambda s, d: rounded(Q.report_curves(market(s, d)).select("datetime", "cum_bench", "cum_return_w_cost", "cum_ex_return_wo_cost", "return_wo_mdd", "turnover"), 4), sql(f"SELECT datetime, sum(bench) {_up} AS cum_bench, sum(ret - cost) {_up} AS cum_return_w_cost, sum(ret - bench) {_up} AS cum_ex_return_wo_cost, dr AS return_wo_mdd, turnover FROM dd", "datetime", "cum_bench cum_return_w_cost cum_ex_return_wo_cost return_wo_mdd turnover", M, 4))
add("q5_drawdown_interval", lambda s, d: Q.drawdown_interval(market(s, d)), sql("SELECT s AS start, e AS \"end\" FROM (SELECT e, arg_max(datetime, c) AS s FROM dd, (SELECT arg_min(datetime, dr) AS e FROM dd) WHERE datetime <= e GROUP BY e)", "start end", ctes=M))


def positions(s, d):
    """The day's first five by score, amounts by volume, priced at close."""
    top = R.top_k(scores(s, d), 5)
    return top.join(bars(s, d).select("instrument", "datetime", F.col("volume").alias("amount"), F.col("close").alias("price")), ["instrument", "datetime"])


POS = BARS + ", pos AS (SELECT instrument, datetime, rank, 1 / count(*) OVER (PARTITION BY datetime) AS weight, volume AS amount, close AS price FROM (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) AS rank FROM scores) WHERE rank <= 5), cash AS (SELECT DISTINCT datetime, 1000.0::DOUBLE AS cash FROM bars), val AS (SELECT datetime, coalesce(v, 0) + cash AS value FROM cash LEFT JOIN (SELECT datetime, sum(amount * price) AS v FROM pos GROUP BY 1) USING (datetime))"
cash = lambda s, d: bars(s, d).select("datetime").distinct().withColumn("cash", F.lit(1000.0))
add("q6_value", lambda s, d: rounded(Q.position_value(positions(s, d), cash(s, d)), 4), sql("SELECT * FROM val", "datetime", "value", POS, 4))
add("q7_returns", lambda s, d: rounded(Q.daily_returns(Q.position_value(positions(s, d), cash(s, d)), 1000)), sql("SELECT datetime, value / coalesce(lag(value) OVER (ORDER BY datetime), 1000) - 1 AS return FROM val", "datetime", "return", POS))
add("q8_performance", lambda s, d: rounded(Q.performance(market(s, d)), 4), sql("SELECT avg(ret) * 250 AS annual_return, avg(ret) / stddev_samp(ret) / sqrt(250) AS sharpe, min(dr) AS max_drawdown, covar_samp(ret, bench) / var_pop(bench) AS beta, avg(ret) * 250 - covar_samp(ret, bench) / var_pop(bench) * avg(bench) * 250 AS alpha, stddev_samp(ret) * sqrt(250) AS volatility FROM dd", "", "annual_return sharpe max_drawdown beta alpha volatility", M, 4))
add("q9_table_ic", lambda s, d: rounded(Q.table_ic(scores(s, d), "score", "label")), sql(f"SELECT {_corr('score', 'label')} AS ic FROM scores", "", "ic"))
STATUS = POS + ", nx AS (SELECT datetime, lead(datetime) OVER (ORDER BY datetime) AS n FROM (SELECT DISTINCT datetime FROM pos)), st AS (SELECT coalesce(a.datetime, b.n) AS datetime, coalesce(a.instrument, b.instrument) AS instrument, CASE WHEN a.instrument IS NOT NULL AND b.instrument IS NULL THEN 1 WHEN a.instrument IS NOT NULL THEN 0 ELSE -1 END AS status FROM pos a FULL JOIN (SELECT instrument, n FROM pos JOIN nx USING (datetime) WHERE n IS NOT NULL) b ON a.datetime = b.n AND a.instrument = b.instrument)"
held = lambda s, d: Q.position_status(positions(s, d).select("datetime", "instrument"))
add("q10_status", held, sql("SELECT * FROM st", "datetime instrument status", ctes=STATUS))
add("q11_label_rank", lambda s, d: rounded(Q.label_rank(scores(s, d).where("label IS NOT NULL").select("instrument", "datetime", "label"), held(s, d))), sql("SELECT datetime, status, avg(r) AS rank_ratio, avg(x) AS excess FROM st JOIN (SELECT instrument, datetime, rank() OVER (PARTITION BY datetime ORDER BY label DESC) / count(*) OVER (PARTITION BY datetime) * 100 AS r, label - avg(label) OVER (PARTITION BY datetime) AS x FROM scores WHERE label IS NOT NULL) USING (instrument, datetime) GROUP BY 1, 2", "datetime status", "rank_ratio excess", STATUS))
add("q12_add_bench", lambda s, d: rounded(Q.add_bench(scores(s, d).select("instrument", "datetime", "score"), market(s, d))), sql("SELECT instrument, datetime, score, nb AS bench FROM scores LEFT JOIN (SELECT datetime, lead(bench) OVER (ORDER BY datetime) AS nb FROM market) USING (datetime)", KEYS, "score bench", M))
add("q13_status_returns", lambda s, d: rounded(Q.status_returns(held(s, d).join(scores(s, d).select("instrument", "datetime", "label"), ["instrument", "datetime"]).withColumn("label", F.coalesce("label", F.lit(0.0))).join(market(s, d).select("datetime", "bench"), "datetime").withColumn("weight", F.lit(0.2))), 4), sql(f"SELECT *, sum(hold) {_up} AS cum_hold, sum(buy) {_up} AS cum_buy, sum(sell) {_up} AS cum_sell FROM (SELECT datetime, sum(CASE WHEN status = 0 THEN v ELSE 0 END) AS hold, sum(CASE WHEN status = 1 THEN v ELSE 0 END) AS buy, sum(CASE WHEN status = -1 THEN v ELSE 0 END) AS sell FROM (SELECT st.datetime, status, 0.2::DOUBLE * (coalesce(label, 0) - bench) AS v FROM st JOIN scores USING (instrument, datetime) JOIN market ON market.datetime = st.datetime) GROUP BY 1)", "datetime", "hold buy sell cum_hold cum_buy cum_sell", STATUS + "," + MARKET, 4))
add("q14_bench_return", lambda s, d: rounded(Q.bench_return(bars(s, d))), sql("SELECT datetime, avg(c) AS bench FROM (SELECT datetime, coalesce(close / lag(close) OVER (PARTITION BY instrument ORDER BY datetime) - 1, 0) AS c FROM bars) GROUP BY 1", "datetime", "bench"))
add("q15_weights", lambda s, d: rounded(Q.stock_weights(positions(s, d), cash(s, d))), sql("SELECT datetime, instrument, amount * price / (sum(amount * price) OVER (PARTITION BY datetime) + 1000) AS weight FROM pos", KEYS, "weight", POS))
add("q16_bench_weights", lambda s, d: rounded(Q.bench_weights(bars(s, d).select(F.col("datetime").alias("date"), F.col("instrument").alias("code"), F.when(F.col("volume") > 20, "a").otherwise("b").alias("index"), F.col("volume").alias("weight")), "a")), sql("SELECT datetime AS date, instrument AS code, volume / 100 AS weight FROM bars WHERE volume > 20", "date code", "weight"))
add("q17_groups", lambda s, d: Q.stock_groups(scores(s, d), "volume", 3).select("instrument", "datetime", F.col("group").cast("long").alias("group")), sql("SELECT instrument, datetime, (3 - (volume > a)::INT - (volume > b)::INT)::BIGINT AS \"group\" FROM scores JOIN (SELECT datetime, quantile_cont(volume, 1/3::DOUBLE) AS a, quantile_cont(volume, 2/3::DOUBLE) AS b FROM scores GROUP BY 1) USING (datetime)", KEYS + " group"))
_part = lambda s, d: scores(s, d).where("label IS NOT NULL").withColumn("group", F.regexp_extract("instrument", r"#(\d)", 1))
_wp = lambda s, d: _part(s, d).select("datetime", "group", (F.col("volume") / 1000).alias("weight"), F.col("label").alias("ret"))
_wb = lambda s, d: _part(s, d).where("volume > 20").select("datetime", "group", F.lit(0.05).alias("weight"), F.col("label").alias("ret"))
GP = BARS + ", lab AS (SELECT *, regexp_extract(instrument, '#(\\d)', 1) AS g FROM scores WHERE label IS NOT NULL), gp AS (SELECT datetime, g, sum(volume / 1000) AS w, sum(volume / 1000 * label) / nullif(sum(volume / 1000), 0) AS r FROM lab GROUP BY 1, 2), gb AS (SELECT datetime, g, sum(0.05::DOUBLE) AS w, sum(0.05::DOUBLE * label) / nullif(sum(0.05::DOUBLE), 0) AS r FROM lab WHERE volume > 20 GROUP BY 1, 2)"
add("q18_decompose", lambda s, d: rounded(Q.decompose(_wp(s, d))), sql('SELECT datetime, g AS "group", w AS weight, r AS ret FROM gp', "datetime group", "weight ret", GP))
add("q19_brinson", lambda s, d: rounded(Q.brinson(Q.decompose(_wp(s, d)), Q.decompose(_wb(s, d)))), sql("SELECT datetime, q2 - q1 AS allocation, q3 - q1 AS selection, q4 - q3 - q2 + q1 AS interaction, q4 - q1 AS total FROM (SELECT datetime, sum(wb * rb) AS q1, sum(wp * rb) AS q2, sum(wb * rp) AS q3, sum(wp * rp) AS q4 FROM (SELECT coalesce(gp.datetime, gb.datetime) AS datetime, coalesce(gp.w, 0) AS wp, coalesce(gp.r, 0) AS rp, coalesce(gb.w, 0) AS wb, coalesce(gb.r, 0) AS rb FROM gp FULL JOIN gb ON gp.datetime = gb.datetime AND gp.g = gb.g) GROUP BY 1)", "datetime", "allocation selection interaction total", GP))


# R
def orders(s, d):
    return read(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_totalprice") / 1000).alias("amount"))


def fills(s, d):
    i = read(s, d, "lineitem")
    return i.select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").cast("string").alias("instrument"), F.col("l_quantity").alias("deal_amount"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_extendedprice").alias("value"), (F.col("l_extendedprice") * F.col("l_discount")).alias("cost"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("direction"))


def changed(s, d):
    from tidepanel.operators.prepare import calc_change

    return calc_change(panel(s, d))


_CH = BARS + ", ch AS (SELECT *, f / lag(f) OVER (PARTITION BY instrument ORDER BY datetime) - 1 AS change FROM (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM panel))"
add("r1_tradability", lambda s, d: R.tradability(changed(s, d), 0.5).select("instrument", "datetime", "suspended", "limit_buy", "limit_sell"), sql("SELECT instrument, datetime, close IS NULL AS suspended, (coalesce(change >= 0.5, false) OR close IS NULL) AS limit_buy, (coalesce(change <= -0.5, false) OR close IS NULL) AS limit_sell FROM ch", KEYS + " suspended limit_buy limit_sell", ctes=_CH))
ranges = lambda s, d: bars(s, d).where(F.dayofmonth("datetime") == 1).select(F.concat_ws("|", "instrument", F.date_format("datetime", "yyyyMMdd")).alias("range_id"), "instrument", F.col("datetime").alias("start"), (F.col("datetime") + F.expr("INTERVAL 9 DAYS")).alias("end"))
RG = _CH + ", rg AS (SELECT instrument || '|' || strftime(datetime, '%Y%m%d') AS range_id, instrument, datetime AS a, datetime + INTERVAL 9 DAY AS b FROM bars WHERE day(datetime) = 1)"
add("h4_range_agg", lambda s, d: rounded(R.range_totals(bars(s, d), ranges(s, d), {"total": ("sum", F.col("volume")), "mean": ("mean", F.col("close")), "last": ("last", F.col("close"))}).drop("start", "end")), sql("SELECT range_id, rg.instrument, sum(volume) AS total, avg(close) AS mean, last(close ORDER BY datetime) AS last FROM rg JOIN bars ON bars.instrument = rg.instrument AND datetime BETWEEN a AND b GROUP BY 1, 2", "range_id instrument", "total mean last", RG))
add("r2_tradable_over", lambda s, d: R.tradable_over(R.tradability(changed(s, d), 0.5), ranges(s, d)).select("range_id", "limit_buy", "limit_sell", "suspended"), sql("SELECT range_id, bool_and((coalesce(change >= 0.5, false) OR close IS NULL)) AS limit_buy, bool_and((coalesce(change <= -0.5, false) OR close IS NULL)) AS limit_sell, bool_and(close IS NULL) AS suspended FROM rg JOIN ch ON ch.instrument = rg.instrument AND datetime BETWEEN a AND b GROUP BY 1", "range_id limit_buy limit_sell suspended", ctes=RG))
add("r3_deal_price", lambda s, d: rounded(R.deal_price(panel(s, d), ranges(s, d)).select("range_id", "deal_price")), sql("SELECT range_id, last(vwap ORDER BY datetime) AS deal_price FROM rg JOIN bars ON bars.instrument = rg.instrument AND datetime BETWEEN a AND b GROUP BY 1", "range_id", "deal_price", RG))
add("r4_extra_quotes", lambda s, d: R.extra_quotes(R.tradability(changed(s, d), 0.5).where("close IS NOT NULL").select("instrument", "datetime", "suspended"), bars(s, d).where("volume > 40").select(F.concat(F.lit("x"), "instrument").alias("instrument"), "datetime")), sql("SELECT instrument, datetime, false AS suspended FROM bars UNION ALL SELECT 'x' || instrument, datetime, false FROM bars WHERE volume > 40", KEYS + " suspended"))
add("r5_amounts", lambda s, d: rounded(R.weights_to_amounts(positions(s, d).withColumn("tradable", F.col("amount") > 10), 1e6).select("instrument", "datetime", "amount")), sql("SELECT instrument, datetime, floor(1e6::DOUBLE * w / nullif(sum(w) OVER (PARTITION BY datetime), 0) / price) AS amount FROM (SELECT *, CASE WHEN amount > 10 THEN weight ELSE 0 END AS w FROM pos)", KEYS, "amount", POS))
add("r6_targets", lambda s, d: rounded(R.target_amounts(positions(s, d).withColumns({"tradable": F.col("amount") > 10, "close": F.col("price"), "held_price": F.col("price") * 2}), 1e6).select("instrument", "datetime", "target")), sql("SELECT instrument, datetime, 1e6::DOUBLE * 0.95 * weight / CASE WHEN amount > 10 THEN price ELSE price * 2 END AS target FROM pos", KEYS, "target", POS))
_day = lambda s, d, day: positions(s, d).where(F.col("datetime") == F.lit(day).cast("timestamp"))
add("r7_orders", lambda s, d: rounded(R.order_deltas(_last(s, d, 0).select("instrument", (F.col("amount") * 100).alias("target"), F.lit(1.0).alias("factor"), F.lit(True).alias("tradable")), _last(s, d, 1).select("instrument", (F.col("amount") * 70).alias("amount")), 100.0)), sql("SELECT instrument, abs(dl) AS amount, CASE WHEN dl < 0 THEN 'sell' ELSE 'buy' END AS direction, CASE WHEN dl < 0 THEN 0 ELSE 1 END AS priority FROM (SELECT coalesce(a.instrument, b.instrument) AS instrument, CASE WHEN a.amount IS NULL THEN -b.amount * 70 ELSE sign(a.amount * 100 - coalesce(b.amount * 70, 0)) * floor((abs(a.amount * 100 - coalesce(b.amount * 70, 0)) + 0.1) / 100) * 100 END AS dl FROM (SELECT * FROM pos WHERE datetime = (SELECT max(datetime) FROM pos)) a FULL JOIN (SELECT * FROM pos WHERE datetime = (SELECT max(datetime) FROM pos WHERE datetime < (SELECT max(datetime) FROM pos))) b ON a.instrument = b.instrument) WHERE dl <> 0", "instrument direction priority", "amount", POS))


def _last(s, d, back):
    p = positions(s, d)
    dates = p.select("datetime").distinct().orderBy(F.desc("datetime")).limit(back + 1).agg(F.min("datetime").alias("datetime"))
    return p.join(dates, "datetime")


add("r9_fill_rates", lambda s, d: rounded(R.fill_rates(orders(s, d), fills(s, d))), sql("SELECT o_orderkey AS order_id, o_totalprice / 1000 AS amount, q AS deal_amount, coalesce(q / (o_totalprice / 1000), 0) AS ffr FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey", "order_id", "amount deal_amount ffr"))
add("r10_fills", lambda s, d: rounded(R.aggregate_fills(fills(s, d)), 4), sql("SELECT l_orderkey AS order_id, l_suppkey::VARCHAR AS instrument, sum(l_quantity) AS deal_amount, sum(l_extendedprice) AS value, sum(l_extendedprice * l_discount) AS cost, sum(l_extendedprice) / sum(l_quantity) AS trade_price, sign(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END))::DOUBLE AS direction FROM lineitem GROUP BY 1, 2", "order_id instrument", "deal_amount value cost trade_price direction", digits=4))
long_ranges = lambda s, d: ranges(s, d).withColumn("end", F.col("start") + F.expr("INTERVAL 364 DAYS"))
add("r11_base_price_years", lambda s, d: rounded(R.base_price(bars(s, d).withColumn("price", F.col("close")), long_ranges(s, d)).select("range_id", "twap", "vwap")), sql(
    "SELECT range_id, avg(close) AS twap, sum(close * volume) / sum(volume) AS vwap FROM rg JOIN bars ON bars.instrument = rg.instrument AND datetime BETWEEN a AND a + INTERVAL 364 DAYS GROUP BY 1", "range_id", "twap vwap", RG))
add("r11_base_price", lambda s, d: rounded(R.base_price(bars(s, d).withColumn("price", F.col("close")), ranges(s, d)).select("range_id", "twap", "vwap")), sql("SELECT range_id, avg(close) AS twap, sum(close * volume) / sum(volume) AS vwap FROM rg JOIN bars ON bars.instrument = rg.instrument AND datetime BETWEEN a AND b GROUP BY 1", "range_id", "twap vwap", RG))
_steps = lambda s, d: bars(s, d).select("datetime", "instrument", (F.col("volume") / 100).alias("ffr"), R.price_advantage((F.col("volume") > 25).cast("int"), F.col("vwap"), F.col("close")).alias("pa"), F.col("volume").alias("deal_amount"), (F.col("volume") * F.col("vwap")).alias("value"))
add("r13_indicators", lambda s, d: rounded(Q.trade_indicators(_steps(s, d)), 4), sql("SELECT datetime, avg(f) AS ffr_mean, sum(f * volume) / sum(volume) AS ffr_amount, sum(f * v) / sum(v) AS ffr_value, avg(p) AS pa_mean, sum(p * volume) / sum(volume) AS pa_amount, sum(p * v) / sum(v) AS pa_value, avg((p > 0)::INT) AS pos, sum(volume) AS deal_amount, sum(v) AS value, count(*) AS count FROM (SELECT *, volume / 100 AS f, (1 - 2 * (volume > 25)::INT) * (vwap / close - 1) AS p, volume * vwap AS v FROM bars) GROUP BY 1", "datetime count", "ffr_mean ffr_amount ffr_value pa_mean pa_amount pa_value pos deal_amount value", digits=4))
_paper = lambda s, d: changed(s, d).withColumns({"suspended": F.col("close").isNull(), "score": F.col("vwap") / F.col("close") - 1})
add("r14_paper", lambda s, d: rounded(R.paper_returns(_paper(s, d), 3)), sql("SELECT datetime, t - a AS long, a - b AS short, t - b AS long_short FROM (SELECT datetime, avg(CASE WHEN i <= 3 AND s IS NOT NULL THEN r END) AS t, avg(CASE WHEN j <= 3 AND s IS NOT NULL THEN r END) AS b, avg(CASE WHEN close IS NOT NULL THEN r END) AS a FROM (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY s DESC NULLS LAST, instrument) AS i, row_number() OVER (PARTITION BY datetime ORDER BY s NULLS LAST, instrument) AS j FROM (SELECT *, vwap / close - 1 AS s, coalesce(lead(change) OVER (PARTITION BY instrument ORDER BY datetime), 0) AS r FROM ch)) GROUP BY 1)", "datetime", "long short long_short", _CH))
add("r15_top_k", lambda s, d: rounded(R.top_k(scores(s, d), 5)), sql("SELECT * FROM pos", KEYS + " rank", "weight", POS))
add("r16_valuation", lambda s, d: rounded(R.valuation(positions(s, d).select("instrument", "datetime", "amount"), bars(s, d).select("instrument", "datetime", F.col("vwap").alias("deal_price"))), 4), sql("SELECT datetime, sum(amount * vwap) AS value FROM pos JOIN bars USING (instrument, datetime) GROUP BY 1", "datetime", "value", POS, 4))

# S, X on logged closes, so that sums stay small
logged = lambda s, d: bars(s, d).select("instrument", "datetime", F.ln("close").alias("close"))
RET = BARS + ", r0 AS (SELECT instrument, datetime, (ln(close) / lag(ln(close)) OVER (PARTITION BY instrument ORDER BY datetime) - 1) * 100 AS x FROM bars), ret AS (SELECT instrument, datetime, x - avg(x) OVER (PARTITION BY instrument) AS x FROM r0 WHERE x IS NOT NULL), cov AS (SELECT a.instrument AS inst_i, b.instrument AS inst_j, sum(a.x * b.x) / count(*) AS cov FROM ret a JOIN ret b USING (datetime) GROUP BY 1, 2), vr AS (SELECT inst_i AS i, cov AS v FROM cov WHERE inst_i = inst_j), cv AS (SELECT cov.*, a.v AS vi, b.v AS vj FROM cov JOIN vr a ON a.i = inst_i JOIN vr b ON b.i = inst_j)"
ret = lambda s, d: S.risk_returns(logged(s, d))
cov = lambda s, d: S.covariance(ret(s, d))


def shrunk(spark, d, kind, intensity):
    """The covariance shrunk to a target; its cells are written once, as the target and the intensity read them too."""
    r, c = ret(spark, d), written(cov(spark, d))
    to = S.target(c, kind, r)
    return rounded(S.shrink(c, to, intensity(r, c, to)))


PAIR = "inst_i inst_j"
add("s1_returns", lambda s, d: rounded(ret(s, d)), sql("SELECT * FROM ret", KEYS, "x", RET))
add("s2_covariance", lambda s, d: rounded(cov(s, d)), sql("SELECT * FROM cov", PAIR, "cov", RET))
add("s3_correlation", lambda s, d: rounded(S.correlation(cov(s, d))), sql("SELECT inst_i, inst_j, cov / sqrt(vi * vj) AS corr FROM cv", PAIR, "corr", RET))
add("s4_const_corr", lambda s, d: rounded(S.target(cov(s, d), "const_corr")), sql("SELECT inst_i, inst_j, CASE WHEN inst_i = inst_j THEN cov ELSE r * sqrt(vi * vj) END AS target FROM cv, (SELECT avg(cov / sqrt(vi * vj)) AS r FROM cv WHERE inst_i <> inst_j)", PAIR, "target", RET))
add("s4_single_factor", lambda s, d: rounded(S.target(cov(s, d), "single_factor", ret(s, d))), sql("SELECT inst_i, inst_j, CASE WHEN inst_i = inst_j THEN cov ELSE a.c * b.c / v END AS target FROM cov JOIN be a ON a.instrument = inst_i JOIN be b ON b.instrument = inst_j, (SELECT avg(m * m) AS v FROM (SELECT DISTINCT datetime, m FROM mk))", PAIR, "target", RET + ", mk AS (SELECT *, avg(x) OVER (PARTITION BY datetime) AS m FROM ret), be AS (SELECT instrument, sum(x * m) / count(*) AS c FROM mk GROUP BY 1)"))
add("s5_shrunk_oas", lambda s, d: shrunk(s, d, "const_var", lambda r, c, to: S.oas_alpha(c, 2000)), sql("SELECT inst_i, inst_j, al * CASE WHEN inst_i = inst_j THEN mv ELSE 0 END + (1 - al) * cov AS cov FROM cov, (SELECT ((1 - 2 / p) * (ss + tr * tr) / ((2001 - 2 / p) * (ss + tr * tr / p))) AS al, tr / p AS mv FROM (SELECT sum(cov * cov) AS ss, sum(CASE WHEN inst_i = inst_j THEN cov ELSE 0 END) AS tr, count(DISTINCT inst_i) AS p FROM cov))", PAIR, "cov", RET))
add("s5_shrunk_lw", lambda s, d: shrunk(s, d, "const_var", S.lw_alpha), sql("SELECT inst_i, inst_j, al * CASE WHEN inst_i = inst_j THEN mv ELSE 0 END + (1 - al) * cov AS cov FROM cov, (SELECT mv, greatest(0, least(1, (q / n - ss) / n / dist)) AS al FROM (SELECT sum(a.x * a.x * b.x * b.x) AS q FROM ret a JOIN ret b USING (datetime)), (SELECT count(DISTINCT datetime) AS n FROM ret), (SELECT sum(cov * cov) AS ss, any_value(mv) AS mv, sum(pow(cov - CASE WHEN inst_i = inst_j THEN mv ELSE 0 END, 2)) AS dist FROM cov, (SELECT avg(v) AS mv FROM vr)))", PAIR, "cov", RET))

# the intensities by their definition over all pairs of instruments and dates
LW = RET + ", mk AS (SELECT *, avg(x) OVER (PARTITION BY datetime) AS m FROM ret), tt AS (SELECT count(DISTINCT datetime)::DOUBLE AS t, (SELECT avg(m * m) FROM (SELECT DISTINCT datetime, m FROM mk)) AS vm FROM mk), ea AS (SELECT instrument AS i, avg(x * m) AS c FROM mk GROUP BY 1), rb AS (SELECT avg(cov / sqrt(vi * vj)) AS r FROM cv WHERE inst_i <> inst_j), pq AS MATERIALIZED (SELECT a.instrument AS inst_i, b.instrument AS inst_j, sum(a.x * a.x * b.x * b.x) AS yy, sum(pow(a.x, 3) * b.x) AS x3, sum(a.x * a.x * b.x * b.m) AS yz, sum(a.x * a.m * b.x * b.m) AS zz FROM mk a JOIN mk b USING (datetime) GROUP BY 1, 2), al AS MATERIALIZED (SELECT pq.*, cv.cov, vi, vj, t, vm, r, a.c AS ci, b.c AS cj, inst_i = inst_j AS same, CASE WHEN inst_i = inst_j THEN cov ELSE r * sqrt(vi * vj) END AS f1, CASE WHEN inst_i = inst_j THEN cov ELSE a.c * b.c / vm END AS f2 FROM pq JOIN cv USING (inst_i, inst_j) JOIN ea a ON a.i = inst_i JOIN ea b ON b.i = inst_j, tt, rb)"
_mixed = lambda f, rho: f"SELECT inst_i, inst_j, s * {f} + (1 - s) * cov AS cov FROM al, (SELECT greatest(0, least(1, (sum(yy / t - cov * cov) - sum({rho})) / sum(pow(cov - {f}, 2)) / any_value(t))) AS s FROM al)"
_own = "CASE WHEN same THEN yy / t - cov * cov ELSE "
for _kind, _f, _rho in (
    ("const_corr", "f1", _own + "r * sqrt(vj / vi) * (x3 / t - vi * cov) END"),
    ("single_factor", "f2", _own + "2 * (yz / t - ci * cov) * cj / vm - (zz / t - vm * cov) * ci * cj / (vm * vm) END"),
):
    add(f"s5_lw_{_kind}", lambda s, d, k=_kind: shrunk(s, d, k, lambda r, c, to: S.lw_alpha(r, c, to, k)), sql(_mixed(_f, _rho), PAIR, "cov", LW))


def _axes(k: int, squarings: int = 24) -> str:
    """CTEs of the ``k`` leading projectors (i, j, v) of the returns' covariance, absent returns 0, by squaring and taking away."""
    out = [
        RET,
        "nt AS (SELECT count(DISTINCT datetime)::DOUBLE AS n, count(DISTINCT instrument)::DOUBLE AS p FROM ret), ids AS (SELECT DISTINCT instrument AS i FROM ret)",
        "x0 AS MATERIALIZED (SELECT d.datetime, ids.i, coalesce(x, 0) AS x FROM (SELECT DISTINCT datetime FROM ret) d CROSS JOIN ids LEFT JOIN ret ON ret.datetime = d.datetime AND instrument = i)",
        "a0 AS MATERIALIZED (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS v FROM x0 a JOIN x0 b USING (datetime) GROUP BY ALL)",
    ]
    for f in range(k):
        out.append(f"b{f}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM a{f} WHERE i = j) AS v FROM a{f})")
        for m in range(squarings):
            out.append(f"c{f}_{m} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM b{f}_{m} a JOIN b{f}_{m} b ON a.j = b.i GROUP BY ALL)")
            out.append(f"b{f}_{m + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM c{f}_{m} WHERE i = j) AS v FROM c{f}_{m})")
        out.append(f"a{f + 1} AS MATERIALIZED (SELECT i, j, a.v - p.v * (SELECT sum(a.v * p.v) FROM a{f} a JOIN b{f}_{squarings} p USING (i, j)) AS v FROM a{f} a JOIN b{f}_{squarings} p USING (i, j))")
    every = " UNION ALL ".join(f"SELECT * FROM b{f}_{squarings}" for f in range(k))
    out.append(f"pj AS MATERIALIZED (SELECT i, j, sum(v) AS v FROM ({every}) GROUP BY ALL)")
    out.append("fr AS MATERIALIZED (SELECT datetime, i, fit, x - fit AS u FROM x0 JOIN (SELECT datetime, pj.i, sum(pj.v * x) AS fit FROM x0 JOIN pj ON x0.i = pj.j GROUP BY ALL) USING (datetime, i))")
    return ", ".join(out)


add("s6_structured", lambda s, d: rounded(S.structured_covariance(ret(s, d), 5), 3), sql(
    "SELECT a.i AS inst_i, b.i AS inst_j, covar_samp(a.fit, b.fit) + CASE WHEN a.i = b.i THEN var_pop(a.u) ELSE 0 END AS cov FROM fr a JOIN fr b USING (datetime) GROUP BY a.i, b.i", PAIR, "cov", _axes(5), 3))
add("s7_poet", lambda s, d: rounded(S.structured_covariance(ret(s, d), 3, 0.05, "soft"), 3), sql(
    "SELECT m.i AS inst_i, m.j AS inst_j, low + CASE WHEN m.i = m.j THEN u ELSE sign(u) * greatest(abs(u) / sqrt(vi * vj) - 0.05 * (1 / sqrt(p) + sqrt(ln(p) / n)), 0) * sqrt(vi * vj) END AS cov FROM m, nt",
    PAIR, "cov", _axes(3) + ", m0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.fit * b.fit) / count(*) AS low, sum(a.u * b.u) / count(*) AS u FROM fr a JOIN fr b USING (datetime) GROUP BY ALL)"
    ", m AS (SELECT m0.*, a.u AS vi, b.u AS vj FROM m0 JOIN m0 a ON a.i = m0.i AND a.j = m0.i JOIN m0 b ON b.i = m0.j AND b.j = m0.j)", 3))
_train, _valid, _test = "datetime < '1998-07-01'", "datetime >= '1998-07-01' AND datetime < '1999-01-01'", "datetime >= '1999-01-01'"


def linear(spark, d, *args, valid=False, **options):
    rows = scores(spark, d).withColumns({"y": F.ln(F.col("label") + 1), "w": F.col("volume") / 25})
    parts = [rows.where(c) for c in (_train, _valid, _test)]
    fit = parts[0].unionByName(parts[1]) if not valid else parts[0]
    return rounded(S.linear_score(fit, parts[2], ["score", "volume"], "y", *args, valid=parts[1] if valid else None, **options), 4)


_LS = f"ls AS (SELECT *, ln(label + 1) AS y, volume / 25 AS w FROM scores WHERE label IS NOT NULL AND ({_train} OR {_valid}))"
add("x1_linear", linear, sql(
    "SELECT instrument, datetime, b0 + b1 * score + b2 * volume AS score FROM scores, (SELECT my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2"
    " FROM (SELECT avg(y) AS my, avg(score) AS m1, avg(volume) AS m2, covar_pop(y, score) AS c1, covar_pop(y, volume) AS c2, covar_pop(score, volume) AS c12, var_pop(score) AS v1, var_pop(volume) AS v2 FROM ls))) WHERE " + _test,
    KEYS, "score", BARS + ", " + _LS, 4))
_NE = "SELECT sum(w) AS n, sum(w * score * score) AS a, sum(w * score * volume) AS b, sum(w * volume * volume) AS c, sum(w * score * y) AS p, sum(w * volume * y) AS q FROM ls"
add("x1_ridge", lambda s, d: linear(s, d, "ridge", 5.0, False, "w", valid=True), sql(
    f"SELECT instrument, datetime, (p * (c + 5) - q * b) / det * score + (q * (a + 5) - p * b) / det * volume AS score FROM scores, (SELECT *, (a + 5) * (c + 5) - b * b AS det FROM ({_NE})) WHERE " + _test,
    KEYS, "score", BARS + ", " + _LS, 4))
add("x1_lasso", lambda s, d: linear(s, d, "lasso", 0.001, False, "w", valid=True), sql(
    "SELECT instrument, datetime, u * score + v * volume AS score FROM scores, (SELECT * FROM cd WHERE r = 400) WHERE " + _test, KEYS, "score",
    "RECURSIVE " + BARS.lstrip() + ", " + _LS + f", ne AS MATERIALIZED ({_NE}), cd AS (SELECT 0 AS r, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v UNION ALL SELECT r + 1, u2, sign(q - b * u2) * greatest(abs(q - b * u2) - 0.001 * n, 0) / c"
    " FROM (SELECT r, n, b, c, q, sign(p - b * v) * greatest(abs(p - b * v) - 0.001 * n, 0) / a AS u2 FROM cd, ne) WHERE r < 400)", 4))
