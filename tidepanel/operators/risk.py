"""Covariances over returns (S) and linear scores (X)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.operators.gram import Gram, beside, cells, diagonal, gram, inner, leading_axes, mapped, times_blocks
from tidepanel.sources.scratch import written


def risk_returns(panel: DataFrame, centre: bool = True, fill: str = "ignore") -> DataFrame:
    """Percent returns (instrument, datetime, x) of closes; centred per instrument; missing ones ignored or 0."""
    x = (F.col("close") / F.nullif(F.lag("close").over(W.partitionBy("instrument").orderBy("datetime")), F.lit(0.0)) - 1) * 100
    out = panel.select("instrument", "datetime", x.alias("x"))
    out = out.fillna(0.0, ["x"]) if fill == "zero" else out.where("x IS NOT NULL")
    return out.withColumn("x", F.col("x") - F.avg("x").over(W.partitionBy("instrument"))) if centre else out


def covariance(returns: DataFrame) -> DataFrame:
    """(inst_i, inst_j, cov) with the number of common dates of each pair as its divisor.

    Products are summed by blocks of instruments and slices of dates (``gram``), so no pairs of rows are made.
    """
    return cells(gram(returns, keep=written), lambda s, n, _: np.where(n > 0, s / np.maximum(n, 1), np.nan), "cov")


def variances(cov: DataFrame) -> DataFrame:
    return cov.where("inst_i = inst_j").select(F.col("inst_i").alias("instrument"), F.col("cov").alias("var"))


def with_variances(cov: DataFrame) -> DataFrame:
    v = variances(cov)
    return cov.join(v.select(F.col("instrument").alias("inst_i"), F.col("var").alias("vi")), "inst_i").join(v.select(F.col("instrument").alias("inst_j"), F.col("var").alias("vj")), "inst_j")


def correlation(cov: DataFrame) -> DataFrame:
    """S3."""
    return with_variances(cov).select("inst_i", "inst_j", (F.col("cov") / F.nullif(F.sqrt(F.col("vi") * F.col("vj")), F.lit(0.0))).alias("corr"))


def target(cov: DataFrame, kind: str, returns: DataFrame | None = None) -> DataFrame:
    """const_var, const_corr or single_factor targets as (inst_i, inst_j, target)."""
    same = F.col("inst_i") == F.col("inst_j")
    if kind == "const_var":
        mean = variances(cov).agg(F.avg("var").alias("_m"))
        return cov.crossJoin(F.broadcast(mean)).select("inst_i", "inst_j", F.when(same, F.col("_m")).otherwise(0.0).alias("target"))
    if kind == "const_corr":
        mean = correlation(cov).where(~same).agg(F.avg("corr").alias("_r"))
        scaled = F.col("_r") * F.sqrt(F.col("vi") * F.col("vj"))
        return with_variances(cov).crossJoin(F.broadcast(mean)).select("inst_i", "inst_j", F.when(same, F.col("cov")).otherwise(scaled).alias("target"))
    market = returns.withColumn("m", F.avg("x").over(W.partitionBy("datetime")))
    beta = market.groupBy("instrument").agg((F.sum(F.col("x") * F.col("m")) / F.count("*")).alias("c"))
    var = market.select("datetime", "m").distinct().agg(F.avg(F.col("m") * F.col("m")).alias("_v"))
    both = cov.join(beta.select(F.col("instrument").alias("inst_i"), F.col("c").alias("ci")), "inst_i").join(beta.select(F.col("instrument").alias("inst_j"), F.col("c").alias("cj")), "inst_j")
    return both.crossJoin(F.broadcast(var)).select("inst_i", "inst_j", F.when(same, F.col("cov")).otherwise(F.col("ci") * F.col("cj") / F.nullif(F.col("_v"), F.lit(0.0))).alias("target"))


def shrink(cov: DataFrame, to: DataFrame, alpha) -> DataFrame:
    """Alpha * target + (1 - alpha) * cov; alpha a number or a one-row frame (alpha)."""
    both = cov.join(to, ["inst_i", "inst_j"])
    both = both.crossJoin(F.broadcast(alpha.select(F.col("alpha").alias("_a")))) if isinstance(alpha, DataFrame) else both.withColumn("_a", F.lit(float(alpha)))
    return both.select("inst_i", "inst_j", (F.col("_a") * F.col("target") + (1 - F.col("_a")) * F.col("cov")).alias("cov"))


def oas_alpha(cov: DataFrame, n_dates: int) -> DataFrame:
    """The oracle-approximating intensity against constant variance, a one-row frame; the sums are those of its definition here, which adds in both parts."""
    s = cov.agg(F.sum(F.col("cov") * F.col("cov")).alias("ss"), F.sum(F.when(F.col("inst_i") == F.col("inst_j"), F.col("cov")).otherwise(0.0)).alias("tr"), F.count_distinct("inst_i").alias("p"))
    top = (1 - 2 / F.col("p")) * (F.col("ss") + F.col("tr") * F.col("tr"))
    low = (n_dates + 1 - 2 / F.col("p")) * (F.col("ss") + F.col("tr") * F.col("tr") / F.col("p"))
    return s.select((top / F.nullif(low, F.lit(0.0))).alias("alpha"))


def lw_alpha(returns: DataFrame, cov: DataFrame, to: DataFrame, kind: str = "const_var") -> DataFrame:
    """Ledoit-Wolf intensity for a target of ``kind``, a one-row frame: the entries' variance, less its share in the target's, over the distance.

    Sums over pairs of instruments within a date are products of sums over instruments, so no pairs are made.
    """
    same = F.col("inst_i") == F.col("inst_j")
    x, m = F.col("x"), F.col("m")
    market = returns.withColumn("m", F.avg("x").over(W.partitionBy("datetime")))
    each = market.groupBy("instrument").agg((F.sum(x * m) / F.count("*")).alias("c"), F.avg(x * x).alias("v"))
    rows = market.join(each, "instrument")
    root = F.sqrt("v")
    day = rows.groupBy("datetime").agg(
        F.sum(x * x).alias("a2"), F.sum(F.pow(x, F.lit(4))).alias("a4"), F.sum(F.pow(x, F.lit(3)) / F.nullif(root, F.lit(0.0))).alias("a3"), F.sum(x * root).alias("a1"),
        F.sum(x * m * F.col("c")).alias("zc"), F.sum(F.pow(x, F.lit(3)) * m * F.col("c")).alias("yzd"), F.sum(F.pow(x * m * F.col("c"), F.lit(2))).alias("zzd"), F.first("m").alias("m"),
    )
    t = F.count("*")
    over = day.agg(
        t.alias("_t"), (F.sum(F.col("a2") * F.col("a2")) / t).alias("_q"), (F.sum("a4") / t).alias("_d4"), (F.sum(F.col("a3") * F.col("a1") - F.col("a4")) / t).alias("_th"),
        (F.sum(F.col("a2") * F.col("zc")) / t).alias("_yz"), (F.sum("yzd") / t).alias("_yzd"), (F.sum(F.col("zc") * F.col("zc")) / t).alias("_zz"), (F.sum("zzd") / t).alias("_zzd"),
        (F.sum(F.col("m") * F.col("m")) / t).alias("_vm"),
    )
    c = each.select(F.col("instrument").alias("inst_i"), F.col("c").alias("ci"), F.col("v").alias("vi"))
    d = each.select(F.col("instrument").alias("inst_j"), F.col("c").alias("cj"), F.col("v").alias("vj"))
    s, scale = F.col("cov"), F.sqrt(F.col("vi") * F.col("vj"))
    pairs = cov.join(to, ["inst_i", "inst_j"]).join(c, "inst_i").join(d, "inst_j").agg(
        F.sum(s * s).alias("_ss"), F.sum(F.when(same, s * s)).alias("_ssd"), F.sum(F.when(~same, scale * s)).alias("_off"), F.avg(F.when(~same, s / F.nullif(scale, F.lit(0.0)))).alias("_r"),
        F.sum(F.col("ci") * F.col("cj") * s).alias("_cc"), F.sum(F.when(same, F.col("ci") * F.col("ci") * s)).alias("_ccd"), F.sum(F.pow(s - F.col("target"), F.lit(2))).alias("_d"),
    )
    one = over.crossJoin(F.broadcast(pairs))
    p = lambda n: F.col(f"_{n}")
    phi, own = p("q") - p("ss"), p("d4") - p("ssd")
    if kind == "const_var":
        rho = F.lit(0.0)
    elif kind == "const_corr":
        rho = own + p("r") * (p("th") - p("off"))
    else:
        first = ((p("yz") - p("cc")) - (p("yzd") - p("ccd"))) / p("vm")
        third = ((p("zz") - p("vm") * p("cc")) - (p("zzd") - p("vm") * p("ccd"))) / (p("vm") * p("vm"))
        rho = own + 2 * first - third
    alpha = (phi - rho) / F.nullif(p("d"), F.lit(0.0)) / p("t")
    return one.select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(alpha, F.lit(0.0)))).alias("alpha"))


def _fitted(returns: DataFrame, factors: int) -> tuple[Gram, DataFrame, int, np.ndarray, np.ndarray]:
    """(Gram matrix, [sums, axes, Gram matrix times axes] side by side, number of axes, axes' products with the Gram matrix, sums in the axes)."""
    g = gram(returns.fillna(0.0, ["x"]), keep=written)
    k = min(factors, g.n_series)
    axes = leading_axes(g, k, written)
    sides = written(beside(g.sums, axes, written(times_blocks(g, axes))))
    products = inner(sides)
    return g, sides, k, products[1 : k + 1, k + 1 :], products[0, 1 : k + 1]


def structured_covariance(returns: DataFrame, factors: int, threshold: float | None = None, kind: str = "soft") -> DataFrame:
    """Sample covariance of principal components' fits plus the residuals' variances.  S7, with a threshold: mean products of the fits
    plus the residuals' correlations beyond the threshold times 1 / sqrt(instruments) + sqrt(log(instruments) / dates).

    Absent returns are 0.  Axes are tables of packed blocks, and fits and residuals never become rows: with the Gram matrix G and axes A, products of
    the fits are A A'GA A', those of the residuals G - GA A' - A GA' + A A'GA A'.
    """
    g, sides, k, core, total = _fitted(returns, factors)
    n = g.n_times
    if threshold is None:
        spread = (core - np.outer(total, total) / n) / max(1, n - 1)

        def fit_and_rest(s, _, own, left, right):
            a, b, image = left[:, 1 : k + 1], right[:, 1 : k + 1], right[:, k + 1 :]
            squares = (s * own).sum(0) - 2 * (image * b).sum(1) + ((b @ core) * b).sum(1)
            mean = (right[:, 0] - b @ total) / n
            return a @ spread @ b.T + own * (squares / n - mean * mean)

        return cells(g, fit_and_rest, "cov", {"a": sides})
    threshold = threshold * (1 / math.sqrt(g.n_series) + math.sqrt(math.log(g.n_series) / max(1, n)))

    def residual_squares(_, x):
        d, a, image = x[:, :1], x[:, 2 : k + 2], x[:, k + 2 :]
        return np.concatenate([x, (d[:, 0] - 2 * (image * a).sum(1) + ((a @ core) * a).sum(1))[:, None]], 1)

    def fit_and_kept(s, _, own, left, right):
        (a, ga), (b, gb) = ((x[:, 2 : k + 2], x[:, k + 2 : 2 * k + 2]) for x in (left, right))
        low = a @ core @ b.T
        u = (s - ga @ b.T - a @ gb.T + low) / n
        scale = np.sqrt(np.maximum(np.outer(left[:, -1], right[:, -1]), 0.0)) / n
        r = np.divide(u, scale, out=np.zeros_like(u), where=scale > 0)
        big, soft = np.abs(r), np.sign(r) * np.maximum(np.abs(r) - threshold, 0)
        cut = np.where(big > threshold, r, 0.0) if kind == "hard" else soft
        if kind == "scad":
            cut = np.where(big < 2 * threshold, soft, np.where(big < 3.7 * threshold, (2.7 * r - np.sign(r) * 3.7 * threshold) / 1.7, r))
        return low / n + np.where(own > 0, u, cut * scale)

    return cells(g, fit_and_kept, "cov", {"a": mapped(beside(diagonal(g), sides), residual_squares)})


def _products(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """Weighted products of every two columns (the last is the weight), by Arrow batches and summed on executors."""
    k = len(columns) - 1

    def run(batches):
        total = np.zeros((k, k))
        for batch in batches:
            z = batch[columns].to_numpy(float)
            total += (z[:, :k] * z[:, k:]).T @ z[:, :k]
        yield pd.DataFrame({"i": np.arange(k * k), "s": total.ravel()})

    cells_ = rows.mapInPandas(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas()
    return cells_.sort_values("i")["s"].to_numpy().reshape(k, k)


def coefficients(gram_: np.ndarray, cross: np.ndarray, n: float, kind: str, alpha: float, rounds: int = 10_000) -> np.ndarray:
    """Coefficients from the features' products, those with the label and the rows' weight.

    ``ols``: least squares (of least length); ``ridge``: the sum of squares plus alpha times the coefficients' squares; ``lasso``: half the
    mean square plus alpha times their sizes, by coordinate descent.
    """
    if kind == "ols":
        return np.linalg.lstsq(gram_, cross, rcond=None)[0]
    if kind == "ridge":
        return np.linalg.solve(gram_ + alpha * np.eye(len(cross)), cross)
    if kind != "lasso":
        raise ValueError(f"unknown kind {kind}")
    w = np.zeros(len(cross))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            if gram_[j, j] > 0:
                part = cross[j] - gram_[j] @ w + gram_[j, j] * w[j]
                w[j] = np.sign(part) * max(abs(part) - n * alpha, 0.0) / gram_[j, j]
        if np.abs(w - before).max(initial=0.0) <= 1e-12 * np.abs(w).max(initial=0.0):
            break
    return w


def linear_score(
    train: DataFrame, apply_to: DataFrame, features: list[str], label: str, kind: str = "ols", alpha: float = 0.0,
    intercept: bool = True, weight: str | None = None, valid: DataFrame | None = None,
) -> DataFrame:
    """A linear fit without the rows that miss a value, then a score for each row (missing where a feature is).

    ``valid`` rows are added to the training rows, ``weight`` is a column of theirs.  Two passes sum means and then products; the
    driver solves a system of as many unknowns as there are features.
    """
    rows = train if valid is None else train.unionByName(valid)
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in (*features, label)], (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")).dropna()
    total = F.sum("_w")
    means = rows.agg(total.alias("_n"), *[(F.sum(F.col(c) * F.col("_w")) / total).alias(c) for c in (*features, label)]).first()
    if not means["_n"]:
        raise ValueError("no complete row to fit on")
    centre = {c: means[c] if intercept else 0.0 for c in (*features, label)}
    products = _products(rows.select(*[(F.col(c) - F.lit(m)).alias(c) for c, m in centre.items()], "_w"), [*features, label, "_w"])
    w = coefficients(products[:-1, :-1], products[:-1, -1], means["_n"], kind, alpha)
    base = centre[label] - sum(b * centre[c] for b, c in zip(w.tolist(), features, strict=True))
    score = F.lit(base)
    for b, c in zip(w.tolist(), features, strict=True):
        score = score + F.col(c) * F.lit(b)
    return apply_to.select("instrument", "datetime", score.alias("score"))
