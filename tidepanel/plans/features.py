"""Named feature sets (L)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import expressions as E
from tidepanel.functions.nulls import ieee_div

WINDOWS = (5, 10, 20, 30, 60)
FAMILIES = tuple("ROC MA STD BETA RSQR RESI MAX LOW QTLU QTLD RANK RSV IMAX IMIN IMXD CORR CORD CNTP CNTN CNTD SUMP SUMN SUMD VMA VSTD WVMA VSUMP VSUMN VSUMD".split())
TINY = 1e-12


def fields():
    return {f: E.feature(f) for f in ("open", "high", "low", "close", "vwap", "volume")}


def kbar() -> dict[str, E.Expr]:
    """L1: shapes of a bar."""
    x = fields()
    o, h, lo, c = x["open"], x["high"], x["low"], x["close"]
    span = h - lo + TINY
    return {
        "KMID": (c - o) / o, "KLEN": (h - lo) / o, "KMID2": (c - o) / span, "KUP": (h - E.greater(o, c)) / o, "KUP2": (h - E.greater(o, c)) / span,
        "KLOW": (E.less(o, c) - lo) / o, "KLOW2": (E.less(o, c) - lo) / span, "KSFT": (2 * c - h - lo) / o, "KSFT2": (2 * c - h - lo) / span,
    }


def prices(names=("OPEN", "HIGH", "LOW", "VWAP"), windows=(0,)) -> dict[str, E.Expr]:
    """L2: earlier prices over the close."""
    x = fields()
    at = lambda f, d: E.ref(x[f], d) if d else x[f]
    return {f"{n}{d}": at(n.lower(), d) / x["close"] for n in names for d in windows}


def volumes(windows=(0,)) -> dict[str, E.Expr]:
    """L3: earlier volumes over the volume."""
    v = fields()["volume"]
    return {f"VOLUME{d}": (E.ref(v, d) if d else v) / (v + TINY) for d in windows}


def rolling(windows=WINDOWS, include=FAMILIES, exclude=()) -> dict[str, E.Expr]:
    """L4: 29 families over each window; family LOW makes the columns MIN*."""
    x = fields()
    c, h, lo, v = x["close"], x["high"], x["low"], x["volume"]
    rise, vrise = E.ref(c, 1), E.ref(v, 1)
    up, down = E.greater(c - rise, 0.0), E.greater(rise - c, 0.0)
    vup, vdown = E.greater(v - vrise, 0.0), E.greater(vrise - v, 0.0)
    move, vmove = E.abs_(c - rise), E.abs_(v - vrise)
    weight = E.abs_(c / rise - 1) * v
    made = {
        "ROC": lambda d: E.ref(c, d) / c, "MA": lambda d: E.mean(c, d) / c, "STD": lambda d: E.std(c, d) / c, "BETA": lambda d: E.slope(c, d) / c,
        "RSQR": lambda d: E.rsquare(c, d), "RESI": lambda d: E.resi(c, d) / c, "MAX": lambda d: E.max_(h, d) / c, "LOW": lambda d: E.min_(lo, d) / c,
        "QTLU": lambda d: E.quantile(c, d, 0.8) / c, "QTLD": lambda d: E.quantile(c, d, 0.2) / c, "RANK": lambda d: E.rank(c, d),
        "RSV": lambda d: (c - E.min_(lo, d)) / (E.max_(h, d) - E.min_(lo, d) + TINY),
        "IMAX": lambda d: E.idx_max(h, d) / d, "IMIN": lambda d: E.idx_min(lo, d) / d, "IMXD": lambda d: (E.idx_max(h, d) - E.idx_min(lo, d)) / d,
        "CORR": lambda d: E.corr(c, E.log(v + 1), d), "CORD": lambda d: E.corr(c / rise, E.log(v / vrise + 1), d),
        "CNTP": lambda d: E.mean(c > rise, d), "CNTN": lambda d: E.mean(c < rise, d), "CNTD": lambda d: E.mean(c > rise, d) - E.mean(c < rise, d),
        "SUMP": lambda d: E.sum_(up, d) / (E.sum_(move, d) + TINY), "SUMN": lambda d: E.sum_(down, d) / (E.sum_(move, d) + TINY),
        "SUMD": lambda d: (E.sum_(up, d) - E.sum_(down, d)) / (E.sum_(move, d) + TINY),
        "VMA": lambda d: E.mean(v, d) / (v + TINY), "VSTD": lambda d: E.std(v, d) / (v + TINY), "WVMA": lambda d: E.std(weight, d) / (E.mean(weight, d) + TINY),
        "VSUMP": lambda d: E.sum_(vup, d) / (E.sum_(vmove, d) + TINY), "VSUMN": lambda d: E.sum_(vdown, d) / (E.sum_(vmove, d) + TINY),
        "VSUMD": lambda d: (E.sum_(vup, d) - E.sum_(vdown, d)) / (E.sum_(vmove, d) + TINY),
    }
    return {f"{'MIN' if n == 'LOW' else n}{d}": made[n](d) for n in include if n not in exclude for d in windows}


def alpha158() -> dict[str, E.Expr]:
    """158 columns."""
    return kbar() | prices() | rolling()


def alpha360() -> dict[str, E.Expr]:
    """60 lags of six fields, prices over the close and volumes over the volume."""
    lags = tuple(range(59, -1, -1))
    return prices(("CLOSE", "OPEN", "HIGH", "LOW", "VWAP"), lags) | volumes(lags)


def alpha360_frame(panel: DataFrame) -> DataFrame:
    """L6 in one window: the last 60 slots of all fields as arrays, divided there, then read by place."""
    names, lags = tuple(fields()), 60
    past = F.collect_list(F.struct(*[F.col(f).cast("double").alias(f) for f in names])).over(E.by_time().rowsBetween(1 - lags, 0))
    rows = panel.select(E.KEY, E.TIME, "close", "volume", past.alias("past"))

    def over(f: str, base: Column) -> Column:
        return F.transform(F.col("past")[f], lambda v: ieee_div(v, base)).alias(f"_{f}")

    rows = rows.select(E.KEY, E.TIME, F.size("past").alias("_n"), *[over(f, F.col("volume") + F.lit(TINY) if f == "volume" else F.col("close")) for f in names])
    at = lambda f, d: F.get(F.col(f"_{f}"), F.col("_n") - 1 - d)
    order = [(f, d) for f in ("close", "open", "high", "low", "vwap") for d in range(lags - 1, -1, -1)] + [("volume", d) for d in range(lags - 1, -1, -1)]
    return rows.select(E.KEY, E.TIME, *[at(f, d).alias(f"{f.upper()}{d}") for f, d in order])


def labels(field: str = "close") -> dict[str, E.Expr]:
    """The return from the next slot to the one after."""
    x = E.feature(field)
    return {"LABEL0": E.ref(x, -2) / E.ref(x, -1) - 1}


def intraday_normalised(day: int = 240, late: int = 3, days: int = 30, prices: tuple[str, ...] = ("open", "high", "low", "close", "vwap")) -> dict[str, E.Expr]:
    """Prices over yesterday's close at ``late`` slots before its end, volume over its mean of ``days`` days; both of today and of a day ago.

    Paused slots (paused_num over 1.001 is live) are left out by ``E.select`` with ``live``.
    """
    close, volume = E.ffill(E.feature("close")), E.feature("volume")
    base = E.day_last(E.ref(close, day + late))
    mean = E.ref(E.day_last(E.mean(volume, days * day)), day)
    out = {}
    for name, back in (("", 0), ("_1", day)):
        for p in prices:
            filled = E.if_(E.is_null(E.feature(p)), close, E.feature(p))
            out[p + name] = E.ffill((E.ref(filled, back) if back else filled) / base)
    for name, back in (("", 0), ("_1", day)):
        share = (E.ref(volume, back) if back else volume) / mean
        share = E.if_(E.is_null(share), 0.0, share)
        out["volume" + name] = E.if_(share >= 0.0, share, 0.0)
    return out


def live() -> E.Expr:
    return E.feature("paused_num") > 1.001


def intraday_execution(zeros: tuple[str, ...] = ("volume", "factor")) -> dict[str, E.Expr]:
    """Filled close0, vwap0 (the close where missing) and ``zeros`` with 0 where missing, for live slots (``live``)."""
    close = E.ffill(E.feature("close"))
    out = {"close0": close, "vwap0": E.if_(E.is_null(E.feature("vwap")), close, E.feature("vwap"))}
    return out | {f"{z}0": E.if_(E.is_null(E.feature(z)), 0.0, E.feature(z)) for z in zeros}


def trend(fast: int = 10, slow: int = 20) -> E.Expr:
    """Sign of the fast less the slow exponential mean of the close."""
    c = E.feature("close")
    return E.sign(E.ema(c, fast) - E.ema(c, slow))


def realised_volatility(n: int = 20) -> E.Expr:
    """From sums of log returns and of their squares."""
    r = E.log(E.feature("close") / E.ref(E.feature("close"), 1))
    return E.power(E.sum_(r * r, n) / (n - 1) - E.power(E.sum_(r, n), 2.0) / (n * (n - 1)), 0.5)
