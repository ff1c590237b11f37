"""Composable panel expressions, planned in stages of shared windows.

An ``Expr`` knows the columns it reads, how it becomes a Spark column (or SQL text of its inputs), and how many calendar slots
before and after a row it looks at.  ``evaluate`` names every result once, step by step: each is computed once, expressions stay
as small as their own operator, and all windows of a stage share one exchange and sort.  Frames count calendar slots, so panels are
aligned to the calendar first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidepanel.functions import ordered
from tidepanel.functions.nulls import INF, finite, ieee_div, ieee_log, no_nan, safe_corr, unbiased_kurtosis, unbiased_skew

KEY, TIME, SLOT = "instrument", "datetime", "_slot"
#: Frames flatter than this have no Rsquare or Corr (fixed value).
FLAT = 2e-5
UNBOUNDED = None


@dataclass(frozen=True)
class Expr:
    text: str
    make: Callable[..., Column] = field(compare=False)
    inputs: tuple[Expr, ...] = field(default=(), compare=False)
    windowed: bool = field(default=False, compare=False)
    #: Slots read before and after a row; None: all.
    left: int | None = field(default=0, compare=False)
    right: int = field(default=0, compare=False)
    #: SQL of the inputs {0}, {1}; one call to the JVM instead of one for each part.
    sql: str | None = field(default=None, compare=False)
    #: Makes a state that is fed the input's values in time order, instead of a window.
    state: Callable[[], object] | None = field(default=None, compare=False)

    def name(self) -> str:
        return "_e" + hashlib.md5(self.text.encode()).hexdigest()[:16]

    def reference(self) -> str:
        """SQL text of a field, a constant, or the name that ``evaluate`` gives the result."""
        return self.sql if self.sql and not self.inputs else f"`{self.name()}`"

    # operators
    def __add__(self, o):
        return add(self, o)

    def __radd__(self, o):
        return add(o, self)

    def __sub__(self, o):
        return sub(self, o)

    def __rsub__(self, o):
        return sub(o, self)

    def __mul__(self, o):
        return mul(self, o)

    def __rmul__(self, o):
        return mul(o, self)

    def __truediv__(self, o):
        return div(self, o)

    def __rtruediv__(self, o):
        return div(o, self)

    def __pow__(self, o):
        return power(self, o)

    def __gt__(self, o):
        return gt(self, o)

    def __ge__(self, o):
        return ge(self, o)

    def __lt__(self, o):
        return lt(self, o)

    def __le__(self, o):
        return le(self, o)

    def __and__(self, o):
        return and_(self, o)

    def __or__(self, o):
        return or_(self, o)

    def __invert__(self):
        return not_(self)


def _wider(a: int | None, b: int | None) -> int | None:
    return None if a is None or b is None else max(a, b)


def expr(x) -> Expr:
    if isinstance(x, Expr):
        return x
    text = f"{x!r}D" if isinstance(x, float) and math.isfinite(x) else str(x) if isinstance(x, int) else None
    return Expr(f"lit({x!r})", lambda: F.lit(x), sql=text)


def feature(name: str) -> Expr:
    """A field of the panel."""
    return Expr(f"${name}", lambda: F.col(name), sql=f"`{name}`")


def _plain(op: str, make: Callable[..., Column], *inputs, sql: str | None = None) -> Expr:
    inputs = tuple(expr(i) for i in inputs)
    left, right = 0, 0
    for i in inputs:
        left, right = _wider(left, i.left), max(right, i.right)
    return Expr(f"{op}({', '.join(i.text for i in inputs)})", make, inputs, False, left, right, sql)


#: Operands as doubles, and a result without NaN, in SQL.
A, B = "CAST({0} AS DOUBLE)", "CAST({1} AS DOUBLE)"


def _real(text: str) -> str:
    return f"nanvl({text}, CAST(NULL AS DOUBLE))"


# D: element-wise operators
def number(c: Column) -> Column:
    return c.cast("double")


def abs_(x):
    return _plain("Abs", lambda a: F.abs(number(a)), x, sql=f"abs({A})")


def sign(x):
    return _plain("Sign", lambda a: F.signum(number(a)), x)


def log(x):
    return _plain("Log", lambda a: ieee_log(a), x)


def power(x, y):
    return _plain("Power", lambda a, b: no_nan(F.pow(number(a), number(b))), x, y)


def add(x, y):
    return _plain("Add", lambda a, b: no_nan(number(a) + number(b)), x, y, sql=_real(f"{A} + {B}"))


def sub(x, y):
    return _plain("Sub", lambda a, b: no_nan(number(a) - number(b)), x, y, sql=_real(f"{A} - {B}"))


def mul(x, y):
    return _plain("Mul", lambda a, b: no_nan(number(a) * number(b)), x, y, sql=_real(f"{A} * {B}"))


def div(x, y):
    return _plain("Div", ieee_div, x, y, sql=_real(f"CASE WHEN {B} = 0 THEN {A} * DOUBLE('Infinity') ELSE {A} / {B} END"))


def greater(x, y):
    return _plain("Greater", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(number(a), number(b))), x, y, sql=f"CASE WHEN {{0}} IS NOT NULL AND {{1}} IS NOT NULL THEN greatest({A}, {B}) END")


def less(x, y):
    return _plain("Less", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(number(a), number(b))), x, y, sql=f"CASE WHEN {{0}} IS NOT NULL AND {{1}} IS NOT NULL THEN least({A}, {B}) END")


def _compare(op: str, test: Callable[[Column, Column], Column], missing: bool):
    sign_ = {"Gt": ">", "Ge": ">=", "Lt": "<", "Le": "<=", "Eq": "=", "Ne": "!="}[op]
    return lambda x, y: _plain(op, lambda a, b: F.coalesce(test(a, b), F.lit(missing)), x, y, sql=f"coalesce({{0}} {sign_} {{1}}, {missing})")


gt = _compare("Gt", lambda a, b: a > b, False)
ge = _compare("Ge", lambda a, b: a >= b, False)
lt = _compare("Lt", lambda a, b: a < b, False)
le = _compare("Le", lambda a, b: a <= b, False)
eq = _compare("Eq", lambda a, b: a == b, False)
ne = _compare("Ne", lambda a, b: a != b, True)


def and_(x, y):
    return _plain("And", lambda a, b: a & b, x, y)


def or_(x, y):
    return _plain("Or", lambda a, b: a | b, x, y)


def not_(x):
    return _plain("Not", lambda a: ~a, x)


def if_(c, x, y):
    return _plain("If", lambda k, a, b: F.when(k, a).otherwise(b), c, x, y)


def is_null(x):
    return _plain("IsNull", lambda a: a.isNull(), x)


def is_inf(x):
    return _plain("IsInf", lambda a: F.coalesce(F.abs(a) == F.lit(INF), F.lit(False)), x)


# E, F: windows within an instrument, over calendar slots
def by_time():
    return W.partitionBy(KEY).orderBy(TIME)


def frame(n: int):
    """Trailing ``n`` slots; 0: all so far."""
    return by_time().rowsBetween(W.unboundedPreceding if n == 0 else 1 - n, W.currentRow)


def over(n: int) -> str:
    """The frame of ``n`` slots in SQL."""
    return f"OVER (PARTITION BY {KEY} ORDER BY {TIME} ROWS BETWEEN {f'{n - 1} PRECEDING' if n else 'UNBOUNDED PRECEDING'} AND CURRENT ROW)"


def _window(op: str, n, make: Callable[..., Column], *inputs, left=0, right=0, sql: str | None = None) -> Expr:
    plain = _plain(op, make, *inputs)
    whole = left is None or plain.left is None
    return Expr(f"{op}({', '.join(i.text for i in plain.inputs)}, {n})", make, plain.inputs, True, None if whole else plain.left + left, plain.right + right, sql)


def present(x) -> Expr:
    """The value as a rolling input: a double, infinities missing."""
    return _plain("Present", lambda a: finite(number(a)), x, sql=f"CASE WHEN abs({A}) != DOUBLE('Infinity') THEN {A} END")


def _rolling(op: str, aggregate: Callable[[Column, object], Column], sql: str | None = None):
    def build(x, n: int | float) -> Expr:
        if 0 < n < 1:
            return ewm_mean(x, n)
        return _window(op, n, lambda a: aggregate(a, frame(n)), present(x), left=n - 1 if n else None, sql=f"{sql}({{0}}) {over(n)}" if sql else None)

    return build


def ref(x, n: int) -> Expr:
    """The value ``n`` slots ago; 0: the first one."""
    if n == 0:
        return _window("Ref", 0, lambda a: F.first(a).over(frame(0)), x, left=None)
    return _window("Ref", n, lambda a: F.lag(a, n).over(by_time()) if n > 0 else F.lead(a, -n).over(by_time()), x, left=max(n, 0), right=max(-n, 0),
                   sql=f"{'lag' if n > 0 else 'lead'}({{0}}, {abs(n)}) OVER (PARTITION BY {KEY} ORDER BY {TIME})")


def delta(x, n: int) -> Expr:
    return sub(x, ref(x, n))


mean = _rolling("Mean", lambda a, w: F.avg(a).over(w), "avg")
sum_ = _rolling("Sum", lambda a, w: F.sum(a).over(w), "sum")
std = _rolling("Std", lambda a, w: F.stddev_samp(a).over(w), "stddev_samp")
var = _rolling("Var", lambda a, w: F.var_samp(a).over(w), "var_samp")
max_ = _rolling("Max", lambda a, w: F.max(a).over(w), "max")
min_ = _rolling("Min", lambda a, w: F.min(a).over(w), "min")
count = _rolling("Count", lambda a, w: F.count(a).over(w).cast("double"))
skew = _rolling("Skew", lambda a, w: unbiased_skew(F.skewness(a).over(w), F.count(a).over(w), F.stddev_pop(a).over(w)))
kurt = _rolling("Kurt", lambda a, w: unbiased_kurtosis(F.kurtosis(a).over(w), F.count(a).over(w), F.stddev_pop(a).over(w), -3.0))


def _fed(op: str, n: int, x, trailing: Callable[[int], object], expanding: Callable[[], object]) -> Expr:
    """A windowed operator by a state over the rows in time order."""
    plain = _plain(op, None, present(x))
    left = None if n == 0 or plain.left is None else plain.left + n - 1
    return Expr(f"{op}({plain.inputs[0].text}, {n})", None, plain.inputs, True, left, plain.right, state=(lambda: trailing(n)) if n else expanding)


def quantile(x, n: int, q: float) -> Expr:
    """The linearly interpolated quantile."""
    return _fed(f"Quantile{q}", n, x, lambda n: ordered.Quantile(n, q), lambda: ordered.ExpandingQuantile(q))


def med(x, n: int) -> Expr:
    """E12; a share instead of a number of slots is an exponential mean, as for the other rolling operators."""
    return ewm_mean(present(x), n) if 0 < n < 1 else quantile(x, n, 0.5)


def _position(op: str, best: Callable[[Column, Column], Column]):
    """1-based place in the frame; a missing value in the frame wins."""

    def build(x, n: int) -> Expr:
        def make(a: Column) -> Column:
            w, slot = frame(n), F.col(SLOT)
            start = F.min(slot).over(w)
            place = F.when(F.count(a).over(w) < F.count("*").over(w), F.min(F.when(a.isNull(), slot)).over(w)).otherwise(best(a, slot).over(w)["s"])
            return F.when(F.count(a).over(w) > 0, (place - start + 1).cast("double"))

        return _window(op, n, make, present(x), left=n - 1 if n else None)

    return build


idx_max = _position("IdxMax", lambda a, s: F.max(F.struct(a.alias("v"), (-s).alias("m"), s.alias("s"))))
idx_min = _position("IdxMin", lambda a, s: F.min(F.struct(a.alias("v"), s.alias("m"), s.alias("s"))))


def mad(x, n: int) -> Expr:
    """Mean absolute deviation about the frame's mean."""
    return _fed("Mad", n, x, ordered.Mad, ordered.ExpandingMad)


def rank(x, n: int) -> Expr:
    """Percent rank of the last value, ties averaged."""
    return _fed("Rank", n, x, ordered.Rank, ordered.ExpandingRank)


def _regression(op: str, make: Callable[[Column, Column, object], Column]):
    return lambda x, n: _window(op, n, lambda a: make(number(a), F.when(a.isNotNull(), F.col(SLOT).cast("double")), frame(n)), x, left=n - 1 if n else None)


slope = _regression("Slope", lambda a, s, w: F.regr_slope(a, s).over(w))
slot_mean = _regression("SlotMean", lambda a, s, w: F.avg(s).over(w))
slot_var = _regression("SlotVar", lambda a, s, w: F.var_samp(s).over(w))


def resi(x, n: int) -> Expr:
    """The last value less the frame's regression line there, which runs through both means."""
    line = lambda a, b, m, s: number(a) - (b * (F.col(SLOT) - s) + m)
    return _plain(f"Resi{n}", line, x, slope(x, n), mean(x, n), slot_mean(x, n))


def rsquare(x, n: int) -> Expr:
    """The squared correlation with the slots, from the slope and both variances, which other columns share."""
    if n == 0:
        return _regression("Rsquare0", lambda a, s, w: F.pow(safe_corr(a, s, w), F.lit(2.0)))(x, n)
    squared = lambda b, d, v: F.when(d > FLAT, b * b * v / (d * d))
    return _plain(f"Rsquare{n}", squared, slope(x, n), std(x, n), slot_var(x, n))


def wma(x, n: int) -> Expr:
    """Linear weights that sum to one, then the mean over the present values (divided twice, as defined)."""

    def make(a: Column) -> Column:
        a, w, s = finite(number(a)), frame(n), F.col(SLOT)
        rows, start = F.count("*").over(w), F.min(s).over(w)
        weighted = F.sum(a * s).over(w) - (start - 1) * F.sum(a).over(w)
        return weighted / (rows * (rows + 1) / 2) / F.nullif(F.count(a).over(w), F.lit(0))

    return _window("WMA", n, make, x, left=n - 1 if n else None)


def ewm_mean(x, alpha: float) -> Expr:
    """Exponentially weighted mean over the whole history; missing rows age the weights and repeat the value.

    Slots are cut into blocks in which a weight falls to 1e-100 at most.  A row's sums are those of its block so far, in the block's own scale,
    and of the block before; older ones weigh nothing.  So time is linear in the history.
    """
    keep = 1 - alpha
    reach = max(1, math.ceil(math.log(1e-18) / math.log(keep)))
    size = max(1, math.floor(100 / -math.log10(keep)))

    def make(a: Column) -> Column:
        a = finite(number(a))
        at = F.col(SLOT) - 1
        block, off = F.floor(at / size), at % size
        so_far = W.partitionBy(KEY, block).orderBy(TIME).rowsBetween(W.unboundedPreceding, W.currentRow)
        before = W.partitionBy(KEY).orderBy(block).rangeBetween(-1, -1)
        scale = F.pow(F.lit(keep), -off)

        def total(v: Column) -> Column:
            return F.sum(v * scale).over(so_far) + F.lit(keep**size) * F.coalesce(F.sum(v * scale).over(before), F.lit(0.0))

        there = F.when(a.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
        return total(F.coalesce(a, F.lit(0.0))) / F.nullif(total(there), F.lit(0.0))

    return _window(f"EwmMean{alpha}", alpha, make, x, left=reach)


def ema(x, n: int | float) -> Expr:
    """Span ``n``, or alpha below 1; 0: per-frame weights over all rows so far."""
    if 0 < n < 1:
        return ewm_mean(x, n)
    if n:
        return ewm_mean(x, 2 / (n + 1))
    return _fed("EMA", 0, x, None, ordered.WholeEma)


def corr(x, y, n: int) -> Expr:
    def make(a, b):
        w = frame(n)
        steep = (F.stddev_samp(a).over(w) > FLAT) & (F.stddev_samp(b).over(w) > FLAT)
        return F.when(steep, safe_corr(a, b, w))

    return _window("Corr", n, make, present(x), present(y), left=n - 1 if n else None)


def cov(x, y, n: int) -> Expr:
    return _window("Cov", n, lambda a, b: F.covar_samp(finite(number(a)), finite(number(b))).over(frame(n)), x, y, left=n - 1 if n else None)


# G: within a day
def day_window():
    return W.partitionBy(KEY, F.to_date(TIME))


def day_last(x) -> Expr:
    """The day's last present value on all its rows."""
    whole = lambda: day_window().orderBy(TIME).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return _window("DayLast", "", lambda a: F.last(a, True).over(whole()), x)


def day_cumsum(x, start: str, end: str) -> Expr:
    """G1: zero before minute ``start``, the running sum to minute ``end`` (HH:mm), zero after."""

    def make(a):
        minute = F.date_format(TIME, "HH:mm")
        inside = (minute >= start) & (minute <= end)
        w = day_window().orderBy(TIME).rowsBetween(W.unboundedPreceding, W.currentRow)
        return F.when(inside, F.sum(F.when(inside, number(a))).over(w)).otherwise(F.lit(0.0))

    return _window(f"DayCumsum{start}-{end}", "", make, x)


def ffill(x) -> Expr:
    return _window("FFillNan", "", lambda a: F.last(a, True).over(frame(0)), x, left=None)


def bfill(x) -> Expr:
    ahead = lambda: by_time().rowsBetween(W.currentRow, W.unboundedFollowing)
    return _window("BFillNan", "", lambda a: F.first(a, True).over(ahead()), x)


def date(x=None) -> Expr:
    return _plain("Date", lambda *_: F.to_date(TIME))


def keyed(panel: DataFrame) -> bool:
    """Whether the rows of an instrument lie in one partition by the plan, as in a table bucketed by it."""
    return panel._jdf.queryExecution().sparkPlan().outputPartitioning().toString().startswith(f"hashpartitioning({KEY}#")


def streamed(panel: DataFrame, exprs: list[Expr]) -> DataFrame:
    """Columns of operators with a state: one pass over the rows of each instrument.

    Rows are numbered by a window first, as that alone makes Spark keep an instrument in one partition (it may read a
    bucketed table otherwise where nothing asks for the buckets); windows before it have sorted them already.
    """
    panel = panel.withColumn("_order", F.row_number().over(by_time()))
    names, inputs, make = [e.name() for e in exprs], [e.inputs[0].name() for e in exprs], [e.state for e in exprs]
    schema = StructType([*panel.schema.fields, *[StructField(n, DoubleType()) for n in names]])
    return panel.sortWithinPartitions(KEY, TIME).mapInArrow(lambda batches: ordered.stream(batches, KEY, inputs, names, make), schema).drop("_order")


def evaluate(panel: DataFrame, features: dict[str, Expr], keep: tuple[str, ...] = (KEY, TIME)) -> DataFrame:
    """All features of a panel (instrument, datetime, fields ...), one select per step of operators or windows.

    A result that another operator reads twice isn't inlined again by Catalyst, so an expression's size is linear in its operators.
    """
    #: Where a result is made: after so many stages of windows, then so many steps of plain operators.
    place: dict[str, tuple[int, int]] = {}
    named: dict[str, Expr] = {}

    def locate(e: Expr) -> tuple[int, int]:
        if e.text not in place:
            stage, step = max((locate(i) for i in e.inputs), default=(0, 0))
            place[e.text] = (stage + 1, 0) if e.windowed else (stage, step + 1 if e.inputs else 0)
            if e.inputs or e.windowed:
                named[e.text] = e
        return place[e.text]

    top = max((locate(e)[0] for e in features.values()), default=0)
    def spread(panel: DataFrame) -> DataFrame:
        # windows cost far more time than their bytes tell, so partitions aren't merged by size; this is the windows' exchange
        return panel.repartition(int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")), KEY)

    if top and not keyed(panel):
        panel = spread(panel)
    if SLOT not in panel.columns:
        panel = panel.withColumn(SLOT, F.row_number().over(by_time()))

    def column_of(e: Expr) -> Column:
        return F.col(e.name()) if e.text in named else e.make()

    def made(e: Expr) -> Column:
        if e.sql and all(i.text in named or i.sql for i in e.inputs):
            return F.expr(f"{e.sql.format(*[i.reference() for i in e.inputs])} AS `{e.name()}`")
        return e.make(*[column_of(i) for i in e.inputs]).alias(e.name())

    steps: dict[tuple[int, int], list[Expr]] = {}
    for text, e in named.items():
        steps.setdefault(place[text], []).append(e)
    for at in sorted(steps):
        panel = panel.select("*", *[made(e) for e in steps[at] if not e.state])
        if fed := [e for e in steps[at] if e.state]:
            panel = streamed(panel, fed)
            if at[0] < top:
                panel = spread(panel)
    return panel.select(*keep, *[column_of(e).alias(n) for n, e in features.items()])


def select(panel: DataFrame, condition: Expr, features: dict[str, Expr]) -> DataFrame:
    """The features on the rows where the condition holds."""
    return evaluate(panel, features | {"_where": condition}).where("_where").drop("_where")


def reach(features: dict[str, Expr]) -> tuple[int | None, int]:
    """Slots that the features read before and after a row; None: the whole history."""
    left, right = 0, 0
    for e in features.values():
        left, right = _wider(left, e.left), max(right, e.right)
    return left, right
