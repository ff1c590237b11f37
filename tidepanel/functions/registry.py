"""Operators by name, and users' own functions as operators.

A registered operator is any function of expressions (and numbers) that returns an expression, so it may compose built-in ones,
wrap a Spark column function (``elementwise``) or run a Python function over trailing frames (``over_frame``).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepanel.functions import expressions as E

#: Names of the built-in operators.
BUILT_IN: dict[str, Callable[..., E.Expr]] = {
    "Abs": E.abs_, "Sign": E.sign, "Log": E.log, "Power": E.power, "Add": E.add, "Sub": E.sub, "Mul": E.mul, "Div": E.div, "Greater": E.greater, "Less": E.less,
    "Gt": E.gt, "Ge": E.ge, "Lt": E.lt, "Le": E.le, "Eq": E.eq, "Ne": E.ne, "And": E.and_, "Or": E.or_, "Not": E.not_, "If": E.if_,
    "Ref": E.ref, "Delta": E.delta, "Mean": E.mean, "Sum": E.sum_, "Std": E.std, "Var": E.var, "Skew": E.skew, "Kurt": E.kurt, "Max": E.max_, "Min": E.min_,
    "IdxMax": E.idx_max, "IdxMin": E.idx_min, "Quantile": E.quantile, "Med": E.med, "Mad": E.mad, "Rank": E.rank, "Count": E.count,
    "Slope": E.slope, "Rsquare": E.rsquare, "Resi": E.resi, "WMA": E.wma, "EMA": E.ema, "Corr": E.corr, "Cov": E.cov,
}
_registered = dict(BUILT_IN)


def register(name: str, make: Callable[..., E.Expr]) -> None:
    """Make an operator known by a name; a name that is taken gets the new operator, with a warning."""
    if not name.isidentifier():
        raise ValueError(f"{name!r} isn't a name")
    if name in _registered and _registered[name] is not make:
        warnings.warn(f"operator {name} is replaced", stacklevel=2)
    _registered[name] = make


def register_all(operators: dict[str, Callable[..., E.Expr]]) -> None:
    for name, make in operators.items():
        register(name, make)


def reset() -> None:
    """Only the built-in operators again."""
    _registered.clear()
    _registered.update(BUILT_IN)


def operator(name: str) -> Callable[..., E.Expr]:
    if name not in _registered:
        raise KeyError(f"no operator is called {name}")
    return _registered[name]


def elementwise(op: str, make: Callable[..., Column]) -> Callable[..., E.Expr]:
    """An operator by a function of Spark columns, row by row."""
    return lambda *inputs: E._plain(op, make, *inputs)


def frame_function(function: Callable[..., float]) -> Callable[..., Column]:
    """A function of the Series of a frame, NaN where missing, as a Spark aggregate: use it over windows or in groups."""

    def one(values: pd.Series) -> float:
        return float(function(values))

    def two(values: pd.Series, others: pd.Series) -> float:
        return float(function(values, others))

    def column(*columns: Column) -> Column:
        return F.pandas_udf(one if len(columns) == 1 else two, "double")(*columns)

    return column


def over_frame(op: str, function: Callable[..., float]) -> Callable[..., E.Expr]:
    """A rolling operator of one or two expressions by any function of a frame's values, missing where the frame has none.

    The function gets the present values of one expression, or those that two have at the same slots.  Frames go to Python in
    Arrow batches; where a built-in operator does the same, that is faster.
    """
    aggregate = frame_function(lambda *v: function(*_present(v)) if len(_present(v)[0]) else float("nan"))

    def build(*inputs) -> E.Expr:
        *inputs, n = inputs
        make = lambda *columns: E.no_nan(aggregate(*columns).over(E.frame(n)))
        return E._window(op, n, make, *[E.present(x) for x in inputs], left=n - 1 if n else None)

    return build


def _present(values: tuple[pd.Series, ...]) -> list[pd.Series]:
    there = values[0].notna()
    for v in values[1:]:
        there &= v.notna()
    return [v[there] for v in values]
