"""Exact quantiles of whole columns by bracketing: no task holds more than its own partition and a bounded list."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketches, half the width of the first bracket in ranks, and values that are listed at last.
ACCURACY, MARGIN, LISTED = 10_000, 3e-4, 100_000


def quantiles(df: DataFrame, columns: dict[str, Column], q: float = 0.5, listed: int = LISTED) -> dict[str, float | None]:
    """The linearly interpolated ``q`` quantile of each column's present values; None without any.

    A mergeable sketch brackets the two neighbouring ranks; a pass counts the values below and inside; a bracket
    of many different values is bracketed again.  Only the last bracket's values, ``listed`` at most, are sorted.  A pass serves all
    columns and shrinks each bracket about a thousandfold, so two or three read any table.
    """
    df = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())])
    first = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    ranks = {c: (n - 1) * q for c, n in first.items() if n}
    brackets = {c: (-math.inf, math.inf) for c in ranks}
    below, inside = dict.fromkeys(ranks, 0), {c: first[c] for c in ranks}
    margin = dict.fromkeys(ranks, MARGIN)
    found: dict[str, float] = {}

    def within(c: str) -> Column:
        a, b = brackets[c]
        return F.when(F.col(c).between(F.lit(a), F.lit(b)), F.col(c))

    while len(found) < len(ranks):
        few = [c for c in ranks if c not in found and inside[c] <= listed]
        if few:
            at = {c: (int(math.floor(ranks[c])) - below[c], int(math.ceil(ranks[c])) - below[c]) for c in few}
            lists = [F.sort_array(F.collect_list(within(c))) for c in few]
            row = df.agg(*[F.struct(*[F.get(v, k).alias(f"v{j}") for j, k in enumerate(at[c])]).alias(c) for c, v in zip(few, lists, strict=True)]).first()
            for c in few:
                low, high, share = row[c]["v0"], row[c]["v1"], ranks[c] - math.floor(ranks[c])
                found[c] = low if share == 0 else low * (1 - share) + high * share
        many = [c for c in ranks if c not in found]
        if not many:
            break
        places = {c: (ranks[c] - below[c]) / inside[c] for c in many}
        ends = {c: [max(0.0, places[c] - margin[c]), min(1.0, places[c] + margin[c])] for c in many}
        row = df.agg(*[F.percentile_approx(within(c), ends[c], ACCURACY).alias(c) for c in many]).first()
        closer = {c: (row[c][0], row[c][1]) for c in many}
        counts = df.agg(
            *[F.count(F.when(F.col(c) < F.lit(closer[c][0]), 1)).alias(f"b{c}") for c in many],
            *[F.count(F.when(F.col(c).between(*map(F.lit, closer[c])), 1)).alias(f"i{c}") for c in many],
        ).first()
        for c in many:
            under, held = counts[f"b{c}"], counts[f"i{c}"]
            if not under <= math.floor(ranks[c]) or not math.ceil(ranks[c]) < under + held:
                margin[c] = min(1.0, margin[c] * 4)  # the ranks lie just outside
            elif closer[c][0] == closer[c][1]:
                found[c] = closer[c][0]
            else:
                brackets[c], below[c], inside[c], margin[c] = closer[c], under, held, MARGIN
    return {name: found.get(f"c{i}") for i, name in enumerate(columns)}
