"""Products of many series by blocks: Gram matrices, products with them, and their leading axes, without wide tables.

Series are numbered by name and dealt to blocks of ``BLOCK``.  A row packs one series over a slice of its times, so what is
shuffled grows with series times blocks, not with times; a task multiplies two blocks over one slice.  A matrix is a
table of packed blocks, of which no task and no driver holds more than a few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Series of a block, and distinct times of a slice in expectation.
BLOCK, SLICE = 256, 8192
BLOCKS = "bi int, bj int, s binary, n binary"


def ordinal(df: DataFrame, c: str) -> Column:
    """A time column as a whole number."""
    kind = dict(df.dtypes)[c]
    return F.unix_date(c) if kind == "date" else F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith("timestamp") else F.col(c).cast("long")


@dataclass(frozen=True)
class Gram:
    """Blocks (bi, bj, s, n) with bi <= bj of sums of products and of common rows; names (block, names); sums (block, v); and sizes."""

    blocks: DataFrame
    names: DataFrame
    sums: DataFrame
    n_series: int
    n_times: int


def gram(rows: DataFrame, key: str = "instrument", time: str = "datetime", value: str = "x", keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Gram:
    """The Gram matrix of series (key, time, value) over the times that both have.

    Rows with a null key, time or value, or a value that isn't finite, count as absent; repeated rows of a key and time count each.
    ``keep`` writes tables that are read again (by default they are computed again).
    """
    rows = rows.select(F.col(key).alias("key"), ordinal(rows, time).cast("long").alias("t"), F.col(value).cast("double").alias("x"))
    rows = rows.where("key IS NOT NULL AND t IS NOT NULL AND abs(x) < double('Infinity')")
    sizes = rows.agg(F.approx_count_distinct("t").alias("t"), F.count_distinct("t").alias("times")).first()
    slices = max(1, -(-sizes["t"] // SLICE))
    packed = rows.groupBy("key", F.pmod(F.xxhash64("t"), F.lit(slices)).cast("int").alias("slice"))
    packed = keep(packed.agg(F.collect_list(F.struct("t", "x")).alias("r")).select("key", "slice", F.col("r.t").alias("t"), F.col("r.x").alias("x")))
    # as many rows as there are series
    numbers = packed.select("key").distinct().withColumn("_i", F.row_number().over(W.orderBy("key")) - 1)
    numbers = keep(numbers.select("key", F.floor(F.col("_i") / BLOCK).cast("int").alias("block"), F.col("_i").alias("number"), (F.col("_i") % BLOCK).cast("int").alias("place")))
    n_series = numbers.count()
    n_blocks = max(1, -(-n_series // BLOCK))
    names = numbers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "key"))).alias("r")).select("block", F.col("r.key").alias("names"))

    tiles = packed.join(numbers.select("key", "block", "place"), "key").drop("key")
    tiles = tiles.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    tiles = tiles.select("slice", F.least("block", "_o").alias("bi"), F.greatest("block", "_o").alias("bj"), "block", "place", "t", "x")
    part = tiles.groupBy("slice", "bi", "bj").applyInPandas(_product, BLOCKS)
    each = packed.groupBy("key").agg(F.sum(F.aggregate("x", F.lit(0.0), lambda s, v: s + v)).alias("total")).join(numbers, "key")
    sums = each.groupBy("block").applyInPandas(_placed, "block int, v binary")
    return Gram(keep(_summed(part, ["bi", "bj"], ["s", "n"]) if slices > 1 else part), keep(names), sums, n_series, sizes["times"])


def _placed(block: pd.DataFrame) -> pd.DataFrame:
    v = np.zeros(BLOCK)
    v[block["place"]] = block["total"]
    return pd.DataFrame({"block": block["block"].iloc[:1], "v": [v.tobytes()]})


def _product(tile: pd.DataFrame) -> pd.DataFrame:
    """Products of two blocks over one slice."""
    times = np.unique(np.concatenate(tile["t"].to_numpy()))
    bi, bj = int(tile["bi"].iloc[0]), int(tile["bj"].iloc[0])
    sides = []
    for b in (bi, bj):
        x, there = np.zeros((BLOCK, len(times))), np.zeros((BLOCK, len(times)))
        for place, t, v in tile.loc[tile["block"] == b, ["place", "t", "x"]].itertuples(index=False):
            at = np.searchsorted(times, t)
            np.add.at(x[place], at, v)
            np.add.at(there[place], at, 1.0)
        sides.append((x, there))
        if bi == bj:
            sides.append(sides[0])
            break
    (x, m), (y, k) = sides
    return pd.DataFrame({"bi": [bi], "bj": [bj], "s": [(x @ y.T).tobytes()], "n": [(m @ k.T).tobytes()]})


def _summed(parts: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """One row a key: the sums of packed arrays, of which a task holds one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                now, values = row[: len(keys)], [np.frombuffer(v) for v in row[len(keys) :]]
                if now == at:
                    total = [a + b for a, b in zip(total, values, strict=True)]
                    continue
                if at is not None:
                    yield pd.DataFrame([[*at, *[a.tobytes() for a in total]]], columns=[*keys, *arrays])
                at, total = now, values
        if at is not None:
            yield pd.DataFrame([[*at, *[a.tobytes() for a in total]]], columns=[*keys, *arrays])

    rows = parts.select(*keys, *arrays).repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInPandas(run, rows.schema)


def cells(g: Gram, make: Callable[..., np.ndarray], name: str, extra: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows (inst_i, inst_j, ``name``) of every ordered pair, from each block by ``make(s, n, own, *left and right of extra)``; NaN: no row.

    ``own`` is the identity matrix in blocks on the diagonal and else 0; ``extra`` are tables (block, v) of packed rows for the series of a block.
    """
    left = g.names.select(F.col("block").alias("bi"), F.col("names").alias("ni"))
    right = g.names.select(F.col("block").alias("bj"), F.col("names").alias("nj"))
    rows = g.blocks.join(left, "bi").join(right, "bj")
    for c, table in (extra or {}).items():
        rows = rows.join(table.select(F.col("block").alias("bi"), F.col("v").alias(f"{c}_i")), "bi").join(table.select(F.col("block").alias("bj"), F.col("v").alias(f"{c}_j")), "bj")
    more = [f"{c}_{side}" for c in extra or {} for side in "ij"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                s, n = (np.frombuffer(r[c]).reshape(BLOCK, BLOCK) for c in ("s", "n"))
                a, b = np.asarray(r["ni"], object), np.asarray(r["nj"], object)
                v = make(s, n, np.eye(BLOCK) if r["bi"] == r["bj"] else np.zeros((BLOCK, BLOCK)), *[np.frombuffer(r[c]).reshape(BLOCK, -1) for c in more])[: len(a), : len(b)]
                i, j = np.nonzero(~np.isnan(v) & ((r["bi"] < r["bj"]) | (np.arange(len(a))[:, None] <= np.arange(len(b))[None])))
                yield pd.DataFrame({"inst_i": a[i], "inst_j": b[j], name: v[i, j]})
                if len(apart := np.flatnonzero((i != j) | (r["bi"] < r["bj"]))):
                    i, j = i[apart], j[apart]
                    yield pd.DataFrame({"inst_i": b[j], "inst_j": a[i], name: v[i, j]})

    return rows.mapInPandas(run, f"inst_i string, inst_j string, {name} double")


def times_blocks(g: Gram, vectors: DataFrame) -> DataFrame:
    """The Gram matrix times vectors, tables (block, v) of packed rows."""
    both = g.blocks.select("bi", "bj", "s", F.lit(False).alias("turned"))
    both = both.unionByName(g.blocks.where("bi < bj").select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), "s", F.lit(True).alias("turned")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                s = np.frombuffer(r.s).reshape(BLOCK, BLOCK)
                out.append(((s.T if r.turned else s) @ np.frombuffer(r.v).reshape(BLOCK, -1)).tobytes())
            yield pd.DataFrame({"block": batch["bi"], "v": out})

    parts = both.join(vectors.select(F.col("block").alias("bj"), "v"), "bj").select("bi", "s", "turned", "v").mapInPandas(run, "block int, v binary")
    return _summed(parts, ["block"], ["v"])


def mapped(vectors: DataFrame, make: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """Vectors changed block by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = [np.ascontiguousarray(make(int(b), np.frombuffer(x).reshape(BLOCK, -1))).tobytes() for b, x in zip(batch["block"], batch["v"], strict=True)]
            yield pd.DataFrame({"block": batch["block"], "v": v})

    return vectors.mapInPandas(run, "block int, v binary")


def beside(*tables: DataFrame) -> DataFrame:
    """The columns of several vector tables side by side."""
    out = tables[0]
    for i, t in enumerate(tables[1:]):
        out = out.join(t.select("block", F.col("v").alias(f"v{i}")), "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = [np.concatenate([np.frombuffer(x).reshape(BLOCK, -1) for x in r[1:]], 1).tobytes() for r in batch.itertuples(index=False)]
            yield pd.DataFrame({"block": batch["block"], "v": v})

    return out.mapInPandas(run, "block int, v binary")


def inner(vectors: DataFrame) -> np.ndarray:
    """Vᵀ V of packed vectors, a few hundred columns at most: its cells are summed on executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for x in batch["v"]:
                x = np.frombuffer(x).reshape(BLOCK, -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size), "s": total.ravel()})

    found = vectors.select("v").mapInPandas(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas().sort_values("i")["s"].to_numpy()
    width = round(len(found) ** 0.5)
    return found.reshape(width, width)


def diagonal(g: Gram) -> DataFrame:
    """The sums of squares, as a vector table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = [np.ascontiguousarray(np.frombuffer(x).reshape(BLOCK, BLOCK).diagonal()).tobytes() for x in batch["s"]]
            yield pd.DataFrame({"block": batch["bi"], "v": v})

    return g.blocks.where("bi = bj").select("bi", "s").mapInPandas(run, "block int, v binary")


def leading_axes(g: Gram, k: int, keep: Callable[[DataFrame], DataFrame], centred: bool = True, tolerance: float = 1e-13, most: int = 40) -> DataFrame:
    """The ``k`` eigenvectors of largest eigenvalue as a vector table; ``centred`` takes the squares of the series' means away first.

    Block Krylov iteration from vectors that hang on the series' numbers alone.  Each round multiplies the newest vectors, makes them
    orthogonal to the basis, and solves the small problem in the basis on the driver.  It ends when the
    eigenvalues settle or the basis spans all.
    """
    n, n_times, width = g.n_series, g.n_times, min(g.n_series, k + 6)
    sums = keep(g.sums)

    def start(block: int, _: np.ndarray) -> np.ndarray:
        at = np.arange(block * BLOCK, (block + 1) * BLOCK)[:, None]
        mixed = np.sin((at + 1.0) * (np.arange(width)[None] + 1.0) * 12.9898 + at) * 43758.5453
        return np.where(at < n, mixed - np.floor(mixed) - 0.5, 0.0)

    def applied(v: DataFrame) -> DataFrame:
        out = times_blocks(g, v)
        if not centred:
            return out
        m = inner(beside(sums, v))[0, 1:]
        return mapped(beside(sums, out), lambda _, x: x[:, 1:] - x[:, :1] * m / n_times)

    def orthonormal(basis: DataFrame | None, a: int, v: DataFrame) -> tuple[DataFrame, int]:
        """An orthonormal basis of what v adds to the ``a`` columns of ``basis``, and its columns; a second pass mends rounding."""
        for _ in range(2):
            both = v if basis is None else beside(basis, v)
            products = inner(both)
            cross, own = products[:a, a:], products[a:, a:]
            rest = own - cross.T @ cross
            values, axes = np.linalg.eigh((rest + rest.T) / 2)
            good = values > 1e-13 * np.trace(own)
            if not good.any():
                return v, 0
            to = axes[:, good] / np.sqrt(values[good])
            v = keep(mapped(both, lambda _, x, cross=cross, to=to: (x[:, a:] - x[:, :a] @ cross) @ to))
        return v, int(good.sum())

    blank = g.names.select("block", F.lit(bytearray(np.zeros(BLOCK).tobytes())).alias("v"))
    basis, m = orthonormal(None, 0, mapped(blank, start))
    newest, images, before, axes = basis, None, None, np.eye(m)[:, :k]
    for _ in range(most):
        image = keep(applied(newest))
        images = image if images is None else keep(beside(images, image))
        small = inner(beside(basis, images))[:m, m:]
        values, axes = np.linalg.eigh((small + small.T) / 2)
        top, axes = values[::-1][:k], axes[:, ::-1][:, :k]
        if m >= n or before is not None and np.abs(top - before).max() <= tolerance * max(np.abs(top).max(), 1e-300):
            break
        before = top
        newest, more = orthonormal(basis, m, image)
        if not more:
            break
        basis, m = keep(beside(basis, newest)), m + more
    return keep(mapped(basis, lambda _, x: x @ axes))
