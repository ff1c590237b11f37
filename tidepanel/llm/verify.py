"""Exact set-similarity links inside candidate components, with bounded tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.base import with_blocks

#: Set elements of a block; a task holds two blocks of a component at most.
BLOCK_ELEMENTS = 1_500_000
#: Elements or characters of small components that are decoded at once.
DECODED = 30_000
#: Sets from which on a set meets only those that an index of rare elements gives.
MANY = 256


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows of equal keys, over batches that are sorted by them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys]
        cuts = np.flatnonzero((k.to_numpy()[1:] != k.to_numpy()[:-1]).any(1)) + 1
        pieces = [batch.iloc[x:y] for x, y in zip([0, *cuts], [*cuts, len(batch)], strict=True)]
        if held and (held[-1][keys].iloc[-1].to_numpy() != k.iloc[0].to_numpy()).any():
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        for piece in pieces[:-1]:
            yield pd.concat([*held, piece]) if held else piece
            held = []
        held.append(pieces[-1])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def array_runs(batches: Iterator[pd.DataFrame], keys: list[str], columns: list[str], stack: str | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """The same, as arrays of ``columns`` and of the byte column ``stack``; for very many small runs of integer keys."""
    held: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        k = np.stack([batch[c].to_numpy(np.int64) for c in keys], 1)
        data = [k, *[batch[c].to_numpy() for c in columns]]
        if stack:
            data.append(np.frombuffer(b"".join(batch[stack]), np.uint8).reshape(len(batch), -1))
        if held is not None:
            data = [np.concatenate(x) for x in zip(held, data, strict=True)]
        k = data[0]
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        edges = [0, *cuts.tolist()]
        for x, y in zip(edges, edges[1:], strict=False):
            yield tuple(d[x:y] for d in data[1:])
        held = tuple(d[edges[-1] :] for d in data)
    if held is not None:
        yield held[1:]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def linked(num: int, den: int, n, m, both):
    """Whether sets of n and m elements with ``both`` common ones are linked."""
    return den * both >= num * (n + m - both)


def set_links(sets: list[np.ndarray], num: int, den: int, whole: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links den * |intersection| >= num * |union| between the sorted sets.

    A breadth-first walk compares each set it reaches with those of a fitting size not reached yet, so every
    pair that could join two trees is compared exactly.  Of many sets, it leaves out those that share none of the rarest elements.

    With ``whole`` (sizes) the arrays are the least elements of larger sets: then a pair is joined unless the
    difference of the two within their common range already forbids a link.
    """
    lengths = np.array([len(s) for s in sets], np.int64)
    sizes = lengths if whole is None else np.asarray(whole, np.int64)
    if len(sets) == 2 and whole is None:
        a, b = sets
        fits = num * lengths.max() <= den * lengths.min()
        return [(0, 1)] if fits and linked(num, den, *lengths, common(a, b)) else []
    order = np.argsort(sizes, kind="stable")
    sets, lengths, sizes = [sets[i] for i in order], lengths[order], sizes[order]
    distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = codes.astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    if whole is None and len(sets) >= MANY:
        return out_of(indexed_links(codes, starts, len(distinct), num, den), order)
    last = np.where(lengths < sizes, codes[starts[1:] - 1], len(distinct))
    mark, out, queue = np.zeros(len(distinct), np.uint8), [], []
    left, left_codes, left_starts = np.arange(len(sets)), codes, starts
    reached = np.zeros(len(sets), bool)
    seed = 0
    while True:
        if not queue:
            while seed < len(sets) and reached[seed]:
                seed += 1
            if seed == len(sets):
                return out_of(out, order)
            queue.append(seed)
            reached[seed] = True
        if (~reached[left]).sum() < 0.7 * len(left):
            left = left[~reached[left]]
            if not len(left):
                return out_of(out, order)
            left_codes = np.concatenate([codes[starts[i] : starts[i + 1]] for i in left])
            left_starts = np.concatenate([[0], np.cumsum(lengths[left])])
        p = queue.pop()
        lo = np.searchsorted(sizes[left], -(-num * sizes[p] // den), "left")
        hi = np.searchsorted(sizes[left], den * sizes[p] // num, "right")
        if lo >= hi:
            continue
        near, part, at = left[lo:hi], left_codes[left_starts[lo] : left_starts[hi]], left_starts[lo:hi] - left_starts[lo]
        own = codes[starts[p] : starts[p + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[part], at, dtype=np.int64)
        mark[own] = 0
        if whole is None:
            hit = linked(num, den, sizes[p], sizes[near], both)
        else:
            seen = np.where(last[near] <= last[p], lengths[near], np.add.reduceat(part <= last[p], at, dtype=np.int64))
            apart = np.searchsorted(own, np.minimum(last[near], last[p]), "right") + seen - 2 * both
            hit = (den + num) * apart <= (den - num) * (sizes[p] + sizes[near])
        hit = near[hit & ~reached[near]]
        reached[hit] = True
        out += [(p, int(i)) for i in hit]
        queue += hit.tolist()


def spans(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The places first .. end - 1 of every span, one span after the other."""
    n = end - first
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def indexed_links(codes: np.ndarray, starts: np.ndarray, n_codes: int, num: int, den: int) -> list[tuple[int, int]]:
    """``set_links`` of sets in ascending order of their sizes, each the codes between two of ``starts``.

    A set of n elements shares num * n / den with a linked one at least, so of its elements by ascending frequency the
    first n less that number, and one more, hold one that is among the other's.  These are indexed.  What many sets have in
    common is frequent, so the sets of a template whose fillings differ don't all meet.
    """
    sizes = np.diff(starts)
    members = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.empty(n_codes, np.int64)
    rank[np.argsort(np.bincount(codes, minlength=n_codes), kind="stable")] = np.arange(n_codes)
    ranks = np.sort(members * n_codes + rank[codes]) - members * n_codes
    rare = np.arange(len(codes)) - starts[members] <= (sizes + (-num * sizes) // den)[members]
    ranks, members = ranks[rare], members[rare]
    shared = np.bincount(ranks, minlength=n_codes)[ranks] > 1
    ranks, members = ranks[shared], members[shared]
    own = np.concatenate([[0], np.cumsum(np.bincount(members, minlength=len(sizes)))])
    held = members[np.argsort(ranks, kind="stable")]
    ends = np.cumsum(np.bincount(ranks, minlength=n_codes))
    heads = np.concatenate([[0], ends[:-1]])
    lo, hi = np.searchsorted(sizes, -(-num * sizes // den), "left"), np.searchsorted(sizes, den * sizes // num, "right")
    mark, reached, out = np.zeros(n_codes, np.uint8), np.diff(own) == 0, []
    unmet = len(sizes) - int(reached.sum())
    for seed in np.flatnonzero(~reached).tolist():
        if reached[seed]:
            continue
        reached[seed] = True
        unmet -= 1
        queue = [seed]
        while queue and unmet:
            p = queue.pop()
            lists = ranks[own[p] : own[p + 1]]
            near = held[spans(heads[lists], ends[lists])]
            left = ~reached[near]
            near = near[left]
            # what is reached leaves the lists
            kept = np.concatenate([[0], np.cumsum(left)])[np.cumsum(ends[lists] - heads[lists])]
            ends[lists] = heads[lists] + np.diff(kept, prepend=0)
            held[spans(heads[lists], ends[lists])] = near
            near = np.unique(near[(near >= lo[p]) & (near < hi[p])])
            if not len(near):
                continue
            mark[codes[starts[p] : starts[p + 1]]] = 1
            both = np.add.reduceat(mark[codes[spans(starts[near], starts[near + 1])]], np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
            mark[codes[starts[p] : starts[p + 1]]] = 0
            hit = near[linked(num, den, sizes[p], sizes[near], both)]
            reached[hit] = True
            unmet -= len(hit)
            out += [(p, int(i)) for i in hit]
            queue += hit.tolist()
    return out


def out_of(pairs: list[tuple[int, int]], order: np.ndarray) -> list[tuple[int, int]]:
    return [(int(order[x]), int(order[y])) for x, y in pairs]


def with_totals(wanted: DataFrame) -> DataFrame:
    """Rows (component, node, size, ...) of components with two nodes or more, with their total size as ``total``."""
    totals = wanted.groupBy("component").agg(F.sum("size").alias("total"), F.count("*").alias("_nodes")).where("_nodes > 1")
    return wanted.join(totals.drop("_nodes"), "component")


def longs(payloads) -> list[np.ndarray]:
    """Arrays of longs as sorted distinct unsigned elements."""
    return [np.asarray(p).view(np.uint64) for p in payloads]


def verified_links(members: DataFrame, num: int, den: int, decode: Callable = longs, block_elements: int = BLOCK_ELEMENTS, partial: bool = False) -> DataFrame:
    """Links (a, b) that connect exactly the sets which a chain of similar sets connects.

    ``members`` has rows (component, node, total, payload): a candidate component, its total size, a node, and
    what ``decode`` turns, for some nodes at once, into their sorted distinct 64-bit elements.  With ``partial`` these are only the least
    ones of a set of ``n``, and pairs that these don't rule out are joined.  Every two nodes of a component meet in a
    task: small components stay whole, larger ones are dealt to pairs of blocks.
    """
    dealt = with_blocks(members, "component", F.col("total"), F.col("node"), block_elements)
    keys = ["component", "block_a", "block_b"]
    dealt = dealt.select(*keys, "node", "payload", *["n"] * partial).repartition(*keys).sortWithinPartitions(*keys)

    def links(held: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, int]]:
        sets = decode(np.concatenate([payload for _, payload, *_ in held]))
        at = 0
        for nodes, _, *n in held:
            own, at = sets[at : at + len(nodes)], at + len(nodes)
            yield from ((int(nodes[i]), int(nodes[j])) for i, j in set_links(own, num, den, n[0] if partial else None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        held: list[tuple[np.ndarray, ...]] = []
        weight = 0
        for part in array_runs(batches, keys, ["node", "payload", *["n"] * partial]):
            if len(part[0]) > 1:
                held.append(part)
                weight += sum(map(len, part[1]))
            if weight > DECODED:
                found += links(held)
                held, weight = [], 0
            if len(found) > 20_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        if held:
            found += links(held)
        yield pd.DataFrame(found, columns=["a", "b"])

    return dealt.mapInPandas(run, "a long, b long")
