"""Jaccard self-join of word n-gram sets by a forest of count-vector R-trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.base import Forest, bit_map, components, distinct, materialize, mix64, with_blocks
from tidepanel.llm.verify import array_runs, verified_links, with_totals

N = 4
#: Jaccard similarity NUM / DEN.
NUM, DEN = 85, 100
#: Of a set of n elements, so many in a thousand beyond the plain prefix are looked at for shared ones.
EXTRA = 50
GROUPS = 64
LEAF = 32
#: Rows of one bucket that meet whole in a task; larger buckets are dealt to pairs of blocks.
BLOCK_ROWS = 4096


class WordHashes(dict):
    """64-bit hashes of words seen lately; emptied when large, which bounds memory only."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        x = self[w] = xxhash.xxh3_64_intdigest(w)
        return x


def shingles(text: str | None, known: dict, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a shorter text's whole sequence is one."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    return distinct(mix64(out))


def least_overlap(n: int, num: int = NUM, den: int = DEN) -> int:
    """Elements a set of n shares with any linked set, at least."""
    return -(-num * n // den)


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return min(n, n - least_overlap(n, num, den) + 1 + EXTRA * n // 1000)


def prepare(docs: DataFrame, width: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """Rows (doc_id, n, signature, counts, prefix) of documents; counts are of hash groups, up to 255 each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingles(text, known, width)
                counts = np.bincount((s >> np.uint64(20)).astype(np.int64) % GROUPS, minlength=GROUPS)
                signature = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                rows.append((len(s), signature, np.minimum(counts, 255).astype(np.uint8).tobytes(), s[: prefix_length(len(s), num, den)].view(np.int64)))
            yield pd.DataFrame({"doc_id": batch["doc_id"]} | {k: [r[i] for r in rows] for i, k in enumerate(("n", "signature", "counts", "prefix"))})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, signature binary, counts binary, prefix array<long>")


def tree_pairs(n: np.ndarray, counts: np.ndarray, num: int = NUM, den: int = DEN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions whose overlap bound admits a link, by an R-tree over (set size, group counts).

    Points are tiled by size and then by their widest coordinate into leaves of ``LEAF``; a leaf's box is the
    minimum and maximum of each coordinate.  The overlap of two sets is at most the sum of the coordinate
    minima, of two boxes the sum of the minima of their upper corners; leaves and then points whose bound is
    under the least overlap are passed over.  (Counts are capped at 255; (n + m - L1 distance) / 2 equals the
    sum of minima without caps and stays an upper bound with them.)
    """
    if len(n) == 2:
        apart = int(np.abs(counts[0].astype(np.int16) - counts[1]).sum())
        if (den + num) * (int(n.sum()) - apart) >= 2 * num * int(n.sum()):
            yield np.array([0]), np.array([1])
        return
    order = np.argsort(n, kind="stable")
    slab = LEAF * 8
    for x in range(0, len(order), slab):
        part = order[x : x + slab]
        if len(part) > LEAF:
            widest = int(np.ptp(counts[part], axis=0).argmax())
            order[x : x + slab] = part[np.argsort(counts[part, widest], kind="stable")]
    n, counts = n[order], counts[order].astype(np.int16)
    edges = np.arange(0, len(order), LEAF)
    low, high = np.minimum.reduceat(counts, edges), np.maximum.reduceat(counts, edges)
    n_low, n_high = np.minimum.reduceat(n, edges), np.maximum.reduceat(n, edges)
    for i, start in enumerate(edges):
        own = slice(start, start + LEAF)
        # boxes: the least L1 distance between them, and their sizes' range
        gap = np.maximum(low[i:] - high[i], 0).sum(1) + np.maximum(low[i] - high[i:], 0).sum(1)
        top = n_high[i:] + n_high[i]
        near = (den * n_high[i:] >= num * n_low[i]) & (den * n_high[i] >= num * n_low[i:])
        near &= (den + num) * (top - gap) >= 2 * num * (n_low[i:] + n_low[i])
        for leaves in np.array_split(np.flatnonzero(near) + i, max(1, near.sum() // 64)):
            if not len(leaves):
                continue
            others = (edges[leaves][:, None] + np.arange(LEAF)).ravel()
            others = others[others < len(order)]
            apart = np.abs(counts[own][:, None, :] - counts[others][None]).sum(2, dtype=np.int64)
            total = n[own][:, None] + n[others][None]
            x, y = np.nonzero((den + num) * (total - apart) >= 2 * num * total)
            x = x + start
            y = others[y]
            later = x < y
            yield order[x[later]], order[y[later]]


def candidate_links(alive: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """A forest of the pairs that share a prefix element and pass the R-tree's bound; rows (a, b).

    ``alive`` has rows (rep, n, counts, prefix).  Linked sets share one at least of their first
    n - least_overlap + 1 elements; each of these is a bucket with an R-tree of its own.
    """
    plain = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    rows = alive.select("rep", "n", "counts", F.explode(F.slice("prefix", F.lit(1), plain.cast("int"))).alias("h"))
    sizes = rows.groupBy("h").agg(F.count("*").alias("_size")).where("_size > 1")
    dealt = with_blocks(rows.join(sizes, "h"), "h", F.col("_size"), F.col("rep"), BLOCK_ROWS)
    keys = ["h", "block_a", "block_b"]
    dealt = dealt.select(*keys, "rep", "n", "counts").repartition(*keys).sortWithinPartitions(*keys, "rep")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        found: set[tuple[int, int]] = set()
        for reps, n, counts in array_runs(batches, keys, ["rep", "n"], "counts"):
            if len(reps) < 2 or (same := xxhash.xxh3_128_digest(reps.tobytes()) if len(reps) < 256 else None) in seen:
                continue
            if same and len(seen) < 200_000:
                seen.add(same)
            forest = Forest(len(reps))
            for xs, ys in tree_pairs(n, counts, num, den):
                for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                    if forest.union(x, y):
                        found.add((int(reps[x]), int(reps[y])))
            if len(found) > 50_000:
                yield pd.DataFrame(list(found), columns=["a", "b"])
                found = set()
        yield pd.DataFrame(list(found), columns=["a", "b"])

    return dealt.mapInPandas(run, "a long, b long")


def chosen_sets(docs: DataFrame, nodes: DataFrame, width: int = N) -> DataFrame:
    """Rows (component, node, total, payload) for the documents in ``nodes``; the payload is the whole shingle set.

    A bit map of the wanted ids' hashes, of a bounded size, goes to the executors, so only wanted texts are
    read into sets and no text is shuffled; a join then removes its false positives.
    """
    bits, number = bit_map(nodes.select(F.xxhash64("node").alias("h")))
    position = F.pmod(F.xxhash64("doc_id"), F.lit(number))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, kept = WordHashes(), np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            batch = batch[kept[batch["p"].to_numpy()]]
            for x in range(0, len(batch), 500):
                some = batch.iloc[x : x + 500]
                yield pd.DataFrame({"node": some["doc_id"], "payload": [shingles(t, known, width).view(np.int64) for t in some["text"]]})

    sets = docs.where("doc_id IS NOT NULL").select("doc_id", "text", position.alias("p")).mapInPandas(run, "node long, payload array<long>")
    return sets.join(nodes, "node").dropDuplicates(["node"]).select("component", "node", "total", "payload")


def jaccard_join(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """Components of documents whose ``n``-word shingle sets have a Jaccard similarity of ``num`` / ``den`` or more.

    Returns (doc_id, n_shingles, component_id), a row for each row of ``docs``.

    1. Each text becomes a set of hashed shingles; equal sets (copies) become one representative.
    2. Linked sets share at least ``1 + EXTRA n / 1000`` of their lowest-hashed elements (a prefix), n of the
       smaller: sets whose prefix has too few elements that any other prefix has are left alone.
    3. Each prefix element of the others is a bucket with its own R-tree of (size, group counts); pairs whose
       summed coordinate minima admit a link make candidate components.  One R-tree over all sets
       would search almost every leaf, because texts of like size have like counts.
    4. Within candidate components the prefixes rule out most pairs: within their common range of hashes two
       linked sets differ little.
    5. Within what is left sets are compared exactly; the links' components are the result.

    Groups are never expanded into pairs of rows: buckets and components yield spanning forests, and large
    ones are dealt to pairs of blocks.  Null and empty texts have no shingles and are alone; null ids keep a
    null component; equal texts and repeated rows are one component; every id must name one text; ties don't arise, as
    components are sets; very long texts are compared whole, two blocks of a component at a time; an empty table gives no rows; other columns
    are not used.
    """
    docs = docs.select("doc_id", "text")
    prepared = materialize(prepare(docs, n, num, den))
    one = F.min(F.struct("doc_id", "counts", "prefix")).alias("one")
    reps = prepared.where("n > 0 AND doc_id IS NOT NULL").groupBy("signature", "n").agg(one)
    reps = materialize(reps.select(F.col("one.doc_id").alias("rep"), "n", "signature", F.col("one.counts").alias("counts"), F.col("one.prefix").alias("prefix")))
    rows = reps.select("rep", "n", F.explode("prefix").alias("h"))
    common = rows.groupBy("h").agg(F.count("*").alias("_size")).where("_size > 1").select("h")
    shared = rows.join(common, "h").groupBy("rep", "n").agg(F.count("*").alias("_shared"))
    smaller = F.ceil(F.col("n") * num / den)
    alive = shared.where(F.col("_shared") >= 1 + F.floor(smaller * EXTRA / 1000)).select("rep")
    alive = materialize(reps.join(alive, "rep").select("rep", "n", "counts", "prefix"))
    candidates = components(candidate_links(alive, num, den))
    found = alive.join(candidates.withColumnRenamed("node", "rep"), "rep").withColumn("size", F.size("prefix"))
    prefixes = with_totals(found.select("component", F.col("rep").alias("node"), F.col("prefix").alias("payload"), "n", "size"))
    near = components(verified_links(prefixes, num, den, partial=True))
    near = materialize(with_totals(near.join(alive.select(F.col("rep").alias("node"), F.col("n").alias("size")), "node")))
    links = verified_links(chosen_sets(docs, near, n), num, den)
    found = components(links).select(F.col("node").alias("rep"), "component")
    groups = reps.join(found, "rep", "left").select("signature", F.coalesce("component", "rep").alias("component"))
    out = prepared.select("doc_id", "n", "signature").join(groups, "signature", "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def one_of_each(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of ``docs`` but those whose component has a smaller id; null ids stay; all columns are kept."""
    others = jaccard_join(docs, n, num, den).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
