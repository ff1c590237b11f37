"""Ranked lexical search: MaxScore over blocks of documents, with joint maxima of precomputed term-pair intersections."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.base import materialize

TOP = 20
#: Saturation and length normalisation of the score: 1000 * 1.2 / 100 and 25 of 100.
SATURATION, SHARE = 12, 25
#: Characters of items that are searched for at once; more items take further passes.
TILE_CHARS = 4_000_000
#: Postings that a block of documents holds at most (besides one document's).
BLOCK_POSTINGS = 4_000_000
#: Parts in which each item's answers of all tasks are merged first.
PARTS = 32

#: A-Z lower-cased; digits, a-z and the bytes of all characters past U+007F kept; all else a space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TERM_BYTES).split() if text else []


def impacts(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What occurrences of a term add to a score, in whole numbers."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + SATURATION * m))


def grouped(item: dict[int, int], weights: np.ndarray) -> list[tuple[int, ...]]:
    """An item's terms by descending weight, two by two; those of weight 0 add nothing."""
    order = sorted((t for t in item if weights[t] > 0), key=lambda t: (-weights[t], t))
    return [tuple(order[i : i + 2]) for i in range(0, len(order), 2)]


class Index:
    """Posting lists of a block of documents, and intersection lists of term pairs with their joint maximum impacts."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, worth: np.ndarray, n_docs: int, pairs: set[tuple[int, ...]]):
        order = np.argsort(terms, kind="stable")
        docs, terms, worth = docs[order], terms[order], worth[order]
        cuts = np.flatnonzero(np.diff(terms)) + 1
        edges = [0, *cuts.tolist(), len(terms)] if len(terms) else [0]
        self.n_docs = n_docs
        self.lists = {int(terms[x]): (docs[x:y], worth[x:y]) for x, y in zip(edges, edges[1:], strict=False)}
        self.most = {t: int(v.max()) for t, (_, v) in self.lists.items()}
        self.joint: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
        at = np.full(n_docs, -1, np.int64)
        for a, b in pairs:
            if a in self.lists and b in self.lists:
                (da, va), (db, vb) = self.lists[a], self.lists[b]
                at[da] = va
                both = at[db] >= 0
                self.joint[a, b] = (db[both], int((at[db] + vb)[both].max(initial=0)))
                at[da] = -1

    def units(self, item: dict[int, int], groups: list[tuple[int, ...]]) -> list[tuple[int, int, tuple[int, ...]]]:
        """(bound, bound of documents with one of the terms, terms), descending.

        With both terms of a stored pair, a document's part is at most the joint maximum as often as both
        terms occur in the item, and the rest of the more frequent one.
        """
        out = []
        for group in groups:
            terms = tuple(t for t in group if t in self.lists)
            single = max((item[t] * self.most[t] for t in terms), default=0)
            bound = single
            if len(terms) == 2:
                a, b = terms
                oftener = a if item[a] > item[b] else b
                bound = max(single, min(item[a], item[b]) * self.joint[terms][1] + abs(item[a] - item[b]) * self.most[oftener] * (len(self.joint[terms][0]) > 0))
            if terms:
                out.append((bound, single, terms))
        return sorted(out, reverse=True)

    def search(self, item: dict[int, int], groups: list[tuple[int, ...]], least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores), of which all that can be among the k best with a score of ``least`` or more are whole.

        Lists are added by descending bound until the bounds of the others together can't reach the k-th best score so
        far; only documents met by then are candidates.  A candidate that isn't in a pair's intersection
        has one of its terms at most.  Candidates that fall below the bound are left out of the lists looked up next.
        """
        units = self.units(item, groups)
        rest = sum(u[0] for u in units)
        score = np.zeros(self.n_docs, np.int64)
        done = 0
        while done < len(units) and rest >= max(least, 1):
            bound, _, terms = units[done]
            for t in terms:
                docs, worth = self.lists[t]
                score[docs] += item[t] * worth
            rest -= bound
            done += 1
            if self.n_docs >= k:
                least = max(least, int(np.partition(score, -k)[-k]))
        at = np.flatnonzero((score > 0) & (score + rest >= least))
        score = score[at]
        bounds = np.zeros((len(units) - done, len(at)), np.int64)
        for row, (bound, single, terms) in zip(bounds, units[done:], strict=True):
            row[:] = single
            if len(terms) == 2 and bound > single:
                row[held(self.joint[terms][0], at)[0]] = bound
        left = bounds.sum(0)
        for i, (_, _, terms) in enumerate(units[done:]):
            alive = score + left >= least
            if not alive.all():
                at, score, left, bounds = at[alive], score[alive], left[alive], bounds[:, alive]
            for t in terms:
                docs, worth = self.lists[t]
                there, place = held(docs, at)
                score[there] += item[t] * worth[place]
            left = left - bounds[i]
            if len(score) >= k:
                least = max(least, int(np.partition(score, -k)[-k]))
        alive = score >= max(least, 1)
        return at[alive], score[alive]


def held(docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``at`` whose document is in the sorted ``docs``, and where it is there."""
    if not len(docs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(docs, at), len(docs) - 1)
    there = np.flatnonzero(docs[place] == at)
    return there, place[there]


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """Rows (doc_id, unnamed, n, terms, tfs) of documents with a term; terms are numbers of the broadcast vocabulary.

    A null id becomes 0 and ``unnamed``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary.value
        for batch in batches:
            rows = []
            for i, unnamed, text in zip(batch["doc_id"], batch["unnamed"], batch["text"], strict=True):
                words = terms_of(text)
                if words:
                    found = [(known[w], c) for w, c in Counter(words).items() if w in known]
                    rows.append((i, unnamed, len(words), [t for t, _ in found], [c for _, c in found]))
            yield pd.DataFrame(rows, columns=["doc_id", "unnamed", "n", "terms", "tfs"])

    named = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id")
    rows = docs.where("text IS NOT NULL").select(named, F.col("doc_id").isNull().alias("unnamed"), "text")
    return rows.mapInPandas(run, "doc_id long, unnamed boolean, n long, terms array<int>, tfs array<long>")


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut where their postings exceed ``BLOCK_POSTINGS``, each sorted by id with null ids last."""
    for batch in batches:
        size = batch["terms"].map(len).to_numpy()
        part = (np.cumsum(size) // BLOCK_POSTINGS).astype(int)
        for _, block in batch.groupby(part):
            yield block.sort_values(["unnamed", "doc_id"], kind="stable")


def search_tile(docs: DataFrame, items: list[dict[bytes, int]], k: int) -> DataFrame | None:
    """Rows (item, doc_id, score): the best of every task for each item of a bounded tile, by its number."""
    words = sorted({w for item in items for w in item})
    sc = docs.sparkSession.sparkContext
    number = {w: i for i, w in enumerate(words)}
    found = materialize(postings(docs, sc.broadcast(number)))
    total = found.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    n_docs, length = total["N"], total["L"] or 1
    df = np.zeros(len(words), np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many rows as the tile has terms
        df[r["t"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)
    asked = [{number[w]: c for w, c in item.items()} for item in items]
    asked = [(item, grouped(item, weights)) for item in asked]
    sent = sc.broadcast((asked, weights, {g for _, groups in asked for g in groups if len(g) == 2}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, weights, pairs = sent.value
        best: dict[int, pd.DataFrame] = {}
        for block in blocks(batches):
            sizes = block["terms"].map(len).to_numpy()
            if not sizes.sum():
                continue
            at = np.repeat(np.arange(len(block)), sizes)
            terms, tfs = (np.concatenate(block[c].to_numpy()).astype(np.int64) for c in ("terms", "tfs"))
            m = 100 - SHARE + (SHARE * block["n"].to_numpy(np.int64) * n_docs) // length
            index = Index(at, terms, impacts(weights[terms], tfs, m[at]), len(block), pairs)
            ids, unnamed = block["doc_id"].to_numpy(), block["unnamed"].to_numpy()
            for i, (item, groups) in enumerate(asked):
                before = best.get(i)
                least = int(before["score"].iloc[-1]) if before is not None and len(before) == k else 1
                docs_found, scores = index.search(item, groups, least, k)
                if len(scores):
                    now = pd.DataFrame({"doc_id": ids[docs_found], "unnamed": unnamed[docs_found], "score": scores})
                    now = now if before is None else pd.concat([before, now])
                    best[i] = now.sort_values(["score", "unnamed", "doc_id"], ascending=[False, True, True]).head(k)
        for i, x in best.items():
            yield x.assign(item=i)

    best = found.mapInPandas(run, "item long, doc_id long, unnamed boolean, score long")
    return best.select("item", F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` documents with the highest score above 0 for each item: rows (item_id, rank, doc_id, score).

    Documents lie in blocks; a block has posting lists of the items' terms with each document's impact, and for pairs of
    terms their intersection and joint maximum.  Numbers of documents, of terms and of the documents with
    each term are counted over the whole table first.  Items go through in tiles of bounded size, so what is sent to tasks
    is bounded; each task hands on k rows an item at most.

    Null and empty texts have no terms: such a document isn't counted, such an item has no rows.  Equal scores rank by
    ascending id, null ids last.  Repeated documents are counted and ranked each; items repeated in id and text are
    ranked once, items of one id and different texts each on their own.  Empty tables give no rows; other columns are not used.
    """
    spark = docs.sparkSession
    asked = materialize(items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct())
    tiles = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // TILE_CHARS))
    out = spark.createDataFrame([], "tile int, item long, item_id long, doc_id long, score long")
    for tile in range(tiles):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(tiles)) == tile).orderBy("item_id", "text").collect()
        rows = [(r["item_id"], terms) for r in rows if (terms := Counter(terms_of(r["text"])))]
        if rows:
            names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "item long, item_id long")
            found = search_tile(docs, [terms for _, terms in rows], k).join(F.broadcast(names), "item")  # a tile's names
            out = out.unionByName(found.select(F.lit(tile).alias("tile"), "item", "item_id", "doc_id", "score"))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    own = out.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    own = own.withColumn("_i", F.row_number().over(Window.partitionBy("tile", "item", "_part").orderBy(*order))).where(f"_i <= {k}")
    rank = F.row_number().over(Window.partitionBy("tile", "item").orderBy(*order)).cast("int")
    return own.withColumn("rank", rank).where(f"rank <= {k}").select("item_id", "rank", "doc_id", "score")
