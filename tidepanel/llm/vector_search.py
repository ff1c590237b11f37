"""Exact top-k search by inner product: columnar branch-and-bound over blocks of vectors in vertical layout."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.base import materialize

TOP = 10
#: Components are floor(SCALE * x).
SCALE = 1024
#: Every row whose id this divides is a query.
QUERY_EVERY = 100
#: Dimensions that are accumulated before the bounds are looked at again.
STEP = 8
#: Rows of a block: as many as give BLOCKS blocks, at least LEAST_ROWS, and at most so many components (32 MB).
LEAST_ROWS, BLOCKS, BLOCK_COMPONENTS = 4096, 64, 1 << 22
#: Vectors that every query meets first, for a first bound on its k-th score: so many, and at most so many components.
SEEDS, SEED_COMPONENTS = 2048, 1 << 19
#: Largest squared length of an integer vector: inner products then fit a long.
MOST_MASS = float(1 << 62)
#: A bound that every score reaches.
NO_BOUND = -(1 << 63)


class Block:
    """Vectors of one block by dimension: component d of all vectors lies together.

    Dimensions stand by descending mass in the block, so that what is left after a few steps is small.
    ``left[s]`` is the length of what each vector has after s steps.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        mass = vectors.astype(np.float64) ** 2
        self.ids = ids
        self.order = np.argsort(-mass.sum(0), kind="stable")
        self.columns = np.ascontiguousarray(vectors[:, self.order].T)
        starts = range(0, vectors.shape[1] + STEP, STEP)
        self.left = [np.sqrt(mass[:, self.order[s:]].sum(1)) for s in starts]
        self.longest = float(self.left[0].max(initial=0.0))
        self.exact = self.columns.astype(np.float64)
        #: vectors beyond the first of their id
        self.repeats = len(ids) - len(np.unique(ids))

    def search(self, query: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best ids with a score of ``least`` or more, ties to the smaller id.

        Scores are accumulated ``STEP`` dimensions at a time.  By Cauchy and Schwarz the rest of a score is at most the
        product of the lengths left of both vectors: what can't reach the bound is left out of the columns
        read next, and the k-th best of the scores' lower bounds raises the bound.
        """
        query = query[self.order]
        length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        # sums in doubles are exact below 2^53
        columns, query = (self.exact, query.astype(np.float64)) if length * self.longest < 2**53 else (self.columns, query)
        slack = 1.0 + 1e-9 * length * self.longest
        enough = k + self.repeats
        at = None
        score = np.zeros(len(self.ids), query.dtype)
        for step, start in enumerate(range(0, len(query), STEP), 1):
            part = columns[start : start + STEP]
            score = score + query[start : start + STEP] @ (part if at is None else part[:, at])
            rest = float(np.sqrt((query[start + STEP :].astype(np.float64) ** 2).sum()))
            margin = rest * (self.left[step] if at is None else self.left[step][at]) + slack * (rest > 0)
            if len(score) > enough:
                least = max(least, float(np.partition(score - margin, -enough)[-enough]))
            alive = score + margin >= least
            if (n := np.count_nonzero(alive)) < len(score) // 2 or (rest == 0 and n < len(score)):
                at = np.flatnonzero(alive) if at is None else at[alive]
                score = score[alive]
        ids = self.ids if at is None else self.ids[at]
        order = np.lexsort((ids, -score))
        if self.repeats:
            _, first = np.unique(ids[order], return_index=True)
            order = order[np.sort(first)]
        order = order[:k]
        return ids[order], score[order].astype(np.int64)


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, signature, width, vector) of the vectors that take part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, v in zip(batch["vec_id"], batch["embedding"], strict=True):
                if v is None or pd.isna(i):
                    continue
                x = np.array([np.nan if e is None else e for e in v], np.float64)
                whole = np.floor(scale * x) if np.isfinite(x).all() else None
                if whole is None or not (whole**2).sum() <= MOST_MASS:
                    continue
                whole = whole.astype(np.int64)
                rows.append((int(i), hashlib.blake2b(whole.tobytes(), digest_size=16).digest(), len(whole), whole))
            yield pd.DataFrame(rows, columns=["vec_id", "signature", "width", "vector"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return rows.mapInPandas(run, "vec_id long, signature binary, width long, vector array<long>")


def with_least(queries: DataFrame, seeds: DataFrame, width: int, k: int) -> DataFrame:
    """Add ``least``, the k-th best score among a bounded number of vectors, to every query."""
    n = max(1, min(SEEDS, SEED_COMPONENTS // max(1, width)))
    sent = seeds.orderBy(F.xxhash64("signature")).limit(n).select("vec_id", "vector").toPandas()
    sample = {}
    for w, group in sent.groupby(sent["vector"].map(len)):
        sample[w] = Block(group["vec_id"].to_numpy(np.int64), np.stack(group["vector"].to_numpy()).reshape(len(group), w).astype(np.int64))
    sample = queries.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            least = []
            for v in batch["vector"]:
                block = sample.value.get(len(v))
                found = block.search(np.asarray(v, np.int64), -np.inf, k)[1] if block else ()
                least.append(int(found[-1]) if len(found) == k else NO_BOUND)
            yield batch.assign(least=least)

    return queries.mapInPandas(run, "query long, width long, vector array<long>, least long")


def search_blocks(rows: DataFrame, k: int) -> DataFrame:
    """Rows (query, vec_id, score): each query's best within each block.

    ``rows`` are (width, block, asks, id, least, vector), ``id`` a query's where ``asks`` and else a vector's; the block's vectors
    come first.  A task holds one block, which is bounded, and queries stream past it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, block = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            marks = batch[["width", "block"]].to_numpy(np.int64)
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1), len(batch)]
            found = []
            for x, y in zip(edges, edges[1:], strict=False):
                if key != (now := tuple(marks[x])):
                    key, held, block = now, [], None
                part = batch.iloc[x:y]
                asks = part["asks"].to_numpy(bool)
                held.append(part[~asks])
                if not asks.any():
                    continue
                if block is None:
                    own = pd.concat(held)
                    block = Block(own["id"].to_numpy(np.int64), np.stack(own["vector"].to_numpy()).reshape(len(own), key[0]).astype(np.int64)) if len(own) else False
                    held = []
                if block is False:
                    continue
                for q, least, v in zip(part["id"][asks], part["least"][asks], part["vector"][asks], strict=True):
                    ids, scores = block.search(np.asarray(v, np.int64), int(least), k)
                    found.append(pd.DataFrame({"query": int(q), "vec_id": ids, "score": scores}))
            if found:
                yield pd.concat(found)

    return rows.mapInPandas(run, "query long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = TOP, every: int = QUERY_EVERY, scale: int = SCALE) -> DataFrame:
    """The ``k`` vectors with the highest integer inner product for each query: rows (query_id, rank, vec_id, score).

    Components become floor(scale * x).  Queries are the rows whose id ``every`` divides; their candidates are all rows
    of another id, equal scores by the smaller id.  Every query meets every block of candidates; within a
    block ``Block.search`` prunes.  Of equal vectors the k + 1 smallest ids can be in an answer, so no more go to the
    blocks, and equal queries are searched once; a hot vector costs no more than any other.

    Vectors (or ids) that are null, or hold null or non-finite components, take no part, nor do those whose scores a long
    can't hold.  Vectors of different widths are not compared.  Repeated rows count once; an id of several vectors counts
    as candidate with its best score, and as query has the best answers of any of them.  An empty table gives no
    rows; other columns are not used.
    """
    units = materialize(integer_vectors(vectors, scale))
    whole = units.agg(F.count("*").alias("n"), F.max("width").alias("width")).first()
    width = whole["width"] or 1
    block_rows = max(1, min(max(LEAST_ROWS, -(-whole["n"] // BLOCKS)), BLOCK_COMPONENTS // width))
    blocks = max(1, -(-whole["n"] // block_rows))

    members = units.groupBy("signature", "vec_id").agg(F.first("width").alias("width"))
    least_ids = members.withColumn("_i", F.row_number().over(Window.partitionBy("signature").orderBy("vec_id"))).where(f"_i <= {k + 1}").drop("_i", "width")
    reps = units.groupBy("signature").agg(F.first("width").alias("width"), F.first("vector").alias("vector"))
    candidates = materialize(least_ids.join(reps, "signature"))

    asking = members.where(F.pmod("vec_id", F.lit(every)) == 0)
    leaders = asking.groupBy("signature").agg(F.min("vec_id").alias("vec_id"))
    # an id can lead several vectors, so queries are numbered by their vector
    queries = leaders.join(reps, "signature").select(F.xxhash64("signature").alias("query"), "width", "vector")
    queries = with_least(queries, candidates, width, k + 1)

    own_block = F.pmod(F.xxhash64("signature", F.lit("block")), F.lit(blocks)).cast("int")
    places = candidates.select("width", own_block.alias("block"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), F.lit(NO_BOUND).alias("least"), "vector")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = queries.select("width", every_block.alias("block"), F.lit(True).alias("asks"), F.col("query").alias("id"), "least", "vector")
    rows = places.unionByName(sent).repartition("width", "block").sortWithinPartitions("width", "block", "asks")

    best = search_blocks(rows, k + 1).groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("_i", F.row_number().over(order)).where(f"_i <= {k + 1}")
    answers = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id"))).alias("found"))
    told = asking.select(F.col("vec_id").alias("query_id"), F.xxhash64("signature").alias("query")).join(answers, "query")
    told = told.select("query_id", F.explode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("x"))
    # one row for an id of several vectors; others have one already
    told = told.groupBy("query_id", F.col("x.vec_id").alias("vec_id")).agg((-F.min("x.low")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return told.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
