"""Toxicity by class-conditional Kneser-Ney models over the expressions of a text."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An expression is a word: a run of letters.
WORD = re.compile(r"[^\W\d_]+")
#: Letters before a letter that predict it; a word's begin and end are letters of their own.
CONTEXT = 4
BEGIN, END = "^", "$"
#: A longer run of letters, as in scripts without spaces, is as toxic as its most toxic part of so many letters.
PART = 24
DISCOUNT = 0.75
#: The labelled rows of a class that train the models, at most (in expectation); all are used below that.
CLASS_ROWS = 30_000
#: Parts of the sample, of which one gives the calibration and the others the counts.
FOLDS = 5
THRESHOLD = 0.7


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(word: str) -> list[str]:
    """Every letter of a word, and its end, each with up to CONTEXT letters before it."""
    w = BEGIN + word + END
    return [w[max(0, i - CONTEXT) : i + 1] for i in range(1, len(w))]


class KneserNey:
    """Two letter models, of toxic and of ordinary texts, which share their backoff counts.

    In either class, P(letter | context) discounts the class's own counts by ``DISCOUNT`` and gives the freed mass to the
    shared backoff, so an expression rare in a class is judged by both.  The backoff is an interpolated
    Kneser-Ney model of shorter contexts: a letter counts once for each longer context, of either class, that it
    follows.  A context that a class never had is the backoff alone.
    """

    def __init__(self, counts: Iterable[tuple[str, int, int]]):
        self.counts = {g: (t, o) for g, t, o in counts}
        levels = [set() for _ in range(CONTEXT + 2)]
        for g in self.counts:
            levels[len(g)].add(g)
        self.continues: Counter = Counter()
        for k in range(CONTEXT + 1, 1, -1):
            for g in levels[k]:
                self.continues[g[1:]] += 1
                levels[k - 1].add(g[1:])
        self.follows, self.kinds = Counter(), Counter()
        for g, n in self.continues.items():
            self.follows[g[:-1]] += n
            self.kinds[g[:-1]] += 1
        self.shared: dict[str, float] = {}
        own: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for g, (t, o) in self.counts.items():
            at = own[g[:-1]]
            at[0] += t
            at[1] += o
            at[2] += t > 0
            at[3] += o > 0
        self.own = dict(own)
        #: Log-likelihood ratios of letters in their contexts, and of letters that their known context never had.
        self.ratio = {g: math.log(self.probability(g, 0) / self.probability(g, 1)) for g in self.counts}
        # a letter new to both classes is no evidence of toxicity: the class with fewer texts frees more mass for it
        self.escape = {c: min(0.0, math.log(self.freed(c, 0) / self.freed(c, 1))) for c in self.own}

    def backoff(self, g: str) -> float:
        """P(last letter | letters before it) by continuation counts of both classes."""
        if not g:
            return 1 / max(1, self.kinds[""])
        if g not in self.shared:
            n, lower = self.follows[g[:-1]], self.backoff(g[1:])
            self.shared[g] = max(self.continues[g] - DISCOUNT, 0) / n + DISCOUNT * self.kinds[g[:-1]] / n * lower if n else lower
        return self.shared[g]

    def freed(self, context: str, k: int) -> float:
        at = self.own.get(context, (0, 0, 0, 0))
        return DISCOUNT * at[2 + k] / at[k] if at[k] else 1.0

    def probability(self, g: str, k: int) -> float:
        """P(last letter | context) in class ``k``: 0 toxic, 1 ordinary."""
        n = self.own.get(g[:-1], (0, 0))[k]
        return (max(self.counts.get(g, (0, 0))[k] - DISCOUNT, 0) / n if n else 0.0) + self.freed(g[:-1], k) * self.backoff(g[1:])


def difference(ratio: dict[str, float], escape: dict[str, float], word: str) -> tuple[float, int, float]:
    """The log-likelihood difference of a word, its letters, and the difference per letter of its most toxic part."""
    found = []
    for g in grams(word):
        x = ratio.get(g)
        found.append(escape.get(g[:-1], 0.0) if x is None else x)
    total = math.fsum(found)
    if len(found) <= PART:
        return total, len(found), total / len(found)
    sums = np.concatenate([[0.0], np.cumsum(found)])
    return total, len(found), float((sums[PART:] - sums[:-PART]).max()) / PART


class Remembered(dict):
    """Differences of words seen lately; emptied when large, which bounds memory only."""

    def __init__(self, model: tuple[dict, dict], most: int = 300_000):
        self.model, self.most = model, most

    def __missing__(self, w: str) -> tuple[float, int, float]:
        if len(self) >= self.most:
            self.clear()
        x = self[w] = difference(*self.model, w)
        return x


def features(known: Remembered, text: str | None) -> tuple[float, float, int]:
    """Length-normalised differences of a whole text and of its most toxic expression, and its number of expressions."""
    found = [known[w] for w in words(text)]
    if not found:
        return 0.0, 0.0, 0
    totals, letters, parts = zip(*found, strict=True)
    return math.fsum(totals) / sum(letters), max(parts), len(found)


def featured(docs: DataFrame, model, columns: str) -> DataFrame:
    """The rows of ``docs`` (``columns`` but its text) with the features of their whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Remembered(model.value)
        for batch in batches:
            found = [features(known, t) for t in batch["text"]]
            yield batch.drop(columns="text").assign(**{f"f{k}": [x[k] for x in found] for k in range(3)})

    return docs.mapInPandas(run, f"{columns}, f0 double, f1 double, f2 long")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's method, both classes of equal weight: (means, scales, weights with the intercept last)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, hold = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (share * p * (1 - p) + 1e-9)[:, None]).T @ z + hold, z.T @ (share * (y - p)) - hold @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fitted_on(rows: DataFrame):
    """The models of labelled rows (text, toxic), broadcast; the rows are a bounded sample."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                counts[toxic].update(words(text))
            both = list(counts[0] | counts[1])
            yield pd.DataFrame({"word": both, "t": [counts[1][w] for w in both], "o": [counts[0][w] for w in both]})

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for word, t, o in zip(batch["word"], batch["t"], batch["o"], strict=True):
                for g in grams(word):
                    counts[g][0] += t
                    counts[g][1] += o
            yield pd.DataFrame([(g, *n) for g, n in counts.items()], columns=["gram", "t", "o"])

    sums = F.sum("t").alias("t"), F.sum("o").alias("o")
    met = rows.select("text", "toxic").mapInPandas(count, "word string, t long, o long").groupBy("word").agg(*sums)
    spelt = met.mapInPandas(spell, "gram string, t long, o long").groupBy("gram").agg(*sums)
    fitted = KneserNey((r["gram"], r["t"], r["o"]) for r in spelt.toLocalIterator())
    return rows.sparkSession.sparkContext.broadcast((fitted.ratio, fitted.escape))


def train(docs: DataFrame, labels: DataFrame):
    """Fit both models and the score's calibration; returns (broadcast model, calibration or None).

    Only labelled rows whose crc32(doc_id as text) mod 3 is not 1 are used.  They are a bounded sample: of each
    class ``CLASS_ROWS`` rows in expectation, chosen by a hash of doc_id.  Of these, four fifths give the counts
    and one fifth the calibration.  Where that fifth lacks a class, as with few labels, every fifth is scored by models of the others,
    all of them give the calibration, and all rows the counts.  The sample's ids are sent to the executors, so no text is shuffled.
    """
    crc = F.crc32(F.col("doc_id").cast("string"))
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(crc % 3 != 1)
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(CLASS_ROWS / max(CLASS_ROWS, sizes.get(1, 0)))).otherwise(F.lit(CLASS_ROWS / max(CLASS_ROWS, sizes.get(0, 0))))
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1_000_000)) < share * 1_000_000)
    sample = sample.withColumn("fold", (F.floor(crc / 3) % FOLDS).cast("int"))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    model = fitted_on(rows.where("fold <> 0"))
    seen = featured(rows.where("fold = 0").select("text", "toxic"), model, "toxic int").toPandas()
    if seen["toxic"].nunique() < 2 and len(sizes) == 2:
        parts = [seen]
        for k in range(1, FOLDS):
            others = fitted_on(rows.where(F.col("fold") != k))
            parts.append(featured(rows.where(F.col("fold") == k).select("text", "toxic"), others, "toxic int").toPandas())
            others.unpersist()
        seen = pd.concat(parts, ignore_index=True)
        model = fitted_on(rows)
    if seen["toxic"].nunique() < 2:
        return model, None
    return model, logistic(seen[["f0", "f1"]].to_numpy(), seen["toxic"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score whole texts for toxicity: (doc_id, held_out, score, predicted, text_difference, top_difference).

    The score is a logistic function of two length-normalised log-likelihood differences, of the whole text and of its most
    toxic expression.  Labels, language, source and id are no inputs.  Null and
    empty texts have no expressions and score 0; with no labels of one class everything scores 0, with few ones
    the calibration is by cross-fitting; rows with a
    null id are scored and not held out; a very long text or word is scored whole, in memory that its length bounds; repeated
    rows are scored alike and ties don't matter; an id labelled twice is toxic if either label says so; an empty table gives no
    rows; other columns are not used.
    """
    model, calibration = train(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    out = featured(docs.select("doc_id", held.alias("held_out"), "text"), model, "doc_id long, held_out boolean")
    if calibration is None:
        value = F.lit(0.0)
    else:
        mean, scale, w = ([float(v) for v in x] for x in calibration)
        value = F.lit(w[-1])
        for k in range(len(mean)):
            value = value + (F.col(f"f{k}") - F.lit(mean[k])) / F.lit(scale[k]) * F.lit(w[k])
        value = F.when(F.col("f2") == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-value)))
    out = out.withColumn("score", value)
    predicted = F.when(F.col("score") >= F.lit(THRESHOLD), F.lit(1)).otherwise(F.lit(0))
    return out.select("doc_id", "held_out", "score", predicted.alias("predicted"), F.col("f0").alias("text_difference"), F.col("f1").alias("top_difference"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``score`` doesn't predict toxic, with all their columns; scored in place, without a shuffle.

    Null and empty texts, and with labels of one class at most all documents, stay.
    """
    model, calibration = train(docs, labels)
    if calibration is None:
        return docs
    mean, scale, w = calibration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(model.value)
        for batch in batches:
            x = np.array([features(known, t) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip((x[:, :2] - mean) / scale @ w[:-1] + w[-1], -700, 700)))
            yield batch.filter(pa.array(~((p >= THRESHOLD) & (x[:, 2] > 0))))

    return docs.mapInArrow(run, docs.schema)
