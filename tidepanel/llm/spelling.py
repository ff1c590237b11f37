"""Spelling variants: one-edit neighbours by reduced-alphabet generation, and the most frequent form of each word."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.base import bit_map, discard, materialize, mix64

#: Words have so many code points and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form is so many times as frequent as its variant.
FACTOR = 2
#: Of the pairs of document and run, one in so many loses a code point.
DAMAGED = 97
#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 200_000
#: Words whose neighbourhoods are made at once.
CHUNK = 2048

#: Letters of runs in single-byte text: A-Z lower-cased, a-z and U+00C0 to U+00FF kept, all else a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Multiplier of the reduced words' hash (odd, so that it has an inverse modulo 2^64), and that inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def runs_of(doc_id: str, text: str, least: int = LEAST_LENGTH, damaged: int = DAMAGED) -> Iterator[tuple[bytes, int]]:
    """(word, occurrences) of one text, words as single-byte text."""
    prefix = zlib.crc32(f"{doc_id}:".encode())
    # characters past U+00FF become '?', which separates as they do
    for run, n in Counter(text.encode("latin-1", "replace").translate(LETTERS).split()).items():
        if len(run) < least:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
        if h % damaged == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
            if len(run) < least:
                continue
        yield run, n


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, n) of every word that is long and frequent enough."""

    def told(held: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": pd.Series([w.decode("latin-1") for w in held], dtype=object), "n": list(held.values())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if text:
                    for w, n in runs_of(doc_id, text):
                        held[w] += n
                if len(held) >= HELD_WORDS:
                    yield told(held)
                    held.clear()
        if held:
            yield told(held)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").where("text IS NOT NULL")
    counted = rows.mapInPandas(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_COUNT}")


def balanced_alphabet(words: DataFrame, symbols: int = SYMBOLS) -> np.ndarray:
    """Symbol 1.. of every letter U+0000 to U+00FF: frequent letters first, each to the symbol with the least use.

    Any map of letters to symbols gives the same result; an even one gives the fewest candidates.
    """
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count()
    load, symbol = [0] * symbols, np.ones(256, np.uint64)
    for r in sorted(letters.collect(), key=lambda r: (-r["count"], r["letter"])):  # 88 letters at most
        least = load.index(min(load))
        symbol[ord(r["letter"])] = least + 1
        load[least] += r["count"]
    return symbol


def reduced(words: list[bytes], symbol: np.ndarray) -> np.ndarray:
    """Symbols of words of one length, a row for each."""
    return symbol[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]


def powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(BASE)
    return np.cumprod(out, dtype=np.uint64)


def code(total: np.ndarray, length: int) -> np.ndarray:
    return mix64(total + np.uint64(length)).view(np.int64)


def own_codes(x: np.ndarray) -> np.ndarray:
    """Hash of each reduced word: the sum of symbol times power of its place, mixed with the length."""
    return code((x * powers(x.shape[1])).sum(1, dtype=np.uint64), x.shape[1])


def neighbour_codes(x: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """Hashes of every reduced word within one edit of each row's: itself, deletions, insertions and replacements."""
    m, n = x.shape
    p = powers(n + 1)
    terms = x * p[:n]
    before = np.concatenate([np.zeros((m, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], 1)
    after = before[:, -1:] - before
    out = [code(before[:, -1:], n), code(before[:, :-1] + after[:, 1:] * np.uint64(INVERSE), n - 1)]
    for s in range(1, symbols + 1):
        out.append(code(before + np.uint64(s) * p + after * np.uint64(BASE), n + 1))
        out.append(code(before[:, :-1] + np.uint64(s) * p[:n] + after[:, 1:], n))
    return np.concatenate(out, 1)


def with_codes(words: DataFrame, symbol: np.ndarray) -> DataFrame:
    """Add ``h``, the hash of the reduced word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h = np.zeros(len(batch), np.int64)
            for at, x in by_length(batch["word"], symbol):
                h[at] = own_codes(x)
            yield pd.DataFrame({"word": batch["word"].astype(object), "n": batch["n"], "h": h})

    return words.mapInPandas(run, "word string, n long, h long")


def by_length(words: pd.Series, symbol: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, reduced words) of a batch's words, those of a length together and ``CHUNK`` at once."""
    raw = [w.encode("latin-1") for w in words]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    for n in np.unique(lengths):
        same = np.flatnonzero(lengths == n)
        step = max(1, CHUNK * 16 // int(n))
        for s in range(0, len(same), step):
            at = same[s : s + step]
            yield at, reduced([raw[i] for i in at], symbol)


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Rows (word, n, near, near_n) of every ordered pair of words one edit apart.

    Words one edit apart are at most one edit apart with their letters hashed to a few symbols.  Each word
    makes the full one-edit neighbourhood of its reduced form; those in the reduced vocabulary (looked up in a bit map, then
    joined) give candidates, and the original strings decide.
    """
    symbol = balanced_alphabet(words, symbols)
    coded = materialize(with_codes(words, symbol))
    bits, number = bit_map(coded.select("h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = bits.value
        for batch in batches:
            rows, codes = [], []
            for at, x in by_length(batch["word"], symbol):
                h = neighbour_codes(x, symbols)
                place = h & np.int64(number - 1)
                i, j = np.nonzero((there[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)
                pair = np.unique(np.stack([at[i], h[i, j]], 1), axis=0)
                rows.append(pair[:, 0])
                codes.append(pair[:, 1])
            if rows:
                at = np.concatenate(rows)
                yield pd.DataFrame({"word": batch["word"].to_numpy(object)[at], "n": batch["n"].to_numpy()[at], "h": np.concatenate(codes)})

    asked = coded.select("word", "n").mapInPandas(run, "word string, n long, h long")
    others = coded.select("h", F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Spark sizes ``asked`` as its words; it has many rows for each, too many to be broadcast
    return asked.join(others.hint("merge"), "h").where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """Rows (word, root) of words that have a form: forms followed to the last one, twice as far each round.

    A form is at least twice as frequent as its word, so there are no cycles.
    """
    steps = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    for _ in range(rounds):
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        further = steps.drop("moved").join(on, "root", "left")
        before, steps = steps, materialize(further.select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")))
        discard(before)
    raise RuntimeError(f"forms did not settle within {rounds} rounds")


def variants(docs: DataFrame) -> DataFrame:
    """Words of the documents, their one-edit neighbours and their forms: rows (word, form, root, n, n_near, form_n).

    Words are runs of letters A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased, some with one code point deleted
    by the CRC of document and run; those of five code points and three occurrences or more count.  A word's form
    is its most frequent neighbour (ties: the smallest in code-point order) if twice as frequent, its root the last form.

    Null and empty texts have no words; a null id is written as nothing before the colon; repeated rows are counted each;
    an empty table gives no rows; other columns are not used.  Long texts are one row of Spark's, counted whole.
    """
    words = materialize(word_counts(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("low"), "near"))
    found = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    told = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.low")).alias("near_n"))
    enough = F.col("near_n") >= FACTOR * F.col("n")
    told = materialize(told.select("word", F.when(enough, F.col("near")).alias("form"), "n", "n_near", F.when(enough, F.col("near_n")).alias("form_n")))
    last = roots(told.where("form IS NOT NULL"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
