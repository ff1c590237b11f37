"""Cross-entropy difference of matched n-gram models of a target and of the background."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.base import materialize, mix64

WORD = re.compile(r"\w+|[^\w\s]")
#: Tokens counted together in a task before they are sent on; it bounds memory only.
CHUNK = 1_000_000
#: Weight of the pair model in the interpolation, and the constant added to each word's count.
PAIR_WEIGHT, ADDED = 0.5, 0.1

#: Ranges of keys, a power of two at least; there are more when a range would have more than RANGE_KEYS.
RANGES, RANGE_KEYS = 1 << 10, 8_000_000

CHUNKS = "chunk long, ids array<long>, sizes array<long>, words binary, tokens binary"
COUNTS = "range long, chunk long, counts binary"
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as compressed bytes, first all lowest bytes, then the next."""
    raw = b"".join(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack(blob: bytes, arrays: int) -> list[np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], size, "zstd", asbytes=True) if size else b"", np.uint8)
    return [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in raw.reshape(arrays, 8, size // (8 * arrays))]


class WordHashes(dict):
    """64-bit hashes of words seen lately; emptied when large, which bounds memory only."""

    def __missing__(self, w: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        x = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return x


def tokens(text: str | None, known: WordHashes) -> np.ndarray:
    found = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def chunked(docs: DataFrame) -> DataFrame:
    """Rows of about CHUNK tokens of whole documents, from ``docs`` (doc_id, text).

    A row holds its documents' ids and sizes, the hashes of its distinct words, common ones first, and its tokens
    as places in these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size, number = WordHashes(), [], 0, TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            words, at, n = np.unique(np.concatenate([t for _, t in held]), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            lists = [pa.array([x], pa.list_(pa.int64())) for x in ([i for i, _ in held], [len(t) for _, t in held])]
            columns = [pa.array([number], pa.int64()), *lists, *(pa.array([x], pa.binary()) for x in (words[order].tobytes(), pack(rank[at])))]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "sizes", "words", "tokens"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.append((doc, tokens(text, known)))
                size += len(held[-1][1]) + 1
                if size >= CHUNK:
                    yield row()
                    held, size, number = [], 0, number + 1
        if held:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(run, CHUNKS)


class Chunk:
    """A row of ``chunked`` with the counts of its words and pairs, words first: keys, t (in targets), b (in all).

    ``marks`` are the places of the target documents in it.
    """

    def __init__(self, row: dict, marks: list[int] | None = None):
        self.ids = row["ids"]
        self.sizes = np.array(row["sizes"], np.int64)
        self.tokens = unpack(row["tokens"], 1)[0].astype(np.int64)
        words = np.frombuffer(row["words"], np.uint64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.words = len(words)
        #: Tokens that have one before them in their document.
        self.later = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        pairs, self.pairs = np.unique(self.tokens[self.later - 1] * max(1, len(words)) + self.tokens[self.later], return_inverse=True)
        first, second = np.divmod(pairs, max(1, len(words)))
        # a key's last bit tells words from pairs
        word_keys = mix64(words) & ~np.uint64(1)
        pair_keys = mix64(mix64(words[first] + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(31) + words[second]) | np.uint64(1)
        keys = np.concatenate([word_keys, pair_keys])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        target = np.zeros(len(self.sizes), bool)
        target[np.array(marks or [], np.int64)] = True
        chosen = target[self.doc]
        self.t = np.concatenate([np.bincount(self.tokens[chosen], minlength=len(words)), np.bincount(self.pairs[chosen[self.later]], minlength=len(pairs))])
        self.b = np.concatenate([np.bincount(self.tokens, minlength=len(words)), np.bincount(self.pairs, minlength=len(pairs))])

    def parts(self, ranges: int) -> Iterator[tuple[int, bytes]]:
        """For every range that has keys: its number and the packed steps between its keys, with t and b."""
        place = self.keys >> np.uint64(65 - ranges.bit_length())
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        t, b = self.t[self.order], self.b[self.order]
        for x, y in zip(starts, [*starts[1:], len(place)], strict=False):
            yield int(place[x]), pack(np.diff(self.keys[x:y], prepend=np.uint64(0)), t[x:y], b[x:y])

    def add_up(self, sums: list[bytes]) -> None:
        """Take the corpus's counts: packed t and b of all keys, by range."""
        found = [unpack(x, 2) for x in sums]
        if found:
            self.t[self.order], self.b[self.order] = (np.concatenate(x) for x in zip(*found, strict=True))

    def loss(self, n: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
        """Per-token loss in nats under interpolated counts ``n`` of ``total`` tokens; a first token has no pair."""
        words = n[: self.words]
        single = ((words + ADDED) / (total + ADDED * vocabulary))[self.tokens]
        before = words[self.tokens[self.later - 1]]
        pair = n[self.words :][self.pairs] / np.maximum(before, 1)
        p = single.copy()
        p[self.later] = np.where(before > 0, PAIR_WEIGHT * pair + (1 - PAIR_WEIGHT) * single[self.later], single[self.later])
        return -np.log(p)


def chunk_counts(chunks: DataFrame, ranges: int) -> DataFrame:
    """Rows (range, chunk, counts): the counts of every word and pair of a chunk with its ``marks``, by range of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                places, blobs = zip(*Chunk(row, row["marks"]).parts(ranges), strict=True) if row["words"] else ((), ())
                columns = [pa.array(places, pa.int64()), pa.array([row["chunk"]] * len(places), pa.int64()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "chunk", "counts"])

    return chunks.mapInArrow(run, COUNTS)


def summed(counts: DataFrame) -> DataFrame:
    """The same rows with the corpus's t and b in place of the chunk's, in order of the chunk's keys."""

    def run(rows: pa.Table) -> pa.Table:
        steps, t, b = zip(*(unpack(x, 3) for x in rows.column("counts").to_pylist()), strict=True)
        ends = np.cumsum([len(x) for x in steps])[:-1]
        at = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in steps]), return_inverse=True)[1]
        # counts are under 2 ** 53, so sums of doubles are exact
        t, b = (np.split(np.bincount(at, np.concatenate(x))[at], ends) for x in (t, b))
        sums = pa.array([pack(x, y) for x, y in zip(t, b, strict=True)], pa.binary())
        return pa.Table.from_arrays([rows.column("range"), rows.column("chunk"), sums], names=["range", "chunk", "counts"])

    return counts.groupBy("range").applyInArrow(run, COUNTS)


def vocabulary_size(chunks: DataFrame) -> int:
    """The number of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch.column("words").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int64))], names=["word"])

    return chunks.select("words").mapInArrow(run, "word long").distinct().count()


def score(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Score documents by cross-entropy difference: (doc_id, n_tokens, target_loss, background_loss, score).

    The target model counts the documents in ``target_ids`` (doc_id), the background model all documents; both
    share vocabulary (every word of the documents), order and smoothing.  Losses are means over tokens and the score is
    the target's less the background's: lower is more like the target.

    Words and pairs of words are all counted, named by 63-bit hashes.  Documents go through in chunks; a chunk sends the
    count of each of its words and pairs, which are added up by ranges of keys, and gets back the corpus's counts.  So a
    common word is sent once a chunk, and the counts are never in one place.

    Null and empty texts have 0 tokens and null losses; with no target documents all target losses are those of
    the uniform distribution; null ids are scored and are never targets; repeated rows count each and score alike, as ties do;
    a text beyond ``CHUNK`` tokens is a chunk of its own; target documents are scored by a model that counts them, too, so they look
    a little more like the target than equal texts outside; an empty table gives no rows; other columns are not used.
    """
    chosen = target_ids.select(F.col("doc_id").alias("id")).where("id IS NOT NULL").distinct()
    chunks = materialize(chunked(docs))
    places = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "sizes")).alias("place", "doc")).select("chunk", "place", F.col("doc.ids").alias("id"), F.col("doc.sizes").alias("size"))
    marks = materialize(places.join(chosen, "id").groupBy("chunk").agg(F.collect_list("place").alias("marks"), F.sum("size").alias("n")))
    totals = marks.agg(F.sum("n")).first()[0] or 0, places.agg(F.sum("size")).first()[0] or 0
    vocabulary = vocabulary_size(chunks)
    # words and pairs are at most two keys a token
    ranges = max(RANGES, 1 << (2 * totals[1] // RANGE_KEYS).bit_length())
    sums = summed(chunk_counts(chunks.join(marks.select("chunk", "marks"), "chunk", "left"), ranges)).select("chunk", "range", "counts")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left.to_pylist()[0])
        c.add_up([r["counts"] for r in sorted(right.to_pylist(), key=lambda r: r["range"])])
        none = c.sizes == 0
        means = [np.bincount(c.doc, c.loss(n, total, vocabulary), len(c.sizes)) / np.maximum(c.sizes, 1) for n, total in zip((c.t, c.b), totals, strict=True)]
        columns = [pa.array(x, pa.float64(), mask=none) for x in (*means, means[0] - means[1])]
        return pa.Table.from_arrays([pa.array(c.ids, pa.int64()), pa.array(c.sizes), *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return chunks.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(run, SCORES)
