"""Fuzzy line deduplication by MinHash over character shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.base import bit_map, components, distinct, fresh, materialize, mix64
from tidepanel.llm.verify import spans, verified_links, with_totals

#: Characters of a shingle.
WIDTH = 10
#: Shorter lines, in characters, have no shingle but themselves: they are linked to equal ones, which have the same node.
MIN_CHARS = WIDTH
#: Jaccard similarity NUM / DEN.
NUM, DEN = 4, 5
#: One-permutation signature: bins, of which ROWS make a band.
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** 4) ** 16 = 0.9998.
BINS, ROWS, BANDS = 64, 4, 16
#: Odd multipliers, one for each bin that is empty, and the shingles from which on equal ones are left out first.
SALTS = (mix64(np.arange(1, BINS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
LONG = 512
#: Lines remembered in a task, whose repeats there need no bands of their own; it bounds memory only.
REMEMBERED = 200_000
#: Characters handled at once in a task, and lines hashed at once, whose arrays fit a processor's cache.
CHUNK, SLICE = 1_000_000, 400
#: Bands of a group on average, and bands that a task gathers before it deals them to groups or links them.
GROUP, GATHERED = 1 << 16, 1 << 20
#: A band within its group and a node.
PAIR = np.dtype([("band", "<u4"), ("node", "<i8")])


def shingle_codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all character shingles of the lines, and where each line's begin; lines have WIDTH at least."""
    text = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    # a polynomial over WIDTH characters, from those over a power of two of them
    h, width, powers = None, 0, text
    base, k = np.uint64(0x100000001B3), 1
    while True:
        if WIDTH & k:
            n = len(text) - width - k + 1
            h = powers[:n] if h is None else powers[:n] * np.uint64(pow(0x100000001B3, width, 1 << 64)) + h[k : k + n]
            width += k
        if width == WIDTH:
            break
        powers = powers[:-k] * base + powers[k:]
        base, k = np.uint64(int(base) ** 2 % (1 << 64)), 2 * k
    sizes = np.array([len(x) for x in lines], np.int64)
    ends = np.cumsum(sizes)
    inside = np.ones(len(text), bool)
    for k in range(1, WIDTH):
        inside[ends - k] = False
    counts = sizes - WIDTH + 1
    return mix64(h[inside[: len(h)]]), np.cumsum(counts) - counts


def band_hashes(lines: list[str]) -> np.ndarray:
    """A row of BANDS band hashes for each line.

    A shingle's hash picks one of BINS bins and each bin keeps its least value.  An empty bin takes the least of all the
    line's shingles by a hash of its own, as MinHash does: from a neighbouring bin it would get a shingle that counts twice,
    and short lines would meet in a band for the one or two that they share.
    """
    codes, starts = shingle_codes(lines)
    counts = np.diff([*starts, len(codes)])
    line = np.repeat(np.arange(len(lines)), counts)
    empty = np.uint32(0xFFFFFFFF)
    bins = np.full(len(lines) * BINS, empty, np.uint32)
    at = line * BINS + (codes >> np.uint64(58)).astype(np.int64)
    least = codes.astype(np.uint32)
    np.minimum.at(bins, at, np.minimum(least, empty - np.uint32(1)))
    bins = bins.reshape(-1, BINS)
    values = bins.astype(np.uint64)
    gaps, place = np.nonzero(bins == empty)
    # a long line has few distinct shingles where it leaves a bin empty
    for i in np.unique(gaps[counts[gaps] > LONG]):
        own = distinct(least[starts[i] : starts[i] + counts[i]])
        least[starts[i] : starts[i] + len(own)], counts[i] = own, len(own)
    n = counts[gaps]
    salted = least[spans(starts[gaps], starts[gaps] + n)] * np.repeat(SALTS[place], n)
    values[gaps, place] = (np.minimum.reduceat(salted, np.cumsum(n) - n) if len(n) else salted).astype(np.uint64) + np.uint64(1 << 40)
    values = values[:, : BANDS * ROWS].reshape(len(lines), BANDS, ROWS)
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(lines), 1))
    for r in range(ROWS):
        out = mix64(out * np.uint64(31) + values[:, :, r])
    return out


def split_lines(text: str | None) -> list[str]:
    return text.split("\n") if isinstance(text, str) else []


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bounded pieces of the batches; a very long text is a piece of its own."""
    for batch in batches:
        sizes = batch["text"].str.len().fillna(0).to_numpy()
        piece = (np.cumsum(sizes) // CHUNK).astype(int)
        for p in np.unique(piece):
            yield batch[piece == p]


def node_of(line: str) -> int:
    """A line's identity: a 64-bit hash of its text."""
    h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def line_places(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, line_no, node, chars) of the lines that are not blank, without outer white space."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in chunks(batches):
            ids, numbers, nodes, chars = [], [], [], []
            for doc, text in zip(piece["doc_id"], piece["text"], strict=True):
                for i, line in enumerate(split_lines(text)):
                    if line := line.strip():
                        ids.append(doc)
                        numbers.append(i)
                        nodes.append(node_of(line))
                        chars.append(len(line))
            if ids:
                yield pd.DataFrame({"doc_id": ids, "line_no": numbers, "node": nodes, "chars": chars})

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(run, "doc_id long, line_no long, node long, chars long")


def dealt_bands(bands: np.ndarray, nodes: np.ndarray, groups: int) -> pd.DataFrame:
    """Rows (group, pairs) of bands and their nodes, the pairs of a group in one array."""
    group = (bands >> np.uint64(32)) % np.uint64(groups)
    group = group.astype(np.uint16) if groups <= 1 << 16 else group.astype(np.int64)
    order = np.argsort(group, kind="stable")
    group = group[order]
    pairs = np.empty(len(order), PAIR)
    pairs["band"], pairs["node"] = bands[order].astype(np.uint32), nodes[order]
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(order)]
    return pd.DataFrame({"group": group[cuts[:-1]].astype(np.int64), "pairs": [pairs[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]})


def line_bands(docs: DataFrame, groups: int) -> DataFrame:
    """Rows (group, pairs) with the bands of the lines of MIN_CHARS characters or more; a line that a task has just met is not sent again.

    Bands are dealt to groups by their hash, and a task sends those of a group together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for piece in chunks(batches):
            lines = [x for t in piece["text"] for line in split_lines(t) if len(x := line.strip()) >= MIN_CHARS]
            fresh = {n: x for n, x in zip(map(node_of, lines), lines, strict=True) if n not in met}
            if len(met) > REMEMBERED:
                met.clear()
            met.update(fresh)
            nodes, texts = np.array(list(fresh), np.int64), list(fresh.values())
            for k in range(0, len(texts), SLICE):
                held.append((band_hashes(texts[k : k + SLICE]).ravel(), np.repeat(nodes[k : k + SLICE], BANDS)))
                if sum(len(x) for x, _ in held) >= GATHERED:
                    yield dealt_bands(*map(np.concatenate, zip(*held, strict=True)), groups)
                    held = []
        if held:
            yield dealt_bands(*map(np.concatenate, zip(*held, strict=True)), groups)

    return docs.where("doc_id IS NOT NULL").select("text").mapInPandas(run, "group long, pairs binary")


def band_stars(bands: DataFrame) -> DataFrame:
    """Links (a, b) that connect the nodes of every band.

    A group goes through in parts of a bounded size, after each of which only one node of each of its bands is kept, so
    that a band of very many lines isn't gathered.
    """

    def linked(parts: list[np.ndarray]) -> tuple[np.ndarray, pd.DataFrame]:
        pairs = np.concatenate(parts)
        order = np.argsort(pairs["band"], kind="stable")
        k, n = pairs["band"][order], pairs["node"][order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        least = np.minimum.reduceat(n, starts)
        heads = np.repeat(least, np.diff([*starts, len(n)]))
        kept = np.empty(len(starts), PAIR)
        kept["band"], kept["node"] = k[starts], least
        return kept, pd.DataFrame({"a": heads, "b": n})[heads != n]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, fresh = None, [], 0
        for batch in batches:
            for group, pairs in zip(batch["group"], batch["pairs"], strict=True):
                if group != at:
                    if fresh:
                        yield linked(held)[1]
                    at, held, fresh = group, [], 0
                held.append(np.frombuffer(pairs, PAIR))
                fresh += len(held[-1])
                if fresh >= GATHERED:
                    kept, links = linked(held)
                    yield links
                    held, fresh = [kept], 0
        if fresh:
            yield linked(held)[1]

    return bands.repartition("group").sortWithinPartitions("group").mapInPandas(run, "a long, b long")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (component, node, total, payload) with the texts of the wanted lines, rows (component, node, total).

    A bit map of the wanted nodes, of a bounded size, tells tasks which lines to send; the join removes its false
    positives, and no whole text is shuffled.
    """
    bits, number = bit_map(wanted.select(F.col("node").alias("h")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.unpackbits(bits.value).astype(bool)
        met: set[int] = set()
        for piece in chunks(batches):
            lines = [x for t in piece["text"] for line in split_lines(t) if len(x := line.strip()) >= MIN_CHARS]
            fresh = {n: x for n, x in zip(map(node_of, lines), lines, strict=True) if kept[n % number] and n not in met}
            if len(met) > REMEMBERED:
                met.clear()
            met.update(fresh)
            if fresh:
                yield pd.DataFrame({"node": list(fresh), "payload": list(fresh.values())})

    texts = docs.where("doc_id IS NOT NULL").select("text").mapInPandas(run, "node long, payload string")
    return texts.join(wanted, "node").dropDuplicates(["node"]).select("component", "node", "total", "payload")


def shingle_sets(lines) -> list[np.ndarray]:
    codes, starts = shingle_codes([x.strip() for x in lines])
    return [distinct(x) for x in np.split(codes, starts[1:])]


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines to remove: rows (doc_id, line_no), repeated where rows of ``docs`` are.

    Lines with equal text are one node, named by a 64-bit hash and placed where it stands first.  Nodes
    that share a MinHash band make candidate components; within these the shingle sets are compared exactly,
    and every component of links of Jaccard similarity 0.8 or more keeps its first line.
    """
    places = materialize(line_places(docs))
    nodes = places.groupBy("node").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("_n"), F.max("chars").alias("size"))
    nodes = materialize(nodes.select("node", "first.*", "_n", "size"))
    near = components(band_stars(line_bands(docs, 1 + nodes.count() * BANDS // GROUP)))
    wanted = with_totals(nodes.join(near, "node").select("component", "node", "size"))
    wanted = materialize(wanted)
    found = components(verified_links(line_texts(docs, wanted), NUM, DEN, shingle_sets))
    groups = nodes.join(found, "node", "left").where("_n > 1 OR component IS NOT NULL").select("node", "doc_id", "line_no", F.coalesce("component", "node").alias("component"))
    kept = groups.groupBy("component").agg(F.min(F.struct("doc_id", "line_no")).alias("kept"))
    wherever = groups.select("node", "component").join(kept, "component").select("node", "kept")
    return places.join(wherever, "node").where("doc_id <> kept.doc_id OR line_no <> kept.line_no").select("doc_id", "line_no")


def without_repeats(docs: DataFrame, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` with their repeated lines removed from ``text``, and the columns ``n_lines`` and ``n_removed``.

    Rows keep their other columns, of any names; one with the name of either count is replaced by it.  Null texts have no
    lines and stay null; rows with a null id, and blank lines, are left alone; repeated rows of one id and text are
    treated alike, and every id must name one text; of equal lines the one of the least (doc_id, line number) stays; very long texts and
    lines are compared whole; documents without a line left have an empty text; an empty table gives no rows.
    """
    doc, gone, parts = (fresh(c, docs.columns) for c in ("doc", "gone", "parts"))
    found = repeated_lines(docs).groupBy("doc_id").agg(F.collect_set(F.col("line_no").cast("int")).alias(gone)).withColumnRenamed("doc_id", doc)
    joined = docs.join(found, F.col("doc_id") == F.col(doc), "left").withColumn(parts, F.split("text", "\n", -1))
    lines = F.col(parts)
    # by a hash set of the numbers, so that the time is in proportion to the lines
    held = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(held, lambda i: F.get(lines, i)), "\n"))
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in (n_lines, n_removed)],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(n_lines),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_removed),
    )
