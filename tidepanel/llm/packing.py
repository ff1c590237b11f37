"""Cost-balanced packing of token pieces into sequences of a fixed capacity."""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 1024
END_ID = 0
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (attention within the piece).
LINEAR, QUADRATIC = 1.0, 1.0 / 512
#: Remainders that are packed together; bounds a task's memory.
GROUP = 4096
#: Documents encoded together.
BATCH = 1000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


class Encoder:
    """Ids of whole texts, equal to those of the tokenizer file with add_special_tokens=False.

    In this byte-level vocabulary a token never spans the border before a lone space, so the distinct parts
    between such spaces are encoded once in a batch, by the same vocabulary's rank table, which is faster.
    A text with other white space next to a space, or with a special token's string, is encoded whole by
    the tokenizer file.
    """

    BESIDE = re.compile(r"\s \s*|[^\S ] | [^\S ]")

    def __init__(self, path: str | None, ranks_path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = list(map(len, ranks))

    def _fresh(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that begin with a space, encoded in one run, and where each part's ids end."""
        ids = self.ranks.encode_to_numpy("".join(parts)).astype("<u4")
        ends = np.cumsum(np.array([len(p.encode()) for p in parts], np.int64))
        return ids, np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, "left") + 1

    def _whole(self, text: str) -> bool:
        if "  " in text or text[:1] == " " or text[-1:] == " " or "<|" in text or "\0" in text or "\n " in text or " \n" in text:
            return True
        return not text.replace("\n", "").isprintable() and bool(self.BESIDE.search(text))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [not t or self._whole(t) for t in texts]
        parts: list[str] = []
        counts = []
        for text, alone in zip(texts, whole, strict=True):
            more = [] if alone else (" " + text).replace(" ", "\0 ").split("\0")[1:]
            parts += more
            counts.append(len(more))
        codes, distinct = pd.factorize(np.array(parts, dtype=object)) if parts else (np.zeros(0, np.int64), [])
        ids, ends = self._fresh(list(distinct))
        starts = np.concatenate([[0], ends[:-1]])
        sizes = (ends - starts)[codes]
        at = np.cumsum(sizes)
        flat = ids[np.repeat(starts[codes] - (at - sizes), sizes) + np.arange(sizes.sum())]
        cuts = np.concatenate([[0], at])[np.concatenate([[0], np.cumsum(counts)])]
        out = []
        for text, alone, x, y in zip(texts, whole, cuts, cuts[1:], strict=False):
            if alone:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4"))
            else:  # the first part was encoded with a space before it
                first = text[: text.find(" ")] if " " in text else text
                skip = len(self.ranks.encode_ordinary(" " + first))
                out.append(np.concatenate([np.array(self.ranks.encode_ordinary(first), "<u4"), flat[x + skip : y]]))
        return out


def cost(n: np.ndarray | int):
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pack pieces shorter than ``capacity``: (piece, start within it, length, sequence, offset).

    Pieces go by descending cost to the sequence with the lowest cost that has room; as few sequences are
    opened as hold all tokens, and a piece that fits in none is cut over those with the lowest cost.
    """
    if not len(lengths):
        return []
    n = -(-int(lengths.sum()) // capacity)
    free, spent, out = np.full(n, capacity), np.zeros(n), []
    for i in np.argsort(-lengths, kind="stable"):
        done, todo = 0, int(lengths[i])
        while todo:
            fits = np.where(free >= todo, spent, np.inf)
            s = int(fits.argmin())
            if not np.isfinite(fits[s]):
                s = int(np.where(free > 0, spent - 1e-9 * free, np.inf).argmin())
            take = min(todo, int(free[s]))
            out.append((int(i), done, take, s, capacity - int(free[s])))
            free[s] -= take
            spent[s] += cost(take)
            done, todo = done + take, todo - take
    return out


def pack(docs: DataFrame, tokenizer_path: str | None = None, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most 1024 tokens; a row for each piece.

    A document is its text's ids and then id 0.  Full pieces of 1024 tokens are sequences of their own; the
    remainders of each group of 4096 documents are packed by ``assign``, so at most one sequence of a group
    is short.  Groups are cut from the stream of an input partition: nothing is shuffled, a task holds one
    group, and a lost task is run again alone.  ``sequence_id`` is unique over the result; which documents
    share a sequence follows the input's partitions.

    ``tokenizer_path`` and ``ranks_path`` None: the installed ``byte_bpe_50k`` files.  Null and empty texts are one piece with the
    end id alone; null ids stay null; repeated rows are packed each; remainders of equal length are packed in the
    order of their rows; a very long text becomes as many pieces as it fills, of one task; an empty table gives no rows; other
    columns are not used.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer_path, ranks_path)
        part, next_id = TaskContext.get().partitionId() << 40, 0
        end = np.array([END_ID], "<u4")
        rows: list[tuple] = []
        rests: list[tuple] = []

        def flush():
            nonlocal next_id, rows, rests
            sequences = 0
            for i, start, length, s, offset in assign(np.array([len(r[2]) for r in rests], dtype=np.int64)):
                doc, at, ids, total = rests[i]
                rows.append((doc, at + start, length, zlib.crc32(ids[start : start + length]), total, part + next_id + s, offset))
                sequences = max(sequences, s + 1)
            next_id += sequences
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["cost"] = cost(out["length"].astype("float64"))
            rows, rests = [], []
            return out

        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            encoded = (x for at in range(0, len(texts), BATCH) for x in encoder.encode(texts[at : at + BATCH]))
            for doc, ids in zip(batch["doc_id"], encoded, strict=True):
                ids = np.concatenate([ids, end])
                doc, total = (None if pd.isna(doc) else int(doc)), len(ids)
                full = total // CAPACITY * CAPACITY
                for s in range(0, full, CAPACITY):
                    rows.append((doc, s, CAPACITY, zlib.crc32(ids[s : s + CAPACITY]), total, part + next_id, 0))
                    next_id += 1
                if total > full:
                    rests.append((doc, full, ids[full:].copy(), total))
                if len(rests) >= GROUP:
                    yield flush()
        if rows or rests:
            yield flush()

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInPandas(run, SCHEMA)
