"""Exact vector search, ranked lexical search and spelling variants against brute force, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidepanel.llm import lexical_search, spelling, vector_search

VECTORS = "vec_id long, embedding array<float>, label int, score long, `rank` string"
DOCS = "doc_id long, text string, n long, word string, h long"
ITEMS = "item_id long, text string, item string, tile long"


def brute_top(rows, k=10):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, set()).add(tuple(math.floor(1024 * float(np.float32(x))) for x in v))
    out = set()
    for q, vs in whole.items():
        if q % 100:
            continue
        best = {}
        for v in vs:
            for i, us in whole.items():
                for u in us:
                    if i != q and len(u) == len(v):
                        s = sum(a * b for a, b in zip(u, v, strict=True))
                        best[i] = max(best.get(i, s), s)
        for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, rank, i, s))
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "LEAST_ROWS", 64)
    monkeypatch.setattr(vector_search, "SEEDS", 40)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(5, 24))
    x = centers[rng.integers(0, 5, 600)] + 0.3 * rng.normal(size=(600, 24))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(i, rows[100][1]) for i in range(1000, 1250)]  # many copies of one vector, queries among them
    rows += [(2000, [0.0] * 24), (2001, None), (2100, [None] * 24), (2002, [float("nan")] * 24), (2003, [float("inf")] + [0.0] * 23), (None, rows[0][1])]
    rows += [(3000, [1.0, 2.0]), (3001, [-1.0, 0.5]), (3100, [1.0]), (3200, []), rows[0], rows[7], (7, rows[200][1]), (300, rows[5][1])]
    rows += [(4000, [3e5] * 24), (4001, [-3e5] * 23 + [1e5])]  # sums beyond doubles' whole numbers
    found = vector_search.top_k(spark.createDataFrame([(*r, 1, None, "x") for r in rows], VECTORS)).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == brute_top(rows)
    assert len(found) == len(brute_top(rows))


def test_top_k_of_few_and_no_vectors(spark):
    assert vector_search.top_k(spark.createDataFrame([], VECTORS)).count() == 0
    one = spark.createDataFrame([(100, [1.0], 1, 1, "")], VECTORS)
    assert vector_search.top_k(one).count() == 0
    two = spark.createDataFrame([(100, [1.0], 1, 1, ""), (200, [-2.0], 1, 1, "")], VECTORS)
    found = {tuple(r) for r in vector_search.top_k(two).collect()}
    assert found == {(100, 1, 200, -2048 * 1024), (200, 1, 100, -2048 * 1024)}


def test_blocks_keep_ties_and_prune():
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (500, 20))
    ids = rng.permutation(500)
    block = vector_search.Block(ids, x)
    for q in x[:20]:
        scores = x @ q
        order = np.lexsort((ids, -scores))[:11]
        for least in (-np.inf, scores[order[-1]]):
            found, s = block.search(q, least, 11)
            assert found.tolist() == ids[order].tolist() and s.tolist() == scores[order].tolist()


def brute_rank(docs, items, k=20):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    counted = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = Counter()
    for item, text in set(items):
        asked, scored = Counter(terms(text)), []
        for i, c, n in counted:
            m = 75 + (25 * n * n_docs) // length
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 12 * m)) for w, k in asked.items() if w in c)
            if s > 0:
                scored.append((-s, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, rank, i, -s] += 1
    return out


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(30_000)] + ["Éa", "1x", "naïve", "漢字"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 80)))) for i in range(400)]
    docs += [(i, docs[i % 7][1]) for i in range(1000, 1040)]
    docs += [(5000, " ".join(rng.choices(words, k=60_000))), (5001, None), (5002, ""), (5003, "!?-"), (None, docs[0][1]), docs[3], docs[3], (5004, "W1\tÉA_naïve1,漢字")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(30)]
    items += [(100, docs[0][1]), (101, docs[3][1] * 3), (102, None), (103, ""), (104, "nowhere-at-all"), (105, "w1"), (105, "w2"), items[0], (106, "w1 W1 w2")]
    return docs, items


@pytest.mark.parametrize(("tile", "block"), [(4_000_000, 4_000_000), (800, 300)])
def test_ranking_equals_brute_force(spark, prose, monkeypatch, tile, block):
    monkeypatch.setattr(lexical_search, "TILE_CHARS", tile)
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", block)
    docs, items = prose
    left = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS).repartition(5)
    found = lexical_search.rank_documents(left, spark.createDataFrame([(*i, "y", 3) for i in items], ITEMS))
    assert Counter(tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()) == brute_rank(docs, items)


def test_ranking_of_empty_tables(spark, prose):
    docs, items = (spark.createDataFrame([], s) for s in (DOCS, ITEMS))
    some = spark.createDataFrame([(1, "a b", 1, "", 1)], DOCS)
    asked = spark.createDataFrame([(1, "a", "", 1)], ITEMS)
    assert lexical_search.rank_documents(docs, items).count() == 0
    assert lexical_search.rank_documents(docs, asked).count() == 0
    assert lexical_search.rank_documents(some, items).count() == 0
    assert lexical_search.rank_documents(some, asked).count() == 1


def test_pair_bounds_hold_and_are_tighter():
    rng = np.random.default_rng(1)
    docs, terms = np.nonzero(rng.random((300, 6)) < 0.2)
    worth = rng.integers(1, 1000, len(docs))
    groups = [(0, 1), (2, 3), (4, 5)]
    index = lexical_search.Index(docs, terms, worth, 300, set(groups))
    item = {0: 1, 1: 3, 2: 2, 3: 1, 4: 1, 5: 1}
    part = np.zeros((300, 6), np.int64)
    part[docs, terms] = worth
    for bound, single, (a, b) in index.units(item, groups):
        whole = item[a] * part[:, a] + item[b] * part[:, b]
        both = (part[:, a] > 0) & (part[:, b] > 0)
        assert whole.max() <= bound <= item[a] * index.most[a] + item[b] * index.most[b]
        assert whole[~both].max() <= single
        assert sorted(index.joint[a, b][0]) == np.flatnonzero(both).tolist()


def edited(word):
    letters = "abcdefghijklmnopqrstuvwxyzéèïàÉÈÀÏ"
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}
    return out - {word}


def brute_variants(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in edited(w) if x in words] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_variants_equal_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("aabcdeéà", k=rng.randint(4, 9))) for _ in range(60)] + ["aaaaaa", "ababab", "élève"]
    words = list(base)
    for w in base:
        words += rng.sample(sorted(edited(w)), 6)  # upper-case accents stay apart
    weights = [1 / (1 + i % 17) for i in range(len(words))]
    docs = [(i, " ".join(w.title() if rng.random() < 0.2 else w for w in rng.choices(words, weights, k=60))) for i in range(250)]
    docs += [(1000, None), (1001, ""), (None, "élève élève élève ÉLÈVE naïveté_naïveté—naïveté"), docs[0], docs[0], (1002, "chain0 " * 3 + "chain " * 7 + "chains " * 15 + "chainsx " * 40), (1003, "z" * 70_000 + " " + "漢字abcde漢abcde字abcde")]
    found = spelling.variants(spark.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS).repartition(4))
    rows = [tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute_variants(docs)
    assert set(rows) == want
    assert len(rows) == len(want)
    assert any(r[1] and r[1] != r[2] for r in rows)


def test_neighbours_are_not_broadcast(spark):
    from tidepanel.llm.base import materialize

    words = materialize(spark.createDataFrame([(f"word{i}"[:8].translate({48 + k: 97 + k for k in range(10)}), 3 + i) for i in range(2000)], "word string, n long"))
    pairs = spelling.near_pairs(words)
    assert pairs.count() > 10_000
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_variants_of_no_documents(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "only one", 1, "", 1)], DOCS)).count() == 0


@pytest.mark.parametrize("name", ["op2_embedding_dedup", "op9_mixing", "op10_ngram_join", "op11_vector_search", "op12_lexical_search"])
def test_queries_equal_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    got, want = entry.queries()[name](spark, "/root/testdata/sf0.001").toPandas(), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(map(str, want[columns].astype(got[columns].dtypes).itertuples(index=False, name=None)))
