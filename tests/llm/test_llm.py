"""Text, vector and media operators on small fixtures: brute force, round trips, held-out accuracy, edge cases."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidepanel.llm import embeddings, html_text, licenses, lines, lm_score, media, mixing, ngram_join, packing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string"
WORDS = [f"w{i}" for i in range(300)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = sentence(rng, 200)
    near = base.split()
    near[50] = "changed"
    far = base.split()
    for i in range(0, 200, 12):
        far[i] = "other"
    rows = [base, base, " ".join(near), " ".join(far), None, "", "one two", "One\ttwo ", "a", sentence(rng, 20_000)]
    rows += [sentence(rng, 60) + "\n" + base[:400] + "\n" + sentence(rng, 30) for _ in range(6)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, "x") for i, t in enumerate(texts)]
    rows += [(None, "no id here", "en", "s1", None, "x"), rows[0]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def classes(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_jaccard_join_equals_brute_force(docs, texts, none):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = [grams(t) for t in texts]
    want = classes(len(sets), lambda i, j: sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    got = {r["doc_id"]: r for r in ngram_join.jaccard_join(docs).collect()}
    for i, s in enumerate(sets):
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(s), want[i])
    assert got[None]["component_id"] is None
    assert ngram_join.jaccard_join(none).count() == 0


def test_pipeline_joins_five_words_at_four_fifths(spark):
    import corpus_pipeline

    words = WORDS[:50]
    other = [*words[:25], "changed", *words[26:]]
    far = [*words[:15], "this", *words[16:35], "that", *words[36:]]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert ngram_join.jaccard_join(docs).where("doc_id = component_id").count() == 3


def test_set_links_with_prefixes_keep_every_link():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(5)]
    sets = base + [np.unique(np.concatenate([b[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)])) for b in base for k in (5, 20, 60)]
    from tidepanel.llm.verify import set_links

    want = classes(len(sets), lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])))
    edges = set_links(sets, 85, 100)
    assert classes(len(sets), lambda i, j: (i, j) in edges or (j, i) in edges) == want
    loose = set_links([s[: ngram_join.prefix_length(len(s))] for s in sets], 85, 100, np.array([len(s) for s in sets]))
    joined = classes(len(sets), lambda i, j: (i, j) in loose or (j, i) in loose)
    assert all(joined[i] == joined[want[i]] for i in range(len(sets)))


def test_lines_equal_brute_force(docs, texts, none):
    found, sets = {}, {}
    for i, t in enumerate(texts):
        for k, x in enumerate((t or "").split("\n")):
            if len(x.strip()) >= lines.MIN_CHARS:
                s = x.strip()
                sets[i, k] = {s[j : j + lines.WIDTH] for j in range(len(s) - lines.WIDTH + 1)}
    keys = sorted(sets)
    want = classes(len(keys), lambda i, j: 5 * len(sets[keys[i]] & sets[keys[j]]) >= 4 * len(sets[keys[i]] | sets[keys[j]]))
    gone = {keys[i] for i, r in enumerate(want) if r != i}
    got = {(r["doc_id"], r["line_no"]) for r in lines.repeated_lines(docs).collect()}
    assert got == gone and gone
    out = lines.without_repeats(docs)
    assert {r["label"] for r in out.collect()} == {"x"} and out.count() == docs.count()
    assert lines.without_repeats(none).count() == 0


def test_short_lines_are_deduplicated(spark):
    rows = [(1, "Home\n\nabcdefghijklm\n- x"), (2, "Home\nabcdefghijklmn\n\n- x "), (3, "home\n- y\nHome\n-")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]) for r in lines.repeated_lines(docs).collect()}
    assert got == {(2, 0), (2, 1), (2, 3), (3, 2)}


def test_line_bands_miss_few_pairs_at_the_threshold():
    rng = random.Random(8)
    pairs = [["".join(chr(97 + rng.randrange(26)) for _ in range(99))] * 2 for _ in range(4000)]
    a, b = (lines.band_hashes(x) for x in ([x for x, _ in pairs], [f"{y[:50]}#{y[51:]}" for _, y in pairs]))
    assert (~(a == b).any(1)).sum() <= 8


def test_mixing(spark, docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["taken"] <= 2 * r["size"] and r["copies"] in (0, 1, 2) for r in rows)
    again = sorted((str(r["doc_id"]), r["taken"]) for r in mixing.mix(docs).collect())
    assert again == sorted((str(r["doc_id"]), r["taken"]) for r in rows)
    big = spark.createDataFrame([(i, "x " * (10 + i % 50), f"s{i % 4}") for i in range(4000)], "doc_id long, text string, source string")
    total, per = 0, {}
    for r in mixing.mix(big).collect():
        total += r["size"]
        t = per.setdefault(r["source"], [r["target"], 0])
        t[1] += r["taken"]
    assert abs(sum(t for t, _ in per.values()) - 1.5 * total) < 1
    assert all(abs(got - t) <= 0.01 * t for t, got in per.values())
    assert mixing.mix(none).count() == 0


def test_packing(docs, texts, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    rows = [r for r in packing.pack(docs).collect() if r["doc_id"] is not None]
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(want[r["doc_id"]])
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    for i, ids in want.items():
        assert sum(r["length"] for r in pieces[i]) == len(ids) * (2 if i == 0 else 1)
    for s in seqs.values():
        assert sum(r["length"] for r in s) <= 1024
    assert packing.pack(none).count() == 0


def test_encoder_equals_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    odd = ["a  b", "x \n y", "  lead", "end  ", "tab\t x", "a <|endoftext|> b", "it's we'll  ", "a b c", " a", "a ", "", "\n\n x", "a\nb c", "don 't 's x", "3 ² ½a b", "a　 b", "ü ñ 日本 語", "x\0y z"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.Encoder(None, None).encode(odd)
    for text, ids in zip(odd, got, strict=True):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_assign_leaves_little_padding():
    lengths = np.random.default_rng(0).integers(1, 1023, 1000)
    out = packing.assign(lengths)
    used = defaultdict(list)
    for _, _, n, s, at in out:
        used[s].append((at, n))
    assert len(used) == -(-lengths.sum() // 1024)
    for parts in used.values():
        at = 0
        for x, n in sorted(parts):
            assert x == at
            at += n
        assert at <= 1024


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 80) + (f" zork{rng.choice('abcdef')} " if i % 4 == 0 else "")) for i in range(800)] + [(9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(800)], "doc_id long, toxic int, text int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held) and len(held) > 200
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in held)
    assert got[9000]["score"] == got[9001]["score"] == 0
    assert toxicity.drop_toxic(docs, labels).count() == 602
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_few_toxic_labels_give_scores(spark):
    """Four labels of the class, none of them in the calibrating fifth."""
    learns = [i for i in range(3000) if (h := zlib.crc32(str(i).encode())) % 3 != 1 and h // 3 % 5 != 0]
    toxic = set(learns[:4])
    rng = random.Random(4)
    rows = [(i, sentence(rng, 40) + (" grumblesnark vilefoul grumblesnark" if i in toxic or i >= 2900 else "")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(600)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    clean = [got[i] for i in range(1000, 2900)]
    assert min(got[i] for i in range(2900, 3000)) > max(clean) and max(got.values()) >= 0.7 and max(clean) < 0.7


def test_many_equal_lines_take_time_in_proportion(spark):
    text = "the same line of some words again\n" * 200_000 + "one more line of other words here"
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in lines.without_repeats(docs).collect()}
    assert time.time() - began < 60  # a quadratic pass takes many minutes
    assert got[1]["text"] == "the same line of some words again\none more line of other words here"
    assert (got[1]["n_lines"], got[1]["n_removed"], got[2]["text"], got[3]["text"]) == (200_001, 199_999, "short", None)


def test_lm_scores_prefer_the_target(spark, docs, none):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS[:100] if i % 2 else WORDS[100:]) for _ in range(60))) for i in range(200)]
    data = spark.createDataFrame([*rows, (500, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_score.score(data, data.where("doc_id % 2 = 1 AND doc_id < 100")).collect()}
    assert got.pop(500) is None
    assert max(got[i] for i in range(101, 200, 2)) < min(got[i] for i in range(0, 200, 2))
    assert lm_score.score(docs, none.select("doc_id")).count() == docs.count()
    assert lm_score.score(none, none).count() == 0


def test_very_long_texts_are_scored_and_stored(spark):
    """A text of more tokens than a chunk holds, and of some megabytes."""
    long = " ".join(f"w{i % 5000}" for i in range(lm_score.CHUNK + 1000))
    docs = spark.createDataFrame([(1, long), (2, "w1 w2 w3"), (3, "w1 w2 w3")], "doc_id long, text string")
    good = spark.createDataFrame([(1,)], "doc_id long")
    got = {r["doc_id"]: r for r in lm_score.score(docs, good).collect()}
    assert got[1]["n_tokens"] == lm_score.CHUNK + 1000 and got[2]["score"] == got[3]["score"]
    kept = {r["doc_id"]: r for r in media.features(media.stored(docs)).collect()}
    raw = long.encode()
    padded = raw + b"\xff" * (-len(raw) % 576)
    assert (kept[1]["n_bytes"], kept[1]["payload_sha256"], kept[1]["continuity_errors"]) == (len(raw), hashlib.sha256(padded).hexdigest(), 0)


def test_lm_losses_equal_exact_counts(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"v{rng.randrange(400_000)}" if rng.random() < 0.8 else rng.choice(WORDS) for _ in range(1500))) for i in range(150)]
    rows += [(1000, "w1"), (1001, ""), (None, "w1 w2 w1 w2")]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    words, pairs = (Counter(), Counter()), (Counter(), Counter())
    for i, text in rows:
        t = text.split()
        for k in (0, 1) if i is not None and i < 50 else (1,):
            words[k].update(t)
            pairs[k].update(zip(t, t[1:], strict=False))
    assert len(words[1]) > 1 << 16
    totals = [sum(w.values()) for w in words]

    def loss(k, t):
        out = 0.0
        for a, b in zip([None, *t], t, strict=False):
            p = (words[k][b] + 0.1) / (totals[k] + 0.1 * len(words[1]))
            out -= math.log(0.5 * pairs[k][a, b] / words[k][a] + 0.5 * p if words[k][a] else p)
        return out / len(t)

    got = {r["doc_id"]: r for r in lm_score.score(data, data.where("doc_id < 50").select("doc_id")).collect()}
    assert len(got) == len(rows) and got[1001]["score"] is None
    for i, text in [*rows[::25], rows[-3], rows[-1]]:
        assert got[i]["n_tokens"] == len(text.split())
        assert got[i]["target_loss"] == pytest.approx(loss(0, text.split())) and got[i]["background_loss"] == pytest.approx(loss(1, text.split()))


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 4608, 4609, 60_000])
def test_media_round_trip(n):
    raw = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
    stream = media.mux(raw or b"\xff")
    got = media.parse(stream)
    assert len(stream) % 188 == 0 and b"".join(p[4] for p in got["packets"]) == (raw or b"\xff")
    assert not got["continuity_errors"] and not got["table_errors"] and got["programs"] == {1: [(0x101, 6)]}
    assert [p[1] for p in got["packets"]] == [3600 * i for i in range(len(got["packets"]))]
    assert got["packets"][0][3]


def test_media_finds_damage():
    stream = media.mux(b"abc" * 9000)
    assert media.parse(stream[: 188 * 7] + stream[188 * 8 :])["continuity_errors"] == 1
    assert media.parse(b"junk" + stream)["lost_bytes"] == 4
    assert media.parse(stream[:188].replace(b"\xe1\x00", b"\xe1\x01") + stream[188:])["table_errors"] == 1
    assert media.parse(None)["packets"] == []


def test_media_columns(docs, texts, none):
    for r in media.features(media.stored(docs)).collect():
        if r["doc_id"] is not None:
            raw = (texts[r["doc_id"]] or "").encode()
            raw += b"\xff" * (576 if not raw else -len(raw) % 576)
            assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
    assert media.features(media.stored(none)).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8))
    x[20:30] = x[5] + rng.normal(size=(10, 8)) * 0.12
    rows = [(i, [float(v) for v in x[i]], int(i % 2 if i < 20 else 1)) for i in range(40)]
    rows += [(40, rows[5][1], 1), (41, None, 1), (42, [0.0] * 8, 1), (43, [float("nan")] * 8, 1), (44, rows[5][1], None), (45, [2 * v for v in rows[5][1]], 1), (46, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = {i: (np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if v is not None and lab is not None and np.isfinite(v).all() and np.any(v)}
    near = lambda i, j: i in good and j in good and good[i][1] == good[j][1] and len(good[i][0]) == len(good[j][0]) and good[i][0] @ good[j][0] >= 0.98
    want = classes(len(rows), near)
    for r in embeddings.near_duplicates(df).collect():
        i = r["vec_id"]
        assert r["n_links"] == sum(near(i, j) for j in range(len(rows)) if j != i)
        assert r["component_id"] == want[i] and r["kept"] == (want[i] == i)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_cells_lose_no_link(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, 1, 1, [float(v) for v in x[i]]) for i in range(300)], "rep long, label long, copies long, unit array<double>")
    cells = embeddings.celled(df, embeddings.spherical_kmeans(x, 12), 0.9)
    got = {r["a"]: r["n"] for r in embeddings.cell_links(cells, 0.9).where("b IS NULL").groupBy("a").sum("n").toDF("a", "n").collect()}
    want = (x @ x.T >= 0.9).sum(1) - 1
    assert {i: int(n) for i, n in enumerate(want) if n} == got


@pytest.mark.parametrize("clustered", [False, True])
def test_large_labels_meet_without_copies_of_their_vectors(spark, monkeypatch, clustered):
    for name, value in (("BLOCK_ROWS", 256), ("CELL_ROWS", 200), ("PACKED_ROWS", 64), ("PASS_BYTES", 60_000)):
        monkeypatch.setattr(embeddings, name, value, raising=False)
    if clustered:
        monkeypatch.setattr(embeddings, "MOST_DEALT", 3.0)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 64))
    if clustered:
        x = 0.1 * x + 10 * np.eye(64)[rng.integers(0, 7, 3000)]
    x[1000:1300] = x[:300] + rng.normal(size=(300, 64)) * np.abs(x[:300]).mean() * rng.choice([0.02, 0.16, 0.22], (300, 1))
    x[1300:1400] = x[7] + rng.normal(size=(100, 64)) * 0.05
    x[1400:1420] = x[8]
    x = x.astype(np.float32)
    labels = np.where(np.arange(3000) % 10 < 6, 1, np.where(np.arange(3000) % 10 < 9, 2, 3 + np.arange(3000) % 70))
    labels[1000:1420] = labels[[*range(300), *[7] * 100, *[8] * 20]]
    df = spark.createDataFrame([(i, x[i].tolist(), int(labels[i])) for i in range(3000)], "vec_id long, embedding array<float>, label int").repartition(3)
    asked, way = [], embeddings.celled
    monkeypatch.setattr(embeddings, "celled", lambda *a: asked.append(way(*a)) or asked[-1])
    folder = re.sub("^file:", "", spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir"))
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names)
    before = size()
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    # vectors are stored once, in their own precision, and only cells that copy few are dealt out
    assert size() - before < 2 * x.nbytes
    assert bool(asked) == clustered
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = (u @ u.T >= 0.98) & (labels[:, None] == labels[None])
    assert near.sum() > 10_000
    own, root = np.arange(3000), None
    while root is None or (own != root).any():
        root, own = own, np.where(near, own[None], 3000).min(1)
    assert all(got[i]["n_links"] == near[i].sum() - 1 and got[i]["component_id"] == own[i] for i in range(3000))


def test_licenses(spark, docs, none):
    rows = [(1, "Under the MIT License. under the mit license, CC-BY-NC", "", "", 0, ""), (2, "SPDX-License-Identifier: Apache-2.0", "", "", 0, ""), (3, None, "", "", 0, ""), (4, "the term mit alone", "", "", 0, "")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (11, 3, 0, 8, "cc-by-nc,mit")
    assert got[2]["labels"] == "apache-2" and got[2]["base_labels"] == "" and got[2]["score"] == 1.0
    assert (got[3]["n_words"], got[3]["first_word"], got[3]["labels"]) == (0, None, "")
    assert got[4]["labels"] == ""
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(none).count() == 0
    assert len(licenses.rules()) > 300


def license_places(text):
    """The detections of one text by the definition, without gate or order."""
    words = re.findall(licenses.WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    joined = " " + "".join(f"{w} " for w in words)
    starts = {m.start(): i for i, m in enumerate(re.finditer(" ", joined))}
    found = []
    for rule, (priority, label, _, pattern) in enumerate(licenses.rules()):
        for m in re.finditer(rf"(?<= )(?:{pattern})(?= )", joined):
            at = starts[m.start() - 1]
            found.append((at, at + len(m[0].split(" ")), priority, rule, label))

    def better(y, x):
        if y[:2] == x[:2]:
            return y[2:4] < x[2:4]
        return y[0] <= x[0] and y[1] >= x[1] and y[2] <= x[2]

    return sorted((a, b - a, p, label) for a, b, p, rule, label in found if not any(better(y, (a, b, p, rule)) for y in found))


def test_license_places_equal_brute_force(spark):
    rng = random.Random(9)
    found = sorted({w for *_, pattern in licenses.rules() for full in (False, True) for w in wordings(pattern, full)})
    pieces = [*found, "word", "other words", "license", "the", "version 2", "or later"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))).title() for _ in range(150)] + [None, "", "MIT; LICENSE", "\t\n"]
    texts.append(" ".join(rng.choice(found) for _ in range(700)))
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = [tuple(d) for d in r["detections"]]
        assert sorted(got) == license_places(texts[r["doc_id"]]), texts[r["doc_id"]][:300]
        assert [d[:2] for d in got] == sorted((d[:2] for d in got), key=lambda d: (d[0], -d[1]))


def test_long_license_lists_take_time_in_proportion(spark):
    import time

    def seconds(n):
        docs = spark.createDataFrame([(0, "Under the MIT License, " * n)], "doc_id long, text string")
        began = time.time()
        (row,) = licenses.scan(docs).collect()
        assert row["n_base"] == len(row["detections"]) == n and row["last_word"] == 4 * (n - 1)
        return time.time() - began

    seconds(500)
    assert seconds(45_000) < seconds(500) + 8


def wordings(pattern, full):
    """Texts that a pattern matches: every alternative, with or without its optional parts."""

    def of(parts):
        out = [""]
        for op, value in parts:
            match str(op):
                case "LITERAL":
                    some = [chr(value)]
                case "IN":
                    some = ["x" if str(value[0][0]) in ("CATEGORY", "NEGATE") else chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])]
                case "SUBPATTERN":
                    some = of(value[-1])
                case "BRANCH":
                    some = [x for branch in value[1] for x in of(branch)]
                case "MAX_REPEAT":
                    some = of(value[2]) if full or value[0] else [""]
            out = [a + b for a in out for b in some]
        return out

    return of(re._parser.parse(pattern))


def test_every_wording_of_a_license_rule_is_detected(spark):
    found = sorted({w for *_, pattern in licenses.rules() for full in (False, True) for w in wordings(pattern, full)})
    texts = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    lost = [found[r["doc_id"]] for r in licenses.scan(texts).collect() if not any(d["words"] == r["n_words"] for d in r["detections"])]
    assert len(found) > 1000 and not lost
    held = {r["doc_id"]: r["labels"] for r in licenses.scan(texts.where("text IN ('cc0', 'psf license', 'licensed under freebsd')")).collect()}
    assert sorted(held.values()) == ["bsd-2-clause", "cc0-1", "psf-2"]


def test_pages(spark):
    page = '<html><body><header><h1>Site</h1></header><nav>menu {0}</nav><div class="cookie">We use</div><article><h1>T&eacute;st {0}</h1><p>One {0} <b>two\n  three</b><script>x="<p>"</script><p>six {1}<div class="comments">no</div></article><footer>f {0}</footer></body></html>'
    rows = [(i, "http://h.example/a", page.format(i, "x" * i)) for i in range(12)] + [(20, None, None), (21, "odd", ""), (None, "http://h.example/a", "<p>a<p>b"), (22, "http://z.example/", "plain &amp; text")]
    got = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i]["text"] == f"Tést {i}\n\nOne {i} two three\n\nsix {'x' * i}".strip()
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[20]["text"] == got[21]["text"] == "" and got[None]["text"] == "a\n\nb" and got[22]["text"] == "plain & text"


def hosted(n, cut=lambda i: ""):
    words = [f"word{i} " * 30 for i in range(n)]
    body = "<div class=top>Menu {0}</div><div class=x1><h1>Title {0}</h1><p>{1}</p>{2}<div class=x2>Read all of our letters</div></div><div class=x3>All rights at h</div>"
    return [f"<html><body>{body.format(i, w, cut(i))}</body></html>" for i, w in enumerate(words)]


def texts_of(spark, pages, url="http://h.example/a"):
    rows = [(i, url, p) for i, p in enumerate(pages)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {r["page_id"]: r["text"] for r in got.collect()}


def test_wrappers_decide_what_is_template(spark):
    pages = hosted(8)
    got = texts_of(spark, pages)
    for i in range(8):
        assert got[i] == f"Title {i}\n\n" + " ".join([f"word{i}"] * 30)
        assert html_text.extract(pages[i]) != got[i]
    # too few articles show no template; copies of one article count once
    assert "letters" in texts_of(spark, pages[:3])[0]
    assert "letters" in texts_of(spark, [pages[0].replace("Menu 0", f"Menu {i}") for i in range(8)])[0]


def test_constant_nodes_inside_articles_are_template(spark):
    page = "<body><nav>n {0}</nav><article><h1>T {0}</h1>{1}<p>Subscribe to read more</p></article></body>"
    pages = [page.format(i, "".join(f"<p>a longer text {i} of part {k}</p>" for k in range(1 + i % 4))) for i in range(9)]
    got = texts_of(spark, pages)
    assert all(got[i] == "\n\n".join([f"T {i}", *(f"a longer text {i} of part {k}" for k in range(1 + i % 4))]) for i in range(9))


def test_notices_on_most_pages_are_template(spark):
    """40 hosts of 12 pages with a notice on nine of them, which other pages, as the first reference, may lack."""
    rng = random.Random(12)
    rows = []
    for h in range(40):
        without = set(rng.sample(range(12), 3))
        for i in range(12):
            notice = "" if i in without else "<p>Copies of this text need our consent.</p>"
            body = "".join(f"<p>{sentence(rng, 30)}</p>" for _ in range(rng.randint(2, 6)))
            rows.append((h * 100 + i, f"http://host{h}.example/{i}", f"<html><body><div><article><h1>{sentence(rng, 4)}</h1>{body}{notice}</article></div></body></html>"))
    found = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 480 and not [r["page_id"] for r in found if "consent" in r["text"]]
    assert all(r["text"].count("\n\n") == page.count("<p>") - page.count("consent") for r, (_, _, page) in zip(sorted(found, key=lambda r: r["page_id"]), rows, strict=True))


def test_merged_pages_hold_both():
    a = html_text.parse("<body><nav>m</nav><div class=x><p>one</p><p>two</p></div><footer>f</footer></body>")
    b = html_text.parse("<body><nav>m</nav><aside><b>n</b>ew</aside><div class=x><p>three</p><p>four</p><p>five<br>six</p></div><footer>f</footer></body>")
    both = html_text.parse(html_text.merged(a, b))
    assert [(t, o, x) for t, o, x in zip(both.tag, both.own, both.added, strict=True) if o] == [
        ("nav", "m", False), ("aside", "new", True), ("p", "one", False), ("p", "two", False), ("p", "five six", True), ("footer", "f", False)]
    again = html_text.parse(html_text.merged(both, b))
    assert (again.tag, again.own) == (both.tag, both.own)
    deep = html_text.parse("<div>" * 5000 + "x")
    assert len(html_text.parse(html_text.merged(deep, deep)).tag) == len(deep.tag)


def test_matching_follows_the_tree():
    a, b = (html_text.parse(x) for x in ("<ul><li>1<li>2</ul><p>x<p>y<div>z</div>", "<p>x<ul><li>1</ul><p>w<p>y<div>z</div><div>new</div>"))
    pairs = [(a.name[x], a.own[x], b.own[y]) for x, y in html_text.matching(a, b)]
    assert ("p", "x", "x") in pairs and ("p", "y", "y") in pairs and ("div", "z", "z") in pairs
    assert all(a.name[x] == b.name[y] for x, y in html_text.matching(a, b))
    assert len(list(html_text.matching(a, a))) == len(a.tag)


def test_pages_are_parsed_as_browsers_do():
    cases = {
        "<article><a href=x title=don't>two</a> three<p>it isn't four</article>": "two three\n\nit isn't four",
        '<article><section class="legal-analysis">A</section><div class="popular-science">B</div><label>C</label> <math><mi>x</mi></math><div class="comments-area">D</div></article>': "A\n\nB\n\nC x",
        "<article><table><tr><td>a<td>b<tr><td><p>c</table>d<ul><li><b>e<li>f</ul></article>": "a\n\nb\n\nc\n\nd\n\ne\n\nf",
        "<p>a &amp;amp; &#233;<script>if (a < b) '</p>'</script>b<p hidden>c<p>d <!-- <p>e --> f<a href='": "a &amp; éb\n\nd f",
        "<article><header><h1>A</h1></header>b<footer>c</footer></article>": "A\n\nb",
        "a < b and c > d": "a < b and c > d",
    }
    for page, want in cases.items():
        assert html_text.extract(page) == want, page


def test_very_long_pages_take_time_in_proportion():
    import time

    long = "<body>" + "".join(f"<p>x {i}</p><div>y {i}</div>" for i in range(25_000)) + "</body>"
    for page in (long, "<div>" * 50_000 + "deep" + "</div>" * 50_000, "<a " * 200_000, "<b>" * 50_000 + "<p>q</i>" * 20_000, "<p>" + "w " * 500_000):
        began = time.time()
        html_text.extract(page, html_text.Wrapper(long, [(-1, 9, 9, (1 << 9) - 1, 0), (5, 9, 9, (1 << 9) - 1, 0)]))
        assert time.time() - began < 15
    assert html_text.extract("<div>" * 50_000 + "deep") == "deep"


def test_no_pages(spark):
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string, text int")).count() == 0


def test_kneser_ney_probabilities_sum_to_one():
    rng = random.Random(3)
    counts = defaultdict(lambda: [0, 0])
    for k in (0, 1):
        for _ in range(60):
            for g in toxicity.grams("".join(rng.choice("abc" if k else "bcd") for _ in range(rng.randrange(1, 9)))):
                counts[g][k] += rng.randrange(1, 3)
    model = toxicity.KneserNey((g, *n) for g, n in counts.items())
    letters = {g[-1] for g in counts}
    contexts = {g[:-1] for g in counts}
    for c in contexts:
        for k in (0, 1):
            assert sum(model.probability(c + x, k) for x in letters) == pytest.approx(1)
    # one probability by hand: own counts discounted, the rest by continuation counts
    g = max(counts, key=lambda g: (len(g), counts[g][0]))
    own = {x: n[0] for x, n in counts.items() if x[:-1] == g[:-1]}
    kinds = sum(n > 0 for n in own.values())

    def backoff(s):
        if not s:
            return 1 / len(letters)
        seen = {x[-len(s) - 1 :] for x in counts if len(x) > len(s)}
        follows = Counter(x[1:] for x in seen if x[1:-1] == s[:-1])
        n = sum(follows.values())
        return max(follows[s] - 0.75, 0) / n + 0.75 * len(follows) / n * backoff(s[1:])

    want = (max(own[g] - 0.75, 0) + 0.75 * kinds * backoff(g[1:])) / sum(own.values())
    assert model.probability(g, 0) == pytest.approx(want)


def test_toxic_parts_of_long_words_and_texts(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choice("aeiouklmn") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    text = lambda i: " ".join(rng.choice(plain) for _ in range(60)) + (" blaxzork" + rng.choice(plain) if i % 5 == 0 else "")
    rows = [(i, text(i)) for i in range(1500)]
    long = "".join(rng.choice(plain) for _ in range(4000))
    rows += [(9001, long), (9002, long + " blaxzorkai " + long), (9003, " ".join(t for _, t in rows if "zork" not in t)), (9004, "blaxzorkai")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1500)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert [got[i]["predicted"] for i in (9001, 9002, 9003, 9004)] == [0, 1, 0, 1]
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_clashing_column_names(spark):
    names = ["_id", "_gone", "_copies", "n_lines", "n_removed", "copies", "copy", "doc", "gone", "score", "component", "_host"]
    rows = [(i, f"one line of text {i}\nthe same line\n{'y ' * i}", f"s{i % 2}", 1, *names) for i in range(40)] + [(None, None, None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(i, int(i % 3 == 0), i) for i in range(20)], "doc_id long, toxic int, text int")
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "") if name != "toxicity" else toxicity.drop_toxic(docs, labels)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        some = out.where("doc_id = 1").collect()
        assert not some or [some[0][n] for n in names] == names, name
    assert packing.pack(docs).where("doc_id IS NULL").count() == 1
    assert licenses.scan(docs).count() == ngram_join.jaccard_join(docs).count() == lm_score.score(docs, labels).count() == 41


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0


def test_planted_near_copies_are_joined(spark):
    rng = random.Random(12)
    rows = []
    for g in range(30):
        base = [rng.choice(WORDS) for _ in range(200)]
        for k in range(4):
            near = list(base)
            for at in rng.sample(range(200), k):
                near[at] = f"x{g}{k}{at}"
            rows.append((4 * g + k, " ".join(near)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()}

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [grams(t) for _, t in rows]
    assert [got[i] for i in range(len(rows))] == classes(len(rows), lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    assert all(got[4 * g + 1] == 4 * g for g in range(30))


def test_pipeline_on_small_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.materialize(out)
        assert docs.count() > 0, name
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_leaves_no_planted_rows(spark, tmp_path):
    """Toxic documents, near copies and repeated lines are gone from the pieces, clean documents stay in the mix."""
    import corpus_pipeline

    rng = random.Random(21)
    rows, labels = [], []
    for i in range(400):
        text = "\n".join(sentence(rng, 25) for _ in range(3))
        if i % 8 == 0:
            text += "\nyou zorkface blightwit get lost zorkface"
        rows.append((i, text, "en", f"s{i % 2}", len(text)))
        labels.append((i, 1, int(i % 8 == 0)))
    near = rows[1][1].split(" ")
    near[10] = "changed"
    rows += [(1000, rows[1][1], "en", "s0", 0), (1001, " ".join(near), "en", "s1", 0), (1002, rows[2][1].split("\n")[1] + "\n" + sentence(rng, 60), "en", "s0", 0), (None, sentence(rng, 30), "en", None, 0), (1003, sentence(rng, 20_000), "en", "s1", 0)]
    rows += [rows[3]] * 2
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept[name] = docs.toPandas()
    ids = {k: set(v["doc_id"].dropna().astype(int)) for k, v in kept.items()}
    toxic, held = {i for i in range(0, 400, 8)}, {i for i in range(400) if i % 8}
    assert not ids["toxicity"] & toxic and ids["toxicity"] >= held
    # of two equal texts no line of the second stays
    assert 1000 not in ids["line dedup"] and kept["toxicity"]["doc_id"].isna().sum() == 1
    lines_left = Counter(x for i, t in zip(kept["line dedup"]["doc_id"], kept["line dedup"]["text"], strict=True) if i != 3 for x in t.split("\n"))
    assert max(lines_left.values()) == 1
    assert ids["n-gram join"] >= held and kept["n-gram join"]["doc_id"].isna().sum() == 1
    assert ids["packing"] <= ids["n-gram join"] and 1003 in ids["packing"]
    pieces = kept["packing"]
    assert (pieces.groupby("sequence_id")["length"].sum() <= 1024).all()


def test_pages_are_dealt_out_once_for_two_joins_that_split_a_large_host(spark):
    wanted = {"autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "adaptive.advisoryPartitionSizeInBytes": "10k", "shuffle.partitions": "8"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        own = [f"text {i} " + str(i * i * 777) * 20 if i % 7 else "" for i in range(1500)]
        rows = [(i, f"http://h{0 if i % 4 else i % 23}.org/{i}", f"<body><p>all of it</p><article>{t}</article></body>" if t else None) for i, t in enumerate(own)]
        found = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8))
        assert {r["page_id"]: r["text"] for r in found.collect()} == dict(enumerate(own))
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        # one join reads what the other's exchange wrote
        assert plan.count("SortMergeJoin(skew=true)") == 2
        assert re.search(r"ReusedExchange \[page_id", plan)
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)


def test_bands_are_sent_by_groups_and_a_large_one_goes_through_in_parts(spark):
    rng = random.Random(5)
    texts = [sentence(rng, 20) for _ in range(2000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows = lines.line_bands(docs, 8).collect()
    assert len(rows) == 8
    got = {(int(b), int(n)) for r in rows for b, n in np.frombuffer(r["pairs"], lines.PAIR)}
    assert got == {(int(b) & 0xFFFFFFFF, lines.node_of(t)) for t, own in zip(texts, lines.band_hashes(texts), strict=True) for b in own}

    # bands 7 and 8 in 6 parts of one group, beyond what is gathered at once, and band 7 of another group
    def part(group, band, nodes):
        pairs = np.empty(len(nodes), lines.PAIR)
        pairs["band"], pairs["node"] = band, nodes
        return group, pairs.tobytes()

    size = lines.GATHERED // 4 + 1
    order = np.random.default_rng(1).permutation(6 * size)
    parts = [part(3, np.where(x < 10, 8, 7), x) for x in np.array_split(order, 6)] + [part(4, 7, np.array([-1, -2]))]
    links = lines.band_stars(spark.createDataFrame([(g, bytearray(p)) for g, p in parts], "group long, pairs binary")).toPandas()
    above = np.arange(6 * size)
    for a, b in links[links["a"] >= 0].to_numpy().tolist():
        assert a < b and (a < 10) == (b < 10)
        above[b] = min(above[b], a)
    while (above[above] != above).any():
        above = above[above]
    assert (above == np.where(np.arange(6 * size) < 10, 0, 10)).all()
    assert links[links["a"] < 0].to_numpy().tolist() == [[-2, -1]]
    assert len(links) < 6 * size + 20


def test_short_lines_that_share_two_shingles_rarely_meet_in_a_band():
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz "

    def line(middle):
        return "".join(rng.choices(letters, k=20)) + middle + "".join(rng.choices(letters, k=20))

    pairs = [(line(m), line(m)) for m in ("".join(rng.choices(letters, k=lines.WIDTH + 1)) for _ in range(4000))]
    a, b = (lines.band_hashes(list(x)) for x in zip(*pairs, strict=True))
    assert (a == b).any(1).sum() <= 4  # by a neighbour's shingle in empty bins, some hundred


def test_many_sets_of_a_template_don_t_all_meet():
    from tidepanel.llm.verify import set_links

    rng = np.random.default_rng(4)
    template = rng.integers(0, 1 << 63, 60)
    sets = [np.unique(np.concatenate([template, rng.integers(0, 1 << 63, 40)]).astype(np.uint64)) for _ in range(20_000)]
    copies = [np.unique(np.concatenate([s[:95], rng.integers(0, 1 << 63, 4).astype(np.uint64)])) for s in sets[:500]]
    began = time.time()
    got = set_links(sets + copies, 4, 5)
    assert time.time() - began < 20  # every pair of them takes over a minute
    assert {(min(p), max(p)) for p in got} == {(i, len(sets) + i) for i in range(len(copies))}
    # and the same components as by comparing all pairs, for sets of all sizes and overlaps
    base = [rng.integers(0, 900, rng.integers(1, 40)) for _ in range(60)]
    sets = [np.unique(np.concatenate([b[rng.integers(0, 3) :], rng.integers(0, 900, rng.integers(0, 4))])).astype(np.uint64) for b in base for _ in range(5)]
    sets = [s for s in sets if len(s)]
    assert len(sets) >= 256
    want = classes(len(sets), lambda i, j: 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])))
    edges = {(min(p), max(p)) for p in set_links(sets, 4, 5)}
    assert classes(len(sets), lambda i, j: (j, i) in edges) == want


def test_pipeline_does_not_chain_unrelated_short_lines(spark, monkeypatch):
    import corpus_pipeline
    from tidepanel.llm import verify

    rng = random.Random(13)
    middles = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=lines.WIDTH + 1)) for _ in range(12)]
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20)) + rng.choice(middles) + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20))) for i in range(4000)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    met, way = [], verify.with_totals
    monkeypatch.setattr(lines, "with_totals", lambda wanted: met.append(wanted.count()) or way(wanted))
    assert corpus_pipeline.drop_repeated_lines(spark, docs, "").count() == 4000
    assert met[0] < 100  # by a neighbour's shingle in empty bins, 741 lines of these were candidates
