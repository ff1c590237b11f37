"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import embeddings, html_text, lexical_search, licenses, lines, lm_score, media, mixing, ngram_join, packing, spelling, toxicity, vector_search
from tidepanel.llm.base import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", "text")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1")
    return lm_score.score(table(spark, sf_dir, "documents", "doc_id", "text"), good)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.stored(table(spark, sf_dir, "documents")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op11_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_licenses": op4_licenses,
    "op5_lm_score": op5_lm_score,
    "op6_media": op6_media,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_ngram_join": op10_ngram_join,
    "op11_vector_search": op11_vector_search,
    "op12_lexical_search": op12_lexical_search,
    "op13_spelling": op13_spelling,
}
#: A-Z lower-cased only.
_lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The least node that each node reaches, itself included, from ``nodes`` (v) and ``links`` (a, b), both ways.
_REACH = "reach AS (SELECT v, v AS c FROM nodes UNION SELECT l.b AS v, c FROM reach JOIN links l ON l.a = reach.v), least_ AS (SELECT v, min(c) AS c FROM reach GROUP BY 1)"

_NEAR_VECTORS = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id AS v, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT p.v AS a, q.v AS b FROM usable p JOIN usable q ON p.label = q.label AND p.v <> q.v AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.98),
nodes AS (SELECT vec_id AS v FROM embeddings), {_REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN least_ ON v = vec_id
"""

_NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(w[i], w[i + 1], w[i + 2], w[i + 3]) AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
z AS MATERIALIZED (SELECT s.*, n FROM s JOIN n USING (doc_id)),
half AS MATERIALIZED (
  SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, p.n AS x, q.n AS y, count(*) AS shared FROM z p JOIN z q ON p.g = q.g AND p.doc_id < q.doc_id AND 100 * q.n >= 85 * p.n AND 100 * p.n >= 85 * q.n GROUP BY ALL)
  WHERE 100 * shared >= 85 * (x + y - shared)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
nodes AS (SELECT doc_id AS v FROM documents), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN least_ ON v = d.doc_id
"""

_TOP_VECTORS = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM x q JOIN x c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0))
WHERE rank <= 10
"""

_terms = f"unnest(regexp_extract_all({_lower}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
_RANKED = f"""
WITH t AS MATERIALIZED (SELECT doc_id, {_terms} AS term FROM documents),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM d),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term, n_docs),
m AS (SELECT doc_id, 75 + (25 * n * n_docs) // total AS m FROM d, g),
i AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, {_terms} AS term FROM benchmark) GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM (
    SELECT item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM i JOIN p USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY 1, 2) WHERE score > 0)
WHERE rank <= 20
"""

ORACLES: dict[str, str] = {
    "op2_embedding_dedup": _NEAR_VECTORS,
    "op9_mixing": mixing.ORACLE,
    "op10_ngram_join": _NGRAM_JOIN,
    "op11_vector_search": _TOP_VECTORS,
    "op12_lexical_search": _RANKED,
}
