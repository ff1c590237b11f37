"""Mixing sources to target weights by systematic sampling over prefix sums of expected copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.llm.base import SPACED_WORD, fresh, materialize

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2
#: Rows of a source are laid out in cells of about so many rows.
CELL_ROWS = 20_000


def uniform(*parts: Column) -> Column:
    """A repeatable number in [0, 1) from the md5 of the parts, joined by a colon."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size), one for each source.

    Sources take the weights in turn, by code point with null last.  With lambda the common words per unit of
    weight, a target is min(cap, lambda * weight): the limit of resharing the excess over the caps.  The
    table has one row per source, so a global window over it is small.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    pick = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (pick + 1).cast("int"))
    caps = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(MAX_REPEAT)))
    caps = caps.withColumn("_level", F.col("_cap") / F.col("_w"))
    below = W.orderBy("_level", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    caps = caps.withColumns({
        "_full": F.coalesce(F.sum("_cap").over(below), F.lit(0.0)),
        "_rest": F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(below), F.lit(0.0)),
        "_all": F.sum("source_size").over(whole) * F.lit(TOTAL_SHARE),
    })
    caps = caps.withColumn("_try", (F.col("_all") - F.col("_full")) / F.col("_rest"))
    caps = caps.withColumn("_lambda", F.max(F.when(F.col("_try") <= F.col("_level"), F.col("_try"))).over(whole))
    target = F.least("_cap", F.coalesce(F.col("_lambda"), F.col("_level")) * F.col("_w"))
    return caps.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Decide how many copies of each document the mix takes.

    Returns (doc_id, source, size, source_size, target, copies, taken), a row for each row of ``docs``.
    Every document of a source expects target / source_size copies.  A source's documents are laid in one line:
    one half (by a hash) with rising sizes, then the other with falling ones.  The line of expected copies is
    cut at the integers after adding one random offset for the source, and a document is taken once for each
    integer it crosses.  Neighbours have similar sizes and the two halves' drifts cancel, so the words taken
    stay near the target.

    The line is never gathered: counts of (source, size class, cell) give each cell's start, and ranks run
    within cells of about CELL_ROWS rows.  Null text has size 0; null ids and sources are values like others
    (all null sources are one source); repeated rows each count, and those of one id lie side by side in any order;
    a text's length matters by its words alone; an empty table gives an empty result; columns
    other than the three are not used, and a source without words takes nothing.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(SPACED_WORD)), F.lit(0)).cast("long")
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")))
    cells = F.greatest(F.lit(1), F.ceil(F.lit(rows.count() / CELL_ROWS))).cast("long")
    known = {"_s": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()}
    size_class = F.floor(F.log2(F.col("size") + 1) * 8).cast("int")
    rows = rows.withColumns(known | {"_u": uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))})
    rows = rows.withColumn("_falls", F.pmod((F.col("_u") * 4294967296).cast("long"), F.lit(2)) == 1)
    rows = rows.withColumn("_class", F.when(F.col("_falls"), 1000 - size_class).otherwise(size_class))
    rows = rows.withColumn("_size", F.when(F.col("_falls"), -F.col("size")).otherwise(F.col("size")))
    rows = rows.withColumn("_cell", F.floor(F.col("_u") * cells))
    key = ["_s", "_null", "_class", "_cell"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.sum("size").alias("_words"))
    counts = materialize(counts)
    sizes = counts.groupBy("_s", "_null").agg(F.sum("_words").alias("source_size"))
    sizes = sizes.select(F.when(~F.col("_null"), F.col("_s")).alias("source"), "source_size")
    targets = source_targets(sizes).withColumns(known).drop("source")
    line = W.partitionBy("_s", "_null").orderBy("_class", "_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(line), F.lit(0))).join(targets, ["_s", "_null"])
    inside = W.partitionBy(*key).orderBy("_size", "_u", F.col("doc_id").isNull(), "doc_id")
    ranked = rows.withColumn("_rank", F.row_number().over(inside)).join(starts.drop("_n", "_words"), key)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = uniform(F.lit("offset"), F.concat(F.col("_s"), F.col("_null").cast("string")))
    ranked = ranked.withColumns({"_rate": rate, "_offset": offset, "_at": F.col("_before") + F.col("_rank")})
    crossed = lambda i: F.floor(F.col("_rate") * i + F.col("_offset"))
    copies = (crossed(F.col("_at")) - crossed(F.col("_at") - 1)).cast("long")
    ranked = ranked.withColumn("copies", copies)
    return ranked.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents the mix takes, each as often as it is taken, with the columns of ``docs``.

    Repeated rows of one doc_id are taken as often as the one taken most, so every id must name one text; null ids
    are one id; other columns, of any names, are kept.
    """
    doc, copies, copy = (fresh(c, docs.columns) for c in ("doc", "copies", "copy"))
    taken = mix(docs).groupBy("doc_id").agg(F.max("copies").alias(copies)).where(F.col(copies) > 0).withColumnRenamed("doc_id", doc)
    joined = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(doc)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
h AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS bits FROM d),
r AS (SELECT doc_id, size, source, coalesce(source, '') AS s, source IS NULL AS sn, bits / 4294967296.0::DOUBLE AS u,
  CASE WHEN bits % 2 = 1 THEN -size ELSE size END AS line_size,
  CASE WHEN bits % 2 = 1 THEN 1000 - floor(log2(size + 1) * 8)::INTEGER ELSE floor(log2(size + 1) * 8)::INTEGER END AS class FROM h),
k AS (SELECT greatest(1, ceil(count(*) / 20000.0))::BIGINT AS cells FROM d),
rc AS (SELECT r.*, floor(u * cells)::BIGINT AS cell FROM r, k),
z AS (SELECT s, sn, sum(size)::BIGINT AS source_size FROM rc GROUP BY s, sn),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY sn, s) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS wt,
  source_size * 2.0::DOUBLE AS cap FROM z),
l AS (SELECT *, cap / wt AS level FROM w),
f AS (SELECT *, coalesce(sum(cap) OVER b, 0.0::DOUBLE) AS full_words,
  sum(wt) OVER () - coalesce(sum(wt) OVER b, 0.0::DOUBLE) AS rest, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM l WINDOW b AS (ORDER BY level, sn, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, (total - full_words) / rest AS attempt FROM f),
g AS (SELECT *, max(CASE WHEN attempt <= level THEN attempt END) OVER () AS lam FROM t),
x AS (SELECT s, sn, source_size, least(cap, coalesce(lam, level) * wt) AS target FROM g),
o AS (SELECT rc.*, x.source_size, x.target,
  row_number() OVER (PARTITION BY rc.s, rc.sn ORDER BY class, cell, line_size, u, doc_id NULLS LAST) AS at_row,
  CASE WHEN x.source_size > 0 THEN x.target / x.source_size ELSE 0.0::DOUBLE END AS rate,
  ('0x' || substr(md5('offset:' || rc.s || rc.sn::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off
  FROM rc JOIN x ON rc.s = x.s AND rc.sn = x.sn)
SELECT doc_id, size, source_size, target,
  ((floor(rate * at_row + off) - floor(rate * (at_row - 1) + off))::BIGINT * size)::BIGINT AS taken FROM o
"""
