"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Every stage but the last keeps the columns of its input, whatever they are called besides doc_id, text, source and n_chars.  Rows with a null
id or text pass the first three stages; the mix takes null texts, of size 0, as often as their source's rate says; repeated
rows of one id and text are treated alike; of tied rows, as equal lines or near copies, the least id stays; very long texts go
through whole; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import lines, mixing, ngram_join, packing, toxicity
from tidepanel.llm.base import fresh, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class models don't call toxic; null and empty texts stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document of which no line stays goes; its lines stand in others.  One that had no text stays."""
    n_lines, n_removed = (fresh(c, docs.columns) for c in ("n_lines", "n_removed"))
    cut = F.col(n_removed) > 0
    kept = lines.without_repeats(docs, n_lines, n_removed).where(~cut | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share four fifths of their shingles of five words; the least id of a group stays, with all its rows."""
    return ngram_join.one_of_each(docs, 5, 80, 100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it: never, once or twice."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens; a null text is an empty one."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The models, near duplicates and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage but the last goes through a written table."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
