"""Shared pieces: table access, scratch tables and distributed components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern of the text contracts: runs without ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one input table through Spark only, with just the given columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset, one machine (tests) gets a local folder, and a
    cluster an error, as its machines share none.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(path or f"{tempfile.gettempdir()}/spark-scratch-{uuid.uuid4().hex}")
    return sc.getCheckpointDir()


def fresh(name: str, columns: list[str]) -> str:
    """``name``, or the first one with a number that no column has."""
    taken = {c.lower() for c in columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(len(taken)))) if n.lower() not in taken)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage."""
    path = f"{scratch_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit hashes (fixed multipliers of a public integer mixer)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for short arrays faster than the general function."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def with_blocks(df: DataFrame, key: str, n: Column, node: Column, block_rows: int) -> DataFrame:
    """Deal the rows of each key to pairs of blocks, so that every two rows of a key meet in some task.

    ``n`` is the key's number of rows.  Keys of up to ``block_rows`` rows stay whole (block pair 0, 0); of a
    larger key each row goes to one pair for each of its blocks, so a task holds two blocks at most.
    ``block`` is the row's own block.
    """
    blocks = F.ceil(n / F.lit(block_rows)).cast("int")
    own = F.pmod(F.xxhash64(node, F.lit("block")), F.col("_blocks")).cast("int")
    df = df.withColumn("_blocks", blocks).withColumn("_own", own)
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return df.withColumns({"block_a": F.least("_own", "_other"), "block_b": F.greatest("_own", "_other"), "block": F.col("_own")}).drop("_blocks", "_own", "_other")


class Forest:
    """Union-find over the positions of one task's bounded block."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components by distributed union-find: rows (node, component), component the smallest node.

    Each round hooks every node onto its smallest neighbour's root and halves the paths, all by joins and
    map-side combined minima, so no neighbourhood is gathered in one task.  Rounds end when every edge has both
    ends in one tree.  An empty edge table gives an empty result; loops and repeated edges are allowed.
    """
    edges = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    ends = edges.select(F.col("a").alias("node"), "b").union(edges.select(F.col("b").alias("node"), F.col("a").alias("b")))
    labels = materialize(ends.groupBy("node").agg(F.least(F.min("b"), F.first("node")).alias("root")))
    scratch = labels
    for _ in range(rounds):
        # halve paths: the root's own root
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        labels = labels.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
        before, labels = scratch, materialize(labels)
        scratch = labels
        discard(before)
        # edges between trees, seen from their roots
        at_a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        at_b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        apart = edges.join(at_a, "a").join(at_b, "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("node"), F.least("ra", "rb").alias("_low"))
        hooks = materialize(apart.groupBy("node").agg(F.min("_low").alias("_low")))
        steps = labels.join(labels.select(F.col("node").alias("root"), F.col("root").alias("_up")), "root").where("_up <> root")
        if hooks.isEmpty() and steps.isEmpty():
            discard(edges)
            discard(hooks)
            return labels.select("node", F.col("root").alias("component"))
        labels = labels.join(hooks, "node", "left").select("node", F.least("root", "_low").alias("root"))
    raise RuntimeError(f"components did not settle within {rounds} rounds")


#: Bits of a filter that is sent to executors, at least and at most: 512 KB and 32 MB.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 28


def bit_map(hashes: DataFrame) -> tuple:
    """(broadcast packed bits, their number): the places pmod(h, number) of the hashes ``h`` are set.

    There are some eight bits for each hash, up to a fixed size; a fuller map only lets more false positives through.
    """
    number = max(LEAST_BITS, min(MOST_BITS, 1 << (8 * hashes.count()).bit_length()))
    positions = hashes.select(F.pmod("h", F.lit(number)).alias("p"))
    rows = positions.groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    bits = np.zeros(number, bool)
    for r in rows.toLocalIterator():
        # bucket k holds positions (k - 1) * 32768 + 1 .. k * 32768, and bucket 0 position 0 alone
        found = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little"))
        at = (r["k"] - 1) * 32_768 + 1 + found if r["k"] > 0 else np.zeros(1, np.int64)
        bits[at[at < number]] = True
    return hashes.sparkSession.sparkContext.broadcast(np.packbits(bits)), number
