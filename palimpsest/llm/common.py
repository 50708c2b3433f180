"""Shared pieces of the training-data operators: tables, materialised steps, global order, permutations, components."""

from __future__ import annotations

import functools
import tempfile

import numpy as np
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the quality, mixing, secret and near-duplicate contracts: a run without ASCII white space.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: that of ``spark.checkpoint.dir``. Only a local session may go without one."""
    context: SparkContext = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Totals of buckets that travel to all executors, of some thousand rows each.
MAX_TOTALS = 500_000

#: Stands for a null id, before all others.
NULL_ID = -(2**63)


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``rid``, ``tag`` and ``text``: rid is the id (null: the least long); tag tells apart the texts that
    share an id, by their hash, and is 0 if no two rows share one. Rows equal in all are one document."""
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.count("doc_id").alias("known")).first()
    tag = F.lit(0).cast("long") if ids.n == ids.known == ids.ids else F.xxhash64("text")
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("rid"), tag.alias("tag"), "text")


def as_long(x: int) -> int:
    """An unsigned 64-bit number as a signed one."""
    return x - (1 << 64) if x >> 63 else x


def buckets(rows: int) -> int:
    """Number of hash buckets of about a thousand rows: a power of two that depends on the number of rows alone."""
    return 1 << max(4, (max(rows, 1) // 1000).bit_length())


def running_before(df: DataFrame, totals_of: DataFrame, n_buckets: int, size: str | None, group: str | None = None) -> DataFrame:
    """``df`` with ``before``: the sum of ``size`` (1 if None) over the rows that precede each one, in its ``group``.

    The order is that of (hash bucket of doc_id, doc_id, text hash ``_tag``), so it depends on the rows alone and not on
    how they are partitioned; rows equal in all of these take any order. A window never holds more than a bucket of a
    group, or one total per bucket: no group, however large, meets in one task. ``totals_of`` has the same rows as
    ``df``, and may be a narrow, materialised form of it.
    """
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)).alias("_bucket")
    amount = F.coalesce(F.col(size), F.lit(0)) if size else F.lit(1)
    name = F.col(group) if group else F.lit(None).cast("string")
    totals = totals_of.groupBy(name.alias("_group"), bucket.alias("_b")).agg(F.sum(amount).alias("_total"))
    preceding = Window.partitionBy("_group").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # Counted before the join is planned: else wide rows may be shuffled once more before the totals prove to be few.
    totals = bounded(totals.select("_group", "_b", F.coalesce(F.sum("_total").over(preceding), F.lit(0)).alias("_base")), MAX_TOTALS)
    parts = ["_bucket", group] if group else ["_bucket"]
    inside = Window.partitionBy(*parts).orderBy("doc_id", "_tag").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_bucket", bucket).withColumn("_within", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    same = (F.col("_bucket") == F.col("_b")) & (name.eqNullSafe(F.col("_group")) if group else F.lit(True))
    return df.join(totals, same).withColumn("before", (F.col("_within") + F.col("_base")).cast("long")).drop("_bucket", "_within", "_b", "_group", "_base")


#: Of the Feistel round function: a prime below 2^31, so that products stay in 64 bits.
PRIME = 2_147_483_647
ROUNDS = 4


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Multiplier and offset of each Feistel round, from a 64-bit mixing of the seed."""
    keys, x = [], seed & (2**64 - 1)
    for _ in range(2 * ROUNDS):
        x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        keys.append(1 + (z ^ (z >> 31)) % (PRIME - 1))
    return list(zip(keys[::2], keys[1::2], strict=True))


def feistel(x: np.ndarray, n: np.ndarray | int, seed: int, tweak: np.ndarray | int = 0) -> np.ndarray:
    """Permutes each x in [0, n): a balanced Feistel network on 2h bits, walked along its cycle until it is below n.

    2^(2h) is below 4n, or 4, so that a walk takes four steps on average. ``n`` and ``tweak`` may differ by row; the
    tweak makes another permutation of it. n up to 2^60.
    """
    x = np.asarray(x, dtype=np.int64).copy()
    n = np.broadcast_to(np.asarray(n, dtype=np.int64), x.shape)
    tweak = np.broadcast_to(np.asarray(tweak, dtype=np.int64), x.shape) % PRIME
    half = np.ones(x.shape, np.int64)
    while (small := (np.int64(1) << (2 * half)) < n).any():
        half[small] += 1
    mask, keys, left = (np.int64(1) << half) - 1, round_keys(seed), np.arange(x.size)
    while left.size:
        h, m, t = half[left], mask[left], tweak[left]
        a, b = x[left] >> h, x[left] & m
        for k, c in keys:
            f = (b * k + c + t) % PRIME
            f = (f * f + k) % PRIME
            a, b = b, a ^ ((f ^ (f >> 15)) & m)
        x[left] = (a << h) | b
        left = left[x[left] >= n[left]]
    return x


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of its component) of the links ``a``, ``b`` (long, undirected, no nulls).

    Alternates large-star and small-star rounds, O(log^2 n) of them; each is a group-by on narrow rows, is
    materialised, and only its checksum comes to the driver. A node with very many links is never gathered: each round
    takes minima per node and joins them back.
    """
    links = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct()
    links, seen = materialise(links), None
    while True:
        # Large star: each neighbour above u links to the least of u and its neighbours.
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # Small star: each neighbour below u, and u, link to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi > lo")
        links = materialise(small.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1_000_000_007), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == seen:
            break
        seen = now
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def bounded(small: DataFrame, rows: int) -> DataFrame:
    """``small`` materialised; with a broadcast hint if it has at most ``rows`` rows, else left to a shuffled join."""
    small = materialise(small)
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def union_all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)
