"""A table of vectors in buckets of its keys: upserts and deletes that rewrite only the buckets they touch.

A row has key, text, vector and ts; its bucket is a hash of the key. Deleted rows stay as marks without text and vector, so a
bucket is never empty and a later, older upsert of the key doesn't bring it back. Applying the same changes twice
leaves what applying them once does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.steps import counted, materialised

BUCKETS = 64
COLUMNS = ["key", "text", "vector", "ts", "deleted"]


def bucket(key: str = "key"):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


def created(rows: DataFrame, path: str) -> None:
    """A new table at ``path`` of the newest row of each key."""
    newest(rows.select("key", "text", "vector", "ts", F.lit(False).alias("deleted"))).select(*COLUMNS, bucket()).repartition("bucket").write.partitionBy("bucket").parquet(path)


def newest(rows: DataFrame) -> DataFrame:
    """Of each key the row of the latest ts; a delete goes before an upsert of the same time."""
    best = F.max_by(F.struct(*COLUMNS), F.struct("ts", "deleted", F.xxhash64("text", "vector").alias("_tie"))).alias("r")
    return rows.groupBy("key").agg(best).select("r.*")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that aren't deleted."""
    return spark.read.parquet(path).where("NOT deleted").select("key", "text", "vector", "ts")


def merged(spark: SparkSession, path: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
    """Applies ``upserts`` (key, text, vector, ts) and ``deletes`` (ts and one of key, prefix of keys and text, the others null)
    to the table at ``path``; returns how many buckets were rewritten."""
    table = spark.read.parquet(path)
    empty = table.limit(0).select(*COLUMNS)
    changes = upserts.select("key", "text", "vector", "ts", F.lit(False).alias("deleted")) if upserts is not None else empty
    if deletes is not None:
        live = table.where("NOT deleted").select("key", "text")
        d = materialised(deletes.select("key", "prefix", "text", "ts"))
        # A key meets the prefixes of its own that have a length that is asked for.
        sizes = [r.n for r in d.where("prefix IS NOT NULL").select(F.length("prefix").alias("n")).distinct().collect()]
        cuts = F.array_distinct(F.array(*[F.left("key", F.lit(n)) for n in sizes])) if sizes else F.array().cast("array<string>")
        by_prefix = live.select("key", F.explode(cuts).alias("prefix")).join(counted(d.where("prefix IS NOT NULL").select("prefix", "ts")), "prefix").select("key", "ts")
        by_text = live.join(counted(d.where("text IS NOT NULL").select("text", "ts")), "text").select("key", "ts")
        gone = d.where("key IS NOT NULL").select("key", "ts").unionByName(by_prefix).unionByName(by_text)
        kinds = dict(table.dtypes)
        changes = changes.unionByName(gone.select("key", F.lit(None).cast("string").alias("text"), F.lit(None).cast(kinds["vector"]).alias("vector"), "ts", F.lit(True).alias("deleted")))
    changes = materialised(newest(changes).withColumn("bucket", bucket()))
    touched = counted(changes.select("bucket").distinct())
    n = touched.count()
    if n:
        # The bucket of a file is its folder, so only touched ones are read and written.
        rows = materialised(newest(table.join(touched, "bucket", "left_semi").select(*COLUMNS).unionByName(changes.select(*COLUMNS))).withColumn("bucket", bucket()))
        rows.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)
        spark.catalog.refreshByPath(path)
    return n
