"""Steps of long plans: tables cut from their lineage in the shared folder, and small sides that are counted before they
are broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a side that travels to all executors; beyond, the same join is shuffled.
MOST_BROADCAST = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, of ``spark.checkpoint.dir``. Only a local session may go without one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a checkpoint where values repeat, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def counted(small: DataFrame, rows: int = MOST_BROADCAST) -> DataFrame:
    """``small`` materialised, with a broadcast hint if it has at most ``rows`` rows."""
    small = materialised(small)
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df``, materialised, with ``_rank``: its place from 0 in its ``group`` by ``order``. Rows are dealt by ranges of
    both and counted per part, so a group of any size is numbered without meeting in one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    # A row's place in its sorted partition is what the generated id counts.
    at = materialised(at.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = at.groupBy(group, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_base"))
    found = at.join(counted(base), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return found.withColumn("_rank", F.col("_place") + F.col("_base")).drop("_part", "_place", "_base", "_group", "_of")


def summed(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``df``, materialised, with ``_before_<column>``: the sum of each column over all rows before, by ``order`` (which tells
    the rows apart). Rows are dealt by ranges and their sums added per part, so no task holds them all."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = materialised(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    totals = at.groupBy("_part").agg(*[F.sum(c).alias(f"_all_{c}") for c in columns])
    # A row a part: as many as there are partitions.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_part", *[F.coalesce(F.sum(f"_all_{c}").over(earlier), F.lit(0)).alias(f"_base_{c}") for c in columns])
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = at.join(F.broadcast(base), "_part")
    return found.withColumns({f"_before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_base_{c}") for c in columns}).drop("_part", *[f"_base_{c}" for c in columns])
