"""Streams of state writes: newest value per key, windowed activity, duplicates within a time, sensed expectations.

Sources are files; runs use the AvailableNow trigger, so a run ends when it has read what is there. State and results
are kept in the folder given, which executors must share.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, folder: str, name: str, files_a_batch: int | None = None) -> DataFrame:
    """The Parquet table ``name`` in ``folder`` as a stream, with its schema."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    reader = reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader
    return reader.parquet(f"{folder}/{name}.parquet*")


def finished(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """The stream run to its end; complete and update results keep each batch's rows, of which the newest count."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("append").parquet(f"{folder}/rows")

    spark = stream.sparkSession
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    return rows if mode == "append" else rows.where(F.col("_batch") == rows.agg(F.max("_batch")).first()[0]) if mode == "complete" else rows


def newest(writes: DataFrame) -> DataFrame:
    """Newest value of each key by sequence number (complete mode)."""
    return writes.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))


def activity(events: DataFrame, width: str, late: str) -> DataFrame:
    """Events per type and tumbling window, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"))


def without_repeats(writes: DataFrame, keys: list[str], within: str) -> DataFrame:
    """The first of equal writes within a time."""
    return writes.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def expectations(observed: DataFrame) -> DataFrame:
    """Per entity: an expected value that changes only when a new value is seen twice running; ``updates`` counts that.

    ``observed`` has entity, seq and value. State is kept per entity and survives restarts.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, pending, updates = state.get if state.exists else (None, None, 0)
        for batch in [pd.concat(list(batches)).sort_values("seq")]:
            for value in batch["value"]:
                if expected is None:
                    expected = value
                elif value == expected:
                    pending = None
                elif value == pending:
                    expected, pending, updates = value, None, updates + 1
                else:
                    pending = value
        state.update((expected, pending, updates))
        yield pd.DataFrame({"entity": [key[0]], "expected": [expected], "updates": [updates]})

    return observed.groupBy("entity").applyInPandasWithState(step, "entity string, expected string, updates long", "expected string, pending string, updates long", "update", GroupStateTimeout.NoTimeout)


#: Seconds that a message's clock may differ from ours, and successes running after which an entity has cooled down.
DRIFT, COOL_AFTER = 120, 3


def received(messages: DataFrame, drift: int = DRIFT, cool_after: int = COOL_AFTER) -> DataFrame:
    """What becomes of each message of a peer: ``peer``, ``place``, ``verdict``, ``cursor``, ``trust`` and ``attention``.

    ``messages`` has peer, place (order of arrival), seq, sent, got (seconds) and ok (whether what it says was confirmed).
    A message whose clock is off by more than ``drift`` is drifted, one at or before the peer's cursor replayed; others are
    applied and move the cursor. Applied ones that are confirmed count for the peer's trust (their share of all applied
    ones). One that isn't asks for attention, until ``cool_after`` in a row have been confirmed. Cursor and counters are
    state of the peer and survive restarts.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor, confirmed, applied, hot, streak = state.get if state.exists else (-1, 0, 0, False, 0)
        out = []
        for m in pd.concat(list(batches)).sort_values("place").itertuples():
            if abs(m.sent - m.got) > drift:
                verdict = "drifted"
            elif m.seq <= cursor:
                verdict = "replayed"
            else:
                verdict, cursor, applied = "applied", int(m.seq), applied + 1
                confirmed, streak = (confirmed + 1, streak + 1) if m.ok else (confirmed, 0)
                hot = not m.ok or (hot and streak < cool_after)
            out.append((key[0], m.place, verdict, cursor, confirmed / applied if applied else 0.0, hot))
        state.update((cursor, confirmed, applied, hot, streak))
        yield pd.DataFrame(out, columns=["peer", "place", "verdict", "cursor", "trust", "attention"])

    rows, kept = "peer string, place long, verdict string, cursor long, trust double, attention boolean", "cursor long, confirmed long, applied long, hot boolean, streak long"
    return messages.groupBy("peer").applyInPandasWithState(step, rows, kept, "append", GroupStateTimeout.NoTimeout)
