"""Queries that run as streams over the events and must agree with SQL over the table."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.steps import shared_folder
from palimpsest.plans.registry import query
from palimpsest.streaming import state


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, d: str) -> DataFrame:
    return state.source(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id || ':' || event_type AS key, max(event_id) AS seq, arg_max(round(value, 2), event_id) AS value FROM events GROUP BY 1")
def stream_hot_buffer(spark: SparkSession, d: str) -> DataFrame:
    writes = events(spark, d).select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("event_id").alias("seq"), F.round("value", 2).alias("value"))
    return state.finished(state.newest(writes), "complete", folder(spark)).select("key", "seq", "value")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS started, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def stream_activity(spark: SparkSession, d: str) -> DataFrame:
    found = state.finished(state.activity(events(spark, d), "6 hours", "1 hour"), "complete", folder(spark))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("started"), "event_type", "events")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "event_type", "ts")
    return state.finished(state.without_repeats(rows, ["user_id", "event_type"], "60 days"), "append", folder(spark)).select("user_id", "event_type")


@query(
    """WITH RECURSIVE o AS (SELECT 'u' || user_id AS entity, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT entity, n, value AS expected, NULL::VARCHAR AS pending, 0 AS updates FROM o WHERE n = 1
  UNION ALL SELECT s.entity, o.n, CASE WHEN o.value <> expected AND o.value = pending THEN o.value ELSE expected END, CASE WHEN o.value = expected OR o.value = pending THEN NULL ELSE o.value END,
    updates + CASE WHEN o.value <> expected AND o.value = pending THEN 1 ELSE 0 END FROM s JOIN o ON s.entity = o.entity AND o.n = s.n + 1)
SELECT entity, arg_max(expected, n) AS expected, CAST(arg_max(updates, n) AS BIGINT) AS updates FROM s GROUP BY entity"""
)
def stream_expectations(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select(F.concat(F.lit("u"), F.col("user_id")).alias("entity"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    found = state.finished(state.expectations(rows), "update", folder(spark))
    return found.groupBy("entity").agg(F.max_by("expected", "_batch").alias("expected"), F.max_by("updates", "_batch").alias("updates"))


_MESSAGE = "'u' || user_id AS peer, event_id AS place, event_id + 400 - CASE WHEN event_id % 4 = 0 THEN 400 ELSE 0 END AS seq, CAST(event_id AS BIGINT) * 60 AS sent, CAST(event_id AS BIGINT) * 60 + event_id * 37 % 261 - 130 AS got, event_id % 5 > 0 AS ok"


@query(
    f"""WITH m AS (SELECT {_MESSAGE} FROM events), c AS (SELECT *, abs(sent - got) > 120 AS drifted FROM m),
d AS (SELECT *, coalesce(max(CASE WHEN NOT drifted THEN seq END) OVER (PARTITION BY peer ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM c),
v AS (SELECT *, CASE WHEN drifted THEN 'drifted' WHEN seq <= before THEN 'replayed' ELSE 'applied' END AS verdict FROM d),
t AS (SELECT *, count(*) FILTER (verdict = 'applied') OVER w AS applied, count(*) FILTER (verdict = 'applied' AND ok) OVER w AS confirmed, max(CASE WHEN verdict = 'applied' AND NOT ok THEN place END) OVER w AS bad FROM v WINDOW w AS (PARTITION BY peer ORDER BY place)),
s AS (SELECT t.*, (SELECT count(*) FROM v x WHERE x.peer = t.peer AND x.verdict = 'applied' AND x.place > t.bad AND x.place <= t.place) AS streak FROM t)
SELECT peer, place, verdict, CASE WHEN verdict = 'applied' THEN seq ELSE before END AS cursor, round(CASE WHEN applied > 0 THEN CAST(confirmed AS DOUBLE) / applied ELSE 0e0 END, 9) AS trust, bad IS NOT NULL AND streak < 3 AS attention FROM s"""
)
def stream_peer_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of each user as a peer: drifted, replayed or applied, with the peer's cursor, trust and attention."""
    messages = state.source(spark, d, "events").selectExpr(*_MESSAGE.split(", "))
    return state.finished(state.received(messages), "append", folder(spark)).select("peer", "place", "verdict", "cursor", F.round("trust", 9).alias("trust"), "attention")
