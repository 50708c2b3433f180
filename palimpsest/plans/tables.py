"""Memory-shaped inputs derived from the driver's tables; each has a SQL twin of the same name in ``SQL``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1_704_067_200
AS_OF = EPOCH + 40 * 86_400


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each document: key, subject, value, confidence, ts, source_type, importance."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    kind = F.element_at(F.array(*map(F.lit, ["user_explicit", "tool_output", "external_doc", "agent_inference"])), (F.col("doc_id") % 4 + 1).cast("int"))
    space = F.element_at(F.array(*map(F.lit, ["fact:", "rule:", "hermes:memory_md:", "session:a", "kv:", "temp_"])), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat(space, F.col("source"), F.lit(":"), F.col("doc_id")).alias("key"),
        F.col("text").alias("value"),
        F.coalesce(F.col("quality") * 0.4 + 0.5, F.lit(0.7)).alias("confidence"),
        (F.lit(EPOCH) + F.col("doc_id") % 3000 * 1000).cast("long").alias("ts"),
        kind.alias("source_type"),
        (F.col("doc_id") % 100 / 100.0).alias("importance"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part, confidence the best discount, time the last shipment; parallel edges merged by maximum."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst")).agg(F.max(1 - F.col("l_discount")).alias("confidence"), F.max("l_shipdate").alias("ts"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write of a keyed state for each event."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), F.col("user_id"), F.lit(":"), F.col("event_type")).alias("key"), F.round("value", 2).alias("value"), "ts", "user_id", "event_type", "props")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five tokens of each benchmark item."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.length(t) >= 3)
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, 1, 5), " ").alias("query"))


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation to region, customer segment to nation, region to the next: a small graph for paths (a -> b, weight)."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    up = nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("dst"), (0.5 + F.col("n_nationkey") % 5 / 10.0).alias("confidence"))
    ring = region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("src"), F.concat(F.lit("r"), (F.col("r_regionkey") + 1) % 5).alias("dst"), F.lit(0.9).alias("confidence"))
    down = nation.where("n_nationkey % 3 = 0").select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("src"), F.concat(F.lit("n"), (F.col("n_nationkey") + 7) % 25).alias("dst"), F.lit(0.8).alias("confidence"))
    return up.unionByName(ring).unionByName(down)


#: Claims of many kinds, by the event: expressions that both dialects read.
_CLAIMS = {
    "subject": ["'jak_obecnie'", "'config:mode'", "'which'", "'wheree'", "'ab'", "'node' || user_id", "'42.5'", "'we all went to the place that they told us about'", "'user'", "'z jakiej wersji'", "'svc-' || user_id", "'service a ' || user_id", "'me@example.org'"],
    "predicate": ["'is_set'", "'stated_memory'", "'requires'", "'what?'", "'leads_to'"],
    "object": ["'port ' || user_id", "'yes'", "'really?'", "'svc-' || user_id", "'it was told to us that all of this, and more, would be so.'", "'port' || event_id", "'sys:lock'"],
    "source": ["'user_explicit'", "'shadow_inference'", "'tool_output'"],
}


def triples(spark: SparkSession, d: str) -> DataFrame:
    """A claim (subject, predicate, object, source) for each event, with its user, time and a confidence."""
    picked = [F.expr(f"element_at(array({', '.join(xs)}), cast(event_id % {len(xs)} + 1 as int))").alias(name) for name, xs in _CLAIMS.items()]
    return read(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", *picked, (F.col("event_id") * 37 % 100 / 100.0).alias("confidence"), F.col("ts"))


SQL = {
    "triples": "triples AS (SELECT event_id AS id, user_id, " + ", ".join(f"[{', '.join(xs)}][event_id % {len(xs)} + 1] AS {name}" for name, xs in _CLAIMS.items()) + ", (event_id * 37 % 100) / 100e0 AS confidence, ts FROM events)",
    "facts": f"""facts AS (
  SELECT d.doc_id, ['fact:', 'rule:', 'hermes:memory_md:', 'session:a', 'kv:', 'temp_'][d.doc_id % 6 + 1] || source || ':' || d.doc_id AS key, text AS value,
    CAST(coalesce(quality * 0.4e0 + 0.5e0, 0.7e0) AS DOUBLE) AS confidence, CAST({EPOCH} + d.doc_id % 3000 * 1000 AS BIGINT) AS ts,
    ['user_explicit', 'tool_output', 'external_doc', 'agent_inference'][d.doc_id % 4 + 1] AS source_type, CAST(d.doc_id % 100 AS DOUBLE) / 100 AS importance
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "edges": "edges AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, max(1 - l_discount) AS confidence, max(l_shipdate) AS ts FROM lineitem GROUP BY 1, 2)",
    "states": "states AS (SELECT event_id AS seq, 'user:' || user_id || ':' || event_type AS key, round(value, 2) AS value, ts, user_id, event_type, props FROM events)",
    "questions": r"questions AS (SELECT item_id AS query_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: length(t) >= 3)[1:5], ' ') AS query FROM benchmark)",
    "hops": """hops AS (
  SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 0.5e0 + (n_nationkey % 5) / 10e0 AS confidence FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'r' || ((r_regionkey + 1) % 5), 0.9e0 FROM region
  UNION ALL SELECT 'r' || n_regionkey, 'n' || ((n_nationkey + 7) % 25), 0.8e0 FROM nation WHERE n_nationkey % 3 = 0)""",
}


def with_tables(sql: str, *names: str) -> str:
    """SQL with the twins of derived tables as common table expressions; more of them may follow in ``sql``."""
    head = "WITH RECURSIVE " + ", ".join(SQL[n] for n in names)
    return f"{head}, {sql[5:]}" if sql.startswith("WITH ") else f"{head} {sql}"
