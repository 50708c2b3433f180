"""Queries of the arbitration family."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import arbitration
from palimpsest.plans import tables
from palimpsest.plans.registry import query

_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_KEYS = """keys AS (SELECT seq, CASE seq % 6 WHEN 0 THEN 'fact:user' || user_id || ':port' WHEN 1 THEN 'svc' || user_id || ':tags' WHEN 2 THEN 'config:mode:u' || user_id WHEN 3 THEN 'user' || user_id WHEN 4 THEN 'hermes:a:b' || user_id || ':c' ELSE 'x:u' || user_id || ':allowed_roles:extra' END AS key,
  user_id, value, CASE WHEN seq % 2 = 0 THEN 'user_explicit' ELSE 'tool_output' END AS source, (seq * 37 % 100) / 100e0 AS conf FROM (SELECT event_id AS seq, user_id, event_type AS value FROM events))"""
_ROOT = f"CASE WHEN NOT contains(K, ':') THEN K WHEN split_part(K, ':', 1) = 'hermes' AND len(string_split(K, ':')) >= 3 THEN array_to_string(string_split(K, ':')[1:3], ':') WHEN split_part(K, ':', 1) IN {_IN(arbitration.NAMESPACES)} OR len(string_split(K, ':')) >= 3 THEN array_to_string(string_split(K, ':')[1:2], ':') ELSE split_part(K, ':', 1) END"
_F = _IN(arbitration.FUNCTIONAL_SLOTS)
_SLOT = f"CASE WHEN len(string_split(K, ':')) = 1 THEN 'value' WHEN lower(split_part(K, ':', 1)) = 'hermes' AND len(string_split(K, ':')) >= 3 THEN array_to_string(string_split(K, ':')[3:], ':') WHEN len(string_split(K, ':')) = 2 THEN CASE WHEN split_part(K, ':', 2) IN {_F} THEN split_part(K, ':', 2) ELSE 'value' END WHEN split_part(K, ':', 2) IN {_F} AND split_part(K, ':', 3) NOT IN {_F} THEN split_part(K, ':', 2) ELSE array_to_string(string_split(K, ':')[3:], ':') END"
_MULTI = f"(lower(S) IN {_IN(arbitration.MULTI_VALUED)} OR len(list_filter(string_split(replace(lower(S), ':', '_'), '_'), lambda w: w IN {_IN(arbitration.MULTI_VALUED)})) > 0)"


def keys(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    u, k = F.col("user_id"), F.col("event_id") % 6
    key = F.when(k == 0, F.concat(F.lit("fact:user"), u, F.lit(":port"))).when(k == 1, F.concat(F.lit("svc"), u, F.lit(":tags"))).when(k == 2, F.concat(F.lit("config:mode:u"), u)).when(k == 3, F.concat(F.lit("user"), u)).when(k == 4, F.concat(F.lit("hermes:a:b"), u, F.lit(":c"))).otherwise(F.concat(F.lit("x:u"), u, F.lit(":allowed_roles:extra")))
    return e.select(F.col("event_id").alias("seq"), key.alias("key"), "user_id", F.col("event_type").alias("value"), F.when(F.col("event_id") % 2 == 0, "user_explicit").otherwise("tool_output").alias("source"), (F.col("event_id") * 37 % 100 / 100.0).alias("conf"))


@query(f"WITH {_KEYS}, s AS (SELECT seq, key AS K, {_ROOT.replace('K', 'key')} AS root, {_SLOT.replace('K', 'key')} AS S FROM keys) SELECT seq, root, S AS slot, {_MULTI} AS many FROM s")
def key_coordinates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("key")
    return keys(spark, d).select("seq", arbitration.root(k).alias("root"), arbitration.slot(k).alias("slot"), arbitration.multi_valued(k).alias("many"))


_PAIRS = f"""{_KEYS}, p AS (SELECT seq, key AS new_key, value AS new_value, source AS new_source, conf AS new_conf, lag(value) OVER w AS old_value, lag(source) OVER w AS old_source, lag(conf) OVER w AS old_conf FROM keys WINDOW w AS (PARTITION BY key ORDER BY seq)),
r AS (SELECT *, CASE WHEN new_value <> old_value AND new_source = 'user_explicit' AND new_conf >= 0.95e0 AND old_conf <= new_conf THEN 'belief_revision'
  WHEN (old_conf >= 0.9e0 OR old_source = 'user_explicit') AND old_conf - new_conf > CASE WHEN new_value = old_value THEN 0.2e0 ELSE 0e0 END THEN 'confidence_inversion' ELSE 'none' END AS reason FROM p WHERE old_value IS NOT NULL)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("key").orderBy("seq")
    rows = keys(spark, d).select("seq", F.col("key").alias("new_key"), *[F.col(c).alias(f"new_{c}") for c in ("value", "source", "conf")], *[F.lag(c).over(w).alias(f"old_{c}") for c in ("value", "source", "conf")])
    return arbitration.same_key_reason(rows.where("old_value is not null"))


@query(
    f"""WITH {_PAIRS} SELECT seq, reason, CASE WHEN new_source = 'user_explicit' AND new_conf >= 0.95e0 AND old_conf <= new_conf THEN 'supersede' WHEN reason <> 'none' THEN 'warn_conflict' ELSE 'accept' END AS action FROM r"""
)
def same_key_arbitration(spark: SparkSession, d: str) -> DataFrame:
    return arbitration.decided(pairs(spark, d).withColumn("old_key", F.col("new_key"))).select("seq", "reason", "action")


@query(
    r"""WITH p AS (SELECT conv_id, turn, text AS observed, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS expected FROM conversations UNION ALL SELECT -event_id, 0, CAST(event_id % 50 AS VARCHAR), CAST(event_id % 7 AS VARCHAR) FROM events),
w AS (SELECT *, TRY_CAST(trim(observed) AS DOUBLE) AS x, TRY_CAST(trim(expected) AS DOUBLE) AS y, list_distinct(regexp_extract_all(lower(trim(observed)), '[\p{L}\p{N}_]+')) AS a, list_distinct(regexp_extract_all(lower(trim(expected)), '[\p{L}\p{N}_]+')) AS b FROM p WHERE expected IS NOT NULL),
s AS (SELECT *, x IS NOT NULL AND y IS NOT NULL AS num, round(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN CASE WHEN abs(x - y) < 1e-5 THEN 0e0 ELSE least(1e0, abs(x - y) / greatest(abs(x), abs(y), 1e0)) END
  WHEN lower(trim(observed)) = lower(trim(expected)) THEN 0e0 WHEN len(a) = 0 OR len(b) = 0 THEN 1e0 ELSE 1e0 - len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END, 6) AS discrepancy FROM w)
SELECT conv_id, turn, discrepancy, CASE WHEN discrepancy = 0 THEN 'NONE' WHEN discrepancy < CASE WHEN num THEN 0.1e0 ELSE 0.2e0 END THEN 'LOW' WHEN discrepancy < CASE WHEN num THEN 0.5e0 ELSE 0.6e0 END THEN 'MODERATE' ELSE 'CRITICAL' END AS severity FROM s"""
)
def mixed_discrepancy(spark: SparkSession, d: str) -> DataFrame:
    turns = tables.read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("observed"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("expected"))
    numbers = tables.read(spark, d, "events").select((-F.col("event_id")).alias("conv_id"), F.lit(0).cast("long").alias("turn"), (F.col("event_id") % 50).cast("string").alias("observed"), (F.col("event_id") % 7).cast("string").alias("expected"))
    return arbitration.mixed_discrepancy(turns.where("expected is not null").unionByName(numbers)).select("conv_id", "turn", "discrepancy", "severity")


@query(
    r"""WITH m AS (SELECT DISTINCT p_type AS mention, trim(regexp_replace(regexp_replace(lower(p_type), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS n FROM part UNION SELECT DISTINCT c_mktsegment, lower(c_mktsegment) FROM customer),
a AS (SELECT lower(c_mktsegment) AS alias, 'seg:' || lower(c_mktsegment) AS entity, row_number() OVER (ORDER BY c_mktsegment) AS place FROM (SELECT DISTINCT c_mktsegment FROM customer) UNION ALL SELECT lower(split_part(p_type, ' ', 1)), 'type:' || lower(split_part(p_type, ' ', 1)), 100 + row_number() OVER (ORDER BY split_part(p_type, ' ', 1)) FROM (SELECT DISTINCT split_part(p_type, ' ', 1) || ' ' AS p_type FROM part))
SELECT mention, coalesce((SELECT arg_min(entity, place) FROM a WHERE alias = n), (SELECT arg_min(entity, place) FROM a WHERE length(alias) >= 4 AND contains(' ' || n || ' ', ' ' || alias || ' ')), replace(n, ' ', '_')) AS entity FROM m"""
)
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    segments = tables.read(spark, d, "customer").select("c_mktsegment").distinct()
    kinds = tables.read(spark, d, "part").select(F.split("p_type", " ")[0].alias("k")).distinct()
    place = lambda c, base: (F.row_number().over(Window.orderBy(c)) + base).cast("long")
    aliases = segments.select(F.lower("c_mktsegment").alias("alias"), F.concat(F.lit("seg:"), F.lower("c_mktsegment")).alias("entity"), place("c_mktsegment", 0).alias("place"))
    aliases = aliases.unionByName(kinds.select(F.lower("k").alias("alias"), F.concat(F.lit("type:"), F.lower("k")).alias("entity"), place("k", 100).alias("place")))
    mentions = tables.read(spark, d, "part").select(F.col("p_type").alias("mention")).unionByName(segments.select(F.col("c_mktsegment").alias("mention")))
    return arbitration.resolved(mentions, aliases)


@query()
def synonym_links(spark: SparkSession, d: str) -> DataFrame:
    names = tables.read(spark, d, "part").select(F.col("p_name").alias("name")).unionByName(tables.read(spark, d, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("name"))).distinct()
    return arbitration.synonyms(names)
