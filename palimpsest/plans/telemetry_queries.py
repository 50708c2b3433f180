"""Queries of health, coverage, judgement and sleep."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import analytics, telemetry
from palimpsest.plans import analytics_queries, tables
from palimpsest.plans.analytics_queries import _EXPECT, _RUNS
from palimpsest.plans.registry import query
from palimpsest.plans.tables import with_tables


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 AND event_id % 4 < 3 THEN 'bash[' || ['git', 'python3', 'ls'][event_id % 4 + 1] || ']' WHEN event_id % 3 = 0 THEN 'bash' ELSE event_type END AS token FROM events")
def signature_tokens(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    command = F.element_at(F.array(*map(F.lit, ["git commit -m x", " /usr/bin/python3 a.py", "ls", " "])), (n % 4 + 1).cast("int"))
    tool = F.when(n % 3 == 0, "bash").otherwise(F.col("event_type"))
    return tables.read(spark, d, "events").select(n.alias("id"), telemetry.signature_token(tool, command).alias("token"))


@query(f"WITH {_RUNS}, n AS (SELECT 'u' || session % 10 || '::' || signature AS name, success FROM runs) SELECT name, count(*) AS runs, round(avg(CASE WHEN success THEN 1e0 ELSE 0e0 END), 6) AS rate, left(sha256(name), 12) AS id FROM n GROUP BY 1 HAVING count(*) >= 3 AND avg(CASE WHEN success THEN 1e0 ELSE 0e0 END) >= 0.8e0")
def baked_procedures(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.baked_procedures(analytics_queries.runs(spark, d).withColumn("context", F.concat(F.lit("u"), F.col("session") % 10)))


_HEAT = """e AS (SELECT split_part(name, ':', 1) AS entity, avg(error * error) AS t, max(error) AS worst FROM errs GROUP BY 1), s AS (SELECT split_part(name, ':', 1) AS entity, count(*) AS n FROM errs WHERE error <= 0.1 GROUP BY 1)"""


@query(f"WITH {_EXPECT}, {_HEAT} SELECT entity, coalesce(n, 0) < 3 AND round(t * pow(0.75e0, coalesce(n, 0)), 6) >= 0.15e0 AND worst > 0.5 AS critical FROM e LEFT JOIN s USING (entity)")
def entity_criticality(spark: SparkSession, d: str) -> DataFrame:
    found = analytics_queries.errors(spark, d).withColumn("entity", F.split("name", ":")[0])
    return telemetry.criticality(found, analytics.temperature(found, found.where("level = 'none'")))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 5 = 1 THEN 1 ELSE 2 END AS tier, p_retailprice AS confidence FROM part")
def risk_order(spark: SparkSession, d: str) -> DataFrame:
    risk = F.when(F.col("p_size") % 5 == 0, "CRITICAL").when(F.col("p_size") % 5 == 1, "HIGH").otherwise("LOW")
    return telemetry.by_risk(tables.read(spark, d, "part").select(F.col("p_partkey").alias("id"), risk.alias("risk"), F.col("p_retailprice").alias("confidence"))).select("id", "tier", "confidence")


@query(
    with_tables(
        """WITH m AS (SELECT 'duplication' AS name, CAST(count(*) AS DOUBLE) / count(DISTINCT value) AS v FROM facts UNION ALL SELECT 'coverage', (SELECT CAST(count(*) AS DOUBLE) FROM facts JOIN embeddings ON vec_id = doc_id) / (SELECT count(*) FROM facts)
  UNION ALL SELECT 'points', (SELECT CAST(count(*) AS DOUBLE) FROM embeddings) / (SELECT count(*) FROM facts) UNION ALL SELECT 'raw_chat', CAST(sum(CASE WHEN length(value) >= 1024 AND contains(value, ' | ') THEN length(value) ELSE 0 END) AS DOUBLE) / sum(length(value)) FROM facts
  UNION ALL SELECT 'parity', abs((SELECT count(*) FROM facts) - (SELECT count(DISTINCT key) FROM facts)) / CAST((SELECT count(*) FROM facts) AS DOUBLE)),
l(name, lo, hi) AS (VALUES ('duplication', 1.0, 1.05), ('parity', 0.0, 0.05), ('raw_chat', 0.0, 0.2), ('points', 0.0, 3.0), ('coverage', 0.6, 1.05))
SELECT name, round(v, 6) AS value, v BETWEEN lo AND hi AS holds FROM m JOIN l USING (name)""",
        "facts",
    )
)
def health_invariants(spark: SparkSession, d: str) -> DataFrame:
    facts, points = tables.facts(spark, d), tables.read(spark, d, "embeddings")
    chat = F.sum(F.when((F.length("value") >= 1024) & F.col("value").contains(" | "), F.length("value")).otherwise(0)) / F.sum(F.length("value"))
    a = facts.join(points.select("vec_id"), F.col("vec_id") == F.col("doc_id"), "left").agg(
        (F.count("*") / F.count_distinct("value")).alias("duplication"), (F.count("vec_id") / F.count("*")).alias("coverage"), chat.alias("raw_chat"), (F.abs(F.count("*") - F.count_distinct("key")) / F.count("*")).alias("parity"), F.count("*").alias("n")
    )
    a = a.join(F.broadcast(points.agg(F.count("*").alias("p")))).withColumn("points", F.col("p") / F.col("n"))
    measures = a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in telemetry.LIMITS])).alias("m")).select("m.*")
    return telemetry.invariants(measures)


@query("""WITH s AS (SELECT event_type, value AS ms, CAST(event_id % 100 AS BIGINT) AS tokens, user_id % 3 = 0 AS abstained, event_id % 4 > 0 AS should FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, round(avg(ms), 4) AS mean, round(stddev_pop(ms), 4) AS std, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.9), 4) AS p90, round(quantile_cont(ms, 0.95), 4) AS p95, round(quantile_cont(ms, 0.99), 4) AS p99,
  round(sum(ms), 2) AS total, CAST(sum(tokens) AS BIGINT) AS tokens, round(coalesce(avg(CASE WHEN should THEN 1e0 ELSE 0e0 END) FILTER (abstained), 0), 6) AS abstention_precision FROM s GROUP BY 1""")
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "events").where("value is not null").select("event_type", F.col("value").alias("ms"), (F.col("event_id") % 100).alias("tokens"), (F.col("user_id") % 3 == 0).alias("abstained"), (F.col("event_id") % 4 > 0).alias("should_abstain"))
    return telemetry.summary(rows, "event_type")


@query(with_tables("SELECT (SELECT count(*) FROM facts) AS facts, (SELECT count(DISTINCT key) FROM facts) AS keys, (SELECT count(*) FROM events) AS entries", "facts"))
def store_counts(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.store_counts(tables.facts(spark, d), tables.read(spark, d, "events"))


@query(with_tables("SELECT split_part(key, ':', 1) AS space, count(*) AS keys, count(vec_id) AS covered, round(count(vec_id) / CAST(count(*) AS DOUBLE), 6) AS share FROM facts LEFT JOIN embeddings ON vec_id = doc_id AND label > 1 GROUP BY 1", "facts"))
def vector_coverage(spark: SparkSession, d: str) -> DataFrame:
    facts = tables.facts(spark, d)
    points = tables.read(spark, d, "embeddings").where("label > 1").join(facts.select("doc_id", "key"), F.col("vec_id") == F.col("doc_id")).select("key")
    return telemetry.coverage(facts.select("key"), points)


@query("WITH b AS (SELECT event_type AS kind, count(*) AS before FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT kind, before, (SELECT count(*) FROM events e WHERE e.event_type = b.kind) AS after FROM b")
def migration_counts(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    count = lambda df: df.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return telemetry.monotonic(count(e.where("event_id % 2 = 0")), count(e))


_SAMPLE = "sample AS (SELECT (event_id * 7919 % 10007) / 10007e0 AS score, CASE WHEN (event_id * 7919 % 10007) + (event_id * 31 % 4001) > 7000 THEN 1 ELSE 0 END AS label, (event_id * 53 % 300) / 1000e0 AS margin FROM events)"


def sample(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    return tables.read(spark, d, "events").select((n * 7919 % 10007 / 10007.0).alias("score"), F.when(n * 7919 % 10007 + n * 31 % 4001 > 7000, 1).otherwise(0).alias("label"), (n * 53 % 300 / 1000.0).alias("margin"))


@query(f"""WITH {_SAMPLE}, g AS (SELECT unnest(range(1, 25)) AS step), h AS (SELECT least(CAST(floor(round(margin * 100, 6)) AS BIGINT), 24) AS h, label FROM sample),
m AS (SELECT step, CAST(sum(label) AS BIGINT) AS tp, CAST(sum(1 - label) AS BIGINT) AS fp FROM g JOIN h ON h >= step GROUP BY 1), f AS (SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS p, CAST(tp AS DOUBLE) / (SELECT sum(label) FROM sample) AS r FROM m WHERE tp > 0)
SELECT step / 100e0 AS margin, tp, fp, round(2 * p * r / (p + r), 6) AS f1 FROM f WHERE p > 0.2 ORDER BY 4 DESC, step LIMIT 1""")
def margin_search(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.margin_search(sample(spark, d), 0.2)


@query(f"""WITH {_SAMPLE}, b AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM sample GROUP BY 1), w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b),
t AS (SELECT CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(neg) AS DOUBLE) AS n, sum(pos * (below + 0.5e0 * neg)) / (sum(pos) * sum(neg)) AS auc FROM w),
l AS (SELECT *, auc - 1.96e0 * sqrt((auc * (1 - auc) + (p - 1) * (auc / (2 - auc) - auc * auc) + (n - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (p * n)) AS low FROM t)
SELECT round(auc, 6) AS auc, round(low, 6) AS low, low > 0.5 AND n >= 30 AS publish FROM l""")
def publication_gate(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.publishable(sample(spark, d), F.lit(0.5))


@query("""WITH m AS (SELECT event_id AS id, least(1e0, (event_id % 5) / 3e0) * 0.3e0 + least(1e0, (event_id % 4) / 3e0) * 0.25e0 + least(1e0, (event_id % 3) / 2e0) * 0.2e0 + least(1e0, (event_id % 7) / 2e0) * 0.15e0 + least(1e0, (event_id % 2) / 2e0) * 0.1e0 AS s FROM events)
SELECT id, round(CASE WHEN id % 11 = 0 THEN 0e0 ELSE s END, 6) AS latent, CASE WHEN round(CASE WHEN id % 11 = 0 THEN 0e0 ELSE s END, 6) >= 0.75e0 AND id % 3 > 0 THEN 1 ELSE 0 END AS label FROM m""")
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    marks = [(n % k).alias(c) for c, k in zip(telemetry.MARKS, (5, 4, 3, 7, 2), strict=True)]
    return telemetry.judged(tables.read(spark, d, "events").select(n.alias("id"), *marks, (n % 11 == 0).alias("veto"), (n % 3 > 0).alias("entailed"))).select("id", "latent", "label")


@query(f"WITH {_EXPECT} SELECT name AS entity, 'probe:' || name || ':last_observed' AS key, round(value, 9) AS value, 3600 AS ttl, 'observed_state' AS predicate, error > 0.5 AS settle FROM errs JOIN halves USING (name) WHERE error > 0.1")
def sensing_verdicts(spark: SparkSession, d: str) -> DataFrame:
    found = analytics_queries.errors(spark, d).select(F.col("name").alias("entity"), "level", F.round("value", 9).alias("observed"), "expected")
    return telemetry.sensing_verdicts(found)


@query("SELECT event_id, round(avg(value) OVER w, 9) AS window_mean, count(value) OVER w AS window_n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def rolling_errors(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.rolling(tables.read(spark, d, "events"), "user_id", "event_id", "value", 100).select("event_id", "window_mean", "window_n")


@query("""SELECT c_custkey AS id, ['port', 'value', 'value', 'tags'][c_custkey % 4 + 1] <> ['value', 'port', 'value', 'version'][c_custkey % 4 + 1] AND c_custkey % 4 <> 2 AS blocked FROM customer""")
def orthogonal_slots(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("c_custkey") % 4 + 1).cast("int")
    a, b = (F.element_at(F.array(*map(F.lit, x)), k) for x in (["fact:a:port", "fact:a", "a", "fact:a:tags"], ["fact:a:value", "fact:a:port", "b", "fact:a:version"]))
    return telemetry.orthogonal(tables.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), a.alias("a"), b.alias("b"))).select("id", "blocked")


@query(with_tables("SELECT key FROM facts WHERE (confidence < 0.6e0 OR (doc_id % 3 > 0 AND importance < 0.95e0 AND importance / 4 < 0.15e0)) AND NOT (source_type = 'user_explicit' AND confidence >= 0.99e0)", "facts"))
def forgotten_facts(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.forgotten(tables.facts(spark, d).withColumn("state", F.col("doc_id") % 3 == 0), F.col("importance") / 4, 0.6).select("key")


@query("""SELECT c_custkey % 7 AS session, 'fact:svc' || c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN 'purge' ELSE 'consolidated' END AS fate FROM customer""")
def session_reconciled(spark: SparkSession, d: str) -> DataFrame:
    c = tables.read(spark, d, "customer")
    touched = c.select((F.col("c_custkey") % 7).alias("session"), F.concat(F.lit("fact:svc"), "c_custkey").alias("key"))
    facts = c.select(F.concat(F.lit("rule:svc"), "c_custkey", F.lit(" v1.2")).alias("key"), (F.col("c_custkey") % 5 == 0).alias("superseded"))
    return telemetry.session_reconciled(touched, facts)


@query(f"""WITH {_RUNS}, p AS (SELECT signature, count(*) AS runs, avg(CASE WHEN success THEN 1e0 ELSE 0e0 END) AS rate FROM runs GROUP BY 1)
SELECT 'sop_' || left(sha256(signature), 8) AS id, runs FROM p WHERE runs >= greatest(2, ceil(0.5e0 * log2((SELECT count(DISTINCT session) FROM runs)))) AND rate >= 0.9e0 AND runs >= 5 AND signature NOT LIKE 'view%'""")
def proposed_procedures(spark: SparkSession, d: str) -> DataFrame:
    mined = analytics.mined_procedures(analytics_queries.runs(spark, d), alpha=0.5)
    return telemetry.proposed_procedures(mined, mined.where("signature LIKE 'view%'"), tables.read(spark, d, "customer").select("c_name")).select("id", "runs")


@query(with_tables("SELECT split_part(key, ':', 1) AS space, source_type, count(*) AS facts, count(*) FILTER (regexp_matches(lower(key), '^(rule|user_rule|user:rule|preference|constraint):') OR contains(lower(key), ':rule:')) AS rules FROM facts GROUP BY ROLLUP (split_part(key, ':', 1), source_type)", "facts"))
def fact_rollup(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.rollup_counts(tables.facts(spark, d))
