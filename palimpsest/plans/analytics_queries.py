"""Queries of procedures, sensing, calibration, vectors, replicas and consolidation."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import analytics
from palimpsest.plans import tables
from palimpsest.plans.registry import query
from palimpsest.plans.tables import with_tables


def runs(spark: SparkSession, d: str) -> DataFrame:
    events = tables.read(spark, d, "events")
    steps = events.select(F.col("user_id").alias("session"), F.to_date("ts").alias("day"), F.col("event_id").alias("seq"), F.col("event_type").alias("tool"))
    return analytics.trajectories(steps)


_RUNS = "runs AS (SELECT user_id AS session, CAST(ts AS DATE) AS day, string_agg(event_type, '->' ORDER BY event_id) AS signature, count(*) AS steps, count(*) FILTER (event_type = 'error') = 0 AS success FROM events GROUP BY 1, 2)"


@query(
    f"""WITH {_RUNS} SELECT signature, count(*) AS runs, round(avg(CASE WHEN success THEN 1e0 ELSE 0e0 END), 6) AS rate, 'sop_' || left(sha256(signature), 8) AS id FROM runs GROUP BY signature
HAVING count(*) >= greatest(2, ceil(0.5e0 * log2((SELECT count(DISTINCT session) FROM runs)))) AND avg(CASE WHEN success THEN 1e0 ELSE 0e0 END) >= 0.7e0"""
)
def procedure_mining(spark: SparkSession, d: str) -> DataFrame:
    return analytics.mined_procedures(runs(spark, d), alpha=0.5)


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 6) AS deviation, min(value) AS least, max(value) AS greatest FROM events GROUP BY 1")
def param_distribution(spark: SparkSession, d: str) -> DataFrame:
    return analytics.distribution(tables.read(spark, d, "events"), "event_type", "value")


_REWARDS = "rewards AS (SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'error' THEN -1e0 WHEN 'purchase' THEN 1e0 WHEN 'click' THEN 0.1e0 ELSE -0.05e0 END AS reward FROM events)"


@query(f"WITH {_REWARDS} SELECT session, count(*) AS steps, round(sum(reward), 4) AS total, (avg(reward) >= 0 AND arg_max(reward, seq) >= 0) OR sum(reward) > 1e-9 AS success FROM rewards GROUP BY 1")
def session_success(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    reward = F.when(kind == "error", -1.0).when(kind == "purchase", 1.0).when(kind == "click", 0.1).otherwise(-0.05)
    return analytics.session_success(tables.read(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), reward.alias("reward")))


_EXPECT = """halves AS (SELECT user_id || ':' || event_type AS name, avg(value) FILTER (ts < TIMESTAMP '2024-01-15') AS expected, avg(value) FILTER (ts >= TIMESTAMP '2024-01-15') AS value FROM events GROUP BY 1),
errs AS (SELECT name, round(abs(value - expected) / greatest(abs(expected), abs(value), 1e0), 6) AS error FROM halves WHERE expected IS NOT NULL AND value IS NOT NULL)"""


def errors(spark: SparkSession, d: str) -> DataFrame:
    named = tables.read(spark, d, "events").withColumn("name", F.concat_ws(":", "user_id", "event_type"))
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    mean = lambda df, c: df.groupBy("name").agg(F.avg("value").alias(c)).where(F.col(c).isNotNull())
    return analytics.discrepancy(mean(named.where(early), "expected"), mean(named.where(~early), "value"))


@query(f"WITH {_EXPECT} SELECT name, error, CASE WHEN error <= 0.1 THEN 'none' WHEN error <= 0.5 THEN 'moderate' ELSE 'critical' END AS level FROM errs")
def expectation_vs_observation(spark: SparkSession, d: str) -> DataFrame:
    return errors(spark, d).select("name", "error", "level")


@query(
    f"""WITH {_EXPECT}, e AS (SELECT split_part(name, ':', 1) AS entity, avg(error * error) AS t FROM errs GROUP BY 1), s AS (SELECT split_part(name, ':', 1) AS entity, count(*) AS n FROM errs WHERE error <= 0.1 GROUP BY 1)
SELECT entity, coalesce(n, 0) AS successes, round(t * pow(0.75e0, coalesce(n, 0)), 6) AS temperature FROM e LEFT JOIN s USING (entity)"""
)
def entity_temperature(spark: SparkSession, d: str) -> DataFrame:
    found = errors(spark, d).withColumn("entity", F.split("name", ":")[0])
    return analytics.temperature(found, found.where("level = 'none'"))


@query("SELECT 'u' || user_id AS peer, count(*) AS claims, round(avg(CASE WHEN event_type <> 'error' AND event_type <> 'view' THEN 1e0 ELSE 0e0 END), 6) AS score, avg(CASE WHEN event_type <> 'error' AND event_type <> 'view' THEN 1e0 ELSE 0e0 END) >= 0.5 AS trusted FROM events GROUP BY 1")
def peer_reputation(spark: SparkSession, d: str) -> DataFrame:
    claims = tables.read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("peer"), (~F.col("event_type").isin("error", "view")).alias("valid"))
    return analytics.reputation(claims)


@query(
    with_tables(
        r"""WITH g AS (SELECT sha256(trim(regexp_replace(value, '\s+', ' ', 'g'))) AS hash, key, ts, CASE WHEN starts_with(key, 'rule:') THEN 3 WHEN starts_with(key, 'fact:') THEN 2 ELSE 1 END AS tier FROM facts)
SELECT hash, count(*) AS size, arg_max(key, {'a': tier, 'b': ts, 'c': length(key), 'd': key}) AS keep FROM g GROUP BY hash HAVING count(*) > 1""",
        "facts",
    )
)
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return analytics.duplicate_groups(tables.facts(spark, d))


@query(
    r"""WITH t AS (SELECT source, term, count(*) AS tf FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) WHERE length(term) >= 3 GROUP BY 1, 2),
g AS (SELECT term, sum(tf) AS gf FROM t GROUP BY 1), w AS (SELECT source, term, round(tf * ln(1e0 + (SELECT count(*) FROM documents) / CAST(gf + 1 AS DOUBLE)), 6) AS weight FROM t JOIN g USING (term))
SELECT source, term, weight, CAST(row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS INTEGER) AS rank FROM w QUALIFY rank <= 2"""
)
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    from palimpsest.functions.text import tokens

    docs = tables.read(spark, d, "documents")
    terms = docs.select("source", F.explode(tokens(F.col("text"))).alias("term")).groupBy("source", "term").agg(F.count("*").alias("tf"))
    return analytics.cluster_labels(docs, "source", terms)


_SAMPLE = "sample AS (SELECT l.quality AS label, least(1e0, round(ln(1 + n_chars) / 11e0, 3)) AS score FROM documents JOIN labels l USING (doc_id))"


def sample(spark: SparkSession, d: str) -> DataFrame:
    score = F.least(F.lit(1.0), F.round(F.log(1 + F.col("n_chars")) / 11.0, 3))
    return tables.read(spark, d, "documents").join(tables.read(spark, d, "labels"), "doc_id").select(F.col("quality").alias("label"), score.alias("score"))


@query(
    f"""WITH {_SAMPLE}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS k, avg(label) AS acc, avg(score) AS conf FROM sample GROUP BY 1),
a AS (SELECT sum(CASE WHEN p.score > n.score THEN 1e0 WHEN p.score = n.score THEN 0.5e0 ELSE 0e0 END) AS u FROM sample p, sample n WHERE p.label = 1 AND n.label = 0)
SELECT count(*) AS n, round(avg((score - label) * (score - label)), 6) AS brier, round((SELECT sum(k * abs(acc - conf)) FROM b) / count(*), 6) AS ece, round((SELECT u FROM a) / (sum(label) * sum(1 - label)), 6) AS auc FROM sample"""
)
def brier_ece_auc(spark: SparkSession, d: str) -> DataFrame:
    return analytics.calibration_metrics(sample(spark, d))


@query(
    f"""WITH {_SAMPLE}, g AS (SELECT unnest(range(5, 111)) AS step), m AS (SELECT step, count(*) FILTER (label = 1 AND floor(round(score * 100, 6)) >= step) AS tp, count(*) FILTER (label = 0 AND floor(round(score * 100, 6)) >= step) AS fp FROM g, sample GROUP BY step)
SELECT step / 100e0 AS threshold, tp, fp, fp + (SELECT sum(label) FROM sample)::BIGINT - tp AS cost FROM m WHERE tp + fp > 0 AND tp / CAST(tp + fp AS DOUBLE) > 0.85e0 ORDER BY cost, tp DESC, step LIMIT 1"""
)
def threshold_search(spark: SparkSession, d: str) -> DataFrame:
    return analytics.threshold_search(sample(spark, d), 0.85)


@query("SELECT event_type, round(quantile_cont(value, 0.5e0), 6) AS p50, round(quantile_cont(value, 0.9e0), 6) AS p90, round(quantile_cont(value, 0.99e0), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", p), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)])


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
_COS = f"round({_DOT.format(a='a.embedding', b='b.embedding')} / (sqrt({_DOT.format(a='a.embedding', b='a.embedding')}) * sqrt({_DOT.format(a='b.embedding', b='b.embedding')})), 6)"


@query(f"SELECT a.label, a.vec_id AS a, b.vec_id AS b, {_COS} AS cos FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS} >= 0.2")
def cosine_pairs_blocked(spark: SparkSession, d: str) -> DataFrame:
    return analytics.blocked_pairs(vectors(spark, d), "label", 0.2)


@query(f"WITH p AS (SELECT b.vec_id AS query_id, a.vec_id AS id, {_COS} AS cos FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, id, cos, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS INTEGER) AS rank FROM p WHERE cos >= 0.1 QUALIFY rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return analytics.dense_top_k(v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query")), v.select("id", "vector"), 10, 0.1)


@query(
    """WITH o AS (SELECT user_id AS element, event_type, {'info': round(value, 6), 'clock': event_id % 7, 'ts': ts, 'node': 'n' || (event_id % 3)} AS o FROM events WHERE value IS NOT NULL),
a AS (SELECT element, max(o) AS a FROM o WHERE event_type <> 'error' GROUP BY 1), r AS (SELECT element, max(o) AS r FROM o WHERE event_type = 'error' GROUP BY 1)
SELECT coalesce(a.element, r.element) AS element, a.a IS NOT NULL AND (r.r IS NULL OR a.a >= r.r) AS present, a.a.node AS added_by, r.r.node AS removed_by FROM a FULL JOIN r ON a.element = r.element"""
)
def lww_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "events").where("value is not null").select(F.col("user_id").alias("element"), F.col("value").alias("info"), (F.col("event_id") % 7).alias("clock"), "ts", F.concat(F.lit("n"), F.col("event_id") % 3).alias("node"), "event_type")
    return analytics.lww_merge(rows.where("event_type <> 'error'"), rows.where("event_type = 'error'"))


@query(
    """WITH c AS (SELECT user_id AS doc, event_type AS node, count(*) FILTER (event_id % 2 = 0) AS x, count(*) FILTER (event_id % 2 = 1) AS y FROM events GROUP BY 1, 2)
SELECT doc, CASE WHEN bool_and(x <= y) AND bool_and(x >= y) THEN 'equal' WHEN bool_and(x <= y) THEN 'before' WHEN bool_and(x >= y) THEN 'after' ELSE 'concurrent' END AS relation, CAST(sum(greatest(x, y)) AS BIGINT) AS merged FROM c GROUP BY doc"""
)
def clock_relation(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("node"), "event_id")
    part = lambda k: rows.where(F.col("event_id") % 2 == k).groupBy("doc", "node").count()
    return analytics.clock_relation(part(0), part(1))


@query(
    with_tables(
        """WITH p AS (SELECT seq, key, value AS new_conf, lag(value) OVER w AS old_conf, event_type AS new_source, seq AS new_ts, lag(seq) OVER w AS old_ts, seq % 4 AS a, lag(seq % 4) OVER w AS b FROM states WHERE value IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY seq)),
q AS (SELECT seq, key, new_conf, old_conf, new_ts, old_ts, [2.5e0, 1.5e0, 1.2e0, 1.0e0][a + 1] * new_conf AS n, [2.5e0, 1.5e0, 1.2e0, 1.0e0][b + 1] * old_conf AS o FROM p WHERE old_conf IS NOT NULL)
SELECT seq, key, CASE WHEN n > o + 0.05e0 THEN true WHEN o > n + 0.05e0 THEN false WHEN new_ts <> old_ts THEN new_ts > old_ts ELSE new_conf >= old_conf END AS new_wins FROM q""",
        "states",
    )
)
def precision_arbitration(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("seq")
    kind = F.element_at(F.array(*map(F.lit, ["user_explicit", "tool_output", "external_doc", "agent_inference"])), (F.col("seq") % 4 + 1).cast("int"))
    rows = tables.states(spark, d).where("value is not null").select("seq", "key", F.col("value").alias("new_conf"), kind.alias("new_source"), F.col("seq").alias("new_ts"))
    pairs = rows.withColumns({f"old_{c}": F.lag(f"new_{c}").over(w) for c in ("conf", "source", "ts")}).where("old_conf is not null")
    return analytics.arbitrated(pairs).select("seq", "key", "new_wins")


@query(
    """WITH n AS (SELECT conv_id, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 8 AS w FROM conversations), m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, w ORDER BY turn) AS i FROM n)
SELECT conv_id, w AS "window", string_agg(text, chr(10) ORDER BY turn) FILTER (i <= 4) AS summary, CAST(greatest(count(*) - 4, 0) AS INTEGER) AS omitted FROM m GROUP BY 1, 2"""
)
def turn_compaction(spark: SparkSession, d: str) -> DataFrame:
    return analytics.compacted(tables.read(spark, d, "conversations").select("conv_id", "turn", "text"))


@query("SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    events = tables.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = events.groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))
    return found.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "events")
