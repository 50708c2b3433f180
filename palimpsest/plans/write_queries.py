"""Queries of the write path, replicas and buffers."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import writes
from palimpsest.operators.steps import shared_folder
from palimpsest.plans import tables
from palimpsest.plans.gate_queries import _DISCOURSE, _HEADS, valid_sql
from palimpsest.plans.registry import query
from palimpsest.plans.tables import with_tables
from palimpsest.sources import vectors


@query("SELECT c_name AS key FROM customer WHERE c_custkey % 4 = 0 AND c_acctbal > 0")
def existing_keys(spark: SparkSession, d: str) -> DataFrame:
    customers = tables.read(spark, d, "customer").select(F.col("c_name").alias("key"), "c_custkey", "c_acctbal")
    wanted = customers.where("c_custkey % 4 = 0").select("key").unionByName(customers.select(F.concat("key", F.lit("?")).alias("key")))
    return writes.existing(wanted, customers.where("c_acctbal > 0"))


@query(
    with_tables(
        rf"""WITH asked AS (SELECT 'fact:' || query_id || ':' || split_part(query, ' ', 1) AS in_key, query AS in_value, 'fact:' || query_id AS root FROM questions),
w AS (SELECT DISTINCT in_key, unnest(list_filter(regexp_extract_all(lower(concat_ws(' ', in_key, in_value)), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 4)[1:6]) AS term FROM asked),
held AS (SELECT DISTINCT key, unnest(regexp_extract_all(lower(concat_ws(' ', key, value)), '[\p{{L}}\p{{N}}]+')) AS token FROM facts),
f AS (SELECT in_key, key, 2 AS stage FROM asked JOIN facts ON starts_with(key, root || ':') UNION ALL SELECT in_key, key, 3 FROM w JOIN held ON starts_with(token, term)),
g AS (SELECT in_key, key, min(stage) AS stage FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY in_key ORDER BY stage, key) AS rank FROM g)
SELECT in_key, key, stage, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 200""",
        "facts",
        "questions",
    )
)
def conflict_candidates(spark: SparkSession, d: str) -> DataFrame:
    asked = tables.questions(spark, d).select(F.concat(F.lit("fact:"), "query_id", F.lit(":"), F.split("query", " ")[0]).alias("in_key"), F.col("query").alias("in_value"))
    return writes.conflict_candidates(asked, tables.facts(spark, d).select("key", "value"))


@query(with_tables("""SELECT f.key, importance > 0.7 AS superseded, CASE WHEN importance > 0.7 THEN 'w' || doc_id END AS winner, 'k' AS kind FROM facts f""", "facts"))
def superseded_marks(spark: SparkSession, d: str) -> DataFrame:
    facts = tables.facts(spark, d)
    stored = facts.select("key", F.create_map(F.lit("kind"), F.lit("k")).alias("metadata"))
    losers = facts.where("importance > 0.7").select("key", F.concat(F.lit("w"), "doc_id").alias("winner"), F.lit("older").alias("reason"))
    return writes.superseded(stored, losers, F.lit(tables.AS_OF)).select("key", "superseded", F.try_element_at("metadata", F.lit("superseded_by")).alias("winner"), F.col("metadata")["kind"].alias("kind"))


@query(with_tables(f"SELECT key, CASE WHEN doc_id % 4 > 1 THEN {tables.AS_OF} + (doc_id % 4) * 100 END AS expires_at, doc_id % 4 > 1 AS is_temporary FROM facts", "facts"))
def ttl_marks(spark: SparkSession, d: str) -> DataFrame:
    ttl = F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, 0).otherwise(F.col("doc_id") % 4 * 100)
    return writes.with_ttl(tables.facts(spark, d).withColumn("ttl", ttl), F.lit(tables.AS_OF).cast("long")).select("key", "expires_at", "is_temporary")


@query(with_tables("SELECT 1000000 + max(seq) AS seq, key, '__DELETED__' AS value, 'delete' AS reason FROM states WHERE user_id % 3 = 0 GROUP BY key HAVING NOT starts_with(key, 'fact:')", "states"))
def guarded_deletes(spark: SparkSession, d: str) -> DataFrame:
    states = tables.states(spark, d)
    stored = states.groupBy("key").agg(F.max("seq").alias("seq"))
    wanted = states.where("user_id % 3 = 0").select("key").unionByName(states.select(F.concat(F.lit("fact:"), "key").alias("key")))
    return writes.deleted(stored, wanted, F.lit(1_000_000).cast("long"))


@query("SELECT event_id AS seq, CASE WHEN event_id % 7 = 0 THEN event_id % 2 = 0 ELSE event_id % 5 <> 0 END AS holds FROM events")
def redaction_check(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("u:"), "user_id").alias("key"), "event_type")
    value = F.when(F.col("seq") % 7 == 0, F.concat(F.lit("[REDACTED-"), "seq", F.lit("]"))).when(F.col("seq") % 5 == 0, "forged").otherwise(F.col("event_type"))
    ledger = e.select("seq", "key", value.alias("value"), F.sha2("event_type", 256).alias("value_hash"))
    return writes.redactions(ledger, ledger.where("seq % 2 = 0")).select("seq", "holds")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)")
def replay_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.read(spark, d, "documents").select("doc_id", "text").where("text is not null")
    return writes.unseen(docs, docs.where("doc_id % 3 = 0").select("text")).select("doc_id")


@query("""SELECT event_id AS id, 0 AS at, 'states' AS kind, 'port' || user_id AS subject, CAST(event_id % 90 AS VARCHAR) AS object FROM events WHERE event_id % 3 < 2
UNION ALL SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END, 'sets', 'tryb', event_type FROM events WHERE event_id % 3 > 0""")
def told_facts(spark: SparkSession, d: str) -> DataFrame:
    states = F.concat(F.lit("Port"), "user_id", F.lit(" jest "), F.col("event_id") % 90, F.lit(". "))
    sets = F.concat(F.lit("Ustaw tryb na "), "event_type", F.lit("!"))
    m = F.col("event_id") % 3
    text = F.concat(F.when(m < 2, states).otherwise(F.lit("")), F.when(m > 0, sets).otherwise(F.lit("")))
    return writes.told_facts(tables.read(spark, d, "events").select(F.col("event_id").alias("id"), text.alias("text")))


@query(with_tables(f"""WITH {_HEADS} SELECT id, CASE WHEN source = 'user_explicit' THEN 'shadow_inference' ELSE source END AS source FROM heads
WHERE NOT ({_DISCOURSE} OR contains(object, '?') OR contains(predicate, '?')) AND (id % 4 <> 0 OR id % 3 < 2)""", "triples"))
def shadow_reconcile(spark: SparkSession, d: str) -> DataFrame:
    action = F.element_at(F.array(*map(F.lit, ["accept", "supersede", "warn_conflict"])), (F.col("id") % 3 + 1).cast("int"))
    return writes.reconciled(tables.triples(spark, d).withColumns({"is_state": F.col("id") % 4 == 0, "action": action})).select("id", "source")


@query(with_tables("""WITH s AS (SELECT subject, predicate, arg_max(object, id) AS o, arg_max(confidence, id) AS c FROM triples WHERE id % 2 = 0 GROUP BY 1, 2)
SELECT id, t.subject, t.predicate, object AS new_object, o AS old_object, round(c, 6) AS old_confidence FROM triples t JOIN s ON t.subject = s.subject AND t.predicate = s.predicate WHERE id % 2 = 1 AND starts_with(t.predicate, 'is_') AND object <> o""", "triples"))
def functional_conflicts(spark: SparkSession, d: str) -> DataFrame:
    claims = tables.triples(spark, d)
    stored = claims.where("id % 2 = 0").groupBy("subject", "predicate").agg(*[F.max_by(c, "id").alias(c) for c in ("object", "confidence", "source", "ts")])
    return writes.functional_conflicts(claims.where("id % 2 = 1"), stored).select("id", "subject", "predicate", "new_object", "old_object", F.round("old_confidence", 6).alias("old_confidence"))


@query(with_tables("""WITH n AS (SELECT key, max(seq) FILTER (seq % 10 <> 0) AS seq, max(seq) AS top FROM states GROUP BY key)
SELECT key, seq, CASE WHEN seq IS NULL THEN 'missing' WHEN seq = top THEN 'same' ELSE 'differs' END AS audit FROM n""", "states"))
def latest_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.states(spark, d).select("key", "seq", F.sha2(F.col("seq").cast("string"), 256).alias("value_hash"))
    stored = rows.groupBy("key").agg(F.max_by("value_hash", "seq").alias("value_hash"))
    return writes.latest_audit(stored, rows.where("seq % 10 <> 0"))


@query("""WITH e AS (SELECT event_id AS id, event_id % 3 AS m, 'u' || user_id AS u, event_type AS t FROM events)
SELECT id, u AS src, 'leads_to' AS predicate, t AS dst FROM e WHERE m = 0 UNION ALL SELECT id, t, 'leads_to', 'end' || id FROM e WHERE m = 0
UNION ALL SELECT id, u, 'kind', t FROM e WHERE m = 1 UNION ALL SELECT id, u, 'value', 'x' || chr(10) || t FROM e WHERE m = 2""")
def value_edges(spark: SparkSession, d: str) -> DataFrame:
    e, m, u = tables.read(spark, d, "events"), F.col("event_id") % 3, F.concat(F.lit("u"), "user_id")
    value = F.when(m == 0, F.concat(u, F.lit(" -> "), "event_type", F.lit("->end"), "event_id")).when(m == 1, F.col("event_type")).otherwise(F.concat(F.lit("x\n"), "event_type"))
    return writes.value_edges(e.select(F.col("event_id").alias("id"), F.when(m == 1, F.concat(F.lit("fact:"), u, F.lit(":kind"))).otherwise(u).alias("key"), value.alias("value")))


RULES = {"requires": r"([\p{L}\p{N}_]+) requires ([\p{L}\p{N}_]+(?:\s*[,+;]\s*[\p{L}\p{N}_]+)*)", "depends_on": r"([\p{L}\p{N}_]+) depends on ([\p{L}\p{N}_]+(?:\s*[,+;]\s*[\p{L}\p{N}_]+)*)"}


@query("""SELECT event_id AS id, 'svc' || user_id AS src, 'requires' AS predicate, unnest([event_type, 'db' || event_id % 9, 'cache']) AS dst FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, event_type, 'depends_on', 'svc' || user_id FROM events""")
def rule_relations(spark: SparkSession, d: str) -> DataFrame:
    needs = F.concat(F.lit("Svc"), "user_id", F.lit(" requires "), "event_type", F.lit(", db"), F.col("event_id") % 9, F.lit(" + cache. "))
    text = F.concat(F.when(F.col("event_id") % 2 == 0, needs).otherwise(F.lit("")), "event_type", F.lit(" depends on svc"), "user_id", F.lit("."))
    return writes.rule_relations(tables.read(spark, d, "events").select(F.col("event_id").alias("id"), text.alias("text")), RULES)


@query("""SELECT p_partkey AS id, p_name AS src, 'defines_item' AS predicate, unnest(['Brand', 'size']) AS dst FROM part
UNION ALL SELECT p_partkey, 'Brand', 'has_spec', p_brand FROM part UNION ALL SELECT p_partkey, 'size', 'has_spec', CAST(p_size AS VARCHAR) || ' mm: wide' FROM part""")
def bullet_relations(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("About it\n- Brand: "), "p_brand", F.lit("\n  * size :  "), "p_size", F.lit(" mm: wide\nplain: line"))
    return writes.bullet_relations(tables.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("subject"), text.alias("text")))


_KEPT = f"({valid_sql('subject')} AND {valid_sql('object')} AND NOT {_DISCOURSE})"


@query(
    with_tables(
        f"""WITH {_HEADS}, gone AS (SELECT subject AS name FROM heads WHERE NOT {_KEPT} UNION SELECT object FROM heads WHERE NOT {_KEPT}), kept AS (SELECT subject, predicate, object, max(confidence) AS confidence, max(ts) AS ts FROM heads WHERE {_KEPT} GROUP BY 1, 2, 3)
SELECT *, subject IN (SELECT name FROM gone) OR object IN (SELECT name FROM gone) AS partial FROM kept""",
        "triples",
    )
)
def hydrated_graph(spark: SparkSession, d: str) -> DataFrame:
    return writes.hydrated(tables.triples(spark, d))


@query("""WITH a AS (SELECT event_type || ':' || user_id AS element, max(ts) AS ts FROM events WHERE event_id % 2 = 0 GROUP BY 1), r AS (SELECT event_type || ':' || user_id AS element, max(ts) AS ts FROM events WHERE event_id % 2 = 1 GROUP BY 1),
t AS (SELECT TIMESTAMP '2024-01-30' - INTERVAL 20 DAY AS cut)
SELECT element, true AS added, ts FROM a WHERE NOT EXISTS (SELECT 1 FROM r, t WHERE r.element = a.element AND r.ts < cut AND a.ts <= r.ts) UNION ALL SELECT element, false, ts FROM r, t WHERE ts >= cut""")
def tombstone_gc(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").select(F.concat_ws(":", "event_type", "user_id").alias("element"), "ts", "event_id")
    newest = lambda n: e.where(F.col("event_id") % 2 == n).groupBy("element").agg(F.max("ts").alias("ts"))
    adds, removes = writes.collected_tombstones(newest(0), newest(1), F.lit("2024-01-30").cast("timestamp_ntz"), F.expr("interval 20 days"))
    return adds.select("element", F.lit(True).alias("added"), "ts").unionByName(removes.select("element", F.lit(False).alias("added"), "ts"))


@query("""WITH l AS (SELECT c_custkey AS key, c_mktsegment AS value, (c_custkey * 7 % 100) / 100e0 AS info FROM customer WHERE c_custkey % 3 > 0),
p AS (SELECT c_custkey AS key, 'p' || c_custkey AS value, (c_custkey * 13 % 100) / 100e0 AS info, c_custkey % 5 = 0 AS deleted FROM customer WHERE c_custkey % 2 = 0 AND NOT (c_nationkey % 4 = 1 AND c_custkey <= 100)),
j AS (SELECT coalesce(l.key, p.key) AS key, l.value AS lv, p.value AS pv, l.info AS li, p.info AS pi, p.deleted, p.key IS NOT NULL AND (l.info IS NULL OR p.info >= l.info - 1e-6) AS takes FROM l FULL JOIN p ON l.key = p.key)
SELECT key, CASE WHEN takes THEN pv ELSE lv END AS value, CASE WHEN takes THEN pi ELSE li END AS info FROM j WHERE NOT (takes AND deleted)""")
def delta_apply(spark: SparkSession, d: str) -> DataFrame:
    c, k = tables.read(spark, d, "customer"), F.col("c_custkey")
    local = c.where("c_custkey % 3 > 0").select(k.alias("key"), F.col("c_mktsegment").alias("value"), (k * 7 % 100 / 100.0).alias("info"))
    peer = F.concat(F.lit("peer"), F.col("c_nationkey") % 4)
    delta = c.where("c_custkey % 2 = 0").select(peer.alias("peer"), k.alias("clock"), k.alias("key"), F.concat(F.lit("p"), k).alias("value"), (k * 13 % 100 / 100.0).alias("info"), (k % 5 == 0).alias("deleted"))
    return writes.applied_delta(local, delta, spark.createDataFrame([("peer1", 100)], "peer string, clock long"))


@query("""WITH r AS (SELECT user_id AS run, max(event_id) AS last_step FROM events GROUP BY 1) SELECT 'on' AS mark, * FROM (SELECT run, last_step FROM r WHERE last_step > 500 ORDER BY last_step DESC, run LIMIT 200)
UNION ALL SELECT 'stale', * FROM (SELECT run, last_step FROM r ORDER BY last_step DESC, run LIMIT 200)""")
def sleep_batch(spark: SparkSession, d: str) -> DataFrame:
    runs = tables.read(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.max("event_id").alias("last_step"))
    cases = [writes.sleep_batch(runs, mark).select(F.lit(name).alias("mark"), "run", "last_step") for name, mark in (("on", 500), ("stale", 10**12))]
    return cases[0].unionByName(cases[1])


@query("""SELECT origin, count(*) AS records, min(subject) AS least, round(avg(confidence), 6) AS confidence FROM (
  SELECT 'working' AS origin, 'conv:' || conv_id || ':' || turn AS subject, text, 0.6e0 AS confidence FROM conversations UNION ALL SELECT 'facts', 'doc:' || doc_id, text, 0.7e0 FROM documents
  UNION ALL SELECT 'canonical', p_name, p_brand, 0.9e0 FROM part WHERE p_size < 10 UNION ALL SELECT 'episodic', 'item:' || item_id, text, 0.5e0 FROM benchmark) WHERE trim(text) <> '' GROUP BY 1""")
def source_union(spark: SparkSession, d: str) -> DataFrame:
    read = lambda name: tables.read(spark, d, name)
    shaped = lambda df, subject, text, conf: df.select(subject.alias("subject"), F.col(text).alias("text"), F.lit(conf).alias("confidence"), F.lit(tables.EPOCH).alias("ts"))
    rows = writes.unified(
        [
            ("working", shaped(read("conversations"), F.concat(F.lit("conv:"), "conv_id", F.lit(":"), "turn"), "text", 0.6)),
            ("facts", shaped(read("documents"), F.concat(F.lit("doc:"), "doc_id"), "text", 0.7)),
            ("canonical", shaped(read("part").where("p_size < 10"), F.col("p_name"), "p_brand", 0.9)),
            ("episodic", shaped(read("benchmark"), F.concat(F.lit("item:"), "item_id"), "text", 0.5)),
        ]
    )
    return rows.groupBy("origin").agg(F.count("*").alias("records"), F.min("subject").alias("least"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("""SELECT event_id AS id, ['user_explicit', 'tool_output', 'external_doc', 'agent_inference'][event_id % 4 + 1] AS source_type, greatest(0e0, least(1e0, (event_id % 30 - 5) / 20e0)) AS importance, CASE WHEN event_id % 6 = 0 THEN 0e0 ELSE 1e0 END AS score FROM events""")
def record_cast(spark: SparkSession, d: str) -> DataFrame:
    e, n = tables.read(spark, d, "events"), F.col("event_id")
    trust = F.element_at(F.array(*map(F.lit, ["seen [user] x", "[Tool]", "a[DOC]", "none"])), (n % 4 + 1).cast("int"))
    rows = e.select(n.alias("id"), F.col("event_type").alias("subject"), F.lit("x").alias("text"), trust.alias("trust"), ((n % 30 - 5) / 20.0).alias("importance"), F.when(n % 6 == 0, None).otherwise(F.lit(7.0)).alias("score"))
    return writes.as_records(rows).select("id", "source_type", "importance", "score")


@query("SELECT event_id AS step_id, CAST(user_id AS VARCHAR) AS session_id, value AS reward, CAST(NULL AS DOUBLE) AS uncertainty FROM events")
def buffer_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    steps = tables.read(spark, d, "events").select(F.col("event_id").alias("step_id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("action_name"), F.col("value").alias("reward"))
    path = f"{shared_folder(spark)}/buffer-{uuid.uuid4().hex}"
    writes.dump_buffer(steps, path)
    return writes.load_buffer(spark, path).select("step_id", "session_id", "reward", "uncertainty")


@query(
    """WITH d AS (SELECT 'v' || vec_id AS key, 'text ' || vec_id % 50 AS text, embedding, 1 AS ts FROM embeddings), u AS (SELECT key, CASE WHEN i % 3 = 0 THEN 'new' ELSE text END AS text, CASE WHEN i % 3 = 0 THEN 2 ELSE ts END AS ts, i FROM (SELECT *, CAST(substr(key, 2) AS BIGINT) AS i FROM d))
SELECT key, text, CAST(ts AS BIGINT) AS ts FROM u WHERE NOT (i % 7 = 0 OR starts_with(key, 'v1') OR text = 'text 20')"""
)
def merged_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A table of vectors after upserts, and deletes by key, prefix and text, each applied twice."""
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    i = F.col("vec_id")
    e = tables.read(spark, d, "embeddings").select("vec_id", F.concat(F.lit("v"), i).alias("key"), F.concat(F.lit("text "), i % 50).alias("text"), F.col("embedding").alias("vector"), F.lit(1).cast("long").alias("ts"))
    vectors.created(e, path)
    upserts = e.where("vec_id % 3 = 0").withColumns({"text": F.lit("new"), "ts": F.lit(2).cast("long")})
    none = lambda name: F.lit(None).cast("string").alias(name)
    at = F.lit(3).cast("long").alias("ts")
    deletes = e.where("vec_id % 7 = 0").select("key", none("prefix"), none("text"), at)
    some = e.where("vec_id = 20").select(none("key"), F.lit("v1").alias("prefix"), none("text"), at)
    deletes = deletes.unionByName(some).unionByName(e.where("vec_id = 20").select(none("key"), none("prefix"), "text", at))
    for _ in range(2):
        vectors.merged(spark, path, upserts)
        vectors.merged(spark, path, deletes=deletes)
    return vectors.stored(spark, path).select("key", "text", "ts")
