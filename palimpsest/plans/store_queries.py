"""Queries of the store and text families."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import store
from palimpsest.plans import tables
from palimpsest.plans.registry import query
from palimpsest.plans.tables import with_tables

_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_STARTS = lambda c, xs: f"len(list_filter({_LIST(xs)}, lambda p: starts_with({c}, p))) > 0"
_BARE = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'))"


@query(
    rf"""WITH t AS (SELECT conv_id, turn, text, {_BARE} AS clean, trim(lower(text)) AS low FROM conversations),
w AS (SELECT *, list_filter(regexp_split_to_array(clean, '\s+'), lambda x: x <> '') AS words FROM t)
SELECT conv_id, turn,
  len(list_filter({_LIST(text.TRIVIAL)}, lambda x: clean = x OR starts_with(clean, x || ' '))) > 0
    OR (len(list_filter(words[1:2], lambda x: list_contains({_LIST(text.TRIVIAL)}, x))) > 0 AND len(words) <= 4) AS trivial,
  len(list_filter({_LIST(text.CONTINUATION)}, lambda x: low = x OR starts_with(low, x || ' '))) > 0 AS continuation
FROM w"""
)
def trivial_gate(spark: SparkSession, d: str) -> DataFrame:
    turns = tables.read(spark, d, "conversations")
    return turns.select("conv_id", "turn", text.is_trivial(F.col("text")).alias("trivial"), text.is_continuation(F.col("text")).alias("continuation"))


@query(
    r"""WITH t AS (SELECT page_id, trim(url) AS q, regexp_split_to_array(trim(url), '\s+') AS w FROM pages
  UNION ALL SELECT 1000000000 + item_id, trim(text[1:40]), regexp_split_to_array(trim(text[1:40]), '\s+') FROM benchmark)
SELECT page_id, q <> '' AND ((NOT contains(q, ' ') AND (length(q) > 3 OR regexp_matches(q, '[:_-]')))
  OR (regexp_matches(w[1], '[:_-]') AND NOT ends_with(w[1], ':')) OR (len(w) <= 3 AND NOT contains(q, '?') AND regexp_matches(q, '[:_-]'))) AS symbolic FROM t"""
)
def symbolic_flag(spark: SparkSession, d: str) -> DataFrame:
    pages = tables.read(spark, d, "pages").select("page_id", F.col("url").alias("q"))
    items = tables.read(spark, d, "benchmark").select((F.lit(1_000_000_000) + F.col("item_id")).alias("page_id"), F.substring("text", 1, 40).alias("q"))
    return pages.unionByName(items).select("page_id", text.is_symbolic(F.col("q")).alias("symbolic"))


@query(
    with_tables(
        f"""SELECT key, length(value) AS n_chars FROM facts WHERE NOT ({_STARTS("lower(key)", ["probe:", *store.CONTROL])})
AND NOT (len(list_filter({_LIST(text.CHURN)}, lambda x: contains(lower(key), x) OR contains(lower(value), x))) > 0 OR {_STARTS("lower(key)", text.CHURN_KEYS)})""",
        "facts",
    )
)
def readable_facts(spark: SparkSession, d: str) -> DataFrame:
    return store.readable(tables.facts(spark, d)).select("key", F.length("value").cast("long").alias("n_chars"))


@query(
    with_tables(
        f"""WITH k AS (SELECT key, CASE WHEN starts_with(lower(key), 'session:') THEN string_split(key, ':')[2]
    WHEN {_STARTS("lower(key)", text.PERSISTENT)} THEN 'global' WHEN source_type = 'tool_output' THEN 'default' ELSE 'session_a' || source_type END AS session FROM facts)
SELECT key, session, CASE WHEN session = 'global' THEN true WHEN replace(session, 'session_', '') IN ('default', '') THEN false
  ELSE replace(session, 'session_', '') = 'aexternal_doc' END AS accessible FROM k""",
        "facts",
    )
)
def session_access(spark: SparkSession, d: str) -> DataFrame:
    fallback = F.when(F.col("source_type") == "tool_output", "default").otherwise(F.concat(F.lit("session_a"), F.col("source_type")))
    keyed = tables.facts(spark, d).select("key", text.effective_session(F.col("key"), fallback).alias("session"))
    return keyed.select("key", "session", text.session_accessible(F.col("session"), F.lit("session_aexternal_doc")).alias("accessible"))


@query(
    r"""SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN false ELSE
  regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b')
  OR regexp_matches(text, '(?i)(?:\b|_)(api[-_\s]?key|password|client[-_\s]?secret|app[-_\s]?secret|bearer[-_\s]?token|secret[-_\s]?token|secret[-_\s]?key)(?:\b|_)')
  OR regexp_matches(text, '(?i)\bsecret\s*(?:\b|_)?\s*[:=]\s*\S') OR lower(trim(text)) = 'secret' END AS pii FROM documents"""
)
def pii_scan(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "documents").select("doc_id", text.is_pii(F.col("text")).alias("pii"))


_ROOT = "lower(trim(subject))"
for _pattern, _to in text.ROOT_STEPS:
    _ROOT = f"regexp_replace({_ROOT}, '{_pattern}', '{_to}', 'g')"


@query(f"WITH s AS (SELECT page_id, regexp_replace(url, '^https?://', 'fact:') || ' v1.2 2024-01-05 release main=0873d87' AS subject FROM pages) SELECT page_id, trim({_ROOT}) AS root FROM s")
def entity_roots(spark: SparkSession, d: str) -> DataFrame:
    subject = F.concat(F.regexp_replace("url", "^https?://", "fact:"), F.lit(" v1.2 2024-01-05 release main=0873d87"))
    return tables.read(spark, d, "pages").select("page_id", text.entity_root(subject).alias("root"))


_STEM_SQL = "CASE " + " ".join(f"WHEN ends_with(folded, '{s}') AND length(folded) > {len(s) + 2} THEN left(folded, length(folded) - {len(s)})" for s in text.STEM_SUFFIXES) + " ELSE folded END"


@query(
    rf"""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS low FROM documents),
p AS (SELECT low, translate(low, 'ąćęłńóśźż', 'acelnoszz') AS plain, count(*) AS n FROM t WHERE length(low) >= 3 GROUP BY low),
f AS (SELECT *, CASE WHEN plain <> low THEN replace(plain, 'y', 'i') ELSE plain END AS folded FROM p)
SELECT CASE WHEN list_contains({_LIST(text.PROTECTED_ROOTS)}, low) OR list_contains({_LIST(text.PROTECTED_ROOTS)}, plain) THEN plain ELSE {_STEM_SQL} END AS stem, CAST(sum(n) AS BIGINT) AS n
FROM f GROUP BY 1"""
)
def stem_counts(spark: SparkSession, d: str) -> DataFrame:
    words = tables.read(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("w")).groupBy("w").count()
    return words.select(text.stem(F.col("w")).alias("stem"), "count").groupBy("stem").agg(F.sum("count").alias("n"))


@query(with_tables("SELECT key, seq, value FROM states ORDER BY key, seq LIMIT 500 OFFSET 250", "states"))
def kv_page(spark: SparkSession, d: str) -> DataFrame:
    return store.page(tables.states(spark, d).select("key", "seq", "value"), 500, 250)


@query(
    """WITH k AS (SELECT c_name AS key, c_acctbal AS value FROM customer),
w AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE upper(c_name) END AS key FROM customer WHERE c_custkey % 3 = 0),
e AS (SELECT w.key, w.key AS found, k.value FROM w JOIN k ON w.key = k.key),
l AS (SELECT w.key, k.key AS found, k.value FROM w JOIN k ON lower(w.key) = lower(k.key) WHERE w.key NOT IN (SELECT key FROM k) QUALIFY row_number() OVER (PARTITION BY w.key ORDER BY k.key) = 1)
SELECT * FROM e UNION ALL SELECT * FROM l"""
)
def kv_get_ci(spark: SparkSession, d: str) -> DataFrame:
    customers = tables.read(spark, d, "customer")
    kv = customers.select(F.col("c_name").alias("key"), F.col("c_acctbal").alias("value"))
    wanted = customers.where("c_custkey % 3 = 0").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.upper("c_name")).alias("key"))
    return store.get_ci(kv, wanted)


@query(with_tables("SELECT seq, key, ts FROM (SELECT * FROM states WHERE ts >= TIMESTAMP '2024-01-20' ORDER BY ts DESC, seq DESC LIMIT 1000)", "states"))
def kv_recent(spark: SparkSession, d: str) -> DataFrame:
    return store.recent(tables.states(spark, d).select("seq", "key", "ts"), F.lit("2024-01-20").cast("timestamp_ntz"), 1000)


@query(
    with_tables(
        r"""WITH held AS (SELECT DISTINCT key, unnest(regexp_extract_all(lower(concat_ws(' ', key, value)), '[\p{L}\p{N}]+')) AS token FROM facts),
wanted AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')[1:8]) AS term FROM questions),
found AS (SELECT DISTINCT query_id, key FROM wanted JOIN held ON token[1:3] = term[1:3] AND starts_with(token, term) WHERE length(token) >= 3 AND length(term) >= 3),
n AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY key) AS rank FROM found)
SELECT query_id, key, 3 AS stage, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 500""",
        "facts",
        "questions",
    )
)
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return store.keyword_search(tables.facts(spark, d).select("key", "value"), tables.questions(spark, d))


@query(
    with_tables(
        "SELECT seq, sha256(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)) <> CASE WHEN seq % 97 = 0 THEN 'x' ELSE sha256(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)) END AS tampered FROM states WHERE value IS NOT NULL",
        "states",
    )
)
def tamper_check(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.states(spark, d).where("value is not null").select("seq", F.round(F.col("value") * 100).cast("long").alias("value"))
    rows = rows.withColumn("value_hash", F.when(F.col("seq") % 97 == 0, "x").otherwise(F.sha2(F.col("value").cast("string"), 256)))
    return store.tampered(rows).select("seq", "tampered")


@query(with_tables("SELECT key, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(event_type, seq) AS event_type FROM states GROUP BY key", "states"))
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(tables.states(spark, d).select("key", "seq", "value", "event_type"))


@query(with_tables("SELECT key, max(seq) AS seq FROM states WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR GROUP BY key ORDER BY seq DESC LIMIT 25", "states"))
def hot_ring(spark: SparkSession, d: str) -> DataFrame:
    states = tables.states(spark, d)
    now = F.lit(states.agg(F.max("ts")).first()[0])
    return store.ring(states.select("key", "seq", "ts"), 25, 6 * 3600, now).select("key", "seq")


@query(
    with_tables(
        """WITH l AS (SELECT key, seq, value, lag(value) OVER (PARTITION BY key ORDER BY seq) AS prior_value FROM states),
c AS (SELECT *, CASE WHEN prior_value IS NOT NULL AND prior_value <> value THEN 1 ELSE 0 END AS changed FROM l),
r AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY key ORDER BY seq) AS BIGINT) AS revision FROM c)
SELECT key, seq, value, prior_value, revision FROM r WHERE changed = 1""",
        "states",
    )
)
def state_revisions(spark: SparkSession, d: str) -> DataFrame:
    return store.revisions(tables.states(spark, d).select("key", "seq", "value"))


@query(
    """WITH stored AS (SELECT doc_id AS key, text AS value FROM documents WHERE doc_id % 2 = 0),
incoming AS (SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN text || ' ' WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END AS value FROM documents)
SELECT i.key, CASE WHEN s.value IS NULL THEN 'new' WHEN trim(regexp_replace(s.value, '\\s+', ' ', 'g')) = trim(regexp_replace(i.value, '\\s+', ' ', 'g')) THEN 'unchanged' ELSE 'updated' END AS status
FROM incoming i LEFT JOIN stored s ON i.key = s.key""".replace("\\\\", "\\")
)
def upsert_status(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.read(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("value"))
    changed = F.when(F.col("key") % 3 == 0, F.concat("value", F.lit(" "))).when(F.col("key") % 5 == 0, F.concat("value", F.lit("x"))).otherwise(F.col("value"))
    return store.upsert_status(docs.withColumn("value", changed), docs.where("key % 2 = 0")).select("key", "status")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Per user, a ledger of events in which each entry names the hash of the one before; some are forged."""
    rows = tables.states(spark, d).select("user_id", "seq", "key", F.coalesce(F.round(F.col("value") * 100).cast("long"), F.lit(0)).cast("string").alias("value"), F.col("seq").cast("string").alias("stamp"))
    rows = rows.withColumn("value_hash", F.sha2("value", 256))
    # A fixture chain: the entry hash leaves out what precedes it, so that it needs no recursion to build.
    rows = rows.withColumn("entry_hash", F.sha2(F.concat_ws(":", F.col("seq").cast("string"), "stamp", "key", "value_hash"), 256))
    w = Window.partitionBy("user_id").orderBy("seq")
    rows = rows.withColumn("prev_hash", F.coalesce(F.lag("entry_hash").over(w), F.lit(store.GENESIS)))
    return rows.withColumn("value", F.when(F.col("seq") % 501 == 0, "forged").otherwise(F.col("value")))


@query(
    with_tables(
        """WITH r AS (SELECT user_id, seq, key, CAST(coalesce(CAST(round(value * 100) AS BIGINT), 0) AS VARCHAR) AS v FROM states),
h AS (SELECT *, sha256(v) AS vh FROM r), e AS (SELECT *, sha256(concat_ws(':', seq, seq, key, vh)) AS eh, CASE WHEN seq % 501 = 0 THEN 'forged' ELSE v END AS seen FROM h)
SELECT user_id, count(*) AS entries, count(*) FILTER (sha256(seen) <> vh) AS bad, min(seq) FILTER (sha256(seen) <> vh) AS first_bad FROM e GROUP BY user_id""",
        "states",
    )
)
def ledger_values(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose value no longer has its hash."""
    rows = store.tampered(ledger(spark, d))
    bad = F.col("tampered")
    return rows.groupBy("user_id").agg(F.count("*").alias("entries"), F.sum(bad.cast("long")).alias("bad"), F.min(F.when(bad, F.col("seq"))).alias("first_bad"))


@query(with_tables("SELECT seq, key, value FROM states WHERE seq > 5000 ORDER BY seq LIMIT 1000", "states"))
def cdc_export(spark: SparkSession, d: str) -> DataFrame:
    return tables.states(spark, d).where("seq > 5000").select("seq", "key", "value").orderBy("seq").limit(1000)


@query(with_tables(f"SELECT key, NOT ({_STARTS('key', text.PROTECTED)}) AS deletable FROM facts", "facts"))
def delete_guard(spark: SparkSession, d: str) -> DataFrame:
    return store.deletable(tables.facts(spark, d).select("key"))


@query(
    with_tables(
        """WITH v AS (SELECT key, (ts // 1000) % 2 = 0 AS good FROM facts WHERE ts % 3000 = 0 UNION ALL SELECT key, true FROM facts WHERE doc_id % 5 = 0),
m AS (SELECT key, sum(CASE WHEN good THEN 0.05e0 ELSE -0.05e0 END) AS d FROM v GROUP BY key)
SELECT f.key, round(greatest(0, least(1, confidence + coalesce(d, 0))), 6) AS confidence FROM facts f LEFT JOIN m ON f.key = m.key""",
        "facts",
    )
)
def feedback_update(spark: SparkSession, d: str) -> DataFrame:
    facts = tables.facts(spark, d)
    votes = facts.where("ts % 3000 = 0").select("key", (F.floor(F.col("ts") / 1000) % 2 == 0).alias("good")).unionByName(facts.where("doc_id % 5 = 0").select("key", F.lit(True).alias("good")))
    return store.feedback(facts, votes).select("key", F.round("confidence", 6).alias("confidence"))


@query(
    r"""WITH l AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM conversations),
w AS (SELECT *, trim(line) AS t, list_filter(regexp_split_to_array(trim(line), '\s+'), lambda x: x <> '') AS words FROM l)
SELECT conv_id, turn, CAST(line_no AS INTEGER) AS line_no, 'turn:' || regexp_replace(lower(array_to_string(words[1:4], '_')), '[^\p{L}\p{N}_]', '', 'g') AS key, t AS value, CASE WHEN role = 'user' THEN 0.9e0 ELSE 0.6e0 END AS confidence
FROM w WHERE len(words) >= 3 AND NOT regexp_matches(t, '^(#|//|```|<)')"""
)
def turn_facts(spark: SparkSession, d: str) -> DataFrame:
    return store.turn_facts(tables.read(spark, d, "conversations"))


@query(
    with_tables(
        """WITH r AS (SELECT user_id, seq, seq % 501 = 0 AS forged FROM states)
SELECT user_id, count(*) AS entries, count(*) FILTER (forged) AS bad, min(seq) FILTER (forged) AS first_bad FROM r GROUP BY user_id""",
        "states",
    )
)
def chain_verify(spark: SparkSession, d: str) -> DataFrame:
    """Chains built anew, then forged in places: links, values and entries are verified."""
    rows = tables.states(spark, d).select("user_id", "seq", F.col("seq").cast("string").alias("stamp"), "key", F.coalesce(F.round(F.col("value") * 100).cast("long"), F.lit(0)).cast("string").alias("value"))
    ledger = store.healed(rows, "user_id")
    forged = ledger.withColumn("value", F.when(F.col("seq") % 501 == 0, "forged").otherwise(F.col("value")))
    return store.verify_chain(forged, ["user_id"])
