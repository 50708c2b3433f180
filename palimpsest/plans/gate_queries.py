"""Queries of the gates: what the write and maintenance paths take, keep or drop."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import gates
from palimpsest.plans import tables
from palimpsest.plans.registry import query
from palimpsest.plans.tables import with_tables


def _in(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_PLAIN = "translate(w, 'ąćęłńóśźż', 'acelnoszz')"
_FOLDED = f"(CASE WHEN {_PLAIN} <> w THEN replace({_PLAIN}, 'y', 'i') ELSE {_PLAIN} END)"
_CUTS = " ".join(f"WHEN ends_with({_FOLDED}, '{s}') AND length({_FOLDED}) > {len(s) + 2} THEN left({_FOLDED}, length({_FOLDED}) - {len(s)})" for s in text.STEM_SUFFIXES)
#: The stem of a lower-case word w.
STEM = f"(CASE WHEN w IN {_in(text.PROTECTED_ROOTS)} OR {_PLAIN} IN {_in(text.PROTECTED_ROOTS)} THEN {_PLAIN} WHEN {_FOLDED} IN {_in(text.PROTECTED_ROOTS)} THEN {_FOLDED} {_CUTS} ELSE {_FOLDED} END)"
_HEADS = r"heads AS (SELECT *, coalesce(list_filter(regexp_split_to_array(lower(trim(subject)), '[-_\s]+'), lambda x: x <> '')[1], '') AS w FROM triples)"
_DISCOURSE = f"(w <> '' AND (w IN {_in(gates.QUESTION_WORDS)} OR {STEM} IN {_in(gates.QUESTION_STEMS)}))"


def valid_sql(c: str) -> str:
    low = f"""trim(lower(trim({c})), '._-:;,()[]{{}}"'' ')"""
    return rf"""(length(trim({c})) <= 80 AND NOT regexp_matches({c}, '(?i)[\n\r]|<!--|\[user\]|\[conversation\]') AND {low} <> '' AND {low} NOT IN {_in(gates.NOISE_ENTITIES)}
  AND NOT regexp_full_match({low}, '[0-9.]*[0-9][0-9.]*') AND len(regexp_split_to_array({low}, '\s+')) <= 7)"""


@query(with_tables(f"SELECT id, {valid_sql('subject')} AS valid FROM triples", "triples"))
def graph_entities(spark: SparkSession, d: str) -> DataFrame:
    return tables.triples(spark, d).select("id", gates.valid_entity(F.col("subject")).alias("valid"))


@query(with_tables(f"WITH {_HEADS} SELECT id, {_DISCOURSE} AS garbage FROM heads", "triples"))
def discourse_subjects(spark: SparkSession, d: str) -> DataFrame:
    return tables.triples(spark, d).select("id", gates.discourse_subject(F.col("subject")).alias("garbage"))


@query(with_tables(f"WITH {_HEADS} SELECT CASE WHEN {_DISCOURSE} OR contains(object, '?') OR contains(predicate, '?') THEN 'conversational_turn' ELSE 'epistemic_assertion' END AS act, count(*) AS n, min(id) AS first FROM heads GROUP BY 1", "triples"))
def speech_acts(spark: SparkSession, d: str) -> DataFrame:
    act = gates.speech_act(F.col("subject"), F.col("predicate"), F.col("object"))
    return tables.triples(spark, d).groupBy(act.alias("act")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


def _ground(k: str, v: str = "''", answered: str = "false") -> str:
    low = f"lower(trim({k}))"
    return f"""CASE WHEN trim({k}) = '' THEN 'empty_key' WHEN regexp_matches(trim({k}), '[:/.]') AND length(split_part(trim({k}), ':', 1)) > 1 THEN 'namespaced_entity' WHEN {low} IN {_in(gates.NOISE_TOKENS)} THEN 'noise_token'
  WHEN length({low}) >= 4 AND NOT regexp_full_match({low}, '[0-9]+') AND len(list_filter({_list([w for w in gates.NOISE_TOKENS if len(w) >= 4])}, lambda x: levenshtein(x, {low}) <= 1)) > 0 THEN 'noise_typo'
  WHEN length({low}) < 3 AND NOT regexp_full_match({low}, '[0-9]+') THEN 'short_token' WHEN {answered} AND lower(trim(trim({v}), '"''')) IN {_in(gates.BARE_ANSWERS)} THEN 'bare_answer' ELSE 'grounded' END"""


@query(with_tables(f"SELECT id, {_ground('subject', 'object', 'id % 2 = 0')} AS reason FROM triples", "triples"))
def grounding_reasons(spark: SparkSession, d: str) -> DataFrame:
    return tables.triples(spark, d).select("id", gates.grounding(F.col("subject"), F.col("object"), F.col("id") % 2 != 0).alias("reason"))


_MAIL = r"regexp_matches(X, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}')"
_SECRET = r"(" + _MAIL + r" OR lower(trim(X)) = 'secret' OR regexp_matches(X, '(?i)(?:\b|_)(password|api[-_\s]?key)(?:\b|_)'))"
_NOT_PROSE = f"lower(trim(predicate)) NOT IN {_in(gates.PROSE_PREDICATES)}"
_GOOD = "('grounded', 'namespaced_entity')"


@query(with_tables(f"""SELECT id, subject, predicate, object FROM triples WHERE {_NOT_PROSE} AND NOT (length(trim(object)) - length(replace(trim(object), ' ', '')) > 6 AND regexp_matches(object, '[.,;!?]'))
  AND NOT {_SECRET.replace("X", "subject")} AND NOT {_SECRET.replace("X", "object")} AND trim(subject) <> trim(object) AND {_ground('subject')} IN {_GOOD} AND {_ground('object')} IN {_GOOD}""", "triples"))
def relation_filter(spark: SparkSession, d: str) -> DataFrame:
    return gates.relations(tables.triples(spark, d)).select("id", "subject", "predicate", "object")


@query(with_tables(f"SELECT id, subject, object FROM triples WHERE {_NOT_PROSE} AND NOT {_SECRET.replace('X', 'subject')} AND NOT {_SECRET.replace('X', 'object')}", "triples"))
def causal_edges(spark: SparkSession, d: str) -> DataFrame:
    return gates.causal_adjacency(tables.triples(spark, d)).select("id", "subject", "object")


@query(with_tables("SELECT id, id % 3 <> 0 AND (source <> 'shadow_inference' OR id % 7 = 0) AS allowed FROM triples", "triples"))
def state_authority(spark: SparkSession, d: str) -> DataFrame:
    promotion = F.when(F.col("id") % 7 == 0, "arbitration_promoted").when(F.col("id") % 7 == 1, "pending_arbitration")
    return tables.triples(spark, d).select("id", gates.may_set_state(F.col("id") % 3 != 0, F.col("source"), promotion).alias("allowed"))


@query(with_tables("SELECT id FROM triples WHERE NOT regexp_matches(object, '^(sys:|lock:|checkpoint:)') AND id % 5 <> 0 AND length(trim(object)) >= 3", "triples"))
def active_candidates(spark: SparkSession, d: str) -> DataFrame:
    return gates.active_candidates(tables.triples(spark, d).select("id", F.col("object").alias("key"), F.col("object").alias("value"), (F.col("id") % 5 == 0).alias("superseded"))).select("id")


@query(r"""WITH t AS (SELECT conv_id, string_agg('[' || role || '] ' || text, ' | ' ORDER BY turn) AS v, CASE WHEN conv_id % 2 = 0 THEN string_agg(text, ' | ' ORDER BY turn) ELSE string_agg(text, ' ' ORDER BY turn) END AS p FROM conversations GROUP BY 1),
a AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN v ELSE p END AS x FROM t)
SELECT conv_id, length(x) >= 1024 AND (regexp_matches(lower(x), '\[(user|assistant)\]|(^|\n)(user|assistant):') OR len(regexp_split_to_array(x, '\s\|\s')) - 1 >= 2) AS dump FROM a""")
def raw_chats(spark: SparkSession, d: str) -> DataFrame:
    turns = tables.read(spark, d, "conversations")
    told = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x).alias("t"))
    marked = F.array_join(F.transform("t", lambda x: F.concat(F.lit("["), x["role"], F.lit("] "), x["text"])), " | ")
    plain = F.transform("t", lambda x: x["text"])
    value = F.when(F.col("conv_id") % 3 == 0, marked).when(F.col("conv_id") % 2 == 0, F.array_join(plain, " | ")).otherwise(F.array_join(plain, " "))
    return told.select("conv_id", gates.raw_chat(value).alias("dump"))


_KEEP, _DELETE = ["rule:", "hermes:"], ["temp_*", "session:a*1?", "kv:web:*"]


@query(with_tables("SELECT key, CASE WHEN regexp_matches(key, '^(rule:|hermes:)') THEN 'keep' WHEN key LIKE 'temp\\_%' ESCAPE '\\' OR key LIKE 'session:a%1_' OR key LIKE 'kv:web:%' THEN 'delete' ELSE 'unmatched' END AS class FROM facts", "facts"))
def key_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return tables.facts(spark, d).select("key", gates.key_class(F.col("key"), _KEEP, _DELETE).alias("class"))


@query(with_tables("SELECT key FROM facts WHERE NOT (key LIKE 'temp\\_w%' ESCAPE '\\' OR key LIKE 'kv:%') AND key NOT IN ('fact:web:6', 'rule:web:1')", "facts"))
def probe_purge(spark: SparkSession, d: str) -> DataFrame:
    return gates.purged(tables.facts(spark, d), ["fact:web:6", "rule:web:1"], ["temp_w", "kv:"]).select("key")


@query(with_tables("""WITH i AS (SELECT id, CASE WHEN id % 10 = 0 THEN ' ' WHEN id % 10 = 1 THEN 'a/../b' WHEN id % 10 = 2 THEN repeat('k', 300) WHEN id % 10 = 3 THEN '..' WHEN id % 10 = 4 THEN 'a..b' ELSE subject END AS k, CASE WHEN id % 10 = 5 THEN repeat('v', 20000) ELSE object END AS v FROM triples)
SELECT id, CASE WHEN trim(k) = '' THEN 'empty' WHEN k IN ('..', 'a/../b') THEN 'traversal' WHEN length(k) > 256 OR length(v) > 10000 THEN 'too_long' ELSE 'ok' END AS fault FROM i""", "triples"))
def input_checks(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("id") % 10
    key = F.when(m == 0, " ").when(m == 1, "a/../b").when(m == 2, F.repeat(F.lit("k"), 300)).when(m == 3, "..").when(m == 4, "a..b").otherwise(F.col("subject"))
    value = F.when(m == 5, F.repeat(F.lit("v"), 20000)).otherwise(F.col("object"))
    return tables.triples(spark, d).select("id", gates.input_fault(key, value).alias("fault"))


@query(with_tables("SELECT DISTINCT src AS node, src IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0) AS tombstoned FROM edges", "edges"))
def entity_tombstones(spark: SparkSession, d: str) -> DataFrame:
    marks = tables.read(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"))
    return gates.tombstoned_entities(tables.edges(spark, d).select(F.col("src").alias("node")).distinct(), marks)


@query(with_tables("SELECT key, CASE WHEN key LIKE 'kv:%' THEN 'key' WHEN source_type LIKE 'tool%' THEN 'subject' ELSE 'tombstone' END AS reason FROM facts WHERE key LIKE 'kv:%' OR source_type LIKE 'tool%' OR importance > 0.8", "facts"))
def view_purge(spark: SparkSession, d: str) -> DataFrame:
    views = tables.facts(spark, d).select("key", F.col("source_type").alias("subject"), (F.col("importance") > 0.8).alias("superseded"))
    return gates.view_purge(views, ["kv:", "tool"]).select("key", "reason")


@query("SELECT vec_id FROM (SELECT vec_id, [NULL, 'global', 'a', 'session_a', 'b', 'hermes_persistent', 'session_b'][vec_id % 7 + 1] AS s FROM embeddings) WHERE s IS NULL OR s IN ('a', 'session_a', 'global', 'hermes_persistent')")
def vector_sessions(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x).cast("string") for x in (None, "global", "a", "session_a", "b", "hermes_persistent", "session_b")])
    points = tables.read(spark, d, "embeddings").select("vec_id", F.element_at(names, (F.col("vec_id") % 7 + 1).cast("int")).alias("session_id"))
    return gates.visible_points(points, "a").select("vec_id")
