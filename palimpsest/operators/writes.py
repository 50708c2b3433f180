"""The write path and what keeps stores in step: candidates, decisions, marks, graph writes, replicas and buffers.

Each is a set operation over tables of incoming and stored records; a caller writes the result (append, or overwrite by
key) with any table format. Nothing here holds a store open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import PROTECTED, starts_with_any, tokens
from palimpsest.operators.arbitration import root
from palimpsest.operators.conflicts import arbitrated, conflicts
from palimpsest.operators.gates import discourse_subject, grounding, speech_act, valid_entity
from palimpsest.operators.steps import counted, materialised
from palimpsest.operators.store import beginnings

FUNCTIONAL_PREDICATE = r"^(is_|has_)|(^|_)(status|state|version|port)(_|$)"
ORIGINS = {"[USER]": "user_explicit", "[TOOL]": "tool_output", "[DOC]": "external_doc"}


def existing(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Those of the ``wanted`` keys that the store has."""
    return wanted.join(stored.select("key"), "key", "left_semi")


def conflict_candidates(incoming: DataFrame, stored: DataFrame, terms: int = 6, least: int = 4, limit: int = 200) -> DataFrame:
    """Per incoming key (in_key, in_value): stored keys that may contradict it, with the stage that found them first: the
    key itself (1), keys under its root (2), records with a token that begins with one of its first long terms (3)."""
    stage = lambda df, n: df.select("in_key", "key", F.lit(n).alias("stage"))
    asked = incoming.withColumn("root", root(F.col("in_key")))
    exact = stage(incoming.join(stored, F.col("in_key") == F.col("key")), 1)
    parts = F.split("key", ":")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ":"))
    under = stored.where(F.col("key").contains(":")).select("key", F.explode(above).alias("root"))
    by_root = stage(under.join(asked.select("in_key", "root"), "root"), 2)
    long = F.slice(F.filter(tokens(F.concat_ws(" ", "in_key", "in_value")), lambda t: F.length(t) >= least), 1, terms)
    wanted = incoming.select("in_key", F.explode(long).alias("term")).distinct()
    held = stored.select("key", F.explode(F.array_distinct(tokens(F.concat_ws(" ", "key", "value")))).alias("t"))
    by_term = stage(held.select("key", F.explode(beginnings(F.col("t"), least)).alias("term")).join(counted(wanted), "term"), 3)
    found = exact.unionByName(by_root).unionByName(by_term).groupBy("in_key", "key").agg(F.min("stage").alias("stage"))
    rank = F.row_number().over(Window.partitionBy("in_key").orderBy("stage", "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def writes(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """What becomes of each incoming record: in_key, action, and of a conflict that decides its key, reason and score.

    Questions and talk about them are no assertions, names that are noise aren't grounded, and a value that its key has
    already is a replay. What passes is clamped in confidence and arbitrated with the stored records that may contradict
    it: accept, supersede or warn_conflict. ``incoming``: in_key, in_value, in_predicate, in_confidence, in_source and
    supersedes; ``stored``: key, value, confidence, source, critical. Keys are unique on either side.
    """
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan("in_confidence"), 0.0).otherwise(F.col("in_confidence"))))
    rows = incoming.withColumn("in_confidence", sure).join(stored.select(F.col("key").alias("in_key"), F.col("value").alias("_old")), "in_key", "left")
    act, why = speech_act(F.col("in_key"), F.col("in_predicate"), F.col("in_value")), grounding(F.col("in_key"), F.col("in_value"), F.col("in_predicate") != "")
    stopped = (
        F.when(act == "conversational_turn", "not_an_assertion")
        .when(~why.isin("grounded", "namespaced_entity"), "ungrounded")
        .when(F.lower(F.trim("_old")) == F.lower(F.trim("in_value")), "replay")
    )
    rows = materialised(rows.withColumn("action", stopped).drop("_old"))
    passed = rows.where("action IS NULL").drop("action")
    found = conflicts(passed, stored, conflict_candidates(passed.select("in_key", "in_value"), stored))
    settled = arbitrated(passed, found).select("in_key", "action", "key", "reason", "score")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("key", "string"), ("reason", "string"), ("score", "double"))]
    return rows.where("action IS NOT NULL").select("in_key", "action", *nothing).unionByName(settled)


def superseded(stored: DataFrame, losers: DataFrame, at: Column) -> DataFrame:
    """``stored`` (key, metadata) with the losers (key, winner, reason) marked: who superseded them, when and why."""
    mark = F.map_concat("metadata", F.create_map(F.lit("superseded_by"), F.col("_w"), F.lit("superseded_at"), at.cast("string"), F.lit("reason"), F.col("_r")))
    rows = stored.join(losers.select("key", F.col("winner").alias("_w"), F.col("reason").alias("_r")), "key", "left")
    return rows.withColumn("superseded", F.col("_w").isNotNull()).withColumn("metadata", F.when(F.col("superseded"), mark).otherwise(F.col("metadata"))).drop("_w", "_r")


def with_ttl(rows: DataFrame, now: Column) -> DataFrame:
    """``rows`` with ``expires_at`` and ``is_temporary`` of their ``ttl`` in seconds; none: they last."""
    lasts = F.col("ttl").isNull() | (F.col("ttl") <= 0)
    return rows.withColumn("expires_at", F.when(~lasts, now + F.col("ttl"))).withColumn("is_temporary", ~lasts)


def deleted(stored: DataFrame, wanted: DataFrame, next_seq: Column) -> DataFrame:
    """The audit rows of a deletion (seq, key, value): a tombstone for each stored, unprotected key that is to go."""
    going = wanted.select("key").distinct().join(stored.select("key", "seq"), "key").where(~starts_with_any(F.col("key"), PROTECTED))
    return going.select((next_seq + F.col("seq")).alias("seq"), "key", F.lit("__DELETED__").alias("value"), F.lit("delete").alias("reason"))


def redactions(ledger: DataFrame, registry: DataFrame) -> DataFrame:
    """Ledger entries (seq, key, value, value_hash) that hold: their hash fits, or they carry a redaction mark that is
    registered for the same seq, key and hash. A mark that isn't registered fails."""
    known = registry.select("seq", "key", "value_hash").distinct().withColumn("_known", F.lit(True))
    marked = F.col("value").startswith("[REDACTED-")
    rows = ledger.join(known, ["seq", "key", "value_hash"], "left")
    return rows.withColumn("holds", F.when(marked, F.coalesce("_known", F.lit(False))).otherwise(F.sha2("value", 256) == F.col("value_hash"))).drop("_known")


def unseen(incoming: DataFrame, passages: DataFrame) -> DataFrame:
    """Incoming texts for which no passage exists; of the others only the store's time stamp would change."""
    return incoming.join(passages.select(F.sha2("text", 256).alias("_h")).distinct(), F.sha2(F.col("text"), 256) == F.col("_h"), "left_anti")


def told_facts(turns: DataFrame) -> DataFrame:
    """Facts by two patterns: ``X to|jest|wynosi Y``, and ``zmień|ustaw X na Y``; one row for each match in order."""
    both = [(r"([\p{L}\p{N}_]+) (?:to|jest|wynosi) ([\p{L}\p{N}_]+)", "states"), (r"(?:zmień|ustaw) ([\p{L}\p{N}_]+) na ([\p{L}\p{N}_]+)", "sets")]
    low = F.lower("text")

    def matches(pattern: str, kind: str) -> Column:
        group = lambda n: F.regexp_extract_all(low, F.lit(pattern), F.lit(n))
        return F.zip_with(group(1), group(2), lambda x, y: F.struct(F.lit(kind).alias("kind"), x.alias("subject"), y.alias("object")))

    found = [matches(*x) for x in both]
    return turns.select("id", F.posexplode(F.concat(*found)).alias("at", "f")).select("id", "at", "f.*")


def reconciled(claims: DataFrame) -> DataFrame:
    """Claims of a shadow run (subject, predicate, object, source, is_state, action): talk is dropped, what it calls the
    user's word counts as inferred, and a state variable needs an accepting arbiter."""
    kept = claims.where(speech_act(F.col("subject"), F.col("predicate"), F.col("object")) == "epistemic_assertion")
    kept = kept.withColumn("source", F.when(F.col("source") == "user_explicit", "shadow_inference").otherwise(F.col("source")))
    return kept.where(~F.col("is_state") | F.col("action").isin("accept", "supersede"))


def functional_conflicts(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming claims whose relation has one value at a time and another value in store: both sides, for arbitration."""
    old = stored.select("subject", "predicate", *[F.col(c).alias(f"old_{c}") for c in ("object", "confidence", "source", "ts")])
    one = F.regexp_like(F.lower("predicate"), F.lit(FUNCTIONAL_PREDICATE))
    both = incoming.where(one).join(old, ["subject", "predicate"]).where(F.col("object") != F.col("old_object"))
    return both.select("id", "subject", "predicate", F.col("object").alias("new_object"), "old_object", F.col("confidence").alias("new_conf"), "old_confidence", F.col("source").alias("new_source"), "old_source", F.col("ts").alias("new_ts"), "old_ts")


def latest_audit(states: DataFrame, log: DataFrame) -> DataFrame:
    """Keys with the newest audit entry of each, and whether it agrees with the stored hash; missing: no entry."""
    newest = log.groupBy("key").agg(F.max(F.struct("seq", "value_hash")).alias("_n"))
    verdict = F.when(F.col("_n").isNull(), "missing").when(F.col("_n.value_hash") == F.col("value_hash"), "same").otherwise("differs")
    return states.join(newest, "key", "left").select("key", F.col("_n.seq").alias("seq"), verdict.alias("audit"))


def value_edges(writes: DataFrame) -> DataFrame:
    """Edges (id, src, predicate, dst) of written values: a chain ``A->B->C`` of short names leads on from each to the next,
    any other value is what the key states."""
    parts = F.transform(F.split("value", "->"), lambda x: F.trim(x))
    short = F.forall(parts, lambda x: (F.length(x) >= 2) & (F.length(x) <= 64) & (F.size(F.split(x, r"\s+")) <= 6))
    chain = (F.length("value") <= 160) & (F.size(parts) >= 2) & short
    steps = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.struct(F.get(parts, i).alias("src"), F.lit("leads_to").alias("predicate"), F.get(parts, i + 1).alias("dst")))
    pieces = F.split("key", ":")
    atom = F.array(F.struct(F.element_at(pieces, F.when(F.size(pieces) > 1, -2).otherwise(-1)).alias("src"), F.when(F.size(pieces) > 1, F.element_at(pieces, -1)).otherwise("value").alias("predicate"), F.trim("value").alias("dst")))
    return writes.select("id", F.explode(F.when(chain, steps).otherwise(atom)).alias("e")).select("id", "e.*").where("src <> dst")


def rule_relations(texts: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Relations that patterns find: each rule's first group is the subject, its second a list parted by comma, semicolon
    or plus. ``rules``: predicate to pattern; more may be passed in."""
    low = F.lower("text")
    found = []
    for predicate, pattern in rules.items():
        pairs = F.zip_with(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), F.regexp_extract_all(low, F.lit(pattern), F.lit(2)), lambda s, o: F.struct(s.alias("s"), o.alias("o")))
        rows = texts.select("id", F.explode(pairs).alias("p")).select("id", F.col("p.s").alias("src"), F.lit(predicate).alias("predicate"), F.explode(F.split("p.o", r"[,+;]")).alias("dst"))
        found.append(rows.withColumn("dst", F.trim("dst")).where("dst <> '' and src <> dst"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def bullet_relations(texts: DataFrame) -> DataFrame:
    """``key: value`` bullets of each text as relations: the subject defines the item, the item has the value."""
    lines = texts.select("id", "subject", F.explode(F.split("text", "\n")).alias("line"))
    pattern = r"^\s*[-*•]\s*([^:]+):\s*(.+)$"
    item, value = F.trim(F.regexp_extract("line", pattern, 1)), F.trim(F.regexp_extract("line", pattern, 2))
    rows = lines.where(F.regexp_like("line", F.lit(pattern))).select("id", "subject", item.alias("item"), value.alias("value"))
    defines = rows.select("id", F.col("subject").alias("src"), F.lit("defines_item").alias("predicate"), F.col("item").alias("dst"))
    return defines.unionByName(rows.select("id", F.col("item").alias("src"), F.lit("has_spec").alias("predicate"), F.col("value").alias("dst")))


def hydrated(edges: DataFrame) -> DataFrame:
    """A graph read back (subject, predicate, object, confidence, ts): invalid entities go, of parallel edges the greatest
    confidence and time stay, and ``partial`` tells whether a row that went names one of the edge's ends."""
    good = valid_entity(F.col("subject")) & valid_entity(F.col("object")) & ~discourse_subject(F.col("subject"))
    kept = edges.where(good).groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence"), F.max("ts").alias("ts"))
    gone = materialised(edges.where(~good).select(F.explode(F.array("subject", "object")).alias("_name")).where("_name IS NOT NULL").distinct().withColumn("_gone", F.lit(True)))
    for end in ("subject", "object"):
        kept = kept.join(gone.withColumnsRenamed({"_name": end, "_gone": f"_{end}"}), end, "left")
    return kept.withColumn("partial", F.col("_subject").isNotNull() | F.col("_object").isNotNull()).select("subject", "predicate", "object", "confidence", "ts", "partial")


def collected_tombstones(adds: DataFrame, removes: DataFrame, now: Column, ttl: Column) -> tuple[DataFrame, DataFrame]:
    """Adds and removes of a replicated set (element, ts) without removes older than the time to live, and without the adds
    that such a remove has outlived."""
    old = removes.where(F.col("ts") < now - ttl).groupBy("element").agg(F.max("ts").alias("_r"))
    kept = adds.join(old, "element", "left").where(F.col("_r").isNull() | (F.col("ts") > F.col("_r"))).drop("_r")
    return kept, removes.where(F.col("ts") >= now - ttl)


def applied_delta(local: DataFrame, delta: DataFrame, seen: DataFrame) -> DataFrame:
    """A replica (key, value, info) after a peer's delta (peer, clock, key, value, info, deleted): messages no newer than
    the peer's clock in ``seen`` are stale, records with less information than the local one are skipped, deletes go."""
    fresh = delta.join(seen.select("peer", F.col("clock").alias("_seen")), "peer", "left").where(F.col("_seen").isNull() | (F.col("clock") > F.col("_seen")))
    best = fresh.groupBy("key").agg(F.max(F.struct("info", "clock", "peer", "value", "deleted")).alias("d"))
    both = local.join(best, "key", "full")
    takes = F.col("d").isNotNull() & (F.col("info").isNull() | (F.col("d.info") >= F.col("info") - 1e-6))
    out = both.select("key", F.when(takes, F.col("d.value")).otherwise(F.col("value")).alias("value"), F.when(takes, F.col("d.info")).otherwise(F.col("info")).alias("info"), (takes & F.col("d.deleted")).alias("_gone"))
    return out.where(~F.coalesce("_gone", F.lit(False))).drop("_gone")


def sleep_batch(runs: DataFrame, watermark: int, limit: int = 200) -> DataFrame:
    """The newest runs (run, last_step) beyond the watermark; one that is ahead of all runs is stale and counts as zero."""
    top = runs.agg(F.coalesce(F.max("last_step"), F.lit(0)).alias("_top"))
    mark = F.when(F.lit(watermark) > F.col("_top"), 0).otherwise(watermark)
    return runs.join(counted(top)).where(F.col("last_step") > mark).drop("_top").orderBy(F.col("last_step").desc(), "run").limit(limit)


def unified(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Records of several source tables as one: each names its subject, text, confidence and time; blank ones go."""
    rows = None
    for name, df in sources:
        part = df.select(F.lit(name).alias("origin"), F.col("subject").cast("string"), F.col("text").cast("string"), F.col("confidence").cast("double"), F.col("ts").cast("long")).where(F.trim("text") != "")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def as_records(rows: DataFrame) -> DataFrame:
    """Rows (subject, text, trust, importance, score) as records: the origin by a tag in ``trust``, figures within 0 and 1."""
    origin = F.lit("agent_inference")
    for tag, name in reversed(ORIGINS.items()):
        origin = F.when(F.contains(F.upper("trust"), F.lit(tag)), name).otherwise(origin)
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.0))))
    return rows.select("id", "subject", F.col("text").alias("value"), origin.alias("source_type"), inside("importance").alias("importance"), inside("score").alias("score"))


BUFFER = "step_id long, ts long, session_id string, action_name string, reward double, uncertainty double"


def dump_buffer(steps: DataFrame, path: str, codec: str = "zstd") -> None:
    """Writes a transition buffer as Parquet with one of Spark's codecs (zstd, snappy, gzip)."""
    steps.write.option("compression", codec).parquet(path)


def load_buffer(spark, path: str) -> DataFrame:
    """A dumped buffer in its full schema: columns that a file lacks are null. Rows arrive as a stream of batches."""
    return spark.read.schema(BUFFER).parquet(path)
