"""The fact store: scans, lookups, upserts, revisions and the hash-chained ledger, as set operations over tables."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import PROTECTED, is_churn, starts_with_any, tokens
from palimpsest.operators.steps import counted

GENESIS = "0" * 64
CONTROL = ["sys:", "lock:", "checkpoint:"]


def page(states: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of the store in key order."""
    return states.orderBy("key", "seq").offset(offset).limit(limit)


def get_ci(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows for the ``wanted`` keys: exact ones, and for keys without one the first row that matches in lower case."""
    exact = wanted.join(states, "key").withColumn("found", F.col("key"))
    missing = wanted.join(states.select("key").distinct(), "key", "left_anti")
    low = states.withColumn("_low", F.lower("key")).withColumnRenamed("key", "found")
    loose = missing.withColumn("_low", F.lower("key")).join(low, "_low").drop("_low")
    first = Window.partitionBy("key").orderBy("found")
    return exact.unionByName(loose.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"))


def recent(states: DataFrame, since: Column, limit: int) -> DataFrame:
    return states.where(F.col("ts") >= since).orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(limit).orderBy("ts", "seq")


def beginnings(text: Column, least: int | Column) -> Column:
    """All prefixes of a text with ``least`` characters or more."""
    least = F.lit(least) if isinstance(least, int) else least
    return F.when(F.length(text) >= least, F.transform(F.sequence(least, F.length(text)), lambda n: F.left(text, n))).otherwise(F.array().cast("array<string>"))


def keyword_search(states: DataFrame, queries: DataFrame, limit: int = 500, terms: int = 8) -> DataFrame:
    """Per query: exact key, then key prefix, then any token with the prefix of one of its first terms; first found wins.

    Prefixes of keys and tokens are listed where they lie, and those that are asked for are kept by an equi-join: with the
    asked ones broadcast if they are few, so that only hits are shuffled."""
    stage = lambda df, n: df.select("query_id", "key", F.lit(n).alias("stage"))
    exact = stage(queries.join(states, queries["query"] == states["key"]), 1)
    long_enough = (F.length("query") >= 3) & F.col("query").contains(":")
    # An asked prefix has a colon, so a key's prefixes begin at its first one.
    heads = states.select("key", F.explode(beginnings(F.col("key"), F.greatest(F.lit(3), F.instr("key", ":")))).alias("head")).where(F.col("key").contains(":"))
    prefix = stage(heads.join(counted(queries.where(long_enough).select("query_id", F.col("query").alias("head"))), "head"), 2)
    wanted = queries.select("query_id", F.explode(F.slice(tokens(F.col("query")), 1, terms)).alias("term")).distinct()
    held = states.select("key", F.explode(F.array_distinct(tokens(F.concat_ws(" ", "key", "value")))).alias("token"))
    text = stage(held.select("key", F.explode(beginnings(F.col("token"), 3)).alias("term")).join(counted(wanted), "term"), 3)
    found = exact.unionByName(prefix).unionByName(text).groupBy("query_id", "key").agg(F.min("stage").alias("stage"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("stage", "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def tampered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``tampered``: the value's hash isn't the stored one."""
    return rows.withColumn("tampered", F.sha2(F.col("value").cast("string"), 256) != F.col("value_hash"))


def latest(states: DataFrame) -> DataFrame:
    """The newest write of each key, by sequence number; aggregated before the shuffle."""
    rest = [c for c in states.columns if c not in ("key", "seq")]
    return states.groupBy("key").agg(F.max("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in rest])


def ring(states: DataFrame, slots: int, ttl_seconds: int, now: Column) -> DataFrame:
    """The hot buffer: newest write per key within the time to live, the newest ``slots`` keys."""
    fresh = latest(states.where(F.unix_timestamp("ts") >= F.unix_timestamp(now) - ttl_seconds))
    return fresh.orderBy(F.col("seq").desc()).limit(slots)


def revisions(states: DataFrame) -> DataFrame:
    """Every change of a key's value, with the value before it and the number of changes so far."""
    w = Window.partitionBy("key").orderBy("seq")
    changed = F.lag("value").over(w).isNotNull() & (F.lag("value").over(w) != F.col("value"))
    df = states.withColumn("prior_value", F.lag("value").over(w)).withColumn("_changed", changed.cast("int"))
    return df.withColumn("revision", F.sum("_changed").over(w)).where("_changed = 1").drop("_changed")


def upsert_status(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``new``, ``updated`` or ``unchanged`` for each incoming key: values equal up to white space don't change."""
    norm = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    old = stored.select("key", F.col("value").alias("_old"))
    status = F.when(F.col("_old").isNull(), "new").when(norm(F.col("_old")) == norm(F.col("value")), "unchanged").otherwise("updated")
    return incoming.join(old, "key", "left").withColumn("status", status).drop("_old")


def entry_hash() -> Column:
    return F.sha2(F.concat_ws(":", F.col("seq").cast("string"), F.col("stamp"), F.col("key"), F.col("value_hash"), F.col("prev_hash")), 256)


def verify_chain(ledger: DataFrame, by: list[str]) -> DataFrame:
    """Per chain: entries, bad ones and the first bad sequence number. Link, value and entry hashes are checked."""
    w = Window.partitionBy(*by).orderBy("seq")
    link = F.col("prev_hash") == F.coalesce(F.lag("entry_hash").over(w), F.lit(GENESIS))
    value = F.col("value_hash") == F.sha2(F.col("value").cast("string"), 256)
    ok = link & value & (F.col("entry_hash") == entry_hash())
    checked = ledger.withColumn("_ok", ok)
    return checked.groupBy(*by).agg(F.count("*").alias("entries"), F.sum((~F.col("_ok")).cast("long")).alias("bad"), F.min(F.when(~F.col("_ok"), F.col("seq"))).alias("first_bad"))


def deletable(keys: DataFrame) -> DataFrame:
    """``keys`` with ``deletable``: no protected prefix."""
    return keys.withColumn("deletable", ~starts_with_any(F.col("key"), PROTECTED))


def readable(facts: DataFrame) -> DataFrame:
    """What the read path may return: no probes, churn or control keys."""
    key = F.col("key")
    return facts.where(~starts_with_any(F.lower(key), ["probe:", *CONTROL]) & ~is_churn(key, F.col("value")))


def feedback(facts: DataFrame, votes: DataFrame, step: float = 0.05) -> DataFrame:
    """Confidence moved by ``step`` for each vote, within 0 and 1."""
    moved = votes.groupBy("key").agg(F.sum(F.when(F.col("good"), step).otherwise(-step)).alias("_d"))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + F.coalesce("_d", F.lit(0.0))))
    return facts.join(moved, "key", "left").withColumn("confidence", conf).drop("_d")


def turn_facts(turns: DataFrame) -> DataFrame:
    """Facts of conversation turns: each line of three words or more that is no comment, code or markup."""
    lines = turns.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    clean = F.trim("line")
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    kept = lines.withColumn("line", clean).withColumn("_w", words).where((F.size("_w") >= 3) & ~F.regexp_like("line", F.lit(r"^(#|//|```|<)")))
    head = F.regexp_replace(F.lower(F.array_join(F.slice("_w", 1, 4), "_")), r"[^\p{L}\p{N}_]", "")
    confidence = F.when(F.col("role") == "user", 0.9).otherwise(0.6)
    return kept.select("conv_id", "turn", "line_no", F.concat(F.lit("turn:"), head).alias("key"), F.col("line").alias("value"), confidence.alias("confidence"))


def healed(entries: DataFrame, by: str) -> DataFrame:
    """``entries`` (by, seq, stamp, key, value) with value, previous and entry hashes computed anew from the first of
    each chain on. Each hash needs the one before: a chain lies in one partition in order of seq and is folded row by row,
    with only the last hash in memory."""
    columns = [by, "seq", "stamp", "key", "value"]
    rows = entries.select(*columns, F.sha2(F.coalesce("value", F.lit("")), 256).alias("value_hash")).repartition(by).sortWithinPartitions(by, "seq")

    def fold(batches):
        chain, before = None, GENESIS
        for batch in batches:
            previous, hashes = [], []
            for name, seq, stamp, key, value_hash in zip(*(batch.column(c).to_pylist() for c in (by, "seq", "stamp", "key", "value_hash")), strict=True):
                if (name,) != chain:
                    chain, before = (name,), GENESIS
                previous.append(before)
                before = hashlib.sha256(f"{seq}:{stamp}:{key}:{value_hash}:{before}".encode()).hexdigest()
                hashes.append(before)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(previous, pa.string()), pa.array(hashes, pa.string())], names=[*batch.schema.names, "prev_hash", "entry_hash"])

    return rows.mapInArrow(fold, T.StructType([*rows.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())]))
