"""Health, coverage, judgement and sleep: aggregations that watch a store, and the small decisions made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import entity_root, is_rule
from palimpsest.operators.arbitration import FUNCTIONAL_SLOTS, multi_valued, slot
from palimpsest.operators.steps import counted, summed

SHELLS = ["bash", "shell", "terminal", "execute", "run_command"]
#: What each invariant of a healthy store may be at most (and at least).
LIMITS = {"duplication": (1.0, 1.05), "parity": (0.0, 0.05), "raw_chat": (0.0, 0.20), "points": (0.0, 3.0), "coverage": (0.60, 1.05)}
#: Weight and full marks of each part of a judge's verdict.
MARKS = {"relevance": (0.30, 3), "answer": (0.25, 3), "support": (0.20, 2), "entity": (0.15, 2), "scope": (0.10, 2)}


def signature_token(tool: Column, command: Column) -> Column:
    """A tool's name in a signature; of a shell the program that it runs, without its folder."""
    program = F.regexp_extract(F.trim(F.coalesce(command, F.lit(""))), r"^(?:\S*/)?([^\s/]+)", 1)
    return F.when(tool.isin(SHELLS) & (program != ""), F.concat(F.lit("bash["), program, F.lit("]"))).otherwise(tool)


def baked_procedures(runs: DataFrame, least: int = 3, success: float = 0.8) -> DataFrame:
    """Step signatures per context that are frequent and successful enough: name, runs, rate and id."""
    name = F.concat("context", F.lit("::"), "signature")
    found = runs.groupBy(name.alias("name")).agg(F.count("*").alias("runs"), F.avg(F.col("success").cast("double")).alias("rate"))
    return found.where((F.col("runs") >= least) & (F.col("rate") >= success)).select("name", "runs", F.round("rate", 6).alias("rate"), F.substring(F.sha2("name", 256), 1, 12).alias("id"))


def criticality(errors: DataFrame, temperatures: DataFrame) -> DataFrame:
    """Entities that are critical: any critical or large error, unless they have cooled down or succeeded three times."""
    worst = errors.groupBy("entity").agg(F.max((F.col("level") == "critical") | (F.col("error") >= 0.70)).alias("_bad"))
    calm = (F.col("successes") >= 3) | (F.col("temperature") < 0.15)
    return temperatures.join(worst, "entity").select("entity", (~calm & F.col("_bad")).alias("critical"))


def by_risk(rows: DataFrame) -> DataFrame:
    """Rows (risk, confidence) in order: critical ones, high ones, the rest; then by confidence."""
    tier = F.when(F.col("risk") == "CRITICAL", 0).when(F.col("risk") == "HIGH", 1).otherwise(2)
    return rows.withColumn("tier", tier).orderBy("tier", F.col("confidence").desc())


def invariants(measures: DataFrame) -> DataFrame:
    """``measures`` (name, value) with the limits of each invariant and whether it holds."""
    rows = [(n, lo, hi) for n, (lo, hi) in LIMITS.items()]
    limits = measures.sparkSession.createDataFrame(rows, "name string, least double, most double")
    return measures.join(F.broadcast(limits), "name").select("name", F.round("value", 6).alias("value"), F.col("value").between(F.col("least"), F.col("most")).alias("holds"))


def summary(samples: DataFrame, by: str) -> DataFrame:
    """Latencies (ms), tokens and abstentions per ``by``: mean, spread, percentiles, sums and the share of right abstentions."""
    p = lambda q: F.round(F.percentile("ms", q), 4).alias(f"p{int(q * 100)}")
    right = F.when(F.col("abstained"), F.col("should_abstain").cast("double"))
    return samples.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("ms"), 4).alias("mean"), F.round(F.stddev_pop("ms"), 4).alias("std"), *map(p, (0.5, 0.9, 0.95, 0.99)), F.round(F.sum("ms"), 2).alias("total"), F.sum("tokens").alias("tokens"), F.round(F.coalesce(F.avg(right), F.lit(0.0)), 6).alias("abstention_precision"))


def store_counts(facts: DataFrame, log: DataFrame) -> DataFrame:
    """Rows, different keys and audit entries of a store, in one row."""
    a = facts.agg(F.count("*").alias("facts"), F.count_distinct("key").alias("keys"))
    return a.join(F.broadcast(log.agg(F.count("*").alias("entries"))))


def coverage(keys: DataFrame, points: DataFrame) -> DataFrame:
    """Per name space: keys, those with a vector point, and their share."""
    known = points.select("key").distinct().withColumn("_has", F.lit(1))
    rows = keys.join(known, "key", "left").groupBy(F.split("key", ":")[0].alias("space"))
    return rows.agg(F.count("*").alias("keys"), F.count("_has").alias("covered"), F.round(F.count("_has") / F.count("*"), 6).alias("share"))


def monotonic(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts (kind, n) before and after a migration; a count that fell raises an error when it is read."""
    both = before.select("kind", F.col("n").alias("before")).join(after.select("kind", F.col("n").alias("after")), "kind", "full")
    b, a = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    return both.select("kind", b.alias("before"), F.when(a >= b, a).otherwise(F.raise_error(F.concat(F.lit("fewer rows after the migration: "), "kind")).cast("long")).alias("after"))


def margin_search(sample: DataFrame, precision: float) -> DataFrame:
    """Over margins .01, .02, ... .24 the one with the best F1 among those precise enough. The sample is counted by
    hundredth first."""
    grid = sample.sparkSession.range(1, 25).select(F.col("id").alias("step"))
    counts = sample.groupBy(F.least(F.floor(F.round(F.col("margin") * 100, 6)), F.lit(24)).alias("h")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    met = grid.join(F.broadcast(counts), F.col("h") >= F.col("step"), "left").groupBy("step").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    met = met.join(F.broadcast(sample.agg(F.sum("label").alias("_p")))).where("tp > 0")
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("_p")
    return met.where(p > precision).withColumn("f1", F.round(2 * p * r / (p + r), 6)).orderBy(F.col("f1").desc(), "step").limit(1).select((F.col("step") / 100.0).alias("margin"), "tp", "fp", "f1")


def judged(verdicts: DataFrame) -> DataFrame:
    """A judge's marks (one column for each of MARKS) and vetoes as a latent score, and the label: high and entailed."""
    total = F.lit(0.0)
    for part, (weight, full) in MARKS.items():
        total = total + weight * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(part) / full))
    score = F.round(F.when(F.col("veto"), 0.0).otherwise(total), 6)
    return verdicts.withColumn("latent", score).withColumn("label", ((F.col("latent") >= 0.75) & F.col("entailed")).cast("int"))


def publishable(sample: DataFrame, threshold: Column, z: float = 1.96, least_negatives: int = 30) -> DataFrame:
    """Whether a calibration may be published: the lower bound of its AUC (Hanley and McNeil's deviation) is above one
    half, it saw enough negatives, and a threshold was learned."""
    by_score = summed(sample.groupBy("score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")), "score", ["neg"])
    u = by_score.withColumn("_u", F.col("pos") * (F.col("_before_neg") + 0.5 * F.col("neg"))).agg(F.sum("_u").alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    auc = F.col("u") / (F.col("p") * F.col("n"))
    q1, q2 = F.col("auc") / (2 - F.col("auc")), 2 * F.col("auc") * F.col("auc") / (1 + F.col("auc"))
    var = (F.col("auc") * (1 - F.col("auc")) + (F.col("p") - 1) * (q1 - F.col("auc") * F.col("auc")) + (F.col("n") - 1) * (q2 - F.col("auc") * F.col("auc"))) / (F.col("p") * F.col("n"))
    low = u.withColumn("auc", auc).withColumn("low", F.col("auc") - z * F.sqrt(var))
    return low.select(F.round("auc", 6).alias("auc"), F.round("low", 6).alias("low"), ((F.col("low") > 0.5) & (F.col("n") >= least_negatives) & threshold.isNotNull()).alias("publish"))


def sensing_verdicts(errors: DataFrame, ttl: int = 3600) -> DataFrame:
    """Corrective writes for observations (entity, level, observed, expected) that miss their expectation: the probe's key
    and value, how long it holds, the edge to draw and whether the entity's weights must be settled anew."""
    bad = errors.where(F.col("level").isin("moderate", "critical"))
    return bad.select("entity", F.concat(F.lit("probe:"), "entity", F.lit(":last_observed")).alias("key"), F.col("observed").alias("value"), F.lit(ttl).alias("ttl"), F.lit("observed_state").alias("predicate"), (F.col("level") == "critical").alias("settle"))


def rolling(rows: DataFrame, by: str, order: str, value: str, last: int) -> DataFrame:
    """Mean and count of the last ``last`` values of each ``by``, at every row."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(1 - last, 0)
    return rows.withColumn("window_mean", F.round(F.avg(value).over(w), 9)).withColumn("window_n", F.count(value).over(w))


def orthogonal(pairs: DataFrame) -> DataFrame:
    """Pairs of keys (a, b) with ``blocked``: they state different slots, one of which has a value of its own kind."""
    x, y = slot(F.col("a")), slot(F.col("b"))
    known = x.isin(FUNCTIONAL_SLOTS) | y.isin(FUNCTIONAL_SLOTS) | multi_valued(F.col("a")) | multi_valued(F.col("b"))
    return pairs.withColumn("blocked", (x != y) & known)


def forgotten(facts: DataFrame, salience: Column, least: float = 0.3) -> DataFrame:
    """Facts that sleep forgets: hardly trusted, or faint and neither state nor important; never what a user said for
    certain."""
    faint = ~F.col("state") & (F.col("importance") < 0.95) & (salience < 0.15)
    return facts.where(((F.col("confidence") < least) | faint) & ~((F.col("source_type") == "user_explicit") & (F.col("confidence") >= 0.99)))


def session_reconciled(touched: DataFrame, facts: DataFrame) -> DataFrame:
    """After sleep, each touched key (session, key) is purged if it was superseded or another superseded key has its
    entity root, else consolidated."""
    dead = facts.where("superseded").select(entity_root(F.col("key")).alias("_r")).distinct().withColumn("_dead", F.lit(True))
    rows = touched.withColumn("_r", entity_root(F.col("key"))).join(dead, "_r", "left")
    return rows.select("session", "key", F.when(F.col("_dead"), "purge").otherwise("consolidated").alias("fate"))


def proposed_procedures(mined: DataFrame, proposed: DataFrame, touched: DataFrame, success: float = 0.9, least: int = 5) -> DataFrame:
    """Procedures (id, runs, rate) to propose: successful, run often, not proposed before; none if nothing was touched."""
    some = counted(touched.limit(1).select(F.lit(True).alias("_any")))
    return mined.where((F.col("rate") >= success) & (F.col("runs") >= least)).join(proposed.select("id"), "id", "left_anti").join(some).drop("_any")


def rollup_counts(facts: DataFrame) -> DataFrame:
    """Facts by name space and source, with totals of each level (null: all)."""
    return facts.rollup(F.split("key", ":")[0].alias("space"), "source_type").agg(F.count("*").alias("facts"), F.count_if(is_rule(F.col("key"))).alias("rules"))
