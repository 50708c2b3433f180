"""Calibration, drift, cluster quality, and the sequential learners that run per group in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.steps import materialised, numbered, summed


def quantile_bins(sample: DataFrame, bins: int = 12) -> DataFrame:
    """``bin``, ``n``, ``x`` (mean score), ``y`` (mean label) of a sample by ranks of its distinct scores.

    Scores are counted first, so there is one row per distinct score.
    """
    counts = summed(sample.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("pos")), "score", ["n"])
    total = counts.agg(F.sum("n").alias("_total"))
    binned = counts.join(F.broadcast(total)).withColumn("bin", F.least(F.lit(bins - 1), F.floor(bins * F.col("_before_n") / F.col("_total"))))
    return binned.groupBy("bin").agg(F.sum("n").alias("n"), (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("x"), (F.sum("pos") / F.sum("n")).alias("y"))


def isotonic(bins: DataFrame) -> DataFrame:
    """The isotonic fit of a few bins: at each bin the greatest, over starts, of the least, over ends, weighted mean."""
    a = bins.select(F.col("bin").alias("i"), "x")
    spans = bins.select(F.col("bin").alias("j")).join(bins.select(F.col("bin").alias("k")), F.col("j") <= F.col("k"))
    inside = bins.select("bin", "n", "y")
    means = spans.join(inside, (F.col("bin") >= F.col("j")) & (F.col("bin") <= F.col("k"))).groupBy("j", "k").agg((F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("mean"))
    least = a.join(means, (F.col("j") <= F.col("i")) & (F.col("k") >= F.col("i"))).groupBy("i", "x", "j").agg(F.min("mean").alias("m"))
    return least.groupBy(F.col("i").alias("bin"), "x").agg(F.max("m").alias("p"))


def calibrated(scores: DataFrame, knots: DataFrame) -> DataFrame:
    """``scores`` with ``p``: linear between the knots (bin, x, p), level beyond them. Knots are a few rows."""
    w = Window.orderBy("bin")
    pieces = knots.select("x", "p", F.lead("x").over(w).alias("x2"), F.lead("p").over(w).alias("p2"), F.row_number().over(w).alias("_n"))
    own = F.when(F.col("_n") == 1, float("-inf")).otherwise(F.col("x"))
    pieces = F.broadcast(pieces.select(own.alias("_from"), F.col("x").alias("_x"), F.col("p").alias("_p"), F.coalesce("x2", F.lit(float("inf"))).alias("_to"), "x2", "p2"))
    on = (F.col("score") >= F.col("_from")) & (F.col("score") < F.col("_to"))
    share = (F.col("score") - F.col("_x")) / (F.col("x2") - F.col("_x"))
    p = F.when(F.col("p2").isNull() | (F.col("score") <= F.col("_x")), F.col("_p")).otherwise(F.col("_p") + share * (F.col("p2") - F.col("_p")))
    return scores.join(pieces, on).withColumn("p", p).drop("_from", "_x", "_p", "_to", "x2", "p2")


def ks_statistic(sample: DataFrame) -> DataFrame:
    """The greatest gap between the score distributions of label 1 and label 0; one row."""
    counts = sample.groupBy("score").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    counts = summed(counts, "score", ["a", "b"])
    total = counts.agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    gap = F.abs((F.col("_before_a") + F.col("a")) / F.col("_a") - (F.col("_before_b") + F.col("b")) / F.col("_b"))
    return counts.join(F.broadcast(total)).select(gap.alias("g")).agg(F.round(F.max("g"), 6).alias("ks"))


def calinski_harabasz(vectors: DataFrame) -> DataFrame:
    """(between / (k - 1)) / (within / (n - k)) of vectors (label, vector); one row."""
    cells = vectors.select("label", F.posexplode("vector").alias("d", "v")).withColumn("v", F.col("v").cast("double"))
    per = cells.groupBy("label", "d").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    mean = cells.groupBy("d").agg(F.avg("v").alias("all"))
    both = per.join(mean, "d").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("all"), 2)).alias("between"), F.sum(F.col("n") * F.col("s")).alias("within"), F.count_distinct("label").alias("k"), (F.sum("n") / F.count_distinct("d")).alias("n"))
    return both.select(F.round((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k"))), 4).alias("ch"), F.col("k"))


#: Of a channel's precision: what of it stays, the least variance, its bounds, and observations of a step of the scan.
STAYS, LEAST_VARIANCE, LOWEST, HIGHEST = 0.85, 0.04, 0.05, 10.0
CHUNK = 1000


def _after(f: Column, g: Column) -> Column:
    """The map that does f, then g; each is x -> a x + b kept within low and high, with a of 0 or more."""
    keep = lambda x: F.greatest(g["low"], F.least(g["high"], g["a"] * x + g["b"]))
    return F.struct((g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), keep(f["low"]).alias("low"), keep(f["high"]).alias("high"))


def precisions(observed: DataFrame, first: float = 1.0) -> DataFrame:
    """``observed`` (channel, seq, error) with ``precision``: the running average of 1 / (error^2 + least variance), kept in its
    bounds after each observation, in the order of seq.

    Each observation is a map of the precision before it, and such maps compose to ones of their kind. So chunks of CHUNK
    observations are composed first, then chunks of chunks, up to one map a channel; the precision that each begins with
    comes down the same way. No channel is folded in one task. A null error leaves the precision as it is.
    """
    gain = (1 - STAYS) / (F.greatest(F.lit(0.0), F.col("error")) * F.greatest(F.lit(0.0), F.col("error")) + LEAST_VARIANCE)
    told = F.col("error").isNotNull()
    one = F.struct(F.when(told, STAYS).otherwise(1.0).alias("a"), F.when(told, gain).otherwise(0.0).alias("b"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high"))
    rows = numbered(observed.withColumn("_map", one), "channel", ["seq"])
    same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high"))
    level, levels = rows.select("channel", F.col("_rank").alias("at"), F.col("_map").alias("map")), []
    while True:
        grouped = level.groupBy("channel", F.expr(f"at DIV {CHUNK}").alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "map"))), lambda x: x["map"]).alias("maps"))
        grouped = materialised(grouped)
        levels.append(grouped)
        if grouped.where("at > 0").isEmpty():
            break
        level = grouped.select("channel", "at", F.aggregate("maps", same, _after).alias("map"))
    begins = levels[-1].select("channel", "at", F.lit(first).alias("x"))
    # Down again: what each map of a chunk begins with, at last what each observation leaves.
    for n, grouped in enumerate(reversed(levels)):
        last = n == len(levels) - 1
        step = lambda xs, m: F.concat(xs, F.array(F.greatest(m["low"], F.least(m["high"], m["a"] * F.element_at(xs, -1) + m["b"]))))
        values = F.aggregate("maps", F.array("x"), step)
        values = F.slice(values, 2, CHUNK) if last else F.slice(values, 1, F.size("maps"))
        placed = grouped.join(begins, ["channel", "at"]).select("channel", "at", F.posexplode(values).alias("k", "x"))
        begins = placed.select("channel", (F.col("at") * CHUNK + F.col("k")).alias("at"), "x")
    return rows.drop("_map").join(begins.select("channel", F.col("at").alias("_rank"), F.col("x").alias("precision")), ["channel", "_rank"]).drop("_rank")
