"""Graph operators over an edge table (src, dst, confidence): merging, neighbourhoods, paths, propagation, components.

Loops run over depth, which is small; each step is a join and an aggregation, and steps of long loops are materialised
in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.steps import materialised


def merge_max(edges: DataFrame) -> DataFrame:
    """Parallel edges merged: confidence and time only grow."""
    return edges.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"), F.max("ts").alias("ts"))


def khop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``seed``, ``node`` and ``depth`` (least) within ``hops`` undirected steps of the seeds (column node)."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, hops + 1):
        step = frontier.join(both, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(frontier)
    return seen


def simple_paths(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """All acyclic directed paths of 1 to ``hops`` edges from the starts (column node): start, target, depth, path, and
    conf, the product of confidences rounded to 4 places at each step."""
    hop = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("confidence").alias("_c"))
    level = starts.select(F.col("node").alias("start"), F.col("node").alias("target"), F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(1.0).alias("conf"))
    levels = []
    for depth in range(1, hops + 1):
        step = level.join(hop, F.col("target") == F.col("_src")).where(~F.array_contains("path", F.col("_dst")))
        level = step.select("start", F.col("_dst").alias("target"), F.lit(depth).alias("depth"), F.concat("path", F.array("_dst")).alias("path"), F.round(F.col("conf") * F.col("_c"), 4).alias("conf"))
        levels.append(level)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def shortest_paths(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Per start and target the shortest directed path; of equal ones the first in order of its nodes. Breadth first, with
    one path for each start and target: the first of a node's paths goes on as the first of those through it."""
    hop = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst")).where("_src <> _dst").distinct()
    level = starts.select(F.col("node").alias("start"), F.col("node").alias("target"), F.lit(0).alias("depth"), F.array("node").alias("path")).distinct()
    seen = level
    for depth in range(1, hops + 1):
        step = level.join(hop, F.col("target") == F.col("_src")).select("start", F.col("_dst").alias("target"), F.concat("path", F.array("_dst")).alias("path"))
        step = step.groupBy("start", "target").agg(F.min("path").alias("path")).join(seen.select("start", "target"), ["start", "target"], "left_anti")
        level = step.select("start", "target", F.lit(depth).alias("depth"), "path")
        seen = seen.unionByName(level)
    return seen.where("depth > 0").select("start", "target", "depth", F.array_join("path", ">").alias("path"))


def diffusion(edges: DataFrame, start: str, hops: int, decay: float) -> DataFrame:
    """Impact of a change at ``start``: in each layer a node hands on its confidence x edge x decay^depth; confidences
    that merge add up to 1 at most; the start and self loops are never entered again."""
    spark = edges.sparkSession
    layer = spark.createDataFrame([(start, 1.0)], "node string, conf double")
    layers = []
    for depth in range(1, hops + 1):
        step = layer.join(edges, F.col("node") == F.col("src")).where((F.col("dst") != start) & (F.col("dst") != F.col("src")))
        reach = step.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("conf") * F.col("confidence") * decay**depth).alias("impact"), F.sum(F.col("conf") * F.col("confidence")).alias("sum"), F.max(F.col("conf") * F.col("confidence")).alias("best"))
        layers.append(reach.select("node", "impact", F.lit(depth).alias("depth"), "best"))
        layer = reach.select("node", F.least(F.lit(1.0), F.col("sum")).alias("conf"))
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    return out.groupBy("node").agg(F.sum("impact").alias("impact"), F.min("depth").alias("depth"), F.max("best").alias("confidence"))


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int, damping: float = 0.85, materialise_every: int = 5) -> DataFrame:
    """Personalised PageRank after a fixed number of rounds: v = d (P'v + dangling p) + (1 - d) p.

    ``edges`` have confidence as weight, ``seeds`` node and weight. Node weights stay distributed; only the dangling
    mass, one number a round, is broadcast.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    total = seeds.agg(F.sum("weight").alias("_t"))
    p = nodes.join(seeds, "node", "left").join(F.broadcast(total)).select("node", (F.coalesce("weight", F.lit(0.0)) / F.col("_t")).alias("p"))
    out = edges.groupBy("src").agg(F.sum("confidence").alias("_w"))
    moves = materialised(edges.join(out, "src").select("src", "dst", (F.col("confidence") / F.col("_w")).alias("share")))
    p = materialised(p.join(out.select(F.col("src").alias("node"), F.lit(True).alias("leaves")), "node", "left").select("node", "p", F.coalesce("leaves", F.lit(False)).alias("leaves")))
    v = p.select("node", F.col("p").alias("v"))
    for n in range(1, rounds + 1):
        lost = v.join(p.where("not leaves"), "node").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("_lost"))
        got = moves.join(v.select(F.col("node").alias("src"), "v"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("v")).alias("_in"))
        v = p.join(got, "node", "left").join(F.broadcast(lost)).select("node", (damping * (F.coalesce("_in", F.lit(0.0)) + F.col("_lost") * F.col("p")) + (1 - damping) * F.col("p")).alias("v"))
        if n % materialise_every == 0:
            v = materialised(v)
    return v


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (least node) of undirected links a, b, by alternating stars: first every greater neighbour of
    a node, then every lesser one and the node, link to the least of all. O(log^2 n) rounds of narrow group-bys, each
    materialised; a node with very many links is never gathered."""
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    rest, seen = materialised(links.select(hi, lo).distinct()), None
    alone = rest.where("hi = lo").select(F.col("hi").alias("node"))
    pairs = rest.where("hi <> lo")
    while True:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        pairs = materialised(small.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct())
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("hi", "lo") % 1_000_000_007)).first()
        if now == seen:
            break
        seen = now
    found = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
    return found.unionByName(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("root")))


def cut_points(edges: DataFrame, start: str, hops: int, least: float = 0.5) -> DataFrame:
    """Nodes without which at least ``least`` of what ``start`` reaches in ``hops`` steps is out of reach: node, cut off,
    reachable and severity. One reachability with the left-out node as a column, not one run per node."""
    reach = reachable(edges, edges.sparkSession.createDataFrame([("", start)], "without string, node string"), hops).where(F.col("node") != start).select("node")
    reach = materialised(reach)
    cases = reach.select(F.col("node").alias("without"), F.lit(start).alias("node"))
    still = reachable(edges, cases, hops).where(F.col("node") != start).groupBy("without").agg(F.count("*").alias("still"))
    total = reach.agg(F.count("*").alias("reachable"))
    out = reach.withColumnRenamed("node", "without").join(still, "without", "left").join(F.broadcast(total))
    lost = F.col("reachable") - 1 - F.coalesce("still", F.lit(0))
    return out.select(F.col("without").alias("node"), lost.alias("cut_off"), "reachable", F.round(lost / F.col("reachable"), 6).alias("severity")).where(F.col("severity") >= least)


def reachable(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """``without``, ``node``: what each case reaches in at most ``hops`` steps that don't enter the node it goes without."""
    seen = frontier = starts.select("without", "node")
    ways = edges.select(F.col("src").alias("node"), "dst").distinct()
    for _ in range(hops):
        step = frontier.join(ways, "node").where(F.col("dst") != F.col("without")).select("without", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen, ["without", "node"], "left_anti")
        seen = seen.unionByName(frontier)
    return seen


def walk_weights(edges: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """Weights of a random walk over passages and entities: src, dst, weight.

    ``edges`` have kind (contains, synonym, relation), src, dst and confidence. Containment leads from the passage with a
    quarter of its weight and back with all of it; synonyms lead both ways; a relation leads on with its confidence over
    the root of both degrees, back with half of that, and with half again where a hub (column node) is an end. Of
    parallel edges the strongest counts, self loops don't.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    du, dv = ends.select(F.col("node").alias("src"), F.col("degree").alias("_du")), ends.select(F.col("node").alias("dst"), F.col("degree").alias("_dv"))
    df = edges.join(du, "src").join(dv, "dst").where("src <> dst")
    if hubs is None:
        df = df.withColumn("_hub", F.lit(1.0))
    else:
        a, b = hubs.select(F.col("node").alias("src"), F.lit(True).alias("_a")).distinct(), hubs.select(F.col("node").alias("dst"), F.lit(True).alias("_b")).distinct()
        df = df.join(a, "src", "left").join(b, "dst", "left").withColumn("_hub", F.when(F.col("_a") | F.col("_b"), 0.5).otherwise(1.0))
    c = F.col("confidence")
    relation = c / F.sqrt(F.col("_du") * F.col("_dv").cast("double")) * F.col("_hub")
    on = F.when(F.col("kind") == "contains", 0.25 * c).when(F.col("kind") == "synonym", c).otherwise(relation)
    back = F.when(F.col("kind") == "relation", 0.5 * relation).otherwise(c)
    both = df.select("src", "dst", on.alias("weight")).unionByName(df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), back.alias("weight")))
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def expanded_seeds(edges: DataFrame, seeds: DataFrame, most: int = 24, widest: int = 16) -> DataFrame:
    """``seeds`` (query_id, node, weight; each node once a query) and up to ``most`` further nodes within two hops, with their
    weights. ``edges`` (src, dst, relation, confidence) are walked both ways from the ``widest`` strongest nodes of a hop;
    weights fall with each hop and with the degree of what is reached. Superseded edges aren't walked, passages are
    walked through but not returned. A null confidence counts as 1."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), "relation", "confidence").unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("to"), "relation", "confidence"))
    degree = both.groupBy(F.col("node").alias("to")).agg(F.count("*").alias("degree"))
    walked = both.where((F.coalesce("relation", F.lit("RELATED")) != "SUPERSEDED_BY") & (F.col("node") != F.col("to")))
    strongest = Window.partitionBy("query_id").orderBy(F.col("weight").desc(), "node")

    def hop(start: DataFrame, damping: float, rule_boost: float, bridges: list[str], cap: float) -> DataFrame:
        top = start.where("weight > 0").withColumn("_place", F.row_number().over(strongest)).where(F.col("_place") <= widest)
        regulates = (F.coalesce("relation", F.lit("RELATED")) == "REGULATES") | F.lower("to").startswith("rule:") | F.lower("to").startswith("constraint:")
        worth = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0)))) * (1.0 / F.sqrt(F.greatest(F.lit(1.0), F.col("degree") / 8.0)))
        reached = F.col("weight") * damping * worth * F.when(regulates, rule_boost).otherwise(1.0) * F.when(F.col("relation").isin(bridges), 1.15).otherwise(1.0)
        steps = top.select("query_id", "node", "weight").join(walked, "node").join(degree, "to")
        return steps.groupBy("query_id", F.col("to").alias("node")).agg(F.least(F.lit(cap), F.max(reached)).alias("weight"))

    first = hop(seeds, 0.42, 1.25, ["SYNONYM", "CONTAINS"], 0.95)
    second = hop(first, 0.45, 1.35, ["SYNONYM", "CONTAINS", "REGULATES"], 0.85).join(seeds.select("query_id", "node"), ["query_id", "node"], "left_anti")
    found = first.unionByName(second).groupBy("query_id", "node").agg(F.max("weight").alias("weight")).where(~F.col("node").startswith("passage:"))
    known = seeds.select("query_id", "node", F.col("weight").alias("_seed"))
    better = found.join(known, ["query_id", "node"], "left").where(F.col("_seed").isNull() | (F.col("weight") > F.col("_seed")))
    before = F.coalesce(F.sum(F.col("_seed").isNull().cast("int")).over(strongest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = better.withColumn("_before", before).where(F.col("_before") < most).select("query_id", "node", (F.floor(F.col("weight") * 1e6 + 0.5) / 1e6).alias("weight"))
    return seeds.select("query_id", "node", "weight").join(taken.select("query_id", "node"), ["query_id", "node"], "left_anti").unionByName(taken)


# From which risk on a path has a level.
RISK_LEVELS = [(0.70, "CRITICAL"), (0.40, "HIGH"), (0.15, "MODERATE")]
# Predicates whose steps are critical.
CRITICAL = ["depends_on", "relies_on", "hosted_on", "hosts", "powers", "routes_to", "critical_for", "requires", "authenticates", "mounts", "databases", "causes", "breaks", "blocks", "restricted_by", "requires_condition"]


def path_risks(paths: DataFrame, edges: DataFrame, critical: list[str] = CRITICAL, severities: DataFrame | None = None) -> DataFrame:
    """``paths`` (start, path, conf) with ``risk`` and ``level``: over its steps the mean of confidence x severity of where it
    leads (``severities``: node, severity; else 0.5 after a critical predicate, 0.2 after others), times the path's own
    confidence. A path with a critical step has 0.72 at least if it is sure (0.70), 0.45 if its risk is below 0.20 and its
    confidence 0.40 or more. ``edges``: src, dst, predicate, confidence, each pair once. Paths of no step are at no risk."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda k: F.struct(F.element_at("path", k).alias("src"), F.try_element_at("path", k + 1).alias("dst")))
    steps = paths.select("start", "path", F.explode(pairs).alias("s")).select("start", "path", "s.*").join(edges.select("src", "dst", "predicate", "confidence"), ["src", "dst"])
    bad = F.col("predicate").isin(critical)
    usual = F.when(bad, 0.5).otherwise(0.2)
    steps = steps.withColumn("severity", usual) if severities is None else steps.join(severities.select(F.col("node").alias("dst"), "severity"), "dst", "left").withColumn("severity", F.coalesce("severity", usual))
    sums = steps.groupBy("start", "path").agg((F.sum(F.col("confidence") * F.col("severity")) / F.count("*")).alias("mean"), F.max(bad.cast("int")).alias("bad"))
    found = paths.join(sums, ["start", "path"], "left").withColumn("plain", F.coalesce(F.col("mean") * F.col("conf"), F.lit(0.0)))
    floor = F.when((F.col("bad") == 1) & (F.col("plain") < 0.40) & (F.col("conf") >= 0.70), 0.72).when((F.col("bad") == 1) & (F.col("plain") < 0.20) & (F.col("conf") >= 0.40), 0.45).otherwise(0.0)
    risk = found.withColumn("risk", F.round(F.greatest("plain", floor), 6))
    level = F.lit("LOW")
    for least, name in reversed(RISK_LEVELS):
        level = F.when(F.col("risk") >= least, name).otherwise(level)
    return risk.withColumn("level", level).drop("mean", "bad", "plain")


def passage_coverage(passages: DataFrame, edges: DataFrame) -> DataFrame:
    """``passages``, ``covered`` and ``coverage`` (4 places): how many of the passages (node) hold an entity by an edge of
    relation CONTAINS; 0 without passages."""
    own = edges.where("relation = 'CONTAINS'").select(F.col("src").alias("node")).distinct().withColumn("_held", F.lit(1))
    counts = passages.select("node").distinct().join(own, "node", "left").agg(F.count("*").alias("passages"), F.count("_held").alias("covered"))
    return counts.withColumn("coverage", F.round(F.col("covered") / F.greatest(F.col("passages"), F.lit(1)), 4))
