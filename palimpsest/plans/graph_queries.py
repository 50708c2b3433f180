"""Queries of the graph family."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import graph
from palimpsest.plans import tables
from palimpsest.plans.registry import query
from palimpsest.plans.tables import with_tables


@query(with_tables("SELECT src, dst, round(confidence, 6) AS confidence, ts FROM edges", "edges"))
def merge_max_edges(spark: SparkSession, d: str) -> DataFrame:
    lines = tables.read(spark, d, "lineitem")
    raw = lines.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_shipdate").alias("ts"))
    return graph.merge_max(raw).withColumn("confidence", F.round("confidence", 6))


_BOTH = "b AS (SELECT src, dst FROM hops UNION SELECT dst, src FROM hops)"


@query(
    with_tables(
        f"""WITH {_BOTH}, k AS (SELECT DISTINCT src AS seed, src AS node, 0 AS depth FROM hops WHERE src LIKE 'n1%'
  UNION SELECT seed, dst, depth + 1 FROM k JOIN b ON node = src WHERE depth < 3)
SELECT seed, node, min(depth) AS depth FROM k GROUP BY 1, 2""",
        "hops",
    )
)
def khop_neighbours(spark: SparkSession, d: str) -> DataFrame:
    edges = tables.hops(spark, d)
    return graph.khop(edges, edges.where("src like 'n1%'").select(F.col("src").alias("node")).distinct(), 3)


_PATHS = """p AS (SELECT DISTINCT src AS start, src AS target, 0 AS depth, [src] AS path, 1e0 AS conf FROM hops WHERE src LIKE 'n%'
  UNION ALL SELECT start, dst, depth + 1, list_append(path, dst), round(conf * confidence, 4) FROM p JOIN hops ON target = src WHERE depth < 4 AND NOT list_contains(path, dst))"""


def starts(spark: SparkSession, d: str) -> DataFrame:
    return tables.hops(spark, d).where("src like 'n%'").select(F.col("src").alias("node")).distinct()


@query(with_tables(f"WITH {_PATHS} SELECT start, target, depth, array_to_string(path, '>') AS path, conf FROM p WHERE depth > 0", "hops"))
def what_if_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.simple_paths(tables.hops(spark, d), starts(spark, d), 4).withColumn("path", F.array_join("path", ">"))


@query(
    with_tables(
        f"WITH {_PATHS} SELECT start, target, depth, array_to_string(path, '>') AS path FROM p WHERE depth > 0 QUALIFY row_number() OVER (PARTITION BY start, target ORDER BY depth, path) = 1", "hops"
    )
)
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_paths(tables.hops(spark, d), starts(spark, d), 4)


def _diffusion_sql(hops: int) -> str:
    parts, union = ["l0 AS (SELECT 's1' AS node, 1e0 AS conf)"], []
    for k in range(1, hops + 1):
        parts.append(f"r{k} AS (SELECT dst AS node, sum(conf * confidence * {0.7**k}) AS impact, sum(conf * confidence) AS s, max(conf * confidence) AS best FROM l{k - 1} JOIN two ON node = src WHERE dst <> 's1' AND dst <> src GROUP BY 1)")
        parts.append(f"l{k} AS (SELECT node, least(1e0, s) AS conf FROM r{k})")
        union.append(f"SELECT node, impact, {k} AS depth, best FROM r{k}")
    two = "two AS (SELECT src, dst, confidence FROM edges UNION ALL SELECT dst, src, confidence * 0.01e0 FROM edges WHERE hash_ok(dst))".replace("hash_ok(dst)", "CAST(substr(dst, 2) AS BIGINT) % 10 = 0")
    return f"WITH {two}, {', '.join(parts)} SELECT node, round(sum(impact), 8) AS impact, min(depth) AS depth, round(max(best), 10) AS confidence FROM ({' UNION ALL '.join(union)}) GROUP BY node"


@query(with_tables(_diffusion_sql(3), "edges"))
def causal_diffusion(spark: SparkSession, d: str) -> DataFrame:
    e = tables.edges(spark, d).select("src", "dst", "confidence")
    back = e.where(F.expr("cast(substr(dst, 2) as bigint)") % 10 == 0).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("confidence") * 0.01).alias("confidence"))
    out = graph.diffusion(e.unionByName(back), "s1", 3, 0.7)
    return out.select("node", F.round("impact", 8).alias("impact"), "depth", F.round("confidence", 10).alias("confidence"))


def _pagerank_sql(rounds: int) -> str:
    parts = [
        "n AS (SELECT src AS node FROM g UNION SELECT dst FROM g)",
        "pp AS (SELECT node, CASE WHEN node IN ('s1', 's2', 's3') THEN 1e0 / 3 ELSE 0e0 END AS p, node IN (SELECT src FROM g) AS leaves FROM n)",
        "m AS (SELECT src, dst, confidence / sum(confidence) OVER (PARTITION BY src) AS share FROM g)",
        "v0 AS (SELECT node, p AS v FROM pp)",
    ]
    for k in range(1, rounds + 1):
        parts.append(
            f"v{k} AS (SELECT pp.node, 0.85e0 * (coalesce(i.v, 0) + (SELECT coalesce(sum(v), 0) FROM v{k - 1} JOIN pp USING (node) WHERE NOT leaves) * p) + 0.15e0 * p AS v FROM pp LEFT JOIN (SELECT dst AS node, sum(share * v) AS v FROM m JOIN v{k - 1} ON node = src GROUP BY 1) i ON pp.node = i.node)"
        )
    return f"WITH g AS (SELECT src, dst, confidence FROM edges UNION ALL SELECT dst, src, confidence / 2 FROM edges WHERE CAST(substr(dst, 2) AS BIGINT) % 3 = 0), {', '.join(parts)} SELECT node, round(v, 8) AS rank FROM v{rounds}"


@query(with_tables(_pagerank_sql(4), "edges"))
def personalised_pagerank(spark: SparkSession, d: str) -> DataFrame:
    e = tables.edges(spark, d).select("src", "dst", "confidence")
    back = e.where(F.expr("cast(substr(dst, 2) as bigint)") % 3 == 0).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("confidence") / 2).alias("confidence"))
    # Seeds are nodes of the edge table, so the query follows its input.
    seeds = e.where(F.col("src").isin("s1", "s2", "s3")).select(F.col("src").alias("node")).distinct().withColumn("weight", F.lit(1.0))
    return graph.pagerank(e.unionByName(back), seeds, 4).select("node", F.round("v", 8).alias("rank"))


@query(
    """WITH RECURSIVE g AS (SELECT md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h, doc_id FROM documents),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.h = b.h WHERE a.doc_id < b.doc_id UNION ALL SELECT c.doc_id, c.doc_id + 1 FROM documents c WHERE c.doc_id % 10 < 3),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT DISTINCT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON r.node = u.a WHERE r.root < u.b)
SELECT node, min(root) AS root FROM (SELECT node, root FROM r UNION SELECT a, a FROM u) GROUP BY node""".replace("\\\\", "\\")
)
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.read(spark, d, "documents")
    hashed = docs.select("doc_id", F.md5(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("h"))
    # A star per group of equal texts joins it as well as all its pairs do.
    firsts = hashed.groupBy("h").agg(F.min("doc_id").alias("a"))
    same = hashed.join(firsts, "h").where("a < doc_id").select("a", F.col("doc_id").alias("b"))
    chain = docs.where("doc_id % 10 < 3").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return graph.components(same.unionByName(chain))


@query("SELECT p_partkey AS part FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def orphan_nodes(spark: SparkSession, d: str) -> DataFrame:
    used = tables.read(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("part"))
    return tables.read(spark, d, "part").select(F.col("p_partkey").alias("part")).join(used, "part", "left_anti")


@query(
    with_tables(
        """WITH reach AS (SELECT '' AS w, 'n1' AS node, 0 AS k UNION SELECT w, dst, k + 1 FROM reach JOIN hops ON node = src WHERE k < 5), all_ AS (SELECT DISTINCT node FROM reach WHERE node <> 'n1'),
still AS (SELECT node AS w, 'n1' AS node, 0 AS k FROM all_ UNION SELECT w, dst, k + 1 FROM still JOIN hops ON still.node = src WHERE k < 5 AND dst <> w),
s AS (SELECT w, count(DISTINCT node) AS n FROM still WHERE node <> 'n1' GROUP BY w), t AS (SELECT count(*) AS reachable FROM all_)
SELECT a.node, reachable - 1 - coalesce(n, 0) AS cut_off, reachable, round((reachable - 1 - coalesce(n, 0)) / CAST(reachable AS DOUBLE), 6) AS severity FROM all_ a LEFT JOIN s ON a.node = s.w, t
WHERE round((reachable - 1 - coalesce(n, 0)) / CAST(reachable AS DOUBLE), 6) >= 0.1""",
        "hops",
    )
)
def critical_points(spark: SparkSession, d: str) -> DataFrame:
    return graph.cut_points(tables.hops(spark, d).select("src", "dst"), "n1", 5, 0.1)


_WALK = """e AS (SELECT 'relation' AS kind, src, dst, confidence FROM edges UNION ALL SELECT 'contains', 'doc' || o_orderkey, 's' || (o_custkey % 100), 0.5e0 + (o_orderkey % 5) / 10e0 FROM orders
  UNION ALL SELECT 'synonym', 's' || s_suppkey, 's' || (s_suppkey + 1), 0.9e0 FROM supplier UNION ALL SELECT 'relation', 's1', 's1', 1e0)"""


@query(
    with_tables(
        f"""WITH {_WALK}, d AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1),
w AS (SELECT kind, src, dst, confidence AS c, confidence / sqrt(CAST(a.n * b.n AS DOUBLE)) * CASE WHEN src IN ('s3', 's4') OR dst IN ('s3', 's4') THEN 0.5e0 ELSE 1e0 END AS r FROM e JOIN d a ON a.node = src JOIN d b ON b.node = dst WHERE src <> dst),
o AS (SELECT src, dst, CASE kind WHEN 'contains' THEN 0.25e0 * c WHEN 'synonym' THEN c ELSE r END AS x FROM w UNION ALL SELECT dst, src, CASE kind WHEN 'relation' THEN 0.5e0 * r ELSE c END FROM w)
SELECT src, dst, round(max(x), 8) AS weight FROM o GROUP BY 1, 2""",
        "edges",
    )
)
def walk_weights(spark: SparkSession, d: str) -> DataFrame:
    orders, suppliers = tables.read(spark, d, "orders"), tables.read(spark, d, "supplier")
    e = tables.edges(spark, d).select(F.lit("relation").alias("kind"), "src", "dst", "confidence")
    e = e.unionByName(orders.select(F.lit("contains").alias("kind"), F.concat(F.lit("doc"), F.col("o_orderkey")).alias("src"), F.concat(F.lit("s"), F.col("o_custkey") % 100).alias("dst"), (0.5 + F.col("o_orderkey") % 5 / 10.0).alias("confidence")))
    e = e.unionByName(suppliers.select(F.lit("synonym").alias("kind"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("src"), F.concat(F.lit("s"), F.col("s_suppkey") + 1).alias("dst"), F.lit(0.9).alias("confidence")))
    # A self loop, of the first supplier.
    e = e.unionByName(suppliers.where("s_suppkey = 1").select(F.lit("relation").alias("kind"), F.lit("s1").alias("src"), F.lit("s1").alias("dst"), F.lit(1.0).alias("confidence")))
    hubs = suppliers.where("s_suppkey in (3, 4)").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"))
    return graph.walk_weights(e, hubs).withColumn("weight", F.round("weight", 8))


_NODE = "CASE WHEN k % 9 = 0 THEN 'rule:p' WHEN k % 9 = 1 THEN 'passage:p' ELSE 'p' END || k"
_WALKED = f"SELECT 's' || s AS src, {_NODE} AS dst, CASE k % 5 WHEN 0 THEN 'REGULATES' WHEN 1 THEN 'SYNONYM' WHEN 2 THEN 'SUPERSEDED_BY' WHEN 3 THEN 'RELATED' ELSE 'CONTAINS' END AS relation, confidence FROM (SELECT l_suppkey AS s, l_partkey AS k, 1e0 - max(CAST(l_discount AS DOUBLE)) AS confidence FROM lineitem GROUP BY 1, 2)"
_SEEDS = "SELECT s_nationkey AS query_id, 's' || s_suppkey AS node, (3 + s_suppkey % 7) / 10e0 AS weight FROM supplier"
_REGULATES = "(relation = 'REGULATES' OR starts_with(lower(b.dst), 'rule:') OR starts_with(lower(b.dst), 'constraint:'))"


def _hop_sql(start: str, damping: str, boost: str, bridges: str, cap: str) -> str:
    return f"""SELECT query_id, b.dst AS node, least({cap}, max(t.weight * {damping} * (greatest(0.05e0, least(1e0, confidence)) * (1e0 / sqrt(greatest(1e0, degree / 8e0)))) * CASE WHEN {_REGULATES} THEN {boost} ELSE 1e0 END * CASE WHEN relation IN ({bridges}) THEN 1.15e0 ELSE 1e0 END)) AS weight
 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, node) AS place FROM {start}) t JOIN both_ways b ON b.src = t.node JOIN degrees g ON g.node = b.dst WHERE place <= 16 AND relation <> 'SUPERSEDED_BY' GROUP BY 1, 2"""


@query(
    f"""WITH walked AS ({_WALKED}), seeds AS ({_SEEDS}), both_ways AS (SELECT * FROM walked UNION ALL SELECT dst, src, relation, confidence FROM walked), degrees AS (SELECT src AS node, count(*) AS degree FROM both_ways GROUP BY 1),
h1 AS ({_hop_sql("seeds", "0.42e0", "1.25e0", "'SYNONYM', 'CONTAINS'", "0.95e0")}), h2 AS ({_hop_sql("h1", "0.45e0", "1.35e0", "'SYNONYM', 'CONTAINS', 'REGULATES'", "0.85e0")}),
f AS (SELECT query_id, node, max(weight) AS weight FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 ANTI JOIN seeds USING (query_id, node)) WHERE NOT starts_with(node, 'passage:') GROUP BY 1, 2),
n AS (SELECT f.*, s.node IS NULL AS fresh FROM f LEFT JOIN seeds s USING (query_id, node) WHERE s.node IS NULL OR f.weight > s.weight),
t AS (SELECT query_id, node, round(weight, 6) AS weight FROM (SELECT *, coalesce(sum(fresh::INT) OVER (PARTITION BY query_id ORDER BY weight DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM n) WHERE earlier < 24)
SELECT query_id, node, weight FROM seeds ANTI JOIN t USING (query_id, node) UNION ALL SELECT query_id, node, weight FROM t"""
)
def associative_expansion(spark: SparkSession, d: str) -> DataFrame:
    lineitem, supplier = tables.read(spark, d, "lineitem"), tables.read(spark, d, "supplier")
    walked = spark.sql(_WALKED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)
    return graph.expanded_seeds(walked, spark.sql(_SEEDS.replace("FROM supplier", "FROM {supplier}"), supplier=supplier))


_RISKY = "CASE WHEN dst LIKE 'n%' THEN 'blocks' WHEN src LIKE 'n%' THEN 'leads_to' ELSE 'relates' END"


@query(
    with_tables(
        f"""WITH {_PATHS}, q AS (SELECT start, target, path, conf FROM p WHERE depth > 0), s AS (SELECT start, path, path[i] AS src, path[i + 1] AS dst FROM q, unnest(range(1, len(path))) AS t(i)),
v AS (SELECT s.start, s.path, avg(confidence * CASE WHEN s.dst = 'r1' THEN 0.9e0 WHEN {_RISKY.replace("dst", "s.dst").replace("src", "s.src")} IN ('blocks') THEN 0.5e0 ELSE 0.2e0 END) AS mean, max(CASE WHEN {_RISKY.replace("dst", "s.dst").replace("src", "s.src")} IN ('blocks') THEN 1 ELSE 0 END) AS bad FROM s JOIN hops h ON h.src = s.src AND h.dst = s.dst GROUP BY 1, 2),
w AS (SELECT q.start, q.target, array_to_string(q.path, '>') AS path, mean * conf AS plain, bad, conf FROM q JOIN v ON v.start = q.start AND v.path = q.path),
x AS (SELECT start, target, path, round(greatest(plain, CASE WHEN bad = 1 AND plain < 0.4e0 AND conf >= 0.7e0 THEN 0.72e0 WHEN bad = 1 AND plain < 0.2e0 AND conf >= 0.4e0 THEN 0.45e0 ELSE 0e0 END), 6) AS risk FROM w)
SELECT *, CASE WHEN risk >= 0.7e0 THEN 'CRITICAL' WHEN risk >= 0.4e0 THEN 'HIGH' WHEN risk >= 0.15e0 THEN 'MODERATE' ELSE 'LOW' END AS level FROM x""",
        "hops",
    )
)
def path_risk(spark: SparkSession, d: str) -> DataFrame:
    """How much is at risk on each path of what-if, where steps down to a nation are critical."""
    hops = tables.hops(spark, d)
    paths = graph.simple_paths(hops, starts(spark, d), 4)
    severe = tables.read(spark, d, "region").where("r_regionkey = 1").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(0.9).alias("severity"))
    return graph.path_risks(paths, hops.withColumn("predicate", F.expr(_RISKY)), severities=severe).select("start", "target", F.array_join("path", ">").alias("path"), "risk", "level")


@query("SELECT count(*) AS passages, count(o) AS covered, round(count(o) / CAST(greatest(count(*), 1) AS DOUBLE), 4) AS coverage FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders JOIN lineitem ON l_orderkey = o_orderkey) ON o = c_custkey")
def dual_node_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The share of customers, as passages, that hold a part that they have ordered."""
    read = lambda name: tables.read(spark, d, name)
    passage = lambda c: F.concat(F.lit("passage:"), F.col(c).cast("string"))
    edges = read("orders").join(read("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(passage("o_custkey").alias("src"), F.lit("CONTAINS").alias("relation"))
    return graph.passage_coverage(read("customer").select(passage("c_custkey").alias("node")), edges)
