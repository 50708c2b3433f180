"""Queries of readers, calibration, cluster quality, learners and consolidation."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import consolidation, learning
from palimpsest.plans import tables
from palimpsest.plans.analytics_queries import _SAMPLE, sample, vectors
from palimpsest.plans.registry import query
from palimpsest.plans.retrieval_queries import _TOP, scored
from palimpsest.plans.tables import with_tables
from palimpsest.operators import retrieval
from palimpsest.sources import readers


@query(
    r"""WITH p AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS section FROM documents),
t AS (SELECT id, section, trim(raw) AS body FROM p WHERE trim(raw) <> '')
SELECT id, CAST(section AS INTEGER) AS section, CASE WHEN contains(body, ':') THEN trim(split_part(body, ':', 1)) ELSE array_to_string(list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> '')[1:5], ' ') END AS subject, body FROM t"""
)
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return readers.sections(tables.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "\n")


@query(
    r"""WITH t AS (SELECT event_id // 10 AS id, event_id, CASE WHEN event_type IN ('click', 'signup') THEN '[' || CAST(ts AS DATE) || '] (' || (event_id % 10) / 10.0 || ') ' || event_type ELSE 'more ' || event_type END AS line FROM events),
g AS (SELECT *, sum(CASE WHEN starts_with(line, '[') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY event_id) AS record FROM t)
SELECT id, CAST(record AS BIGINT) AS record, max(regexp_extract(line, '^\[([0-9-]+)\]', 1)) FILTER (starts_with(line, '[')) AS day, max(TRY_CAST(regexp_extract(line, '\(([0-9.]+)\)', 1) AS DOUBLE)) FILTER (starts_with(line, '[')) AS importance,
  string_agg(CASE WHEN starts_with(line, '[') THEN regexp_extract(line, '\) (.*)$', 1) ELSE line END, chr(10) ORDER BY event_id) AS body FROM g GROUP BY 1, 2"""
)
def context_records(spark: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.lit("["), F.to_date("ts").cast("string"), F.lit("] ("), (F.col("event_id") % 10 / 10.0).cast("string"), F.lit(") "), "event_type")
    line = F.when(F.col("event_type").isin("click", "signup"), head).otherwise(F.concat(F.lit("more "), "event_type"))
    texts = tables.read(spark, d, "events").select(F.floor(F.col("event_id") / 10).alias("id"), F.struct("event_id", line.alias("line")).alias("x")).groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return readers.context_lines(texts.select("id", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("text")))


@query(
    """WITH c AS (SELECT user_id, event_id, event_id % 1000 AS call, event_type FROM events), r AS (SELECT user_id, event_id + 1 AS event_id, event_id % 1000 AS call, event_type, value FROM events WHERE event_id % 3 <> 0),
f AS (SELECT user_id, call, arg_min({'t': event_type, 'v': value}, event_id) AS r FROM r GROUP BY 1, 2)
SELECT c.user_id AS session, c.event_id AS seq, c.event_type AS tool, CASE WHEN r.t = 'error' THEN false WHEN r.t = 'signup' THEN true WHEN r.t = 'view' THEN false ELSE coalesce(r.t, '') <> '' END AS success FROM c LEFT JOIN f ON c.user_id = f.user_id AND c.call = f.call"""
)
def tool_steps(spark: SparkSession, d: str) -> DataFrame:
    base = tables.read(spark, d, "events").select(F.col("user_id").alias("session"), "event_id", (F.col("event_id") % 1000).alias("call_id"), "event_type")
    none = lambda t: F.lit(None).cast(t)
    calls = base.select("session", F.col("event_id").alias("seq"), F.lit("call").alias("role"), "call_id", F.col("event_type").alias("tool"), none("string").alias("output"), none("boolean").alias("is_error"), none("int").alias("exit_code"))
    kind = F.col("event_type")
    flag = F.when(kind == "error", True).when(kind == "signup", False)
    results = base.where("event_id % 3 <> 0").select("session", (F.col("event_id") + 1).alias("seq"), F.lit("result").alias("role"), "call_id", none("string").alias("tool"), kind.alias("output"), flag.alias("is_error"), F.when(kind == "view", 1).alias("exit_code"))
    return readers.tool_steps(calls.unionByName(results))


_BINS = f"""{_SAMPLE}, cnt AS (SELECT score, count(*) AS n, sum(label) AS pos FROM sample GROUP BY 1),
cum AS (SELECT *, least(11, floor(12 * coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER ()::DOUBLE)) AS bin FROM cnt),
bins AS (SELECT bin, sum(n) AS n, sum(score * n) / sum(n)::DOUBLE AS x, sum(pos) / sum(n)::DOUBLE AS y FROM cum GROUP BY 1),
means AS (SELECT a.bin AS j, b.bin AS k, (SELECT sum(n * y) / sum(n)::DOUBLE FROM bins c WHERE c.bin BETWEEN a.bin AND b.bin) AS mean FROM bins a JOIN bins b ON a.bin <= b.bin),
knots AS (SELECT i AS bin, x, max(m) AS p FROM (SELECT bins.bin AS i, x, j, min(mean) AS m FROM bins JOIN means ON j <= bins.bin AND k >= bins.bin GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query(f"WITH {_BINS} SELECT CAST(bin AS BIGINT) AS bin, round(x, 6) AS x, round(p, 6) AS p FROM knots")
def isotonic_fit(spark: SparkSession, d: str) -> DataFrame:
    fit = learning.isotonic(learning.quantile_bins(sample(spark, d)))
    return fit.select(F.col("bin").cast("long").alias("bin"), F.round("x", 6).alias("x"), F.round("p", 6).alias("p"))


@query(
    f"""WITH {_BINS}, l AS (SELECT x, p, lead(x) OVER (ORDER BY bin) AS x2, lead(p) OVER (ORDER BY bin) AS p2, row_number() OVER (ORDER BY bin) AS r FROM knots),
s AS (SELECT doc_id, least(1e0, round(ln(1 + n_chars) / 11e0, 3)) AS score FROM documents)
SELECT doc_id, round(CASE WHEN p2 IS NULL OR score <= x THEN p ELSE p + (score - x) / (x2 - x) * (p2 - p) END, 6) AS p FROM s JOIN l ON (r = 1 OR score >= x) AND (x2 IS NULL OR score < x2)"""
)
def calibrated_probability(spark: SparkSession, d: str) -> DataFrame:
    scores = tables.read(spark, d, "documents").select("doc_id", F.least(F.lit(1.0), F.round(F.log(1 + F.col("n_chars")) / 11.0, 3)).alias("score"))
    found = learning.calibrated(scores, learning.isotonic(learning.quantile_bins(sample(spark, d))))
    return found.select("doc_id", F.round("p", 6).alias("p"))


@query(
    f"""WITH {_SAMPLE}, c AS (SELECT score, sum(label) AS a, sum(1 - label) AS b FROM sample GROUP BY 1)
SELECT round(max(g), 6) AS ks FROM (SELECT abs(sum(a) OVER (ORDER BY score) / (SELECT sum(a) FROM c)::DOUBLE - sum(b) OVER (ORDER BY score) / (SELECT sum(b) FROM c)::DOUBLE) AS g FROM c)"""
)
def drift_ks(spark: SparkSession, d: str) -> DataFrame:
    return learning.ks_statistic(sample(spark, d))


@query(
    """WITH c AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings), p AS (SELECT label, d, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM c GROUP BY 1, 2), g AS (SELECT d, avg(v) AS a FROM c GROUP BY 1)
SELECT round((sum(n * pow(m - a, 2)) / (count(DISTINCT label) - 1)) / (sum(n * s) / ((SELECT count(*) FROM embeddings) - count(DISTINCT label))), 4) AS ch, count(DISTINCT label) AS k FROM p JOIN g USING (d)"""
)
def cluster_quality(spark: SparkSession, d: str) -> DataFrame:
    return learning.calinski_harabasz(vectors(spark, d))


@query(
    with_tables(
        f"{_TOP} SELECT query_id, min(rank) FILTER (contains(lower(value), query)) AS first_hit, coalesce(min(rank) FILTER (contains(lower(value), query)) <= 1, false) AS hit_1, coalesce(min(rank) FILTER (contains(lower(value), query)) <= 3, false) AS hit_3 FROM top JOIN facts USING (key) JOIN questions USING (query_id) WHERE rank <= 10 GROUP BY query_id",
        "facts",
        "questions",
    )
)
def hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    top = retrieval.top_k(scored(spark, d), "raw_bm25", 10).join(tables.facts(spark, d).select("key", "value"), "key").join(tables.questions(spark, d), "query_id")
    first = F.min(F.when(F.contains(F.lower("value"), F.col("query")), F.col("rank")))
    return top.groupBy("query_id").agg(first.cast("long").alias("first_hit"), F.coalesce(first <= 1, F.lit(False)).alias("hit_1"), F.coalesce(first <= 3, F.lit(False)).alias("hit_3"))


def rooted(spark: SparkSession, d: str) -> DataFrame:
    return tables.facts(spark, d).withColumn("root", F.regexp_extract("key", "(src[0-9]+)", 1))


_PAIRS = r"""bags AS (SELECT root, key, t, count(*) AS n FROM (SELECT regexp_extract(key, '(src[0-9]+)', 1) AS root, key, unnest(regexp_extract_all(lower(value), '[\p{L}\p{N}]+')) AS t FROM facts) WHERE length(t) >= 3 GROUP BY 1, 2, 3),
norms AS (SELECT key, sqrt(sum(n * n)) AS norm FROM bags GROUP BY 1), dots AS (SELECT a.key AS a, b.key AS b, sum(a.n * b.n) AS dot FROM bags a JOIN bags b ON a.root = b.root AND a.t = b.t AND a.key < b.key GROUP BY 1, 2)"""


@query(with_tables(f"WITH {_PAIRS} SELECT a, b, round(dot / (x.norm * y.norm), 6) AS cos FROM dots JOIN norms x ON a = x.key JOIN norms y ON b = y.key WHERE round(dot / (x.norm * y.norm), 6) >= 0.88", "facts"))
def similar_facts(spark: SparkSession, d: str) -> DataFrame:
    return consolidation.similar_pairs(rooted(spark, d), 0.88)


@query(
    with_tables(
        f"""WITH {_PAIRS}, l AS (SELECT a, b FROM dots JOIN norms x ON a = x.key JOIN norms y ON b = y.key WHERE round(dot / (x.norm * y.norm), 6) >= 0.88), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON r.node = u.a), m AS (SELECT node, min(root) AS root FROM r GROUP BY 1),
h AS (SELECT m.node AS key, m.root, {{'c': confidence, 't': ts, 'k': f.key}} AS o FROM m JOIN facts f ON f.key = m.node), b AS (SELECT root, max(o) AS best FROM h GROUP BY 1)
SELECT key, best.k AS canonical FROM h JOIN b USING (root)""",
        "facts",
    )
)
def consolidated_facts(spark: SparkSession, d: str) -> DataFrame:
    return consolidation.consolidated(rooted(spark, d), 0.88)


@query(with_tables("SELECT key FROM facts WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0 AND confidence - 0.4e0 < 0.2e0 AND NOT regexp_matches(key, '^(hermes:|fact:|prompt-|mnemosyne:|rule:|preference:|constraint:|config:)') AND doc_id % 7 <> 0", "facts"))
def collectable_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.facts(spark, d).withColumns({"temporary": F.col("doc_id") % 3 == 0, "provenance": F.when(F.col("doc_id") % 5 == 0, "given"), "confidence": F.col("confidence") - 0.4, "superseded": F.col("doc_id") % 7 == 0})
    return consolidation.collectable(rows).select("key")


@query()
def packed_components(spark: SparkSession, d: str) -> DataFrame:
    top = retrieval.top_k(scored(spark, d), "raw_bm25", 60).join(tables.facts(spark, d).select("key", "value"), "key")
    return consolidation.packed_components(top.select("query_id", "key", "value", F.col("lex").alias("score")), 1500)


@query(
    """WITH RECURSIVE o AS (SELECT event_id, event_type, abs(value - 20e0) / 20e0 AS error, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
p AS (SELECT DISTINCT event_type, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, 1e0 AS x FROM events
  UNION ALL SELECT p.event_type, o.n, o.event_id, CASE WHEN error IS NULL THEN x ELSE greatest(0.05e0, least(10e0, 0.85e0 * x + 0.15e0 / (error * error + 0.04e0))) END FROM p JOIN o ON o.event_type = p.event_type AND o.n = p.n + 1)
SELECT event_id, round(x, 8) AS precision FROM p WHERE n > 0"""
)
def channel_precision(spark: SparkSession, d: str) -> DataFrame:
    """How far each kind of event is to be trusted after each observation of its value."""
    events = tables.read(spark, d, "events")
    observed = events.select(F.col("event_type").alias("channel"), F.col("event_id").alias("seq"), (F.abs(F.col("value") - 20.0) / 20.0).alias("error"))
    return learning.precisions(observed).select(F.col("seq").alias("event_id"), F.round("precision", 8).alias("precision"))
