"""Queries of the recall family: from questions and facts to a context block."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scoring, text
from palimpsest.operators import analytics, retrieval
from palimpsest.plans import tables
from palimpsest.plans.gate_queries import STEM
from palimpsest.plans.registry import query
from palimpsest.plans.tables import with_tables

_BM25 = r"""asked AS (SELECT query_id, lower(trim(query)) AS phrase, list_filter(regexp_extract_all(lower(query), '[\p{L}\p{N}]+'), lambda t: length(t) >= 3) AS q FROM questions),
terms AS (SELECT query_id, len(q) AS n_query, term, count(*) AS times FROM (SELECT query_id, q, unnest(q) AS term FROM asked) GROUP BY ALL),
held AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(regexp_extract_all(lower(value), '[\p{L}\p{N}]+')) AS term FROM facts) WHERE length(term) >= 3 GROUP BY ALL),
hits AS (SELECT * FROM terms JOIN held USING (term)),
pools AS (SELECT query_id, count(DISTINCT key) AS pool FROM hits GROUP BY 1),
dfs AS (SELECT query_id, term, count(*) AS df FROM hits GROUP BY 1, 2),
sums AS (SELECT query_id, key, n_query, sum(times) AS matched, sum(times * ln(1.0e0 + (pool - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0)) AS raw
  FROM hits JOIN dfs USING (query_id, term) JOIN pools USING (query_id) GROUP BY 1, 2, 3),
raws AS (SELECT query_id, key, n_query, matched, round(raw + CASE WHEN contains(lower(value), phrase) THEN 1 ELSE 0 END, 6) AS raw_bm25
  FROM sums JOIN asked USING (query_id) JOIN facts USING (key)),
lexical AS (SELECT *, round(raw_bm25 / max(raw_bm25) OVER (PARTITION BY query_id), 4) AS lex FROM raws)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(tables.questions(spark, d), tables.facts(spark, d))


_TOP = f"WITH {_BM25}, top AS (SELECT query_id, key, raw_bm25, lex, row_number() OVER (PARTITION BY query_id ORDER BY raw_bm25 DESC, key) AS rank FROM lexical)"


@query(with_tables(f"{_TOP} SELECT query_id, key, raw_bm25, lex, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 10", "facts", "questions"))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top_k(scored(spark, d), "raw_bm25", 10).select("query_id", "key", "raw_bm25", "lex", "rank")


_COST = "CAST(greatest(1, ceil((length(key) + least(length(value), 1200) + 5) / 3.5e0) + 1) AS BIGINT)"
_PACKED = f"{_TOP}, packed AS (SELECT query_id, key, value, rank, {_COST} AS cost, CAST(sum({_COST}) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS spent FROM top JOIN facts USING (key))"


BUDGET = 1500


def packed(spark: SparkSession, d: str) -> DataFrame:
    # A record costs three tokens or more, so none beyond this rank fits.
    top = retrieval.top_k(scored(spark, d), "raw_bm25", BUDGET // 3)
    return retrieval.within_budget(top.join(tables.facts(spark, d).select("key", "value"), "key"), BUDGET)


@query(with_tables(f"{_PACKED} SELECT query_id, key, cost, spent FROM packed WHERE spent <= 1500", "facts", "questions"))
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    return packed(spark, d).select("query_id", "key", "cost", "spent")


@query(
    with_tables(
        f"{_PACKED} SELECT query_id, '## Memory' || chr(10) || string_agg('• [' || key || '] ' || left(value, 1200), chr(10) ORDER BY rank) AS context, count(*) AS records FROM packed WHERE spent <= 1500 GROUP BY query_id", "facts", "questions"
    )
)
def context_render(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rendered(packed(spark, d))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Lexical candidates with made-up dense and graph scores, so that every branch of the fusion is taken."""
    h = F.col("doc_id") * 7 + F.col("query_id") * 13
    facts = tables.facts(spark, d)
    pool = scored(spark, d).join(facts, "key")
    vector = F.when(h % 3 == 0, 0.0).otherwise(h % 101 / 100.0)
    graph = F.when(h % 5 < 3, 0.0).otherwise(h % 97 / 100.0)
    return pool.withColumns({"vector_score": vector, "graph_score": graph, "symbolic": F.col("query_id") % 4 == 0, "trusted": F.col("matched") >= F.col("n_query") * 0.5})


def _clip(x: str) -> str:
    return f"least(1.0e0, {x})"


def _smooth(t: str) -> str:
    return f"(3e0 * ({t}) * ({t}) - 2e0 * ({t}) * ({t}) * ({t}))"


_SIG0 = "(1e0 / (1e0 + exp(6e0)))"
#: From dense and graph scores (vs, gs) of a pool to the fused score.
_CHAIN = f"""c2 AS (SELECT *, CASE WHEN vs <= 0 THEN 0e0 ELSE least(1e0, greatest(0e0, (1e0 / (1e0 + exp(-12e0 * (vs - 0.5e0))) - {_SIG0}) / (1e0 - {_SIG0}))) END AS nd,
  CASE WHEN n_query > 0 THEN CAST(matched AS DOUBLE) / n_query ELSE 1e0 END AS cov, raw_bm25 / greatest(6e0, n_query * 6e0) AS sat FROM c1),
c3 AS (SELECT *, least(1e0, CASE WHEN n_query >= 3 AND matched <= 1 AND nd < 0.28e0 THEN greatest(lex, sat) * cov ELSE greatest(lex * cov, sat) END) AS nl FROM c2),
c4 AS (SELECT *, contains(key, ':') AND matched = 0 AND lex <= 0 AND NOT trusted AND gs <= 0 AS ung, a * nd + (1 - a) * nl AS b0, greatest(a * nd + (1 - a) * nl, nd) AS b1 FROM c3),
c5 AS (SELECT *, CASE WHEN vs > 0 AND lex > 0 THEN CASE WHEN NOT trusted OR vs <= 0.74e0 THEN b0 WHEN vs >= 0.78e0 THEN b1 ELSE (1 - {_smooth("(vs - 0.74e0) / 0.04e0")}) * b0 + {_smooth("(vs - 0.74e0) / 0.04e0")} * b1 END
  WHEN vs > 0 THEN CASE WHEN ung THEN 0.15e0 * nd WHEN (matched = 0 AND NOT trusted AND n_query >= 2) OR vs <= 0.6e0 THEN a * nd WHEN vs >= 0.8e0 THEN nd ELSE (a + (1 - a) * {_smooth("(vs - 0.6e0) / 0.2e0")}) * nd END
  WHEN trusted THEN nl ELSE (1 - a) * nl END AS f FROM c4),
c6 AS (SELECT *, matched = 0 OR (n_query >= 3 AND matched <= 1 AND NOT symbolic) OR (nl < 0.22e0 AND NOT symbolic) AS weak,
  CASE WHEN symbolic THEN 0.75e0 * gs ELSE least(0.22e0, 0.3e0 * gs) END AS g_only, 0.9e0 * f + 0.1e0 * greatest(gs, f) + 0.02e0 * gs AS spread, (1 - a) * nl + 0.2e0 * gs AS nodense, least(0.18e0, 0.2e0 * gs + 0.5e0 * nl) AS damped FROM c5),
c7 AS (SELECT *, {_clip("CASE WHEN vs <= 0 AND lex <= 0 THEN g_only WHEN vs <= 0 THEN nodense ELSE spread END")} AS full_ FROM c6),
c8 AS (SELECT *, CASE WHEN gs <= 0 THEN f WHEN weak THEN CASE WHEN nd <= 0.1e0 THEN damped WHEN nd >= 0.16e0 THEN full_ ELSE (1 - {_smooth("(nd - 0.1e0) / 0.06e0")}) * damped + {_smooth("(nd - 0.1e0) / 0.06e0")} * full_ END
  ELSE {_clip("CASE WHEN vs <= 0 AND lex <= 0 THEN g_only WHEN vs <= 0 THEN greatest(f, CASE WHEN symbolic AND trusted THEN 0.25e0 * nl + 0.75e0 * gs ELSE nodense END) ELSE spread END")} END AS fs,
  greatest(0e0, ({tables.AS_OF} - ts) / 86400e0) AS age, lower(key) AS lk FROM c7),
c9 AS (SELECT *, CASE WHEN starts_with(lk, 'rule:') OR starts_with(lk, 'user_rule:') OR starts_with(lk, 'user:rule:') OR starts_with(lk, 'preference:') OR starts_with(lk, 'constraint:') OR contains(lk, ':rule:') THEN 110
    WHEN starts_with(lk, 'hermes:user_md:') OR starts_with(lk, 'hermes:memory_md:') THEN 100 WHEN starts_with(lk, 'mnemosyne:canonical_facts:') THEN 70 WHEN starts_with(lk, 'mnemosyne:mnemosyne_working_memory:') THEN 30
    WHEN starts_with(lk, 'fact:') THEN 80 WHEN starts_with(lk, 'database_') OR NOT contains(lk, ':') THEN 90 ELSE 50 END AS auth,
  CASE source_type WHEN 'user_explicit' THEN 1e0 WHEN 'tool_output' THEN 0.85e0 WHEN 'external_doc' THEN 0.65e0 ELSE 0.5e0 END AS vw FROM c8),
fused AS (SELECT *, round(least(1e0, fs * (CASE WHEN starts_with(key, 'session:') AND age > 3 THEN greatest(0.45e0, exp(-0.035e0 * (age - 3))) ELSE 1e0 END * CASE WHEN n_query >= 3 AND matched <= 1 AND nd < 0.28e0 AND gs <= 0 THEN 0.55e0 ELSE 1e0 END)
  + 0.01e0 * (auth / 100e0 / 1.10e0) + 0.005e0 * vw * confidence
  + CASE WHEN auth >= 100 AND (vs >= 0.65e0 OR gs >= 0.7e0 OR (lex > 0 AND (vs > 0 OR gs > 0 OR trusted))) AND NOT (ung AND gs < 0.7e0) THEN 0.035e0 ELSE 0e0 END + 1e-9), 4) AS score FROM c9)"""
_CANDIDATES = f"""{_TOP}, pool AS (
  SELECT l.query_id, l.key, l.n_query, l.matched, l.raw_bm25, l.lex, f.source_type, f.confidence, f.ts, f.value, f.doc_id * 7 + l.query_id * 13 AS h, l.query_id % 4 = 0 AS symbolic, l.matched >= l.n_query * 0.5e0 AS trusted
  FROM lexical l JOIN facts f ON f.key = l.key),
c1 AS (SELECT *, CASE WHEN h % 3 = 0 THEN 0e0 ELSE (h % 101) / 100e0 END AS vs, CASE WHEN h % 5 < 3 THEN 0e0 ELSE (h % 97) / 100e0 END AS gs, CASE WHEN symbolic THEN 0.30e0 ELSE 0.35e0 END AS a FROM pool),
{_CHAIN}"""


_SEEDS = """facts_low AS (SELECT key, lower(value) AS body FROM facts),
distinct_hits AS (SELECT query_id, key, count(*) AS found FROM hits GROUP BY 1, 2), n_terms AS (SELECT query_id, count(*) AS n_terms FROM terms GROUP BY 1),
seeded AS (SELECT h.query_id, h.key, found, n_terms, contains(body, phrase) AS holds, CASE WHEN trim(body) = phrase THEN 1e0 ELSE greatest(CASE WHEN contains(body, phrase) THEN 0.85e0 ELSE 0e0 END, CASE WHEN found >= 2 OR n_terms <= 2 THEN CAST(found AS DOUBLE) / n_terms ELSE 0e0 END) END AS s
  FROM distinct_hits h JOIN n_terms USING (query_id) JOIN asked USING (query_id) JOIN facts_low USING (key)),
seeds AS (SELECT query_id, key, round(s, 6) AS score FROM seeded WHERE round(s, 6) >= 0.34e0)"""


@query(with_tables(f"WITH {_BM25}, {_SEEDS} SELECT * FROM seeds", "facts", "questions"))
def passage_seeds(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.passage_seeds(tables.questions(spark, d), tables.facts(spark, d))


_NEAR = """near AS (SELECT q.vec_id AS query_id, f.key, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS cos, f.doc_id
  FROM embeddings q JOIN questions ON query_id = q.vec_id JOIN embeddings v ON v.vec_id <> q.vec_id JOIN facts f ON f.doc_id = v.vec_id),
dense AS (SELECT query_id, key, cos, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, doc_id) AS rank FROM near QUALIFY rank <= 24)"""


def dense(spark: SparkSession, d: str, k: int = 24) -> DataFrame:
    """Per question the facts with the nearest vectors: a question's vector is that of its number."""
    vectors = tables.read(spark, d, "embeddings")
    asked = tables.questions(spark, d).join(vectors, F.col("query_id") == F.col("vec_id")).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("query"))
    facts = tables.facts(spark, d).select("doc_id", "key")
    known = vectors.join(facts.select("doc_id"), F.col("doc_id") == F.col("vec_id"), "left_semi").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return analytics.dense_top_k(asked, known, k, -1.0).join(facts, F.col("id") == F.col("doc_id")).select("query_id", "key", F.col("cos").alias("score"))


_REAL = f"""{_BM25}, {_SEEDS}, {_NEAR}, floor_ AS (SELECT query_id, key, cos FROM dense WHERE cos >= CASE WHEN query_id % 4 = 0 THEN 0.7e0 ELSE 0.35e0 END),
names AS (SELECT query_id, key FROM lexical UNION SELECT query_id, key FROM floor_ UNION SELECT query_id, key FROM seeds),
pool AS (SELECT n.query_id, n.key, len(a.q) AS n_query, coalesce(l.matched, 0) AS matched, coalesce(l.raw_bm25, 0e0) AS raw_bm25, coalesce(l.lex, 0e0) AS lex, f.source_type, f.confidence, f.ts, f.value, n.query_id % 4 = 0 AS symbolic,
  coalesce(s.holds OR (n_terms = 1 AND found = 1) OR (n_terms >= 2 AND found >= 0.5e0 * n_terms), false) AS trusted, greatest(0e0, coalesce(v.cos, 0e0)) AS vs, coalesce(g.score, 0e0) AS gs, CASE WHEN n.query_id % 4 = 0 THEN 0.30e0 ELSE 0.35e0 END AS a
  FROM names n JOIN asked a USING (query_id) JOIN facts f USING (key) LEFT JOIN lexical l USING (query_id, key) LEFT JOIN floor_ v USING (query_id, key) LEFT JOIN seeds g USING (query_id, key) LEFT JOIN seeded s USING (query_id, key)),
c1 AS (SELECT * FROM pool), {_CHAIN}"""


def recalled(spark: SparkSession, d: str) -> DataFrame:
    """The union of lexical, dense and graph candidates with the scores of each channel (0 where it hasn't the fact)."""
    questions, facts = tables.questions(spark, d), tables.facts(spark, d)
    pairs = retrieval.matches(questions, facts)
    lexical = retrieval.bm25(questions, facts, pairs).select("query_id", "key", "raw_bm25", "lex", "matched")
    symbolic = F.col("query_id") % 4 == 0
    near = retrieval.similarity_floor(dense(spark, d).withColumns({"symbolic": symbolic, "sparse": F.lit(False)})).select("query_id", "key", "score")
    seeds = retrieval.passage_seeds(questions, facts, pairs)
    pool = retrieval.merge_channels([("lexical", lexical.select("query_id", "key", F.col("lex").alias("score"))), ("vector", near), ("graph", seeds)]).drop("lexical_score")
    told = pairs.select("query_id", "key", "n_terms", "found").join(retrieval.phrases(questions, facts, pairs), ["query_id", "key"], "left")
    asked = questions.select("query_id", F.size(text.tokens(F.col("query"))).alias("n_query"))
    rows = pool.join(lexical, ["query_id", "key"], "left").join(told, ["query_id", "key"], "left").join(asked, "query_id").join(facts, "key")
    trust = retrieval.trusted(F.col("n_terms"), F.col("found"), F.col("equal").isNotNull(), F.lit("lexical"))
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("raw_bm25", "lex")}
    return rows.withColumns({**zero, "matched": F.coalesce("matched", F.lit(0)), "trusted": F.coalesce(trust, F.lit(False)), "symbolic": symbolic, "vector_score": F.greatest(F.lit(0.0), F.col("vector_score"))})


def recalled_scores(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fused(recalled(spark, d), tables.AS_OF)


def fused(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fused(candidates(spark, d), tables.AS_OF)


@query(with_tables(f"{_CANDIDATES} SELECT query_id, key, score FROM fused", "facts", "questions"))
def hybrid_score(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d).select("query_id", "key", "score")


_ASKED = "(SELECT query_id, query_id % 4 = 0 AS symbolic FROM questions)"


@query(
    with_tables(
        f"""WITH {_REAL}, best AS (SELECT query_id, max(score) - 0.4e0 AS best, max(gs) AS graph FROM fused GROUP BY 1),
g AS (SELECT q.query_id, best, graph >= 0.7e0 AS strong, CASE WHEN symbolic THEN 0.5e0 ELSE 0.25e0 END AS base FROM {_ASKED} q LEFT JOIN best USING (query_id)),
t AS (SELECT *, CASE WHEN strong THEN least(base, 0.2e0) ELSE base END AS threshold FROM g),
r AS (SELECT *, CASE WHEN best IS NULL THEN 'empty_pool' WHEN best < threshold THEN 'below_threshold' WHEN strong AND best < base THEN 'graph_hit' ELSE 'accepted' END AS reason FROM t)
SELECT query_id, reason IN ('accepted', 'graph_hit') AS retrieve, reason, threshold FROM r""",
        "facts",
        "questions",
    )
)
def retrieval_gate(spark: SparkSession, d: str) -> DataFrame:
    asked = tables.questions(spark, d).withColumn("symbolic", F.col("query_id") % 4 == 0)
    return retrieval.gate(asked, recalled_scores(spark, d).withColumn("score", F.col("score") - 0.4))


@query(
    with_tables(
        f"""WITH {_REAL}, e1 AS (SELECT *, sum(CASE WHEN score > 1e-6 THEN score END) OVER w AS total, sum(CASE WHEN score > 1e-6 THEN 1 ELSE 0 END) OVER w AS k, max(score) OVER w AS best FROM fused WINDOW w AS (PARTITION BY query_id)),
e2 AS (SELECT *, -sum(CASE WHEN score > 1e-6 THEN score / total * ln(score / total) END) OVER (PARTITION BY query_id) / ln(CAST(k AS DOUBLE)) AS h0 FROM e1),
e3 AS (SELECT *, CASE WHEN k < 2 THEN 0e0 ELSE least(1e0, greatest(0e0, h0)) END AS hh FROM e2),
e4 AS (SELECT *, round(CASE WHEN k >= 4 THEN (1 - 3e0 / (k + 3)) * hh + 3e0 / (k + 3) * 0.5e0 ELSE hh END, 6) AS entropy FROM e3),
e5 AS (SELECT *, round(greatest(0e0, CASE WHEN k >= 4 AND entropy >= 0.85e0 THEN 0.55e0 WHEN k >= 4 AND entropy >= 0.7e0 THEN 0.4e0 ELSE 0e0 END * best), 4) AS threshold FROM e4)
SELECT query_id, key, entropy, threshold FROM e5 WHERE score >= threshold AND (auth = 110 OR NOT (gs > 0 AND nd < 0.12e0 AND lex < 0.08e0 AND (score < CASE WHEN k >= 4 THEN 0.5e0 * best ELSE 0e0 END OR score < greatest(threshold, 0.28e0))))""",
        "facts",
        "questions",
    )
)
def entropy_filter(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.entropy_filter(recalled_scores(spark, d)).select("query_id", "key", "entropy", "threshold")


@query(
    with_tables(
        f"""WITH {_REAL}, r AS (SELECT query_id, key, vs, lex, trusted, row_number() OVER (PARTITION BY query_id ORDER BY vs DESC, key) AS rv, row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, key) AS rl FROM c1)
SELECT query_id, key, round(CASE WHEN vs > 0 AND lex > 0 THEN 0.5e0 * (vs * (61e0 / (60 + rv)) + least(1e0, lex) * (61e0 / (60 + rl))) + 0.02e0 WHEN vs > 0 THEN vs * (61e0 / (60 + rv)) WHEN trusted THEN least(1e0, lex) * (61e0 / (60 + rl)) ELSE 0.15e0 * (least(1e0, lex) * (61e0 / (60 + rl))) END, 6) AS score FROM r""",
        "facts",
        "questions",
    )
)
def rrf_score(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("query_id")
    ranked = recalled(spark, d).withColumns({"rv": F.row_number().over(w.orderBy(F.col("vector_score").desc(), "key")), "rl": F.row_number().over(w.orderBy(F.col("lex").desc(), "key"))})
    return ranked.select("query_id", "key", scoring.scaled_round(scoring.rrf(F.col("vector_score"), F.col("lex"), F.col("rv"), F.col("rl"), F.col("trusted")), 6).alias("score"))


@query(
    with_tables(
        f"""WITH {_REAL}, k AS (SELECT *, CASE WHEN length(trim(value)) <= 16 OR len(regexp_split_to_array(trim(value), '\\s+')) <= 2 THEN key || '::' ELSE '' END || md5(lower(trim(regexp_replace(trim(value), '\\s+', ' ', 'g')))) AS fp FROM c9)
SELECT query_id, key, max(vs) OVER w AS vector_score, max(gs) OVER w AS graph_score FROM k WINDOW w AS (PARTITION BY query_id, fp)
QUALIFY row_number() OVER (PARTITION BY query_id, fp ORDER BY auth DESC, gs DESC, vs DESC, key) = 1""",
        "facts",
        "questions",
    )
)
def candidate_dedup(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.deduplicated(recalled(spark, d).withColumn("pos", F.col("key"))).select("query_id", "key", "vector_score", "graph_score")


@query(
    with_tables(
        f"""WITH {_REAL}, ch AS (SELECT query_id, key, 'hot' AS n, 0 AS r, gs AS s FROM c1 WHERE gs > 0.5e0 UNION ALL SELECT query_id, key, 'kv', 1, lex FROM c1 WHERE lex > 0.3e0 UNION ALL SELECT query_id, key, 'vector', 2, vs FROM c1 WHERE vs > 0.2e0),
m AS (SELECT query_id, key, arg_min(n, r) AS source, coalesce(max(s) FILTER (n = 'hot'), 0) AS hot_score, coalesce(max(s) FILTER (n = 'kv'), 0) AS kv_score, coalesce(max(s) FILTER (n = 'vector'), 0) AS vector_score FROM ch GROUP BY 1, 2)
SELECT m.* FROM m JOIN facts f USING (key) WHERE NOT (f.doc_id % 11 = 0)""",
        "facts",
        "questions",
    )
)
def channel_merge(spark: SparkSession, d: str) -> DataFrame:
    c = recalled(spark, d)
    channels = [(name, c.where(F.col(col) > least).select("query_id", "key", F.col(col).alias("score"))) for name, col, least in (("hot", "graph_score", 0.5), ("kv", "lex", 0.3), ("vector", "vector_score", 0.2))]
    store = tables.facts(spark, d).select("key", (F.col("doc_id") % 11 == 0).alias("superseded"))
    return retrieval.truth_gate(retrieval.merge_channels(channels), store)


@query(
    with_tables(
        f"""{_TOP}, dead AS (SELECT regexp_replace(key, '^(kv|fact):', '') AS k FROM facts WHERE doc_id % 7 = 0 UNION SELECT key FROM facts WHERE doc_id % 7 = 0),
p AS (SELECT DISTINCT key, regexp_replace(key, '^kv:', '') AS b FROM top WHERE rank <= 20), q AS (SELECT key, unnest([b, regexp_replace(b, '^fact:', ''), 'fact:' || regexp_replace(b, '^fact:', ''), regexp_replace(b, '_value$', '')]) AS k FROM p)
SELECT query_id, key FROM top WHERE rank <= 20 AND key NOT IN (SELECT key FROM q JOIN dead USING (k))""",
        "facts",
        "questions",
    )
)
def tombstone_gate(spark: SparkSession, d: str) -> DataFrame:
    dead = tables.facts(spark, d).where("doc_id % 7 = 0").select(F.explode(F.array("key", F.regexp_replace("key", "^(kv|fact):", ""))).alias("key"), F.lit(True).alias("superseded"))
    return retrieval.tombstone_gate(retrieval.top_k(scored(spark, d), "raw_bm25", 20).select("query_id", "key"), dead)


@query(
    with_tables(
        f"""WITH r AS (SELECT key, starts_with(lower(key), 'rule:') OR contains(lower(key), ':rule:') AS rule, confidence AS c, source_type AS s, greatest(0, {tables.AS_OF} - ts) AS age,
  CASE source_type WHEN 'user_explicit' THEN 1e0 WHEN 'tool_output' THEN 0.85e0 WHEN 'external_doc' THEN 0.65e0 ELSE 0.5e0 END AS vw, doc_id % 13 = 0 AS dead FROM facts)
SELECT key, CASE WHEN dead THEN -5e0 ELSE round(0.4e0 * (vw * c) + 0.25e0 * CASE WHEN rule THEN 1.1e0 WHEN starts_with(key, 'hermes:memory_md:') THEN 1e0 WHEN starts_with(key, 'fact:') THEN 0.7e0 ELSE 0.5e0 END
  + CASE WHEN rule AND (s = 'user_explicit' OR c >= 0.99e0) THEN 1e0 / (1e0 + 0.15e0 * ln(1e0 + age / 86400e0)) ELSE 0.2e0 * (vw * c) / (1e0 + 0.05e0 * (age / 3600e0)) END, 4) END AS rank FROM r""",
        "facts",
    )
)
def record_rank(spark: SparkSession, d: str) -> DataFrame:
    age = F.greatest(F.lit(0), F.lit(tables.AS_OF) - F.col("ts"))
    return tables.facts(spark, d).select("key", scoring.record_rank(F.col("key"), F.col("source_type"), F.col("confidence"), age, F.col("doc_id") % 13 == 0).alias("rank"))


@query(
    with_tables(
        f"""WITH s AS (SELECT key, importance, doc_id, 0.4e0 * greatest(0e0, least(1e0, (doc_id % 17) / 14e0 - 0.1e0)) + 0.3e0 * importance + 0.2e0 * exp(-1e-4 * ({tables.AS_OF} - ts)) + 0.1e0 * least(1e0, ln(1e0 + doc_id % 60) / ln(51e0)) AS score FROM facts)
SELECT key, round(score, 6) AS salience, NOT (doc_id % 9 = 0) AND importance < 0.95e0 AND score < 0.15e0 AS prunable FROM s""",
        "facts",
    )
)
def salience_decay(spark: SparkSession, d: str) -> DataFrame:
    score = scoring.salience(F.col("doc_id") % 17 / 14.0 - 0.1, F.col("importance"), F.lit(tables.AS_OF) - F.col("ts"), F.col("doc_id") % 60)
    return tables.facts(spark, d).withColumn("score", score).select("key", F.round("score", 6).alias("salience"), scoring.prunable(F.col("score"), F.col("importance"), F.col("doc_id") % 9 == 0).alias("prunable"))


@query(with_tables(f"WITH {_REAL} SELECT query_id, key, score FROM fused", "facts", "questions"))
def recall_score(spark: SparkSession, d: str) -> DataFrame:
    """The fused score over real channels: words, vectors and seeds of the graph."""
    return recalled_scores(spark, d).select("query_id", "key", "score")


@query(with_tables(f"WITH {_REAL} SELECT query_id, count(*) FILTER (vs > 0) AS vector, count(*) FILTER (vs <= 0 AND gs > 0) AS graph, 0 AS hot, count(*) FILTER (vs <= 0 AND gs <= 0) AS store, count(*) AS pool FROM pool GROUP BY 1", "facts", "questions"))
def channel_counts(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.channel_counts(recalled(spark, d))


@query(with_tables(f"WITH {_REAL}, m AS (SELECT query_id, median(score) AS m FROM fused GROUP BY 1) SELECT query_id, key, round(score - m, 6) AS margin, round(ln(greatest(1, n_query)), 6) AS length FROM fused JOIN m USING (query_id)", "facts", "questions"))
def median_margin(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.median_margin(retrieval.fused(recalled(spark, d), tables.AS_OF))


_SPARSE = f"""words AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(value), '[\\p{{L}}\\p{{N}}]+')) AS w FROM facts), sd AS (SELECT id, {STEM} AS bucket, round(1e0 + ln(count(*)), 6) AS weight FROM words WHERE length(w) >= 3 GROUP BY 1, 2),
qwords AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS w FROM questions), sq AS (SELECT DISTINCT query_id, {STEM} AS bucket FROM qwords WHERE length(w) >= 3),
df AS (SELECT bucket, count(*) AS df FROM sd GROUP BY 1), nd AS (SELECT count(DISTINCT id) AS n FROM sd),
ss AS (SELECT query_id, id, round(sum(weight * ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0))), 6) AS score FROM sd JOIN sq USING (bucket) JOIN df USING (bucket), nd GROUP BY 1, 2),
sparse AS (SELECT query_id, key, score FROM ss JOIN facts ON doc_id = id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 24)"""


def sparse(spark: SparkSession, d: str) -> DataFrame:
    facts = tables.facts(spark, d)
    documents = retrieval.sparse_vectors(facts.select(F.col("doc_id").alias("id"), F.col("value").alias("text")))
    asked = retrieval.sparse_vectors(tables.questions(spark, d).select(F.col("query_id").alias("id"), F.col("query").alias("text")), document=False)
    found = retrieval.sparse_top_k(asked, documents, 24).select("query_id", F.col("key").alias("doc_id"), "score")
    return found.join(facts.select("doc_id", "key"), "doc_id").select("query_id", "key", "score")


@query(with_tables(f"WITH {_SPARSE} SELECT query_id, key, score FROM sparse", "facts", "questions"))
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return sparse(spark, d)


@query(with_tables(f"""WITH {_SPARSE}, {_NEAR}, b AS (SELECT query_id, key, cos AS score, 0 AS branch FROM dense UNION ALL SELECT query_id, key, score, 1 FROM sparse),
w AS (SELECT *, avg(score) OVER q - 3 * stddev_pop(score) OVER q AS lo, avg(score) OVER q + 3 * stddev_pop(score) OVER q AS hi FROM b WINDOW q AS (PARTITION BY query_id, branch)),
t AS (SELECT query_id, key, round(sum(CASE WHEN hi > lo THEN greatest(0e0, least(1e0, (score - lo) / (hi - lo))) ELSE 0.5e0 END), 6) AS score, count(*) AS branches FROM w GROUP BY 1, 2)
SELECT query_id, key, branches, score FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) <= 10""", "facts", "questions"))
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fused_branches([dense(spark, d), sparse(spark, d)], 10).select("query_id", "key", "branches", "score")


@query(with_tables("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 4 = 1 THEN 's' || doc_id WHEN doc_id % 4 = 2 THEN regexp_replace(key, '^kv:', '') ELSE 'x' END AS key FROM facts", "facts"))
def hit_keys(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 4
    hits = tables.facts(spark, d).select("doc_id", F.col("doc_id").alias("point"), F.when(m == 2, F.col("key")).when(m == 1, " ").alias("key"), F.when(m == 3, "kv:x").alias("kv_key"), F.when(m == 1, F.concat(F.lit("s"), "doc_id")).alias("subject"))
    return retrieval.normalised_hits(hits).select("doc_id", "key")


@query(
    with_tables(
        """WITH k AS (SELECT CASE WHEN starts_with(key, 'rule:') THEN 'rules' WHEN starts_with(key, 'fact:') THEN 'state' WHEN starts_with(key, 'hermes:') THEN 'entities' END AS kind, key, value FROM facts),
n AS (SELECT *, (row_number() OVER (PARTITION BY kind ORDER BY key) - 1) // 100 AS part FROM k WHERE kind IS NOT NULL)
SELECT kind, part, string_agg(key || '=' || coalesce(value, ''), chr(10) ORDER BY key) AS block FROM n GROUP BY 1, 2""",
        "facts",
    )
)
def cache_prefix(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("key")
    kinds = F.when(key.startswith("rule:"), "rules").when(key.startswith("fact:"), "state").when(key.startswith("hermes:"), "entities")
    return retrieval.cache_prefix(tables.facts(spark, d), kinds)


@query(with_tables("SELECT doc_id, round(CASE WHEN doc_id % 5 = 0 THEN 0e0 ELSE importance * CASE WHEN confidence < 0.7e0 AND doc_id % 3 = 0 THEN 0.4e0 ELSE 1e0 END END, 6) AS rank_score, CASE WHEN doc_id % 2 = 0 AND doc_id % 7 > 0 THEN 0.5e0 ELSE (doc_id % 7) / 10e0 END AS graph_score FROM facts", "facts"))
def epistemic_ranks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = tables.facts(spark, d).select("doc_id", F.when(i % 5 != 0, F.col("importance")).alias("score"), F.col("confidence").alias("vector_score"), (i % 3 / 1.0).alias("lex"), F.when(i % 2 == 0, "graph").otherwise("kv").alias("channel"), F.when((i % 2 == 0) & (i % 7 > 0), 0.0).otherwise(i % 7 / 10.0).alias("graph_score"))
    return retrieval.graph_default(retrieval.epistemic_rank(rows, 0.7)).select("doc_id", "rank_score", F.when(i % 14 == 0, 0.0).otherwise(F.col("graph_score")).alias("graph_score"))
