"""Batch recall: a table of queries against a table of facts, in one plan with query_id as the key.

Tokens of queries and facts meet in an equi-join on the token, so candidates grow with matches and not with
queries x facts. Statistics of the scores are those of each query's candidate pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring
from palimpsest.functions.text import authority, estimated_tokens, is_rule, stem, tokens
from palimpsest.operators.steps import counted, materialised, numbered

SYSTEM_PREFIXES = ["[important: background process", "[system:", "<system_message>", "<system-reminder>", "[message] timestamp="]
THRESHOLD_SYMBOLIC, THRESHOLD_PROSE, THRESHOLD_GRAPH = 0.50, 0.25, 0.20


def matches(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """Each query with each fact that shares a token: query_id, key, n_query (tokens), n_terms (different ones), matched
    (tokens found), found (different ones), inner (of these, neither first nor last in the query) and _terms. Materialised."""
    asked = queries.select("query_id", tokens(F.col("query")).alias("_q"))
    places = asked.select("query_id", F.size("_q").alias("n_query"), F.size(F.array_distinct("_q")).alias("n_terms"), F.posexplode("_q").alias("at", "term"))
    inner = (F.col("at") > 0) & (F.col("at") < F.col("n_query") - 1)
    terms = places.groupBy("query_id", "n_query", "n_terms", "term").agg(F.count("*").alias("times"), F.max(inner.cast("int")).alias("inner"))
    # Only tokens that are asked for leave their fact, and the postings are computed once.
    words = counted(terms.select("term").distinct())
    postings = materialised(facts.select("key", F.explode(tokens(F.col("value"))).alias("term")).join(words, "term").groupBy("key", "term").agg(F.count("*").alias("tf")))
    # All facts with a term are in the pool of each query that has it.
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    hits = counted(terms.join(df, "term")).join(postings, "term")
    sums = [F.sum("times").alias("matched"), F.count("*").alias("found"), F.sum("inner").alias("inner"), F.collect_list(F.struct("term", "times", "df", "tf")).alias("_terms")]
    return materialised(hits.groupBy("query_id", "key", "n_query", "n_terms").agg(*sums))


def phrases(queries: DataFrame, facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``query_id``, ``key`` and ``equal`` of the facts that hold a whole query as a phrase. Such a fact has at least all
    of the query's tokens but its first and last one: few do, and only these are searched."""
    places = queries.select("query_id", "query", tokens(F.col("query")).alias("_q"))
    inner = F.size(F.array_distinct(F.slice("_q", F.lit(2), F.greatest(F.size("_q") - 2, F.lit(0)))))
    asked = places.select("query_id", F.lower(F.trim("query")).alias("_phrase"), inner.alias("needed"))
    could = pairs.join(counted(asked), "query_id").where(F.col("inner") >= F.col("needed")).select("query_id", "key", "_phrase")
    bodies = facts.select("key", F.lower("value").alias("_body")).join(counted(could), "key").where(F.contains("_body", "_phrase"))
    return bodies.groupBy("query_id", "key").agg(F.max(F.trim("_body") == F.col("_phrase")).alias("equal"))


def bm25(queries: DataFrame, facts: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """query_id, key, n_query, matched, raw_bm25 and lex (raw over the pool's best, 4 places) of each candidate.

    A candidate shares a token with the query. Frequencies are those of the query's pool; query terms count as often as
    they occur; no length norm; a fact that holds the whole query as a phrase gets 1 more. ``pairs``: of ``matches``.
    """
    pairs = matches(queries, facts) if pairs is None else pairs
    pool = pairs.groupBy("query_id").agg(F.count("*").alias("pool"))
    idf = lambda x: F.log(1.0 + (F.col("pool") - x["df"] + 0.5) / (x["df"] + 0.5))
    part = lambda s, x: s + x["times"] * idf(x) * x["tf"] * (scoring.K1 + 1) / (x["tf"] + scoring.K1)
    scored = pairs.join(counted(pool), "query_id").withColumn("raw", F.aggregate(F.array_sort("_terms"), F.lit(0.0), part))
    whole = phrases(queries, facts, pairs).select("query_id", "key", F.lit(1.0).alias("_bonus"))
    found = scored.join(whole, ["query_id", "key"], "left")
    best = F.max("raw_bm25").over(Window.partitionBy("query_id"))
    return found.withColumn("raw_bm25", F.round(F.col("raw") + F.coalesce("_bonus", F.lit(0.0)), 6)).select("query_id", "key", "n_query", "matched", "raw_bm25", scoring.scaled_round(F.col("raw_bm25") / best, 4).alias("lex"))


def passage_seeds(queries: DataFrame, facts: DataFrame, pairs: DataFrame | None = None, least: float = 0.34) -> DataFrame:
    """Passages that seed a walk: 1 for the query itself, 0.85 for one that holds it, else the share of the query's
    different tokens (two at least, or one of at most two), from ``least`` on."""
    pairs = matches(queries, facts) if pairs is None else pairs
    whole = phrases(queries, facts, pairs)
    overlap = F.when((F.col("found") >= 2) | (F.col("n_terms") <= 2), F.col("found") / F.col("n_terms")).otherwise(0.0)
    score = F.when(F.col("equal"), 1.0).when(F.col("equal").isNotNull(), F.greatest(F.lit(0.85), overlap)).otherwise(overlap)
    return pairs.join(whole, ["query_id", "key"], "left").select("query_id", "key", F.round(score, 6).alias("score")).where(F.col("score") >= least)


def trusted(n_terms: Column, found: Column, phrase: Column, channel: Column) -> Column:
    """Whether a lexical match is trusted by itself: the whole query as a phrase, a candidate of the graph, the only term,
    or half of two terms or more."""
    return phrase | (channel == "graph") | ((n_terms == 1) & (found == 1)) | ((n_terms >= 2) & (found >= 0.5 * n_terms))


def similarity_floor(hits: DataFrame, symbolic: float = 0.70, prose: float = 0.35) -> DataFrame:
    """Dense hits (score, symbolic, sparse) at or above the floor of their query's kind; hits of the sparse branch pass."""
    return hits.where(F.col("sparse") | (F.col("score") >= F.when(F.col("symbolic"), symbolic).otherwise(prose)))


def fused_branches(branches: list[DataFrame], k: int) -> DataFrame:
    """The best k of several branches (query_id, key, score): each branch's scores are set within its mean and three
    deviations, per query, and added up."""
    both = None
    for n, branch in enumerate(branches):
        w = Window.partitionBy("query_id")
        low, high = F.avg("score").over(w) - 3 * F.stddev_pop("score").over(w), F.avg("score").over(w) + 3 * F.stddev_pop("score").over(w)
        part = F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") - low) / (high - low)))).otherwise(0.5)
        rows = branch.withColumn("part", part).select("query_id", "key", "part", F.lit(n).alias("branch"))
        both = rows if both is None else both.unionByName(rows)
    total = both.groupBy("query_id", "key").agg(F.round(F.sum("part"), 6).alias("score"), F.count("*").alias("branches"))
    return top_k(total, "score", k)


def sparse_vectors(texts: DataFrame, document: bool = True) -> DataFrame:
    """``id``, ``bucket`` and ``weight`` of each text's stems: 1 + ln tf in a document, 1 in a query."""
    stems = texts.select("id", F.explode(F.transform(tokens(F.col("text")), stem)).alias("s")).groupBy("id", "s").agg(F.count("*").alias("tf"))
    weight = 1.0 + F.log(F.col("tf").cast("double")) if document else F.lit(1.0)
    return stems.select("id", F.col("s").alias("bucket"), F.round(weight, 6).alias("weight"))


def sparse_top_k(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """Per query the k documents with the highest sum of weights x idf over shared buckets."""
    n = documents.select("id").distinct().agg(F.count("*").alias("_n"))
    idf = documents.groupBy("bucket").agg(F.count("*").alias("_df"))
    asked = counted(queries.select(F.col("id").alias("query_id"), "bucket", F.col("weight").alias("_w")))
    hits = documents.join(asked, "bucket").join(idf, "bucket").join(counted(n))
    score = F.round(F.sum(F.col("weight") * F.col("_w") * F.log(1.0 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))), 6)
    return top_k(hits.groupBy("query_id", F.col("id").alias("key")).agg(score.alias("score")), "score", k)


def normalised_hits(hits: DataFrame) -> DataFrame:
    """Hits with the first key that their payload names (key, kv_key, subject, else the point's id), without ``kv:``."""
    first = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in ("key", "kv_key", "subject")], F.col("point").cast("string"))
    return hits.withColumn("key", F.regexp_replace(first, "^kv:", ""))


def fingerprint(text: Column) -> Column:
    """Of a content: its first eight tokens and the CRC-32 of it, without a short head, ``:stated_memory`` and space."""
    clean = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit(":stated_memory"), F.lit("")), r"^[^\s:]{1,24}:\s+", "")
    clean = F.lower(F.trim(F.regexp_replace(clean, r"\s+", " ")))
    words = F.filter(F.regexp_extract_all(clean, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: (F.length(t) >= 3) | F.regexp_like(t, F.lit("^[0-9]+$")))
    return F.concat(F.array_join(F.slice(words, 1, 8), "_"), F.lit("::"), F.lpad(F.lower(F.hex(F.crc32(clean.cast("binary")))), 8, "0"))


def graph_default(candidates: DataFrame) -> DataFrame:
    """Candidates of the graph channel without a signal of their own count one half."""
    return candidates.withColumn("graph_score", F.when((F.col("channel") == "graph") & (F.col("graph_score") <= 0), 0.50).otherwise(F.col("graph_score")))


def epistemic_rank(records: DataFrame, threshold: float) -> DataFrame:
    """Records in order of score: 0.4 of it where neither vector nor words support them; unscored ones stay, at 0."""
    weak = (F.coalesce("vector_score", F.lit(0.0)) < threshold) & (F.coalesce("lex", F.lit(0.0)) <= 0)
    return records.withColumn("rank_score", F.round(F.coalesce(F.col("score") * F.when(weak, 0.40).otherwise(1.0), F.lit(0.0)), 6))


def cache_prefix(facts: DataFrame, kinds: Column, lines_a_part: int = 100) -> DataFrame:
    """The stable head of a prompt: rules, state and entities, each sorted by key, one line a record, in numbered parts:
    ``kind``, ``part``, ``block``. A kind of any size is rendered part by part, no task holds more."""
    lines = facts.select(kinds.alias("kind"), "key", F.concat("key", F.lit("="), F.coalesce("value", F.lit(""))).alias("line")).where("kind is not null")
    parts = numbered(lines, "kind", ["key"]).withColumn("part", F.expr(f"_rank DIV {lines_a_part}"))
    return parts.groupBy("kind", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "line"))), lambda x: x["line"]), "\n").alias("block"))


def median_margin(scored: DataFrame) -> DataFrame:
    """Per candidate its score less the median of its query's pool, with the log of the query's words."""
    median = scored.groupBy("query_id").agg(F.expr("percentile(score, 0.5)").alias("_m"))
    return scored.join(counted(median), "query_id").select("query_id", "key", F.round(F.col("score") - F.col("_m"), 6).alias("margin"), F.round(F.log(F.greatest(F.lit(1), F.col("n_query")).cast("double")), 6).alias("length"))


def channel_counts(candidates: DataFrame) -> DataFrame:
    """Per query how many candidates each channel brought, in the order vector, graph, hot, store; and the pool."""
    kind = F.when(F.col("vector_score") > 0, "vector").when(F.col("graph_score") > 0, "graph").when(F.col("source") == "hot", "hot").otherwise("store")
    return candidates.groupBy("query_id").agg(*[F.count_if(kind == k).alias(k) for k in ("vector", "graph", "hot", "store")], F.count("*").alias("pool"))


def top_k(scored: DataFrame, score: str, k: int) -> DataFrame:
    """The best k rows of each query; ties by key."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(score).desc(), "key"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def merge_channels(channels: list[tuple[str, DataFrame]]) -> DataFrame:
    """Candidates (query_id, key, score) of channels in order of priority: the first names the source, the best of each
    channel's scores stays."""
    parts = [df.select("query_id", "key", "score", F.lit(i).alias("_rank"), F.lit(name).alias("_name")) for i, (name, df) in enumerate(channels)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    best = [F.coalesce(F.max(F.when(F.col("_name") == name, F.col("score"))), F.lit(0.0)).alias(f"{name}_score") for name, _ in channels]
    return both.groupBy("query_id", "key").agg(F.min_by("_name", "_rank").alias("source"), *best)


def truth_gate(candidates: DataFrame, store: DataFrame) -> DataFrame:
    """Candidates whose key is in the store and isn't superseded."""
    return candidates.join(store.where("not superseded").select("key"), "key", "left_semi")


def derived_keys(key: Column) -> Column:
    """Keys under which a graph candidate may be known in the store."""
    bare = F.regexp_replace(key, "^kv:", "")
    plain = F.regexp_replace(bare, "^fact:", "")
    return F.array_distinct(F.array(bare, plain, F.concat(F.lit("fact:"), plain), F.regexp_replace(bare, "_value$", "")))


def tombstone_gate(candidates: DataFrame, store: DataFrame) -> DataFrame:
    """Candidates none of whose derived keys is superseded."""
    dead = store.where("superseded").select(F.col("key").alias("_k"))
    probes = candidates.select("key").distinct().select("key", F.explode(derived_keys(F.col("key"))).alias("_k"))
    return candidates.join(probes.join(dead, "_k", "left_semi").select("key").distinct(), "key", "left_anti")


def deduplicated(candidates: DataFrame) -> DataFrame:
    """One candidate per content fingerprint: the highest (authority, graph, vector), with the best scores of all.

    Short values (16 characters or two words at most) are told apart by key. Ties go to the first ``pos``.
    """
    body = F.trim("value")
    content = F.md5(F.lower(F.trim(F.regexp_replace(body, r"\s+", " "))))
    short = (F.length(body) <= 16) | (F.size(F.split(body, r"\s+")) <= 2)
    df = candidates.withColumn("_fp", F.when(short, F.concat_ws("::", "key", content)).otherwise(content)).withColumn("_auth", authority(F.col("key")))
    w = Window.partitionBy("query_id", "_fp")
    rank = F.row_number().over(w.orderBy(F.col("_auth").desc(), F.col("graph_score").desc(), F.col("vector_score").desc(), "pos"))
    df = df.withColumns({"_n": rank, "_v": F.max("vector_score").over(w), "_g": F.max("graph_score").over(w)})
    return df.where("_n = 1").withColumns({"vector_score": F.col("_v"), "graph_score": F.col("_g")}).drop("_fp", "_auth", "_n", "_v", "_g")


def fused(c: DataFrame, as_of: int) -> DataFrame:
    """``c`` with dense, lexical and fused scores. Needs key, source_type, confidence, ts, symbolic, trusted, n_query,
    matched, raw_bm25, lex, vector_score and graph_score."""
    alpha = F.when(F.col("symbolic"), scoring.ALPHA_SYMBOLIC).otherwise(scoring.ALPHA)
    c = c.withColumn("dense", scoring.dense_norm(F.col("vector_score")))
    n = [F.col(x) for x in ("matched", "n_query")]
    c = c.withColumn("n_lex", scoring.lexical_norm(F.col("lex"), F.col("raw_bm25"), *n, F.col("dense"))).withColumn("alpha", alpha)
    ungrounded = F.col("key").contains(":") & (F.col("matched") == 0) & (F.col("lex") <= 0) & ~F.col("trusted") & (F.col("graph_score") <= 0)
    base = scoring.base_fusion(F.col("vector_score"), F.col("lex"), F.col("dense"), F.col("n_lex"), F.col("alpha"), F.col("trusted"), ungrounded, *n)
    c = c.withColumn("base", base)
    synergy = scoring.graph_synergy(F.col("base"), F.col("vector_score"), F.col("lex"), F.col("graph_score"), F.col("dense"), F.col("n_lex"), *n, F.col("symbolic"), F.col("trusted"), F.col("alpha"))
    age = F.greatest(F.lit(0.0), (F.lit(as_of) - F.col("ts")) / 86400.0)
    episodic = F.col("key").startswith("session:")
    ttl = F.when(episodic & (age > 3), F.greatest(F.lit(0.45), F.exp(-0.035 * (age - 3)))).otherwise(1.0)
    faint = (F.col("n_query") >= 3) & (F.col("matched") <= 1) & (F.col("dense") < 0.28) & (F.col("graph_score") <= 0)
    grounded = (F.col("vector_score") >= 0.65) | (F.col("graph_score") >= 0.70) | ((F.col("lex") > 0) & ((F.col("vector_score") > 0) | (F.col("graph_score") > 0) | F.col("trusted")))
    bonus = F.when((authority(F.col("key")) >= 100) & grounded & ~(ungrounded & (F.col("graph_score") < 0.7)), 0.035).otherwise(0.0)
    score = scoring.dbsf(synergy, ttl * F.when(faint, 0.55).otherwise(1.0), F.col("key"), F.col("source_type"), F.col("confidence"), bonus)
    return c.withColumn("score", score)


def gate(queries: DataFrame, scored: DataFrame) -> DataFrame:
    """Per query: retrieve or not, the reason and the threshold. ``queries`` has query and symbolic, ``scored`` score
    and graph_score; a strong graph hit lowers the threshold."""
    best = scored.groupBy("query_id").agg(F.max("score").alias("best"), F.max("graph_score").alias("graph"))
    base = F.when(F.col("symbolic"), THRESHOLD_SYMBOLIC).otherwise(THRESHOLD_PROSE)
    strong = F.coalesce(F.col("graph") >= 0.70, F.lit(False))
    threshold = F.when(strong, F.least(base, F.lit(THRESHOLD_GRAPH))).otherwise(base)
    system = F.exists(F.array(*map(F.lit, SYSTEM_PREFIXES)), lambda p: F.lower(F.trim("query")).startswith(p))
    reason = F.when(system, "system_notification").when(F.col("best").isNull(), "empty_pool").when(F.col("best") < threshold, "below_threshold").when(strong & (F.col("best") < base), "graph_hit").otherwise("accepted")
    out = queries.join(best, "query_id", "left").withColumn("reason", reason).withColumn("threshold", threshold)
    return out.select("query_id", F.col("reason").isin("accepted", "graph_hit").alias("retrieve"), "reason", "threshold")


def entropy_filter(scored: DataFrame, base: float = 0.0) -> DataFrame:
    """Rows above a threshold that rises with the entropy of a query's scores; weak graph-only rows go unless rules.

    Needs score, dense, lex and graph_score. Adds ``entropy`` (normalised, shrunk) and ``threshold``.
    """
    w = Window.partitionBy("query_id")
    positive = F.col("score") > 1e-6
    total, k = F.sum(F.when(positive, F.col("score"))).over(w), F.sum(positive.cast("long")).over(w)
    df = scored.withColumns({"_total": total, "_k": k, "_best": F.max("score").over(w)})
    p = F.when(positive, F.col("score") / F.col("_total"))
    h = -F.sum(p * F.log(p)).over(w) / F.log(F.col("_k").cast("double"))
    df = df.withColumn("_h", F.when(F.col("_k") < 2, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))
    shrink = 3.0 / (F.col("_k") + 3)
    df = df.withColumn("entropy", F.round(F.when(F.col("_k") >= 4, (1 - shrink) * F.col("_h") + shrink * 0.5).otherwise(F.col("_h")), 6))
    rise = F.when((F.col("_k") >= 4) & (F.col("entropy") >= 0.85), 0.55).when((F.col("_k") >= 4) & (F.col("entropy") >= 0.70), 0.40).otherwise(0.0)
    df = df.withColumn("threshold", F.round(F.greatest(F.lit(base), rise * F.col("_best")), 4))
    cliff = F.when(F.col("_k") >= 4, 0.5 * F.col("_best")).otherwise(0.0)
    weak = (F.col("graph_score") > 0) & (F.col("dense") < 0.12) & (F.col("lex") < 0.08) & ((F.col("score") < cliff) | (F.col("score") < F.greatest(F.col("threshold"), F.lit(0.28))))
    return df.where((F.col("score") >= F.col("threshold")) & (is_rule(F.col("key")) | ~weak)).drop("_total", "_k", "_best", "_h")


def within_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """The first rows of each query, by rank, whose estimated tokens add up to at most ``budget``."""
    cost = estimated_tokens(F.col("key"), F.col("value"))
    spent = F.sum("cost").over(Window.partitionBy("query_id").orderBy("rank"))
    return ranked.withColumn("cost", cost).withColumn("spent", spent).where(F.col("spent") <= budget)


def rendered(packed: DataFrame, longest: int = 1200) -> DataFrame:
    """A context block per query: a bullet for each record, in order of rank."""
    bullet = F.concat(F.lit("• ["), F.col("key"), F.lit("] "), F.substring("value", 1, longest))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", bullet.alias("line")))), lambda x: x["line"])
    return packed.groupBy("query_id").agg(F.concat(F.lit("## Memory\n"), F.array_join(lines, "\n")).alias("context"), F.count("*").alias("records"))
