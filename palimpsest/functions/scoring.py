"""Scores of candidates: dense, lexical, fused, aged. Columns in, columns out; no wall clock, ages take ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import authority, is_rule, veracity

# Fixed values of the fusion formulas.
RRF_K = 60
ALPHA, ALPHA_SYMBOLIC = 0.35, 0.30
DENSE_MU, DENSE_BETA = 0.50, 12.0
BM25_SATURATION = 6.0
K1 = 1.2
#: Added before a score is rounded, so that halves that binary fractions miss are rounded up everywhere.
TIES_UP = 1e-9


def scaled_round(x: Column, places: int) -> Column:
    """``x`` to so many places by scaling it, as DuckDB's round does, halves away from zero. Spark's round goes by the
    digits that print ``x``: 0.0039345 is a half there, while a million times it, as a double, falls below one."""
    return F.round(x * 10.0**places, 0) / 10.0**places


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def smoothstep(t: Column) -> Column:
    return 3.0 * t * t - 2.0 * t * t * t


def dense_norm(v: Column) -> Column:
    """A cosine through a logistic curve, anchored at 0 and 1."""
    low = sigmoid(F.lit(-DENSE_BETA * DENSE_MU))
    scaled = (sigmoid(DENSE_BETA * (v - DENSE_MU)) - low) / (F.lit(1.0) - low)
    return F.when(v <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)))


def lexical_norm(lex: Column, raw: Column, matched: Column, n_query: Column, dense: Column) -> Column:
    coverage = F.when(n_query > 0, matched / n_query).otherwise(1.0)
    saturated = raw / F.greatest(F.lit(BM25_SATURATION), n_query * BM25_SATURATION)
    thin = (n_query >= 3) & (matched <= 1) & (dense < 0.28)
    return F.least(F.lit(1.0), F.when(thin, F.greatest(lex, saturated) * coverage).otherwise(F.greatest(lex * coverage, saturated)))


def base_fusion(vs: Column, ls: Column, dense: Column, lex: Column, alpha: Column, trusted: Column, ungrounded: Column, matched: Column, n_query: Column) -> Column:
    """Dense and lexical evidence together; a trusted match lets a strong dense score through whole."""
    base = alpha * dense + (1 - alpha) * lex
    blend = smoothstep((vs - 0.74) / 0.04)
    best = F.greatest(base, dense)
    both = F.when(~trusted | (vs <= 0.74), base).when(vs >= 0.78, best).otherwise((1 - blend) * base + blend * best)
    curve = smoothstep((vs - 0.60) / 0.20)
    alone = F.when(ungrounded, 0.15 * dense).when(((matched == 0) & ~trusted & (n_query >= 2)) | (vs <= 0.60), alpha * dense).when(vs >= 0.80, dense).otherwise((alpha + (1 - alpha) * curve) * dense)
    return F.when((vs > 0) & (ls > 0), both).when(vs > 0, alone).when(trusted, lex).otherwise((1 - alpha) * lex)


def graph_synergy(fused: Column, vs: Column, ls: Column, gs: Column, dense: Column, lex: Column, matched: Column, n_query: Column, symbolic: Column, trusted: Column, alpha: Column) -> Column:
    """Graph evidence added; damped where the words don't ground it."""
    weak = (matched == 0) | ((n_query >= 3) & (matched <= 1) & ~symbolic) | ((lex < 0.22) & ~symbolic)
    only = F.when(symbolic, 0.75 * gs).otherwise(F.least(F.lit(0.22), 0.30 * gs))
    spread = 0.9 * fused + 0.1 * F.greatest(gs, fused) + 0.02 * gs
    no_dense = (1 - alpha) * lex + 0.2 * gs
    damped = F.least(F.lit(0.18), 0.20 * gs + 0.50 * lex)
    full = F.least(F.lit(1.0), F.when((vs <= 0) & (ls <= 0), only).when(vs <= 0, no_dense).otherwise(spread))
    ramp = smoothstep((dense - 0.10) / 0.06)
    faint = F.when(dense <= 0.10, damped).when(dense >= 0.16, full).otherwise((1 - ramp) * damped + ramp * full)
    named = F.when(symbolic & trusted, 0.25 * lex + 0.75 * gs).otherwise(no_dense)
    firm = F.least(F.lit(1.0), F.when((vs <= 0) & (ls <= 0), only).when(vs <= 0, F.greatest(fused, named)).otherwise(spread))
    return F.when(gs <= 0, fused).when(weak, faint).otherwise(firm)


def dbsf(fused: Column, ttl: Column, subject: Column, source_type: Column, confidence: Column, rule_bonus: Column) -> Column:
    auth = authority(subject) / 100.0
    return F.round(F.least(F.lit(1.0), fused * ttl + 0.01 * (auth / 1.10) + 0.005 * veracity(source_type) * confidence + rule_bonus + TIES_UP), 4)


def rrf(vec: Column, lex: Column, vec_rank: Column, lex_rank: Column, trusted: Column) -> Column:
    """Reciprocal-rank fusion with k = 60, scaled so that rank 1 weighs 1."""
    rv, rl = (RRF_K + 1.0) / (RRF_K + vec_rank), (RRF_K + 1.0) / (RRF_K + lex_rank)
    lexical = F.least(F.lit(1.0), lex) * rl
    both = 0.5 * (vec * rv + lexical) + 0.02
    return F.when((vec > 0) & (lex > 0), both).when(vec > 0, vec * rv).when(trusted, lexical).otherwise(0.15 * lexical)


def record_rank(subject: Column, source_type: Column, confidence: Column, age_seconds: Column, superseded: Column) -> Column:
    """Standing of a record without a query."""
    weight = veracity(source_type) * confidence
    s = F.lower(subject)
    auth = F.when(is_rule(subject), 1.10).when(s.startswith("hermes:user_md:") | s.startswith("hermes:memory_md:"), 1.0).when(s.startswith("fact:"), 0.70).otherwise(0.50)
    lasting = is_rule(subject) & ((F.lower(source_type) == "user_explicit") | (confidence >= 0.99))
    fresh = F.when(lasting, 1.0 / (1.0 + 0.15 * F.log(1.0 + age_seconds / 86400.0))).otherwise(0.20 * weight / (1.0 + 0.05 * (age_seconds / 3600.0)))
    return F.when(superseded, -5.0).otherwise(F.round(0.40 * weight + 0.25 * auth + fresh, 4))


def salience(similarity: Column, importance: Column, age_seconds: Column, accesses: Column) -> Column:
    """Similarity and importance within 0 and 1, age and accesses not below 0."""
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    use = F.least(F.lit(1.0), F.log(1.0 + F.greatest(F.lit(0), accesses)) / F.log(F.lit(51.0)))
    return 0.4 * inside(similarity) + 0.3 * inside(importance) + 0.2 * F.exp(-1e-4 * F.greatest(F.lit(0), age_seconds)) + 0.1 * use


def prunable(salience_score: Column, importance: Column, state_variable: Column) -> Column:
    return ~state_variable & (importance < 0.95) & (salience_score < 0.15)
