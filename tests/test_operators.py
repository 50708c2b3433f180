"""Small cases of operators, their edges included."""

import functools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scoring, text
from palimpsest.operators import analytics, graph, learning, retrieval, store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_stems(spark):
    words = {"cache": "cache", "dawka": "dawk", "protokołami": "protokol", "gry": "gry", "żółty": "zolt", "node": "node", "ok": "ok", "badania": "badani"}
    assert {w: one(spark, text.stem(F.lit(w))) for w in words} == words


def test_gates(spark):
    cases = {"hej": True, "Thanks, a lot!": True, "what port does node1 use": False, "": False, "ok run the whole benchmark again": True}
    assert {c: one(spark, text.is_trivial(F.lit(c))) for c in cases} == cases
    assert one(spark, text.entities(F.lit("ask kv:port:x of node1 and node1"))) == ["kv:port:x", "node1"]
    symbolic = {"db:port": True, "how are you?": False, "abcd": True, "abc": False, "see a-b now": True, "": False}
    assert {c: one(spark, text.is_symbolic(F.lit(c))) for c in symbolic} == symbolic


def test_sessions(spark):
    keys = {"session:abc:x": "abc", "session_20240101_120000_ab12:x": "20240101_120000_ab12", "session_20240101_120000_ab12_more": "20240101_120000_ab12", "fact:x": "global", "plain": None}
    assert {k: one(spark, text.effective_session(F.lit(k), F.lit(None).cast("string"))) for k in keys} == keys
    assert one(spark, text.session_accessible(F.lit("session_a"), F.lit("a"))) and not one(spark, text.session_accessible(F.lit("a"), F.lit(None).cast("string")))


def test_entity_root_and_pii(spark):
    assert one(spark, text.entity_root(F.lit("fact:Engine v2.0.1 (2024-01-05) release main=0873d87"))) == "engine"
    assert one(spark, text.entity_root(F.lit(None).cast("string"))) == ""
    pii = {"mail a.b@c.org": True, "token": False, "secret": True, "my api_key here": True, "secret = x": True, "": False}
    assert {c: one(spark, text.is_pii(F.lit(c))) for c in pii} == pii


def test_dense_norm_is_anchored(spark):
    assert one(spark, scoring.dense_norm(F.lit(0.0))) == 0.0 and one(spark, scoring.dense_norm(F.lit(0.5))) == pytest.approx(0.4988, abs=1e-3)


def test_empty_tables_give_empty_results(spark):
    facts = spark.createDataFrame([], "key string, value string")
    queries = spark.createDataFrame([], "query_id long, query string")
    assert retrieval.bm25(queries, facts).count() == 0
    assert store.keyword_search(facts, queries).count() == 0
    edges = spark.createDataFrame([], "src string, dst string, confidence double")
    assert graph.simple_paths(edges, spark.createDataFrame([], "node string"), 3).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bm25_counts_repeats_and_phrases(spark):
    facts = spark.createDataFrame([("a", "red apple pie"), ("b", "red red car"), ("c", None)], "key string, value string")
    queries = spark.createDataFrame([(1, "red apple"), (2, None), (3, "nothing here")], "query_id long, query string")
    rows = {r.key: r for r in retrieval.bm25(queries, facts).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].matched == 2 and rows["a"].raw_bm25 > rows["b"].raw_bm25 + 1 and rows["a"].lex == 1.0


def test_paths_on_a_diamond(spark):
    edges = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.9), ("b", "d", 1.0), ("c", "d", 0.8), ("d", "a", 1.0)], "src string, dst string, confidence double")
    start = spark.createDataFrame([("a",)], "node string")
    paths = {(">".join(r.path), r.conf) for r in graph.simple_paths(edges, start, 3).collect()}
    assert paths == {("a>b", 0.5), ("a>c", 0.9), ("a>b>d", 0.5), ("a>c>d", 0.72)}
    assert {(r.target, r.path) for r in graph.shortest_paths(edges, start, 3).collect()} >= {("d", "a>b>d")}
    assert {r.node for r in graph.cut_points(edges, "a", 3, 0.3).collect()} == set()
    chain = edges.where("src in ('a', 'b') and dst <> 'c'")
    assert {r.node: r.cut_off for r in graph.cut_points(chain, "a", 3, 0.3).collect()} == {"b": 1}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    roots = {r.node: r.root for r in graph.components(links).collect()}
    assert roots == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_pagerank_keeps_its_mass(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0)], "src string, dst string, confidence double")
    v = {r.node: r.v for r in graph.pagerank(edges, spark.createDataFrame([("a", 1.0)], "node string, weight double"), 12).collect()}
    assert sum(v.values()) == pytest.approx(1.0) and v["c"] > v["b"]


def test_clocks_and_sets(spark):
    a = spark.createDataFrame([(1, "x", 5), (1, "y", 2), (2, "x", 1)], "doc long, node string, count long")
    b = spark.createDataFrame([(1, "x", 3), (1, "y", 7), (2, "x", 4)], "doc long, node string, count long")
    assert {r.doc: (r.relation, r.merged) for r in analytics.clock_relation(a, b).collect()} == {1: ("concurrent", 12), 2: ("before", 4)}


def test_ledger_chain_finds_the_first_bad_entry(spark):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows, prev = [], store.GENESIS
    for i in range(1, 8):
        value_hash = h(f"v{i}")
        entry = h(f"{i}:t{i}:k:{value_hash}:{prev}")
        rows.append((1, i, f"t{i}", "k", f"v{i}", value_hash, prev, entry))
        prev = entry
    schema = "user long, seq long, stamp string, key string, value string, value_hash string, prev_hash string, entry_hash string"
    good = spark.createDataFrame(rows, schema)
    assert store.verify_chain(good, ["user"]).first()[1:] == (7, 0, None)
    bad = good.withColumn("value", F.when(F.col("seq") == 4, "forged").otherwise(F.col("value")))
    assert store.verify_chain(bad, ["user"]).first()[1:] == (7, 1, 4)
    assert store.verify_chain(good.where("seq <> 3"), ["user"]).first()[1:] == (6, 1, 4)


@pytest.mark.parametrize("chunk", [3, 1000])
def test_precision_is_that_of_a_plain_loop(spark, monkeypatch, chunk):
    monkeypatch.setattr(learning, "CHUNK", chunk)
    r = random.Random(4)
    rows = [(f"c{i % 3}", i, r.choice([None, 0.0, 0.01, 0.3, 2.0, 9.0, -1.0])) for i in range(90)] + [("one", 0, 0.0)]
    want, now = {}, {}
    for channel, seq, error in rows:
        x = now.get(channel, 1.0)
        if error is not None:
            x = max(0.05, min(10.0, 0.85 * x + 0.15 / (max(0.0, error) ** 2 + 0.04)))
        want[channel, seq] = now[channel] = x
    got = {(x.channel, x.seq): x.precision for x in learning.precisions(spark.createDataFrame(rows, "channel string, seq long, error double")).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_many_query_vectors_meet_the_vectors_by_parts(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)] if i % 9 else None if i % 2 else [0.0] * 6) for i in range(120)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = vectors.where("id < 40").selectExpr("id AS query_id", "vector AS query")
    few = {tuple(x) for x in analytics.dense_top_k(queries, vectors, 4, 0.1, block=7).collect()}
    monkeypatch.setattr(analytics, "MOST_ASKED", 0)
    many = {tuple(x) for x in analytics.dense_top_k(queries, vectors, 4, 0.1, block=7).collect()}
    assert many == few and len(few) > 100


def test_blocked_pairs_of_a_large_block(spark):
    """One block of 4,000 vectors is met in parts within a minute, row by row it took several; odd vectors as in plain code."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4_000, 16))
    rows = [(1, n, v.tolist()) for n, v in enumerate(x)] + [(2, 1, [1.0, 0.0]), (2, 2, [2.0, 0.0]), (2, 3, [0.0, 0.0]), (2, 4, [1.0]), (2, 5, None), (3, 6, [1.0, 0.0]), (None, 7, [1.0, 0.0])]
    began = time.monotonic()
    got = {(r.label, r.a, r.b): r.cos for r in analytics.blocked_pairs(spark.createDataFrame(rows, "label int, id long, vector array<double>"), "label", 0.8, meet=1_500).collect()}
    assert time.monotonic() - began < 60
    near = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = near @ near.T
    want = {(1, int(a), int(b)) for a, b in zip(*np.nonzero(np.round(near, 6) >= 0.8), strict=True) if a < b} | {(2, 1, 2)}
    assert set(got) == want
    assert all(abs(got[k] - near[k[1], k[2]]) < 1e-6 for k in want if k[0] == 1)


def test_session_whose_rewards_cancel_out(spark):
    """Three tenths and six times -0.05 leave 5e-17, which is no success after a last step below zero; rows come in any order."""
    rewards = [0.1] * 3 + [-0.05] * 6
    rows = [(name, n, r) for name, order in (("down", rewards), ("up", rewards[::-1]), ("more", [*rewards, 0.1, -0.05])) for n, r in enumerate(order)]
    random.Random(5).shuffle(rows)
    steps = spark.createDataFrame(rows, "session string, seq int, reward double").repartition(1).sortWithinPartitions("session", "seq")
    got = {r.session: (r.steps, r.total, r.success) for r in analytics.session_success(steps).collect()}
    add = lambda xs: functools.reduce(float.__add__, xs, 0.0)
    up = add(rewards[::-1])
    assert add(rewards) > 0
    assert got == {"down": (9, 0.0, False), "up": (9, 0.0, up >= 0), "more": (11, 0.05, True)}
