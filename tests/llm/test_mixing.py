import heapq
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import documents

from palimpsest.llm import mixing


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(docs):
    rows = mixing.mixed(docs).collect()
    mine = docs.collect()
    sizes = defaultdict(int)
    for r in mine:
        sizes[r.source] += n_words(r.text)
    target = brute_targets(dict(sizes))
    assert Counter((r.doc_id, r.size, r.source_size) for r in rows) == Counter((r.doc_id, n_words(r.text), sizes[r.source]) for r in mine)
    source = {r.doc_id: r.source for r in mine}
    taken, shards = defaultdict(int), defaultdict(lambda: np.zeros(mixing.SHARDS, np.int64))
    for r in rows:
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size and sum(r.shard_words) == r.taken
        taken[source[r.doc_id]] += r.taken
        shards[source[r.doc_id]] += np.array(r.shard_words)
    for s, t in target.items():
        assert abs(taken[s] - t) <= 6 * mixing.BLOCK, (s, taken[s], t)
        # Every shard has its part of each source: at most some blocks from the share in the whole mix.
        assert all(abs(x - t / mixing.SHARDS) <= 6 * mixing.BLOCK for x in shards[s]), (s, shards[s], t)
    return rows


def test_targets_and_takings(spark, edge_docs, no_docs):
    check(edge_docs)
    check(documents(spark))
    assert check(no_docs) == []


def test_reruns_agree(spark):
    docs = documents(spark)
    assert sorted(mixing.mixed(docs).collect()) == sorted(mixing.mixed(docs.repartition(5)).collect())


def test_quotas_are_highest_quotients(spark):
    goals = [("a", 5000, 0, 9100.0), ("b", 900, 1, 777.7), ("c", 40, 2, 80.0), ("d", 3000, 3, 3100.5), ("e", 0, 4, 0.0)]
    got = mixing.quotas(spark.createDataFrame(goals, "source string, source_size long, place int, target double"), 16, 4).collect()
    house = round(sum(g[3] for g in goals) / 16)
    for k in range(4):
        heap = [(-g[3], g[2], 1, g) for g in goals if g[3]]
        heapq.heapify(heap)
        seats = Counter()
        while sum(seats.values()) < house * (k + 1) // 4:
            _, place, seat, g = heapq.heappop(heap)
            if seat <= 2 * -(-g[1] // 16):
                seats[g[0]] += 1
                heapq.heappush(heap, (-g[3] / (2 * seat + 1), place, seat + 1, g))
        assert {g[0]: seats[g[0]] for g in goals} == {g[0]: sum(r.quota for r in got if r.source == g[0] and r.shard <= k) for g in goals}


def test_mix_has_the_words_taken(spark, edge_docs, no_docs):
    for docs in (edge_docs, documents(spark)):
        taken = Counter()
        for r in mixing.mixed(docs).collect():
            taken[r.doc_id] += r.taken
        out = mixing.mix(docs)
        assert out.columns == docs.columns
        words, texts = Counter(), defaultdict(list)
        for r in docs.collect():
            texts[r.doc_id].append(" ".join((r.text or "").split(" ")))
        for r in out.collect():
            words[r.doc_id] += n_words(r.text)
            assert r.n_chars == len(r.text)
            for run in r.text.split("\n"):
                assert any(run in t for t in texts[r.doc_id])
        assert +words == +taken
    assert mixing.mix(no_docs).count() == 0
