import random

import numpy as np
import pytest
from conftest import prose
from llm_cases import documents

from palimpsest.llm import setsketch as ss


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))) if w else frozenset()


def brute(rows):
    """Components over all pairs of rows."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(s), least.get(find(i)), d == least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def held(docs):
    got = sorted((tuple(r) for r in ss.classes(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    return got


def copies(seed, n, share):
    """Copies of a text with a share of their words changed: some are linked to the text only, some to no one."""
    r, words = random.Random(seed), prose(seed, 150).split()
    return [" ".join(f"{w}x{r.randrange(10**6)}" if r.random() < share else w for w in words) for _ in range(n)]


def test_documents(spark):
    assert any(not r[3] for r in held(documents(spark)))


def test_edges(edge_docs, no_docs):
    assert len(held(edge_docs)) > 10 and held(no_docs) == []


def near_copies(spark):
    texts = [t for k, share in enumerate((0.02, 0.045, 0.055, 0.06, 0.08)) for t in copies(k, 40, share)]
    return spark.createDataFrame([(i * 7 % 199 if i else 199, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_groups_of_copies_that_are_partly_linked(spark):
    got = held(near_copies(spark))
    assert 20 < sum(r[3] for r in got) < 180


def test_the_same_in_small_blocks_and_by_buckets(spark, monkeypatch):
    docs = near_copies(spark)
    monkeypatch.setattr(ss, "BLOCK", 5)
    held(docs)
    monkeypatch.setattr(ss, "MAX_BLOCKS", 2)
    monkeypatch.setattr(ss, "COLUMNS", 64)
    monkeypatch.setattr(ss, "MAX_NODES", 0)
    held(docs)


def test_registers_merge_and_tell_similarity():
    r = np.random.default_rng(5)
    for n, common in ((1, 1), (40, 30), (2000, 1700), (5000, 100)):
        both = r.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
        a, b = both[:n], both[n - common :]
        ka, kb = ss.registers(a), ss.registers(b)
        assert (ss.merged(ka, kb) == ss.registers(both)).all()
        best, behind = ss.estimated(ka[None], kb[None], np.array([float(n)]), np.array([float(n)]))
        true = common / (2 * n - common)
        assert abs(best[0] - true) < 0.16
        assert true < 0.8 or best[0] >= 0.8 or behind[0] < ss.DOUBT
    assert behind[0] > ss.DOUBT and (ss.registers(np.zeros(0, np.uint64)) == 0).all()


@pytest.mark.parametrize("text", ["", " \n", "one", "One", "a b", "a b a b", "É É é"])
def test_sets(text):
    assert len(ss.shingles(text.encode())) == len(shingle_set(text))
