from collections import Counter

import numpy as np
import xxhash
from llm_cases import documents

from palimpsest.llm import simhash


def brute(rows):
    fps = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64(b" ".join(w[i : i + 3]), seed=42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return Counter((rows[i][0], fps[i], least[find(i)]) for i in range(len(rows)))


def found(docs):
    return Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.components(docs).collect())


def test_edges_match_brute_force(edge_docs):
    assert found(edge_docs) == brute([(r.doc_id, r.text) for r in edge_docs.collect()])


def test_documents_match_brute_force(spark):
    docs = documents(spark).limit(250)
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_no_link_is_lost_at_any_distance(spark):
    """Chains of fingerprints 1 to 4 bits apart: linked up to 3, whatever fields the bits are in."""
    r = np.random.default_rng(5)
    fps = [int(x) for x in r.integers(0, 2**63, 200)]
    for x in fps[:200]:
        bits = r.choice(64, 4, replace=False)
        fps += [x ^ sum(1 << int(b) for b in bits[:k]) for k in (3, 4)]
    fps = sorted(set(fps))
    rows = spark.createDataFrame([(np.uint64(x).astype(np.int64).item(),) for x in fps], "fp long")
    got = {(x.a, x.b) for x in simhash.links(rows).collect()}
    parent = {x: x for x in (np.uint64(f).astype(np.int64).item() for f in fps)}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in got:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
        parent[find(a)] = find(b)
    keys = list(parent)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                assert find(a) == find(b)


def test_one_of_each_keeps_columns_and_one_row(edge_docs, no_docs):
    kept = simhash.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    whole = simhash.components(edge_docs)
    assert kept.count() == whole.select("component_id").distinct().count()
    assert simhash.one_of_each(no_docs).count() == 0 and simhash.components(no_docs).count() == 0


def test_one_of_each_with_null_and_repeated_ids(spark):
    r = np.random.default_rng(8)
    a, b, c, d, e = (" ".join(f"w{x}" for x in r.integers(0, 10**6, 60)) for _ in range(5))
    rows = [(None, c), (None, d), (None, e), (None, e), (3, a), (7, a), (7, b), (7, b), (None, b)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter(map(tuple, kept.collect())) == Counter([(None, c), (None, d), (None, e), (3, a), (7, b)])
