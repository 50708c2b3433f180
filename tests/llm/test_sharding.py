import zlib
from collections import Counter

import numpy as np
from llm_cases import documents

from palimpsest.llm import sharding
from palimpsest.llm.common import feistel


def check(docs, shards=16):
    rows = sharding.sharded(docs, shards).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts)
    assert {r.law for r in rows} <= {"rows"} and all(r.grown_shard is None for r in rows)
    counts = Counter(r.shard for r in rows)
    if rows:
        sizes = [counts[s] for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    return rows


def test_edges(edge_docs, no_docs):
    check(edge_docs)
    assert check(no_docs) == []


def test_same_shuffle_however_rows_are_partitioned(spark):
    docs = documents(spark)
    a, b = (sorted(check(d)) for d in (docs, docs.repartition(7)))
    assert a == b and [r.slot for r in a] != sorted(r.slot for r in a)


def test_permutation_of_every_size():
    for n in [1, 2, 3, 5, 16, 17, 1000, 4097]:
        assert sorted(feistel(np.arange(n), n, 3)) == list(range(n))
        assert n < 16 or (feistel(np.arange(n), n, 3) != feistel(np.arange(n), n, 4)).any()
    assert sorted(feistel(np.array([0, 1, 2, 0, 1]), np.array([3, 3, 3, 2, 2]), 1, np.array([0, 0, 0, 9, 9]))) == [0, 0, 1, 1, 2]
    assert int(feistel(np.array([5]), 10**15, 3)[0]) < 10**15


def test_in_shards_keeps_rows(edge_docs, no_docs):
    out = sharding.in_shards(edge_docs)
    assert out.count() == edge_docs.count() and out.columns == [*[c for c in edge_docs.columns if c != "shard"], "shard", "slot"]
    assert sharding.in_shards(no_docs).count() == 0
