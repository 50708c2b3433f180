import random
from collections import Counter

import numpy as np
from llm_cases import documents

from palimpsest.llm import suffix


def brute(rows):
    """Each listing (rid, tag, text) as the contract says, with a set of all windows seen so far."""
    seen, done, out = set(), {}, []
    for key in sorted({(d is not None, d or 0, t) for d, t in rows}):
        body = (key[2] or "").encode()
        gone = np.zeros(len(body), bool)
        for s in range(len(body) - 99):
            window = body[s : s + 100]
            if window in seen:
                gone[s : s + 100] = True
            seen.add(window)
        edges = np.diff(np.r_[0, gone.astype(int), 0])
        done[key] = (len(body), int(gone.sum()), int((edges == 1).sum()), bytes(np.frombuffer(body, np.uint8)[~gone]))
    for d, t in rows:
        out.append((d, *done[d is not None, d or 0, t]))
    return Counter(out)


def found(docs):
    rows = suffix.deduplicated(docs).collect()
    for r in rows:
        assert sum(x.end - x.start for x in r.removed) == r.n_removed and len(r.removed) == r.n_spans
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows)


def test_documents(spark):
    docs = documents(spark)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert found(docs) == want and sum(x[2] > 0 for x in want) > 10


def made(seed, n):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcd é") for _ in range(r.randrange(60, 400))) for _ in range(8)] + ["x" * 250, "ab" * 150]
    texts = []
    for _ in range(n):
        text = "".join(r.choice([r.choice(passages), "".join(r.choice("abcd ") for _ in range(r.randrange(80)))]) for _ in range(r.randrange(5)))
        if texts and r.random() < 0.3:
            text = r.choice(texts)
            if text and r.random() < 0.7:
                k = r.randrange(len(text))
                text = text[:k] + r.choice(["", "#", "##"]) + text[k + 1 :]
        texts.append(text)
    return texts


def test_made_passages_in_many_buckets_and_hot_tokens(spark, monkeypatch):
    monkeypatch.setattr(suffix, "AT_ONCE", 700)
    monkeypatch.setattr(suffix, "SMALL", 16)
    monkeypatch.setattr(suffix, "WINDOWS_AT_ONCE", 300)
    rows = list(enumerate(made(1, 120)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert found(docs) == want
    monkeypatch.setattr(suffix, "HOT", 3)
    assert found(docs) == want


def test_edges(edge_docs, no_docs):
    """Ids are shared by equal rows alone here, so the order of texts within an id doesn't matter."""
    assert found(edge_docs) == brute([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert found(no_docs) == Counter()


def test_multikey_quicksort_sorts():
    r = np.random.default_rng(3)
    columns = [r.integers(0, 5, 20_000), r.integers(0, 50, 20_000), r.integers(0, 10**6, 20_000)]
    order = suffix.multikey_quicksort(columns)
    rows = [tuple(int(c[i]) for c in columns) for i in order]
    assert rows == sorted(rows) and sorted(order) == list(range(20_000))
