import random
import re

from llm_cases import SF, documents

from palimpsest.llm import decontam


def words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(docs, items):
    wins = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for m in {len(x) for x in wins}:
            for i in range(len(w) - m + 1):
                found = wins.get(tuple(w[i : i + m]))
                if found is not None:
                    hit |= set(range(i, i + m))
                    ids |= {str(x) for x in found if x is not None}
        out.append((doc_id, len(w), len(hit), sorted(ids), bool(hit)))
    return sorted(out, key=str)


def found(docs, items):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontam.contamination(docs, items).collect()), key=str)


def test_documents(spark):
    docs, items = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(docs, items) == want
    assert any(r[4] for r in want)
    assert {r.doc_id for r in decontam.clean(docs, items).collect()} == {r[0] for r in want if not r[4]}


def test_edges_in_one_pass_and_in_many(spark, edge_docs, no_docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    w = words(rows[0][1])
    texts = [" ".join(w[3:20]), "TWO, words!", "one", None, "", "x 漢字", " ".join(w[3:13]), "é", "a b c", "b c d e a b c d e a b c"]
    items = [(i, t) for i, t in enumerate(texts)] + [(None, " ".join(w[15:26])), (6, texts[6])]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert found(edge_docs, table) == want
    monkeypatch.setattr(decontam, "WINDOWS_A_PASS", 8)
    assert found(edge_docs, table) == want
    kept = decontam.clean(edge_docs, table)
    assert kept.columns == edge_docs.columns and kept.count() == sum(not r[4] for r in want)
    assert found(no_docs, table) == [] and all(not r[4] for r in found(edge_docs, table.limit(0)))


def test_searcher_finds_all_in_random_words():
    r = random.Random(2)
    for m in (1, 2, 3, 7):
        text = [bytes([97 + r.randrange(3)]) for _ in range(400)]
        patterns = {tuple(bytes([97 + r.randrange(3)]) for _ in range(m)): {str(k)} for k in range(6)}
        hit, ids = bytearray(len(text)), set()
        decontam.Searcher(patterns, m).search(text, hit, ids)
        want = [i for i in range(len(text) - m + 1) if tuple(text[i : i + m]) in patterns]
        assert [i for i, h in enumerate(hit) if h] == sorted({i + k for i in want for k in range(m)})
        assert ids == set().union(*[patterns[tuple(text[i : i + m])] for i in want])
