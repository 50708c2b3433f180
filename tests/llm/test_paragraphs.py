import random

import numpy as np
import pyarrow as pa
from llm_cases import documents

from palimpsest.llm import paragraphs


def brute(rows):
    """Clusters of lines by comparing all pairs."""
    units = []
    for known, d, t in sorted({(d is not None, d or 0, t or "") for d, t in rows}):
        for number, line in enumerate(t.split("\n")):
            w = line.encode().lower().split()
            if w:
                units.append(((known, d), number, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)), tuple(w)))
    parent = list(range(len(units)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a[3] == b[3] or a[2] and b[2] and 10 * len(a[2] & b[2]) >= 8 * len(a[2] | b[2]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(units)):
        groups.setdefault(find(i), []).append(units[i][:2])
    real = lambda x: x[1] if x[0] else None
    return {(real(u[0]), u[1], real(g[0][0]), g[0][1], u != g[0]) for g in groups.values() if len(g) > 1 for u in g}


def found(docs):
    rows = [(r.doc_id, r.paragraph, r.cluster_doc_id, r.cluster_paragraph, r.removed) for r in paragraphs.repeated(docs).where("kind = 'line'").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def runs(rows, n):
    """Documents that have n words in a row in common with another, or twice."""
    places = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        for i in range(len(w) - n + 1):
            places.setdefault(tuple(w[i : i + n]), []).append((d, i))
    return {d for found in places.values() if len(set(found)) > 1 for d, _ in found}


def test_documents(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(docs) == brute(rows) != set()
    passages = {r.doc_id for r in paragraphs.repeated(docs).where("kind = 'passage'").collect()}
    assert runs(rows, paragraphs.PASSAGE + paragraphs.SPREAD - 1) <= passages <= runs(rows, paragraphs.PASSAGE)


def test_edits_around_the_threshold(spark):
    r = random.Random(6)
    base = [[f"w{r.randrange(500)}" for _ in range(r.randrange(30, 120))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = list(r.choice(base))
        for _ in range(r.randrange(5)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        rows.append((i, "short line\n" + " ".join(words) + "\n" + " ".join(r.choice(base)).upper()))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_edges(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert found(edge_docs) == brute(rows)
    assert paragraphs.repeated(no_docs).count() == 0


def test_hot_lines_are_joined_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "HOT", 3)
    rows = [(i, f"one line that all of these have\nbut another with the words {i} {i} {i} {i}\nand a tail of long lines here {i % 2}") for i in range(20)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_planted_passages(spark):
    """Passages of 50 to 90 words inside lines of other words, or wrapped, are all found; the other documents never."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    prose = lambda n: [word() for _ in range(n)]
    passages = [prose(r.randrange(50, 90)) for _ in range(30)]
    rows, hosts = [], {}
    for i in range(200):
        words, k = prose(r.randrange(100, 400)), i % 60
        if k < 30:
            at = r.randrange(len(words))
            words[at:at] = [w.upper() if i % 2 else w for w in passages[k]]
            hosts.setdefault(k, []).append(i)
        text, step = "", r.choice([9, 13, 40, 1000])
        for j in range(0, len(words), step):
            text += "  é x ".join(words[j : j + step]) + "\n" if k >= 30 else " ".join(words[j : j + step]) + "\n"
        rows.append((i, text))
    got = paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).where("kind = 'passage'").collect()
    assert {x.doc_id for x in got} == {i for x in hosts.values() for i in x}
    texts = dict(rows)
    for k, ids in hosts.items():
        assert {x.doc_id for x in got if x.cluster_doc_id == ids[0] and x.removed} == set(ids[1:])
        for x in [x for x in got if x.doc_id in ids]:
            # At an end of the passage a window may be one in some of these texts only.
            assert x.cluster_doc_id in ids and x.removed == (x.doc_id != x.cluster_doc_id)
            piece = texts[x.doc_id][x.start : x.end].lower().split()
            assert len(piece) == x.n_words >= paragraphs.PASSAGE and " ".join(piece) in " ".join(passages[k])
            assert x.paragraph == texts[x.doc_id][: x.start].count("\n")
        # Each copy is to be removed from its first word to its last.
        for i in ids[1:]:
            spans = sorted((x.start, x.end) for x in got if x.doc_id == i and x.removed)
            assert all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))  # noqa: B905
            assert texts[i][spans[0][0] : max(e for _, e in spans)].lower().split() == passages[k]


def test_anchors_are_the_least_of_each_run():
    x = np.random.default_rng(3).integers(0, 2**64, 500, dtype=np.uint64)
    x[100:130] = x[100]
    want = sorted({j + k for j in range(len(x) - paragraphs.SPREAD + 1) for k in range(paragraphs.SPREAD) if x[j + k] == x[j : j + paragraphs.SPREAD].min()})
    assert paragraphs.anchors(x, 504).tolist() == [i for i in want if i + paragraphs.PASSAGE <= 504]


def test_texts_are_measured_together(monkeypatch):
    """Many texts are hashed at once, and each gives what it gives alone: no line, shingle or window has words of two."""
    r, calls, shingles = np.random.default_rng(5), [], paragraphs.shingles
    words = ["ab", "Cd", "é", "日本", "🙂", "x\ny", "z\n\n", "\x0b", "q\r\n"]
    texts = [" ".join(words[i] for i in r.integers(0, len(words), n)) for n in [*range(80), 300, 3000]] + [None, "", "\n", "a b c d e", "a b c d e\n", "\nabc"]

    def measured(numbers):
        batch = pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([7] * len(numbers), pa.int64()), pa.array([texts[i] for i in numbers], pa.string())], names=["rid", "tag", "text"])
        return [x for found in paragraphs.measured(iter([batch])) for x in found.to_pylist()]

    plain = lambda rows: sorted(tuple(v for k, v in x.items() if k != "bands") for x in rows)
    banded = lambda rows: {(x["node"], tuple(x["bands"])) for x in rows if x["bands"]}
    alone = [x for i in range(len(texts)) for x in measured([i])]
    monkeypatch.setattr(paragraphs, "shingles", lambda *a: calls.append(1) or shingles(*a))
    together = measured(range(len(texts)))
    assert len(calls) == 1 and plain(together) == plain(alone) and banded(together) == banded(alone) != set()
    for x in together:
        assert len(texts[x["rid"]][x["start"] : x["end"]].split()) == x["n_words"] and (x["kind"] or "\n" not in texts[x["rid"]][x["start"] : x["end"]])
        assert texts[x["rid"]][: x["start"]].count("\n") == x["paragraph"] and len(texts[x["rid"]][: x["start"]].split()) == x["word"]


def test_removal():
    assert paragraphs.without("a\nb\nc", [(2, 3)]) == "a\nc" and paragraphs.without("a", [(0, 1)]) == ""
    assert paragraphs.without("one two three\n\nfour five\nsix", [(4, 7), (6, 19)]) == "one \n five\nsix"
