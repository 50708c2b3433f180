import re
from collections import Counter, defaultdict

import pytest
from llm_cases import documents

from palimpsest.llm import divergence


def brute(docs, top=divergence.TOP):
    counts, langs, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded)
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(terms)
        langs[lang].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in in_docs[lang].items() if n >= divergence.MIN_DOCS)
        share = lambda c: {t: 1 + divergence.SCALE * (c[t] + 1) // n for n in [sum(c[x] for x in kept) + len(kept)] for t in kept}
        shares, q = {s: share(counts[lang, s]) for s in sources}, share(langs[lang])
        score = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(-sum(score(shares[s][t], shares[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-score(shares[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and shares[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def held(docs, **options):
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    got = sorted(tuple(r) for r in divergence.audited(docs, **options).collect())
    assert got == brute(rows, **options)
    return got


def test_documents(spark):
    got = held(documents(spark))
    assert {r[2] for r in got} == {"pair", "term"}
    assert max(r[5] for r in held(documents(spark), top=5) if r[2] == "term") == 5


def test_edges(edge_docs, no_docs):
    assert len(held(edge_docs)) > 10 and held(no_docs) == []


def test_ties_case_and_groups_without_terms(spark):
    texts = [("É ÉA b B", "x", "s1"), ("b éa é", "x", "s2"), ("B,b;\x00b", "x", None), ("é É 1b2", "x", ""), ("...", "x", "s4"), (None, "x", "s5"), ("rare", "y", "s1"), ("words", "y", "s2"), ("a", None, "s1")]
    got = held(spark.createDataFrame(texts, "text string, lang string, source string"))
    assert [r[4] for r in got if r[:3] == ("y", "s1", "pair")] == [0]


def test_small_merges_blocks_tiles_and_shards(spark, edge_docs, monkeypatch):
    many = [(f"a b{i % 3} c{i % 5} common {'x ' * (i % 4)}", "x", f"s{i % 11}") for i in range(120)]
    docs = spark.createDataFrame(many, "text string, lang string, source string")
    for name, value in (("MERGE", 10), ("TEXT_BYTES", 50), ("TILE", 4), ("DENSE", 8), ("WORK", 40)):
        monkeypatch.setattr(divergence, name, value)
    held(docs)
    held(edge_docs)


@pytest.mark.parametrize("count,words", [(10**13, 10**15), (0, 1)])
def test_shares_of_any_size(spark, count, words):
    row = spark.range(1).selectExpr(f"{count}L AS c", f"{words}L AS w", "7L AS v").select(divergence.share("c", "w", "v").alias("p")).first()
    assert row.p == 1 + divergence.SCALE * (count + 1) // (words + 7)
