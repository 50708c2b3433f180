import hashlib
import zlib
from collections import defaultdict

import pytest
from llm_cases import documents
from pyspark.sql import functions as F

from palimpsest.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def tree(nodes, fan):
    """Levels of a tree, from its leaves to its one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def path(levels, at, fan):
    out = []
    for nodes in levels[:-1]:
        first = at // fan * fan
        out.append((nodes[first:at], nodes[at + 1 : first + fan]))
        at //= fan
    return out


def brute(rows, fan):
    sources, out = defaultdict(list), []
    for r in rows:
        sources[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])], fan) for s in names}
    above = tree([trees[s][-1][0] for s in names], fan) if names else []
    for k, s in enumerate(names):
        for at, (known, doc_id, own, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            proof = path(trees[s], at, fan) + path(above, k, fan)
            text = r.text
            if text is not None and known and zlib.crc32(str(doc_id).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            root = leaf(r, text)
            for left, right in proof:
                root = H(*left, root, *right)
            out.append((str(r.doc_id), own, trees[s][-1][0], above[-1][0], H(*(x for lr in proof for side in lr for x in side)), root, root == above[-1][0]))
    return sorted(out)


def held(docs, fan=merkle.FAN):
    got = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.verified(docs).collect())
    assert got == brute(docs.collect(), fan)
    return got


def test_documents_and_order_of_rows(spark):
    docs = documents(spark)
    got = held(docs)
    assert got == held(docs.repartition(7)) and {r[-1] for r in got} == {True, False}


def test_edges_also_with_deeper_trees(edge_docs, no_docs, monkeypatch):
    held(edge_docs)
    assert held(no_docs) == [] and merkle.manifest(no_docs.withColumn("leaf", F.lit("x"))).root.count() == 0
    monkeypatch.setattr(merkle, "FAN", 2)
    held(edge_docs, 2)


@pytest.mark.parametrize("n", [1, 16, 17, 257])
def test_one_source_of_any_size(spark, n):
    held(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("A text").alias("text")))


def test_only_what_is_asked_for_is_proven(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "source", merkle.leaf(F.col("text")).alias("leaf"))
    made = merkle.manifest(rows)
    some = made.leaves.where("doc_id in (3, 77, 150)").select("doc_id", "tree", "rank", "digest")
    proven = {r.doc_id: (r.root, r.folded) for r in merkle.proven(made, some).select("doc_id", "root", merkle.folded("digest").alias("folded")).collect()}
    root = made.root.first().digest
    assert proven == {i: (root, root) for i in (3, 77, 150)}
    for r in made.records.collect():
        assert r.digest == H(*r.children)
