from collections import Counter

import corpus_pipeline
from llm_cases import SF, documents
from pyspark.sql import functions as F
from test_decontam import brute as contaminated
from test_mixing import n_words
from test_quality import plainly_kept
from test_simhash import brute as linked

from palimpsest.llm import mixing


def plain(spark):
    """The first three stages in plain Python."""
    rows = [(r.doc_id, r.text, r.lang) for r in documents(spark).collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    rows = [r[:2] for r, ok in zip(rows, plainly_kept(rows, labels), strict=True) if ok]
    rows = [r for r, (doc_id, _, first) in zip(rows, sorted(linked(rows).elements()), strict=True) if doc_id == first]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated(rows, items) if r[4]}
    return {r for r in rows if r[0] not in bad}


def test_stages_in_order(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:3]:
        columns = docs.columns
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    kept = {(r.doc_id, r.text) for r in docs.collect()}
    assert kept == plain(spark)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert out.columns == [*documents(spark).columns, "shard", "slot"]
    kept = {d for d, _ in plain(spark)}
    assert {r.doc_id for r in rows} <= kept
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    docs = documents(spark).where(F.col("doc_id").isin(sorted(kept)))
    taken = {r.doc_id: r.taken for r in mixing.mixed(docs).collect()}
    words = Counter()
    for r in rows:
        words[r.doc_id] += n_words(r.text)
    assert words == Counter({d: n for d, n in taken.items() if n})


def test_edges(spark, edge_docs, no_docs):
    """Nulls, repeated rows, clashing columns and no rows at all go through every stage in turn."""
    for docs, least in ((edge_docs, 1), (no_docs, 0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            if name != "sharding":
                docs = stage(spark, docs, SF).select(columns)
            else:
                docs = stage(spark, docs.drop("shard"), SF)
        assert docs.columns == [*[c for c in columns if c != "shard"], "shard", "slot"] and docs.count() >= least
