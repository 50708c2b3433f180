"""Source divergence audit (operator 11): how far the words of each source of a language lie from those of other sources.

One pass over the documents, inside mapInArrow: texts are lower-cased (ascii_lower) and split at what is no letter
(split_pattern_regex), terms are dictionary-encoded and counted by hash group_by, first per document, then per
(language, source, term). Counts of a task are merged before they leave it, whenever some MERGE rows have gathered, so
that a third of all rows in one source gives as few rows as any other. Spark then adds them up per language and term;
terms in fewer than MIN_DOCS documents of the language go.

Shares are whole numbers: p = 1 + floor(SCALE * (count + 1) / (N + V)), N the group's words, V the language's terms.
They are taken in decimals, so that no count overflows. The score of a term for a source with share p against another
share q is floor((p - q)^2 / q). Sums over all terms for each two sources of a language are taken on columnar shards:
cells (term, source, p) are dealt by term over all tasks, each task adds up a matrix of its own terms, sources in tiles
of TILE by TILE, and Spark adds up the matrices. A matrix is all that a task holds, besides DENSE numbers of a block of
terms; terms that a source hasn't take that source's share of none. Nothing is collected to the driver.

Nulls: a null text, language or source is an empty one. A group without terms still has its rows of part `pair` (value 0
if the language keeps no term). Every row is a document, repeated ones too. Equal values are ranked by item, bytewise.
An empty table gives an empty result; other columns aren't read, and doc_id isn't either.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import MAX_TOTALS, bounded, materialise, partitions

#: What stands between terms: all ASCII but letters.
NO_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Rows of counts that a task gathers before it merges them, and text bytes that it splits at once.
MERGE, TEXT_BYTES = 400_000, 4 << 20
#: Sources on a side of a tile, numbers of a dense block, and pairs of cell and source that a task looks at, about.
TILE, DENSE, WORK = 1024, 1 << 21, 50_000_000
KEYS = ["lang", "source", "term"]


def counted(batch: pa.RecordBatch) -> pa.Table:
    """``lang``, ``source``, ``term``, ``n`` occurrences and ``docs`` documents of a batch of lang, source and text."""
    words = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), NO_LETTERS)
    terms, row = pc.list_flatten(words), pc.list_parent_indices(words)
    real = pc.not_equal(terms, "")
    codes = pc.filter(terms, real).cast(pa.string()).dictionary_encode()
    per_doc = pa.table({"row": pc.filter(row, real), "code": codes.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
    named = {c: pc.take(batch.column(c), per_doc["row"]) for c in ("lang", "source")}
    found = pa.table({**named, "term": pc.take(codes.dictionary, per_doc["code"]), "n": per_doc["count_all"]})
    found = found.group_by(KEYS).aggregate([("n", "sum"), ("n", "count")])
    return pa.table([*(found[k] for k in KEYS), found["n_sum"], found["n_count"]], names=[*KEYS, "n", "docs"])


def merged(parts: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(parts).group_by(KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.table([*(found[k] for k in KEYS), found["n_sum"], found["docs_sum"]], names=[*KEYS, "n", "docs"])


def partial_counts(batches):
    """Counts of a task's documents; merged whenever MERGE rows have gathered, handed on if merging hardly helps."""
    parts, rows = [], 0
    for batch in batches:
        # Before it is sliced: a slice's cast loses where the slice begins.
        batch, at = batch.set_column(2, "text", batch.column("text").cast(pa.large_string())), 0
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64))
        while at < batch.num_rows:
            done = int(sizes[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, done + TEXT_BYTES, side="right")))
            parts.append(counted(batch.slice(at, upto - at)))
            rows, at = rows + parts[-1].num_rows, upto
            if rows >= MERGE:
                parts = [merged(parts)]
                rows = parts[0].num_rows
                if rows >= MERGE // 2:
                    yield from parts[0].to_batches()
                    parts, rows = [], 0
    if parts:
        yield from merged(parts).to_batches()


def terms_of(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n``: occurrences in each group that has the term, of terms in MIN_DOCS documents
    of their language; ``of_lang``: occurrences in the language; ``one``: 1 in one row of each term, else 0."""
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = texts.mapInArrow(partial_counts, "lang string, source string, term string, n long, docs long")
    # Dealt by term, as sums per group, sums per language and the choice of terms all go by it: one shuffle.
    dealt = partial.repartition(partitions(docs.sparkSession), "lang", "term")
    sums = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    first = F.row_number().over(of_term.orderBy("source")) == 1
    sums = sums.withColumns({"of_lang": F.sum("n").over(of_term), "in_docs": F.sum("docs").over(of_term), "one": F.when(first, 1).otherwise(0)})
    return sums.where(F.col("in_docs") >= MIN_DOCS).drop("docs", "in_docs")


def share(count, words, terms):
    whole = "decimal(20,0)"
    return F.expr(f"1 + CAST(({count} + 1) AS {whole}) * {SCALE} DIV CAST({words} + {terms} AS {whole})").cast("long")


def score(p, q):
    return F.expr(f"({p} - {q}) * ({p} - {q}) DIV {q}").cast("long")


def groups_of(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``gid`` (its number in the language), ``words``, ``all_words``, ``terms`` and ``sources``."""
    every = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    words = cells.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    langs = cells.groupBy("lang").agg(F.sum("n").alias("all_words"), F.sum("one").alias("terms"))
    of_lang = Window.partitionBy("lang")
    found = every.join(words, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["words", "all_words", "terms"])
    return found.withColumns({"gid": F.row_number().over(of_lang.orderBy("source")) - 1, "sources": F.count("*").over(of_lang)})


def matrices(batches):
    """Sums of scores over the terms of a partition, per language and tile: rows of ``lang``, ``a``, ``b``, ``value``."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    rows = pa.Table.from_batches(rows)
    langs = rows["lang"].combine_chunks().dictionary_encode()
    lang = np.asarray(langs.indices, dtype=np.int64)
    lo, hi, gid, p = (np.asarray(rows[c]) for c in ("lo", "hi", "gid", "p"))
    terms = rows["term"].combine_chunks().dictionary_encode().indices
    term = np.asarray(pc.fill_null(terms, -1), dtype=np.int64)
    del rows, terms
    order = np.lexsort((term, hi, lo, lang))
    lang, lo, hi, gid, p, term = (x[order] for x in (lang, lo, hi, gid, p, term))
    starts = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    for start, end in zip(starts, [*starts[1:], len(lang)], strict=True):
        own, share_of, of_term = gid[start:end], p[start:end], term[start:end]
        zero = of_term < 0
        names = np.sort(own[zero])
        none = share_of[zero][np.argsort(own[zero])]
        column, share_of, of_term = np.searchsorted(names, own[~zero]), share_of[~zero], of_term[~zero]
        if not len(of_term):
            continue
        row = np.cumsum(np.r_[0, of_term[1:] != of_term[:-1]])
        total, height = np.zeros((len(names), len(names)), np.int64), max(1, DENSE // len(names))
        for at in range(0, int(row[-1]) + 1, height):
            some = slice(*np.searchsorted(row, [at, at + height]))
            block = np.tile(none[:, None], (1, min(height, int(row[-1]) + 1 - at)))
            block[column[some], row[some] - at] = share_of[some]
            for a in range(len(names)):
                d = block[a] - block
                total[a] += (d * d // block).sum(axis=1)
        a, b = np.divmod(np.arange(total.size), len(names))
        # Of a tile off the diagonal, pairs across its two blocks only: those inside a block belong to its own tile.
        tell = (a != b) & ((lo[start] == hi[start]) | (names[a] // TILE != names[b] // TILE))
        a, b, value = names[a[tell]], names[b[tell]], total.reshape(-1)[tell]
        yield pa.RecordBatch.from_arrays([pa.array([langs.dictionary[int(lang[start])].as_py()] * len(a), pa.string()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(value)], names=["lang", "a", "b", "value"])


def pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``a``, ``b``, ``value``: for each two sources of a language that keeps terms, scores of a against b."""
    spark = cells.sparkSession
    size = cells.agg(F.sum("sources").alias("work")).first()
    n = max(partitions(spark), math.ceil((size.work or 0) / WORK))
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(n)).cast("int")
    tiles = F.expr(f"transform(sequence(0, CAST((sources - 1) DIV {TILE} AS INT)), k -> struct(least(k, gid DIV {TILE}) AS lo, greatest(k, gid DIV {TILE}) AS hi))")
    columns = ["lang", "term", "gid", "p"]
    there = cells.select(shard.alias("shard"), *columns, F.explode(tiles).alias("t"))
    # A source's share of none goes to each shard, a row a source.
    none = groups.where("terms > 0").select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"), "lang", F.lit(None).cast("string").alias("term"), "gid", share("0L", "words", "terms").alias("p"), F.explode(tiles).alias("t"))
    rows = there.unionByName(none).select("shard", *columns, F.col("t.lo").cast("int").alias("lo"), F.col("t.hi").cast("int").alias("hi"))
    found = rows.repartitionById(n, F.col("shard")).drop("shard").mapInArrow(matrices, "lang string, a int, b int, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audited(docs: DataFrame, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: each source's divergence from every other one of its
    language (part `pair`), and its ``top`` terms of above the language's share (part `term`)."""
    counts = materialise(terms_of(docs))
    groups = bounded(groups_of(docs, counts), MAX_TOTALS)
    cells = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "gid", "sources", share("n", "words", "terms").alias("p"), share("of_lang", "all_words", "terms").alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), score("p", "q").alias("value"))
    above = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    one = groups.select("lang", F.col("gid").alias("a"), "source")
    other = groups.select("lang", F.col("gid").alias("b"), F.col("source").alias("item"))
    # All ordered pairs are what is asked for: sources of a language are joined by the language.
    pairs = one.join(other, "lang").where("a <> b").join(pair_sums(cells, groups), ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(above)
