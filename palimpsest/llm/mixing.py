"""Mixing sources to target weights by Sainte-Lague apportionment (operator 5).

A source's words, document after document in the order of (hash bucket of doc_id, doc_id, text hash), are cut into
blocks of ``BLOCK`` words; the last block of a source may be shorter. The mix has as many blocks as its target words
make up. The seats of its first k+1 shards' share are given to sources by the highest quotients target / (2 seat - 1),
for every k, so each shard's integer quotas are the difference between two Sainte-Lague apportionments. No source gets
more than twice its blocks; such seats go to the next quotients. Then a seeded permutation of each source's block
numbers, gone through up to twice, is dealt to the shards: the first takes as many blocks as its quota, the second the
next ones, and so on to the end of the last quota. So each chosen block has a shard, and each shard its quota of every
source. A document has taken what the chosen blocks hold of it, twice its size at most.

Apportionment without listing all quotients: at a slightly larger divisor all seats are certain, at a slightly smaller
one the rest is a few candidates per source, of which the highest fill the house.

Nulls: a null text has size 0, a null source is a source of its own that comes last. Repeated ids or rows are
documents of their own. Empty tables and sources without words give targets and takings of 0. Other columns pass
unread; the pipeline stage gives them back with the taken words as the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import SPACE_CHARS, bounded, buckets, feistel, materialise, running_before

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 16
SHARDS = 16
SEED = 7
MAX_SOURCES = 10_000
BLOCKS_AT_ONCE = 1 << 17
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: source_size, place (0, 1, ... by code point, null last), weight and target.

    A target is weight x level, but at most MOST x source_size; the level is where the targets add up to SHARE of all
    words. In the order of source_size / weight the capped sources come first, and the level follows from running
    sums. The windows hold one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    rest = SHARE * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))
    per = per.withColumn("level", rest / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))))
    free = F.col("level") < F.col("cap") / F.col("weight")
    per = per.withColumn("level", F.min_by(F.when(free, F.col("level")), F.when(free, F.col("cap") / F.col("weight"))).over(whole))
    target = F.when(F.col("level").isNull() | (F.col("level") >= F.col("cap") / F.col("weight")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return per.withColumn("target", target).select("source", "source_size", "place", "target")


def quotas(goals: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """``source``, ``shard``, ``quota``: blocks of each source in each shard."""
    houses = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    total, n = F.sum("target").over(Window.partitionBy()), F.count("*").over(Window.partitionBy())
    df = goals.withColumns({"total": total, "sources": n, "limit": MOST * F.ceil(F.col("source_size") / block)})
    df = df.withColumn("shard", houses).withColumn("house", F.floor(F.round(F.col("total") / block) * (F.col("shard") + 1) / shards))
    loose, tight = F.col("total") / (F.col("house") - F.col("sources")), F.col("total") / (F.col("house") + 3 * F.col("sources"))
    sure = F.when(F.col("house") > F.col("sources"), F.least(F.floor(F.col("target") / loose + 0.5), F.col("limit"))).otherwise(0)
    most = F.least(F.floor(F.col("target") / tight + 0.5), F.col("limit"))
    df = df.withColumns({"sure": F.when(F.col("target") > 0, sure).otherwise(0).cast("long"), "most": F.when(F.col("target") > 0, most).otherwise(0).cast("long")})
    open_seats = df.where("most > sure").withColumn("seat", F.explode(F.sequence(F.col("sure") + 1, F.col("most"))))
    left = F.col("house") - F.col("given")
    given = df.groupBy("shard").agg(F.sum("sure").alias("given"))
    by_quotient = Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("seat") - 1)).desc(), "place", "seat")
    won = open_seats.join(given, "shard").withColumn("_rank", F.row_number().over(by_quotient)).where(F.col("_rank") <= left).groupBy("shard", F.col("place").alias("_place")).agg(F.count("*").alias("won"))
    seats = df.join(won.withColumnRenamed("shard", "_shard"), (F.col("shard") == F.col("_shard")) & (F.col("place") == F.col("_place")), "left").withColumn("seats", F.col("sure") + F.coalesce("won", F.lit(0)))
    before = F.lag("seats", 1, 0).over(Window.partitionBy("place").orderBy("shard"))
    return seats.select("source", "source_size", "place", "target", "shard", (F.col("seats") - before).cast("long").alias("quota"))


def plan(sizes: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """Per source: its target, number of blocks, ``until`` (for each shard, the quotas up to it) and the last of these,
    ``quota``; a small table."""
    per = quotas(targets(sizes), block, shards).withColumn("until", F.sum("quota").over(Window.partitionBy("place").orderBy("shard")))
    per = per.groupBy(F.col("source").alias("_source"), "source_size", "place", "target").agg(F.sum("quota").alias("quota"), F.transform(F.array_sort(F.collect_list(F.struct("shard", "until"))), lambda x: x["until"]).alias("until"))
    return bounded(per.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long")), MAX_SOURCES)


def dealt(number: np.ndarray, blocks, quota, place, until: np.ndarray, seed: int) -> np.ndarray:
    """For each block number the shards that take it, in two columns: -1 where the permutation isn't dealt so far."""
    rank = feistel(number, blocks, seed, place)
    picks = np.stack([rank, rank + blocks], axis=1)
    shards = (picks[:, :, None] >= until[:, None, :]).sum(axis=2)
    return np.where(picks < np.asarray(quota).reshape(-1, 1), shards, -1)


def chosen(before: int, size: int, blocks: int, quota: int, place: int, until: np.ndarray, block: int, seed: int):
    """Chunks of (first word, end, shards) over a document's words, from those of the blocks that it lies in."""
    first, last = before // block, (before + size - 1) // block
    for at in range(first, last + 1, BLOCKS_AT_ONCE):
        numbers = np.arange(at, min(last + 1, at + BLOCKS_AT_ONCE), dtype=np.int64)
        starts = np.maximum(numbers * block, before) - before
        ends = np.minimum((numbers + 1) * block, before + size) - before
        yield starts, ends, dealt(numbers, blocks, quota, place, np.broadcast_to(until, (len(numbers), len(until))), seed)


def summed(rows: np.ndarray, words: np.ndarray, shards: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Words by row and shard, of blocks with ``words`` each that ``shards`` take."""
    cell = (rows[:, None] * shape[1] + shards)[shards >= 0]
    weights = np.broadcast_to(words[:, None], shards.shape)[shards >= 0]
    return np.bincount(cell, weights=weights, minlength=shape[0] * shape[1]).astype(np.int64).reshape(shape)


def taken_words(before, size, blocks, quota, place, until, block: int, seed: int) -> np.ndarray:
    """Words taken of each of many documents by each shard: their blocks side by side, a limited number at once."""
    first = before // block
    counts = np.where(size > 0, (before + size - 1) // block - first + 1, 0)
    shape = (len(size), until.shape[1])
    out, done, at = np.zeros(shape, np.int64), np.cumsum(counts), 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(done, done[at] - counts[at] + BLOCKS_AT_ONCE, side="right")))
        if counts[at] > BLOCKS_AT_ONCE:
            for starts, ends, shards in chosen(*(int(x[at]) for x in (before, size, blocks, quota, place)), until[at], block, seed):
                out[at] += summed(np.zeros(len(starts), np.int64), ends - starts, shards, (1, shape[1]))[0]
            stop = at + 1
        else:
            doc = np.repeat(np.arange(at, stop), counts[at:stop])
            number = first[doc] + np.arange(len(doc)) - (done - counts)[doc] + (done[at] - counts[at])
            words = np.minimum((number + 1) * block, before[doc] + size[doc]) - np.maximum(number * block, before[doc])
            out += summed(doc, words, dealt(number, blocks[doc], quota[doc], place[doc], until[doc], seed), shape)
        at = stop
    return out


PLAN = ("blocks", "quota", "place", "until")


def with_offsets(docs: DataFrame, sizes: DataFrame, rows: int, per: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, size, _tag and others) with the words of its source before it, and the source's plan."""
    return running_before(docs, sizes, buckets(rows), "size", "source").join(per, F.col("source").eqNullSafe(F.col("_source")))


def mixed(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and shard_words (the words each shard takes) of each document."""
    names = ["doc_id", "size", "source_size", "target"]
    sizes = materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_tag")))
    rows = with_offsets(sizes, sizes, sizes.count(), plan(sizes, block)).select("doc_id", "size", "source_size", "target", "before", *PLAN)

    def run(batches):
        for batch in batches:
            columns = [np.asarray(batch.column(c)) for c in ("before", "size", "blocks", "quota", "place")]
            until = batch.column("until").flatten()
            words = taken_words(*columns, np.asarray(until).reshape(batch.num_rows, len(until) // max(1, batch.num_rows)), block, seed)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * words.shape[1]
            shares = pa.ListArray.from_arrays(pa.array(ends), pa.array(words.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(words.sum(axis=1)), shares], names=[*names, "taken", "shard_words"])

    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("taken", T.LongType()), T.StructField("shard_words", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, schema)


def taken_texts(text: str, runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[str]:
    """The text of each pass over a document: its taken words with what stands between them, runs apart by a newline."""
    body, out = text.encode(), []
    spans = None
    starts, ends, shards = (np.concatenate(x) for x in zip(*runs, strict=True))
    times = (shards >= 0).sum(axis=1)
    for number in range(2):
        use = times > number
        if not use.any():
            break
        if use.all():
            out.append(text)
            continue
        spans = [m.span() for m in WORD.finditer(body)] if spans is None else spans
        edges = np.flatnonzero(np.diff(np.r_[0, use.astype(np.int8), 0]))
        out.append("\n".join(body[spans[starts[i]][0] : spans[ends[j - 1] - 1][1]].decode() for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
    return out


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix: the rows of ``docs`` with the taken words as ``text`` (a row for each of at most two passes) and, if
    there, ``n_chars`` of it. The texts are shuffled once, by source and hash bucket."""
    names = docs.columns
    sizes = materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_tag")))
    wide = docs.select(F.struct("*").alias("_row"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_tag"))
    rows = with_offsets(wide, sizes, sizes.count(), plan(sizes, block)).where("size > 0").select("_row.*", *[F.col(c).alias(f"_mix_{c}") for c in ("before", "size", *PLAN)])

    def run(batches):
        for batch in batches:
            columns = [batch.column(f"_mix_{c}").to_pylist() for c in ("before", "size", *PLAN)]
            at, texts = [], []
            for i, (*place, until) in enumerate(zip(*columns, strict=True)):
                passes = taken_texts(batch.column("text")[i].as_py(), list(chosen(*place, np.array(until), block, seed)))
                at += [i] * len(passes)
                texts += passes
            taken = batch.select(names).take(pa.array(at, pa.int64()))
            replaced = {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in names:
                replaced["n_chars"] = pa.array([len(x) for x in texts], pa.int64()).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([replaced.get(c, taken.column(i)) for i, c in enumerate(names)], names=names)

    return rows.mapInArrow(run, docs.schema)
