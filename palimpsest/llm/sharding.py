"""Sharding by a Feistel permutation of global row numbers (operator 3).

Rows are numbered from 0 in the order of (hash bucket of doc_id, doc_id, text hash), which depends on the rows alone.
A seeded Feistel network with cycle walking permutes the numbers; number p of n goes to shard p mod shards, slot
p div shards. So the shuffle is reproducible, shard counts are at most one apart, slots are gapless from 0, and shard
and slot of any row number can be computed without the data. The law is `rows`.

Nulls: a null text has size 1 and CRC 0, a null doc_id is a value like any other. Rows equal in id and text take each
other's places in any order (the result is the same). Copies of a text are not kept together, as counts at most one
apart forbid it. An empty table gives an empty result; other columns pass unread.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import buckets, feistel, materialise, running_before

SHARDS = 16
SEED = 20_240_131


def place(row: Column, rows: int, seed: int = SEED) -> Column:
    """The permuted number of a row number below ``rows``."""

    @F.pandas_udf("long")
    def permuted(x: pd.Series) -> pd.Series:
        return pd.Series(feistel(x.to_numpy(), rows, seed))

    return permuted(row)


def placed(docs: DataFrame, narrow: DataFrame, rows: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with shard and slot; ``narrow`` has doc_id and ``_tag`` of the same rows."""
    numbered = running_before(docs, narrow, buckets(rows), None).withColumn("_place", place(F.col("before"), max(rows, 1), seed))
    return numbered.withColumn("shard", (F.col("_place") % shards).cast("int")).withColumn("slot", F.floor(F.col("_place") / F.lit(shards)).cast("long")).drop("before", "_place")


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, law, shard, slot and grown_shard (null) of each document."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    narrow = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64("text").alias("_tag"))
    narrow = materialise(narrow)
    out = placed(narrow, narrow, narrow.count(), shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def in_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot``; the texts are shuffled once, by hash bucket."""
    narrow = materialise(docs.select("doc_id", F.xxhash64("text").alias("_tag")))
    out = placed(docs.select(F.struct("*").alias("_row"), "doc_id", F.xxhash64("text").alias("_tag")), narrow, narrow.count(), shards, seed)
    return out.select("_row.*", F.col("shard"), F.col("slot")) if not {"shard", "slot"} & set(docs.columns) else out.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
