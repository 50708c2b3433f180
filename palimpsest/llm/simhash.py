"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 10).

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 2 outside one of four 16-bit fields: the field
that holds a differing bit. So each distinct fingerprint, with one field blanked out in turn, emits itself and every
variant one bit away (half the remaining radius): 4 x 49 variants. Those of two linked fingerprints meet in a variant.
Variants are shuffled, and the fingerprints that share one are compared exactly. Of the links found at a variant a
spanning forest is emitted (no more rows than fingerprints met), whose union over all variants joins exactly the
linked fingerprints. Exact copies share a fingerprint, so they are one node however many they are.

Nulls: a null or empty text has no words and fingerprint zero, linked like any other. A null doc_id never names a
component unless all its ids are null (then null). Repeated rows each get a row in the result. Rows of an empty table
give an empty result. Extra columns aren't read. Ids may repeat or be null; the pipeline stage keeps one row of each
component, told by its id and a hash of its text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import connected_components, materialise, partitions

SHINGLE = 3
SEED = 42
RADIUS = 3
FIELDS, FIELD_BITS = 4, 16
VARIANTS = FIELDS * (1 + 64 - FIELD_BITS)
#: Variants that one task of the matching stage reads, about.
ROWS_A_TASK = 2_000_000
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes) -> int:
    """The SimHash of a text (UTF-8): shingles of three lower-cased words, XXH64 with seed 42, majority of each bit."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(SHINGLE, len(words))
    hash_of = xxhash.xxh64_intdigest
    n, counts = len(words) - size + 1, np.zeros(64, np.int64)
    starts, ends = starts[:n].tolist(), ends[size - 1 :].tolist()
    for at in range(0, n, HASHES_AT_ONCE):
        some = np.array([hash_of(joined[s:e], SEED) for s, e in zip(starts[at : at + HASHES_AT_ONCE], ends[at : at + HASHES_AT_ONCE], strict=True)], dtype="<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's 64 bits as a long) and ``tag`` (a hash of the text) of each document."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            fps = np.fromiter((fingerprint(x.as_py() or b"") for x in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), batch.column("tag")], names=["doc_id", "fp", "tag"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType()), T.StructField("tag", T.LongType())]))


def variants(batches):
    """For each fingerprint the values with a field replaced by the field's number, and all those one bit away."""
    for batch in batches:
        fps = np.asarray(batch.column("fp")).view(np.uint64)
        for at in range(0, len(fps), 4096):
            x, keys = fps[at : at + 4096], []
            for field in range(FIELDS):
                hole = np.uint64(((1 << FIELD_BITS) - 1) << (field * FIELD_BITS))
                blank = (x & ~hole) | np.uint64((field + 1) << (field * FIELD_BITS))
                flips = [0, *(1 << b for b in range(64) if b // FIELD_BITS != field)]
                keys.append(blank[:, None] ^ np.array(flips, dtype=np.uint64)[None, :])
            keys = np.concatenate(keys, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(x, keys.shape[1]).view(np.int64))], names=["key", "fp"])


def forest(members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join whatever members are linked: each member is compared with those not reached yet."""
    found, left = [], members
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= RADIUS
            if near.any():
                found.append((np.full(int(near.sum()), x), left[near]))
                queue.extend(left[near])
                left = left[~near]
    return found


def met(batches):
    """Links among the fingerprints of a partition that share a variant."""
    parts = [(np.asarray(b.column("key")), np.asarray(b.column("fp")).view(np.uint64)) for b in batches if b.num_rows]
    if not parts:
        return
    keys, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    two = starts[sizes == 2]
    near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= RADIUS
    found = [(fps[two][near], fps[two + 1][near])]
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        found += forest(fps[start : start + size])
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """``a``, ``b``: links between distinct fingerprints ``fp`` whose components are those of all links."""
    n = max(partitions(distinct.sparkSession), math.ceil(distinct.count() * VARIANTS / ROWS_A_TASK))
    return distinct.mapInArrow(variants, "key long, fp long").repartition(n, "key").mapInArrow(met, "a long, b long")


def rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``fp`` and ``tag`` of each row, and ``fp``, ``root`` and ``first`` (least id) of each fingerprint."""
    fps = materialise(fingerprints(docs))
    first = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(first.select("fp")))
    return fps, first.join(roots, first["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")


def components(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (smallest doc_id reachable over links, itself included) of each row."""
    fps, roots = rooted(docs)
    named = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = roots.select("fp", "root").join(named, "root").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(by_fp, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest doc_id stays.

    Nulls come last, and of rows that share the id that with the least text hash stays.
    """
    fps, roots = rooted(docs)
    # The first row of each fingerprint, then of each component.
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag")
    least = fps.groupBy(F.col("fp").alias("_fp")).agg(F.min(order).alias("row"))
    least = roots.join(least, F.col("fp") == F.col("_fp")).groupBy("root").agg(F.min("row").alias("row"))
    keep = least.select(F.col("row.doc_id").alias("_keep"), F.col("row.tag").alias("_keep_tag")).distinct()
    tagged = docs.withColumn("_tag", F.xxhash64("text"))
    same = tagged["doc_id"].eqNullSafe(keep["_keep"]) & (tagged["_tag"] == keep["_keep_tag"])
    return tagged.join(keep, same, "left_semi").dropDuplicates(["doc_id", "_tag"]).select(*docs.columns)
