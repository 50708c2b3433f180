"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 9).

The patterns are the windows of ten consecutive words of each benchmark item (an item of fewer words is one window).
Patterns of one length m share a shift table over blocks of two words (one word if m is 1): the text is read at the
end of a window, a block that ends no prefix of a pattern skips m - 1 words at once, and a block that can end a
pattern selects, by its hash, the patterns to compare word by word. Whole texts are searched where they lie; only the
patterns travel, in passes of at most ``WINDOWS_A_PASS`` windows whose tables are broadcast, so that a benchmark of
any size is searched in full. Passes are chained within the same tasks and add to the words hit so far.

Nulls: a null text or item has no words. Items with a null id hit words but aren't counted or named. Repeated items or
documents count as they stand: items once per id, documents row by row. Empty tables give an empty result, or one
without hits. Extra columns aren't read; the pipeline stage keeps them.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 10
WINDOWS_A_PASS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8: A-Z lowered, digits, a-z and all of 0x80 and above kept, any other a space.
FOLD = bytes(b if chr(b) in "0123456789" + LOWER or b >= 0x80 else b + 32 if chr(b) in UPPER else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Searcher:
    """The shift and hash tables of patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], tuple], length: int):
        self.length = length
        self.block = 2 if length > 1 else 1
        self.skip = length - self.block + 1
        self.shift: dict = {}
        self.ends: dict = {}
        for pattern in patterns:
            for last in range(self.block - 1, length):
                key = pattern[last - self.block + 1 : last + 1]
                self.shift[key] = min(self.shift.get(key, self.skip), length - 1 - last)
            self.ends.setdefault(pattern[length - self.block :], []).append(pattern)
        self.items = patterns

    def search(self, words: list[bytes], hit: bytearray, items: set) -> None:
        """Marks the words of every occurrence in ``hit`` and adds the ids of its items."""
        m, b, at, n = self.length, self.block, self.length - 1, len(words)
        shift, ends, skip = self.shift.get, self.ends, self.skip
        while at < n:
            key = (words[at - 1], words[at]) if b == 2 else (words[at],)
            step = shift(key, skip)
            if step:
                at += step
                continue
            start = at - m + 1
            for pattern in ends.get(key, ()):
                if words[start] == pattern[0] and tuple(words[start : at + 1]) == pattern:
                    hit[start : at + 1] = b"\x01" * m
                    items.update(self.items[pattern])
            at += 1


def windows(benchmark: DataFrame) -> DataFrame:
    """``item_id`` and ``win`` (its words, space-joined), each pair once."""
    folded = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    words = F.filter(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    df = benchmark.select("item_id", words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    return df.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.array_join(F.slice("w", F.col("i"), WINDOW), " ").alias("win")).distinct()


def searchers(rows: list) -> list[Searcher]:
    by_length: dict[int, dict] = {}
    for r in rows:
        pattern = tuple(r.win.encode().split(b" "))
        found = by_length.setdefault(len(pattern), {}).setdefault(pattern, set())
        if r.item_id is not None:
            found.add(str(r.item_id))
    return [Searcher(patterns, m) for m, patterns in sorted(by_length.items())]


FOUND = T.StructType([T.StructField("_hit", T.BinaryType()), T.StructField("_items", T.ArrayType(T.StringType()))])


def searched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``_hit`` (a byte for each word, 1 if hit) and ``_items`` (ids of the items found)."""
    spark = docs.sparkSession
    wins = windows(benchmark)
    n = max(1, math.ceil(wins.count() / WINDOWS_A_PASS))
    names, schema = docs.columns, T.StructType([*docs.schema.fields, *FOUND.fields])
    df = docs
    for k in range(n):
        tables = spark.sparkContext.broadcast(wins.where(F.pmod(F.xxhash64("win"), F.lit(n)) == k).collect() if n > 1 else wins.collect())

        def run(batches, tables=tables, first=k == 0):
            found = searchers(tables.value)
            for batch in batches:
                hits, items = [], []
                text = batch.column("text")
                for i in range(batch.num_rows):
                    words = words_of(text[i].as_py())
                    hit = bytearray(len(words)) if first else bytearray(batch.column("_hit")[i].as_py())
                    ids = set() if first else set(batch.column("_items")[i].as_py())
                    for searcher in found:
                        searcher.search(words, hit, ids)
                    hits.append(bytes(hit))
                    items.append(sorted(ids))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=[*names, "_hit", "_items"])

        df = df.mapInArrow(run, schema)
    return df


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (found ids as strings, sorted) and contaminated of each document."""
    found = searched(docs.select("doc_id", "text"), benchmark)

    def digest(batches):
        for batch in batches:
            hits = batch.column("_hit").to_pylist()
            n_hit = [sum(h) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(h) for h in hits], pa.int64()), pa.array(n_hit, pa.int64()), batch.column("_items"), pa.array([x > 0 for x in n_hit], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "items", "contaminated"],
            )

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType())]
    return found.drop("text").mapInArrow(digest, T.StructType([docs.schema["doc_id"], *fields]))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark window. The search is a filter: no text is shuffled."""
    wrapped = docs.select(F.struct("*").alias("_row"), "text")
    found = searched(wrapped, benchmark)
    return found.where(~F.contains(F.col("_hit"), F.lit(bytes([1])))).select("_row.*")
