"""Substring dedup with a sparse suffix array built by sample sort (operator 7).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of smaller id, or before
it in the same one. Texts are UTF-8 bytes and matches never cross documents.

Suffixes. Of all suffixes only those are sorted that equal strings are sure to share: every window of LENGTH bytes has
an anchor, the first of its ``LEAD``-byte substrings with the least hash, which depends on the window's content alone.
Consecutive windows with the same anchor form a segment, and one suffix stands for it: its leading token (the hash of
the LEAD bytes at the anchor), then a 128-bit hash of the whole segment, then document and place. This is about one
suffix in 35 bytes.

Sorting. Spark samples splitters over these keys and range-partitions the suffixes; as document and place are part of
the key, even a passage that a third of all documents hold is spread over many buckets. A bucket is sorted by multikey
quicksort. Within a run of equal leading tokens and segments all but the first are repeats, and all their windows go.

Across segments and boundaries. Segments that share their leading token but differ elsewhere may still share windows,
as may runs cut by a bucket's boundary. The first segment of each such run is fetched from the texts, and its windows
are compared with those of the other segments of the token; all but the first of equal windows go. Tokens with more
than ``HOT`` different segments are compared by grouping windows in Spark, in place of a task's memory.

Nulls: a null text is empty; a null id comes before all others. Rows that share an id and text are one document listed
more than once, each with the same result; rows that share an id alone are ordered by a hash of their texts. An empty
table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import bounded, identified, partitions, shared_folder

LENGTH, LEAD = 100, 32
SPAN = LENGTH - LEAD + 1
#: Bytes that are hashed at once; a longer text is read in pieces that overlap by a window.
AT_ONCE = 1 << 20
PLACE_BITS = 23
SMALL = 4096
HOT = 20_000
MAX_HOT = 1_000_000
WINDOWS_AT_ONCE = 1 << 20
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any substring of a buffer, modulo 2^64, by sums of bytes times powers of an odd base."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        if base not in self.powers or len(self.powers[base][0]) <= n:
            size = max(n + 1, AT_ONCE + LENGTH + 1)
            up = np.full(size, base, np.uint64)
            down = np.full(size, pow(base, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            self.powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        up, self.down = self.powers[base]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Of texts at [start, end) of a buffer: first and last window start, and keys, of each segment."""
    n = len(data)
    if n < LENGTH:
        return None
    first, second = Rolling(data, BASES[0]), Rolling(data, BASES[1])
    lead = first.every(LEAD)
    ranked = (lead & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(lead), dtype=np.uint64)
    # Least of every SPAN values in a row: from the left and from the right within blocks of SPAN.
    blocks = np.full(-(-len(ranked) // SPAN) * SPAN, np.uint64(2**64 - 1))
    blocks[: len(ranked)] = ranked
    blocks = blocks.reshape(-1, SPAN)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - LENGTH + 1
    anchor = (np.minimum(right[:windows], left[SPAN - 1 : SPAN - 1 + windows]) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    long = ends - starts >= LENGTH
    change = np.zeros(windows + 1, np.int32)
    np.add.at(change, starts[long], 1)
    np.add.at(change, ends[long] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    if not len(at):
        return None
    anchors = anchor[at]
    fresh = np.flatnonzero(np.r_[True, (anchors[1:] != anchors[:-1]) | (at[1:] != at[:-1] + 1)])
    # Two texts may meet in one run of windows only at a text's start.
    heads = np.flatnonzero(np.isin(at, starts[long]))
    fresh = np.union1d(fresh, heads)
    begin, last = at[fresh], at[np.r_[fresh[1:], len(at)] - 1]
    return begin, last, lead[anchor[begin]], first.of(begin, last + LENGTH), second.of(begin, last + LENGTH)


SUFFIX = "token long, seg1 long, seg2 long, rid long, tag long, start long, size int"


def suffixes(batches):
    """The suffixes of texts; ``start`` is that of the segment's first window, ``size`` the segment's bytes."""

    def flush(held):
        data = np.frombuffer(b"".join(h[3] for h in held), np.uint8)
        lengths = np.array([len(h[3]) for h in held])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        found = segments(data, starts, ends)
        if found is None:
            return None
        begin, last, token, seg1, seg2 = found
        owner = np.searchsorted(starts, begin, side="right") - 1
        # Empty texts share a start with the next one; the last of them owns it.
        rid, tag, offset = (np.array([h[k] for h in held], np.int64)[owner] for k in range(3))
        columns = [token.view(np.int64), seg1.view(np.int64), seg2.view(np.int64), rid, tag, begin - starts[owner] + offset, (last - begin + LENGTH).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "seg1", "seg2", "rid", "tag", "start", "size"])

    held, size = [], 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for rid, tag, value in zip(batch.column("rid").to_pylist(), batch.column("tag").to_pylist(), texts, strict=True):
            body = value.as_py() or b""
            for offset in range(0, max(1, len(body) - LENGTH + 1), AT_ONCE):
                piece = body[offset : offset + AT_ONCE + LENGTH - 1]
                if held and size + len(piece) > AT_ONCE + LENGTH - 1:
                    if (out := flush(held)) is not None:
                        yield out
                    held, size = [], 0
                if len(piece) >= LENGTH:
                    held.append((rid, tag, offset, piece))
                    size += len(piece)
    if held and (out := flush(held)) is not None:
        yield out


def multikey_quicksort(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by columns: split in three by a pivot of one column, equal ones go on with the next column."""
    order = np.arange(len(columns[0]))
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == len(columns):
            continue
        rows = order[low:high]
        if high - low <= SMALL:
            order[low:high] = rows[np.lexsort([c[rows] for c in reversed(columns[depth:])])]
            continue
        values = columns[depth][rows]
        pivot = np.sort(values[:: max(1, len(values) // 9)])[4]
        less, equal = values < pivot, values == pivot
        a, b = int(less.sum()), int(equal.sum())
        order[low:high] = np.concatenate([rows[less], rows[equal], rows[~(less | equal)]])
        todo += [(low, low + a, depth), (low + a, low + a + b, depth + 1), (low + a + b, high, depth)]
    return order


FOUND = "rid long, tag long, start long, size int, token long"


def repeats(batches):
    """Of a bucket: the segments that repeat (token null), and those to be compared window by window (token given)."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    table = pa.Table.from_batches(table)
    names = ("token", "seg1", "seg2", "rid", "tag", "start", "size")
    columns = dict(zip(names, (np.asarray(table.column(c)) for c in names), strict=True))
    del table
    order = multikey_quicksort([columns[c] for c in names[:6]])
    token, seg1, seg2, rid, tag, start, size = (columns[c][order] for c in names)
    same_token = np.r_[False, token[1:] == token[:-1]]
    same = np.r_[False, same_token[1:] & (seg1[1:] == seg1[:-1]) & (seg2[1:] == seg2[:-1])]
    # The same place listed twice, by a repeated row, is no repeat.
    listed = np.r_[False, same[1:] & (rid[1:] == rid[:-1]) & (tag[1:] == tag[:-1]) & (start[1:] == start[:-1])]
    runs = np.cumsum(~same_token) - 1
    many = np.bincount(runs, weights=~same) > 1
    many[0] = many[-1] = True  # the bucket beside may go on with them
    # A later listing of a run's first place isn't a repeat either.
    place = np.maximum.accumulate(np.where(listed, 0, np.arange(len(token))))
    repeat = same[place] & ~listed
    compare = ~same & many[runs]
    for use, tokens in ((repeat, None), (compare, token)):
        if use.any():
            k = int(use.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[use]), pa.array(tag[use]), pa.array(start[use]), pa.array(size[use]), pa.nulls(k, pa.int64()) if tokens is None else pa.array(tokens[use])], names=["rid", "tag", "start", "size", "token"]
            )


def cut(batches):
    """The bytes of the segments listed with each text."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for rid, tag, value, listed in zip(batch.column("rid").to_pylist(), batch.column("tag").to_pylist(), texts, batch.column("listed"), strict=True):
            body, k = value.as_py() or b"", len(listed)
            token, start, size = (listed.values.field(c) for c in ("token", "start", "size"))
            data = [body[s : s + n] for s, n in zip(start.to_pylist(), size.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([token, pa.array([rid] * k, pa.int64()), pa.array([tag] * k, pa.int64()), start, pa.array(data, pa.binary())], names=["token", "rid", "tag", "start", "data"])


def windows_of(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every window of the segments, the number of its segment, and its place there."""
    buffer = np.frombuffer(b"".join(data), np.uint8)
    lengths = np.array([len(x) for x in data])
    starts = np.cumsum(lengths) - lengths
    counts = lengths - LENGTH + 1
    owner = np.repeat(np.arange(len(data)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[owner] + offset
    return Rolling(buffer, BASES[0]).of(at, at + LENGTH), Rolling(buffer, BASES[1]).of(at, at + LENGTH), owner, offset


def compared(batches):
    """Windows of a task's segments that equal an earlier one, as runs (rid, tag, start, size)."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    table = pa.Table.from_batches(table)
    token, rid, tag, start = (np.asarray(table.column(c)) for c in ("token", "rid", "tag", "start"))
    data = table.column("data")
    order = np.argsort(token, kind="stable")
    bounds = np.flatnonzero(np.r_[True, token[order][1:] != token[order][:-1], True])
    lengths = np.asarray(pc.binary_length(data))[order] - LENGTH + 1
    done = np.r_[0, np.cumsum(lengths)]
    first = 0
    while first < len(bounds) - 1:
        # Whole groups, as many as make up a limited number of windows.
        last = max(first + 1, int(np.searchsorted(done[bounds], done[bounds[first]] + WINDOWS_AT_ONCE, side="right")) - 1)
        rows = order[bounds[first] : bounds[last]]
        first = last
        h1, h2, owner, offset = windows_of([data[int(i)].as_py() for i in rows])
        owner = rows[owner]
        place = start[owner] + offset
        by = np.lexsort([place, tag[owner], rid[owner], h2, h1])
        equal = (h1[by][1:] == h1[by][:-1]) & (h2[by][1:] == h2[by][:-1])
        twice = equal & (rid[owner][by][1:] == rid[owner][by][:-1]) & (tag[owner][by][1:] == tag[owner][by][:-1]) & (place[by][1:] == place[by][:-1])
        same = np.r_[False, equal]
        listed = np.r_[False, twice]
        at = np.maximum.accumulate(np.where(listed, 0, np.arange(len(by))))
        gone = by[same[at]]
        if not len(gone):
            continue
        gone = np.sort(gone)  # owners and offsets rise together again
        fresh = np.flatnonzero(np.r_[True, (gone[1:] != gone[:-1] + 1) | (owner[gone][1:] != owner[gone][:-1])])
        begin, end = gone[fresh], gone[np.r_[fresh[1:], len(gone)] - 1]
        yield pa.RecordBatch.from_arrays([pa.array(rid[owner[begin]]), pa.array(tag[owner[begin]]), pa.array(place[begin]), pa.array((end - begin + LENGTH).astype(np.int32))], names=["rid", "tag", "start", "size"])


def hot_windows(batches):
    for batch in batches:
        if batch.num_rows:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                h1, h2, owner, offset = windows_of(some.column("data").to_pylist())
                rid, tag, start = (np.asarray(some.column(c))[owner] for c in ("rid", "tag", "start"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1.view(np.int64), h2.view(np.int64), rid, tag, start + offset)], names=["h1", "h2", "rid", "tag", "start"])


def repeated(texts: DataFrame) -> DataFrame:
    """``rid``, ``tag``, ``start``, ``size``: stretches of ``texts`` (rid, tag, text) of which each window repeats."""
    spark = texts.sparkSession
    ranged = texts.mapInArrow(suffixes, SUFFIX).repartitionByRange(partitions(spark), "token", "seg1", "rid", "start")
    path = f"{shared_folder(spark)}/suffixes-{uuid.uuid4().hex}"
    ranged.mapInArrow(repeats, FOUND).write.parquet(path)
    found = spark.read.schema(FOUND).parquet(path)
    whole = found.where("token is null").select("rid", "tag", "start", "size")
    open_ = found.where("token is not null")
    hot = bounded(open_.groupBy("token").count().where(F.col("count") > HOT).select(F.col("token").alias("_token")), MAX_HOT)
    any_hot = bool(hot.take(1))

    def bytes_of(some: DataFrame) -> DataFrame:
        listed = some.groupBy("rid", "tag").agg(F.collect_list(F.struct("token", "start", "size")).alias("listed"))
        return texts.join(listed, ["rid", "tag"]).mapInArrow(cut, "token long, rid long, tag long, start long, data binary")

    usual = open_.join(hot, F.col("token") == F.col("_token"), "left_anti") if any_hot else open_
    out = whole.unionByName(bytes_of(usual).repartition(partitions(spark), "token").mapInArrow(compared, "rid long, tag long, start long, size int"))
    if any_hot:
        rows = bytes_of(open_.join(hot, F.col("token") == F.col("_token"), "left_semi")).mapInArrow(hot_windows, "h1 long, h2 long, rid long, tag long, start long")
        firsts = rows.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.min(F.struct("rid", "tag", "start")).alias("first"))
        later = rows.join(firsts, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).where(F.struct("rid", "tag", "start") != F.col("first"))
        out = out.unionByName(later.select("rid", "tag", "start", F.lit(LENGTH).alias("size")))
    return out


def runs_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans (start, size)."""
    out: list[list[int]] = []
    for start, size in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + size)
        else:
            out.append([start, start + size])
    return [(s, e) for s, e in out]


def kept_bytes(body: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(body)]
    return b"".join(body[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) and removed (the spans) of each document."""
    texts = identified(docs)
    found = repeated(texts.select("rid", "tag", "text"))
    listed = found.groupBy("rid", "tag").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    rows = texts.join(listed, ["rid", "tag"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            columns = []
            for value, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans"), strict=True):
                body, given = value.as_py() or b"", spans.values if spans.is_valid else None
                runs = runs_of(list(zip(given.field("start").to_pylist(), given.field("size").to_pylist(), strict=True))) if given is not None else []
                columns.append((len(body), sum(e - s for s, e in runs), len(runs), kept_bytes(body, runs), [{"start": s, "end": e} for s, e in runs]))
            n_bytes, n_removed, n_spans, kept, removed = zip(*columns, strict=True) if columns else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"],
            )

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [*[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType()), T.StructField("removed", T.ArrayType(span))]
    return rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], *fields]))

