"""Near-duplicate paragraphs by MinHash banding, exact Jaccard and components (operator 4).

Two kinds of paragraph are looked at. A line is what stands between newlines. Two lines are linked if the sets of their
five-word shingles (words lower-cased in ASCII) have a Jaccard similarity of ``SIMILARITY`` or more; those of fewer than
five words, which have no shingle, if they are equal. A passage is a window of ``PASSAGE`` words, whatever lines it lies
in: it begins where a shingle is the least of some ``SPREAD`` shingles in a row, which depends on the words around alone.
So any PASSAGE + SPREAD - 1 words (48) that two texts have in common, at whatever place and in whatever lines, hold a
window that both texts have. Windows are linked if they are equal (at similarity 0.8 they could differ at their ends
only); those of a text that overlap and go to the same document are one row.

Equal paragraphs are one node, known by a 64-bit hash, however many there are. A line has BANDS x ROWS minima of permuted
shingle hashes; nodes that agree in all rows of a band collide. At similarity 0.8 a pair collides in some band with
probability 1 - (1 - 0.8^3)^10, over 0.999. Of each colliding group every node is first compared with the group's least
one; a group all of whose nodes are linked to it is settled, without meeting in one task, however large. What is left are
groups of unlike lines: in one task each, members are visited in turn and compared with those not reached yet. So no link
found is lost, and what leaves the tasks is a spanning forest of the links. Components over it are the clusters; of a
cluster the paragraph that comes first (by id and position) stays and the others are to be removed.

Nulls: a null text has no paragraphs, a null id comes before all others. Rows equal in id and text are one document
listed more than once, in the result once. Lines without words are no paragraphs. An empty table gives an empty result;
extra columns aren't read.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import NULL_ID, bounded, connected_components, identified, materialise, partitions, shared_folder, union_all

SHINGLE = 5
LINE, WINDOW = 0, 1
KINDS = ("line", "passage")
#: Words of a window, a multiple of SHINGLE; shingles of which the least begins one.
PASSAGE, SPREAD = 25, 24
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
SEED = 11
CHARS_AT_ONCE = 1_000_000
#: Equal lines of a task have bands once, as long as the task remembers this many.
REMEMBERED = 500_000
#: Rows of a partition that a task holds at once, and nodes with so many paragraphs that they are joined by themselves.
AT_ONCE, HOT = 1_000_000, 10_000
MAX_BROADCAST = 200_000
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def constants() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each run of five words; none of fewer words."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        out = mixed(out + h[k : k + len(out)] * np.uint64(2 * k + 3))
    return out


class Words:
    """The words of texts in order: lower-cased bytes, number of their text, first and end code point and line number in it."""

    def __init__(self, texts: list[str]):
        bodies = [t.encode() for t in texts]
        # A line ends between two texts, so that no line has words of both.
        body = b"\n".join(bodies)
        self.words = body.lower().split()
        data = np.frombuffer(body, np.uint8)
        inside = np.r_[False, (data != 32) & ((data < 9) | (data > 13)), False]
        first, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        begins = np.cumsum([0, *(len(b) + 1 for b in bodies)])[:-1]
        self.text = np.searchsorted(begins, first, "right") - 1
        points, lines = np.r_[0, np.cumsum((data & 0xC0) != 0x80)], np.flatnonzero(data == 10)
        self.start, self.end = points[first] - points[begins][self.text], points[end] - points[begins][self.text]
        line = np.searchsorted(lines, first)
        self.line = line - np.searchsorted(lines, begins)[self.text]
        #: First word of each line with words, and the number of words after all.
        self.lines = np.flatnonzero(np.r_[True, line[1:] != line[:-1], True]) if len(first) else np.zeros(1, np.int64)
        #: First word of each text, and the number of words after all.
        self.texts = np.searchsorted(self.text, np.arange(len(texts) + 1))


def rolled(x: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) of each ``width`` values in a row, by doubling."""
    size, out = 1, x
    while 2 * size <= width:
        out = least(out[:-size], out[size:])
        size *= 2
    return least(out[: len(x) - width + 1], out[width - size :]) if size < width else out


def anchors(x: np.ndarray, n_words: int, text: np.ndarray | None = None) -> np.ndarray:
    """Where windows begin: at shingles that are the least of SPREAD in a row, with PASSAGE words from there on. ``text``,
    the number of each word's text, keeps both within a text."""
    if len(x) < SPREAD:
        return np.zeros(0, np.int64)
    least, none = rolled(x, SPREAD, np.minimum), np.zeros(SPREAD - 1, np.uint64)
    if text is not None:
        least[text[-len(least) :] != text[: len(least)]] = 0
    at = np.flatnonzero(rolled(np.concatenate([none, least, none]), SPREAD, np.maximum) == x)
    at = at[at + PASSAGE <= n_words]
    return at if text is None else at[text[at + PASSAGE - 1] == text[at]]


def node_of(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), LINE)


PARAGRAPH = "kind int, node long, rid long, tag long, paragraph int, word int, start long, end long, n_words int, bands array<bigint>"


def measured(batches):
    """Each line, with the key of its minima in each band (none if an equal line of the task has them), and each window."""
    factors, offsets = constants()
    seen: set[int] = set()

    def banded(sets: list[np.ndarray]) -> np.ndarray:
        keys = np.zeros((len(sets), BANDS), np.uint64)
        if sets:
            x, cuts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
            minima = np.stack([np.minimum.reduceat((x ^ b) * a, cuts) for a, b in zip(factors, offsets, strict=True)], axis=1)
            for row in range(ROWS):
                keys = mixed(keys + minima[:, row::ROWS] * np.uint64(2 * row + 3))
            keys = mixed(keys + np.arange(BANDS, dtype=np.uint64))
        return keys

    def flush(held):
        rids, tags, texts = zip(*held, strict=True)
        w = Words(texts)
        x = shingles(w.words)
        first, end = w.lines[:-1], w.lines[1:]
        nodes, has, sets = [], [], []
        for i, j in zip(first.tolist(), end.tolist(), strict=True):
            nodes.append(node := node_of(w.words[i:j]))
            has.append(fresh := j - i >= SHINGLE and node not in seen)
            if fresh:
                seen.add(node)
                sets.append(x[i : j - SHINGLE + 1])
        if len(seen) > REMEMBERED:
            seen.clear()
        at = anchors(x, len(w.words), w.text)
        windows = np.full(len(at), WINDOW, np.uint64)
        for k in range(0, PASSAGE, SHINGLE):
            windows = mixed(windows + x[at + k] * np.uint64(2 * k + 3))
        has += [False] * len(at)
        begin, last = np.r_[first, at], np.r_[end, at + PASSAGE] - 1
        text = w.text[begin]
        kind, node = np.repeat([LINE, WINDOW], [len(first), len(at)]), np.r_[np.array(nodes, np.uint64), windows]
        rest = np.array(rids, np.int64)[text], np.array(tags, np.int64)[text], w.line[begin], begin - w.texts[text], w.start[begin], w.end[last], last - begin + 1
        ends = np.concatenate([[0], np.cumsum(np.array(has, bool) * BANDS)])
        bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(banded(sets).reshape(-1).view(np.int64)))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        arrays = [pa.array(kind, pa.int32()), pa.array(node.view(np.int64)), *[pa.array(v.astype(np.int64), pa.int64()).cast(t) for v, t in zip(rest, types, strict=True)], bands]
        return pa.RecordBatch.from_arrays(arrays, names=["kind", "node", "rid", "tag", "paragraph", "word", "start", "end", "n_words", "bands"])

    held, size = [], 0
    for batch in batches:
        for rid, tag, value in zip(batch.column("rid").to_pylist(), batch.column("tag").to_pylist(), batch.column("text"), strict=True):
            if text := value.as_py():
                held.append((rid, tag, text))
                size += len(text)
                if size >= CHARS_AT_ONCE:
                    yield flush(held)
                    held, size = [], 0
    if held:
        yield flush(held)


def collided(batches):
    """``group``, ``node`` and ``pivot`` (the least node) of the groups of two or more nodes that share a band's key."""
    parts = [(np.asarray(b.column("band")), np.asarray(b.column("node"))) for b in batches if b.num_rows]
    if not parts:
        return
    band, node = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort([node, band])
    band, node = band[order], node[order]
    new = np.r_[True, (band[1:] != band[:-1]) | (node[1:] != node[:-1])]
    band, node = band[new], node[new]
    starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
    sizes = np.diff(np.r_[starts, len(band)])
    # A group is named by its members, so that those of several bands coincide.
    names = mixed(np.add.reduceat(mixed(node.view(np.uint64)), starts) + sizes.astype(np.uint64))
    many = np.repeat(sizes > 1, sizes)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, sizes)[many].view(np.int64)), pa.array(node[many]), pa.array(np.repeat(node[starts], sizes)[many])], names=["group", "node", "pivot"])


def sets_of(batches):
    """``node`` and ``shingles`` (distinct, sorted) of the lines listed with each text by their first code points."""
    for batch in batches:
        nodes, words, cuts = [], [], [0]
        for value, listed in zip(batch.column("text"), batch.column("listed"), strict=True):
            text = value.as_py() or ""
            for x in listed.as_py():
                end = text.find("\n", x["start"])
                words += text[x["start"] : end if end >= 0 else len(text)].encode().lower().split()
                nodes.append(x["node"])
                cuts.append(len(words))
        h = shingles(words)
        sets = [np.unique(h[i : j - SHINGLE + 1]).view(np.int64) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        ends = np.cumsum([0, *map(len, sets)])
        values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], names=["node", "shingles"])


def compared(batches):
    """``a``, ``b`` and ``linked`` of each pair, by the similarity of their sets ``x`` and ``y``."""
    for batch in batches:
        (xs, xe), (ys, ye) = ((np.asarray(c.offsets)[:-1], np.asarray(c.offsets)[1:]) for c in (batch.column("x"), batch.column("y")))
        x, y = np.asarray(batch.column("x").values), np.asarray(batch.column("y").values)
        linked = []
        for i in range(batch.num_rows):
            both = np.sort(np.concatenate([x[xs[i] : xe[i]], y[ys[i] : ye[i]]]))
            common = int((both[1:] == both[:-1]).sum())
            linked.append(common >= SIMILARITY * (len(both) - common) - 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def similar(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between nodes of a group, by their exact similarity."""
    found, left = [], list(range(len(nodes)))
    sizes = np.array([len(s) for s in sets])
    while len(left) > 1:
        queue = [left.pop()]
        while queue and left:
            i = queue.pop()
            rest = np.array(left)
            values = np.concatenate([sets[j] for j in left])
            common = np.add.reduceat(np.isin(values, sets[i]), np.cumsum(sizes[rest]) - sizes[rest])
            # Similarity as a fraction of integers: common / (both - common) >= SIMILARITY.
            near = common >= SIMILARITY * (sizes[i] + sizes[rest] - common) - 1e-9
            for j in rest[near].tolist():
                found.append((int(nodes[i]), int(nodes[j])))
                queue.append(j)
            left = rest[~near].tolist()
    return found


def verified(batches):
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    table = pa.Table.from_batches(table)
    group, node, lists = np.asarray(table.column("group")), np.asarray(table.column("node")), table.column("shingles").combine_chunks()
    values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
    order = np.argsort(group, kind="stable")
    bounds = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1], True])
    links: list[tuple[int, int]] = []
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        rows = order[first:last]
        links += similar(node[rows], [values[offsets[i] : offsets[i + 1]] for i in rows])
    if links:
        a, b = zip(*links, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def spread(spark, rows: int) -> int:
    """Number of partitions so that a task holds AT_ONCE rows or less, hot keys aside."""
    return max(partitions(spark), -(-rows // AT_ONCE))


def verdicts(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a``, ``b``, ``linked`` of the pairs (a, its pivot b). A pivot of very many pairs is spread over several tasks."""
    hot = pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(F.col("b").alias("_b"), F.ceil(F.col("n") / HOT).alias("salts"))
    hot = bounded(hot, MAX_BROADCAST)
    pairs = pairs.join(hot, F.col("b") == F.col("_b"), "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), "salts"), F.lit(0)).alias("salt"))
    pivots = pairs.select("b").distinct().join(hot, F.col("b") == F.col("_b"), "left").select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    pivots = pivots.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(pivots, ["b", "salt"])
    return both.select("a", "b", "x", "y").mapInArrow(compared, "a long, b long, linked boolean")


def line_links(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """``a``, ``b``: links between nodes of lines, enough of them to join all that are linked."""
    spark = texts.sparkSession
    bands = lines.where(F.size("bands") > 0)
    n = spread(spark, BANDS * bands.count())
    groups = bands.select("node", F.explode("bands").alias("band")).repartition(n, "band").mapInArrow(collided, "group long, node long, pivot long").distinct()
    groups = materialise(groups)
    # The shingles of each node in a group, from one of its lines.
    nodes = bounded(groups.select("node").distinct(), MAX_BROADCAST)
    one = lines.where(F.col("n_words") >= SHINGLE).join(nodes, "node").groupBy("node").agg(F.min(F.struct("rid", "tag", "start")).alias("at"))
    listed = one.select("node", "at.*").groupBy("rid", "tag").agg(F.collect_list(F.struct("start", "node")).alias("listed"))
    sets = materialise(texts.join(listed, ["rid", "tag"]).mapInArrow(sets_of, "node long, shingles array<bigint>").dropDuplicates(["node"]))
    told = materialise(verdicts(groups.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), sets))
    failed = told.where(~F.col("linked")).select(F.col("a").alias("node"), F.col("b").alias("pivot"))
    left = groups.join(groups.join(failed, ["node", "pivot"]).select("group").distinct(), "group", "left_semi")
    left = materialise(left.select("group", "node"))
    others = left.join(sets, "node").select("group", "node", "shingles").repartition(spread(spark, 10 * left.count()), "group").mapInArrow(verified, "a long, b long")
    return told.where("linked").select("a", "b").unionByName(others)


def members(docs: DataFrame) -> DataFrame:
    """The paragraphs that have near-duplicates, the ``first`` of each one's cluster, and whether it is to be removed."""
    spark, place = docs.sparkSession, F.struct("rid", "tag", "start", "paragraph")
    texts = identified(docs).select("rid", "tag", "text")
    path = f"{shared_folder(spark)}/paragraphs-{uuid.uuid4().hex}"
    texts.mapInArrow(measured, PARAGRAPH).write.parquet(path)
    rows = spark.read.schema(PARAGRAPH).parquet(path)
    roots = connected_components(line_links(texts, rows.where(F.col("kind") == LINE)))
    nodes = rows.groupBy("kind", "node").agg(F.min(place).alias("least"), F.max(place).alias("greatest"), F.count("*").alias("n"))
    roots = bounded(roots.select(F.lit(LINE).alias("kind"), "node", "root"), MAX_BROADCAST)
    # A node by itself that occurs once has no near-duplicate and leaves before anything is joined to it.
    nodes = nodes.join(roots, ["kind", "node"], "left").where(F.col("root").isNotNull() | (F.col("least") != F.col("greatest")))
    nodes = materialise(nodes.withColumn("root", F.coalesce("root", "node")))
    firsts = nodes.groupBy("kind", "root").agg(F.min("least").alias("first"), F.max("greatest").alias("last")).where(F.col("first") != F.col("last"))
    named = materialise(nodes.join(firsts, ["kind", "root"]).select("kind", "node", "first", "n"))
    narrow = rows.drop("bands")
    # Nodes of very many paragraphs are few; the others' paragraphs meet theirs in a shuffled join.
    often = bounded(named.where(F.col("n") > HOT).drop("n"), MAX_BROADCAST)
    out = narrow.join(often, ["kind", "node"]).unionByName(narrow.join(named.where(F.col("n") <= HOT).drop("n"), ["kind", "node"]))
    return out.withColumn("removed", place != F.col("first"))


def outward(text: str, at: int, side: int) -> list[tuple[int, int, bytes]]:
    """(start, end, lower-cased word) of the SPREAD - 1 words outward of the window that begins at ``at``, nearest first."""
    n, size = SPREAD - 1 + (PASSAGE if side else 0), 512
    while True:
        first, last = (at, min(len(text), at + size)) if side else (max(0, at - size), at)
        found = list(WORD.finditer(text, first, last))
        # A word at the chunk's far end may be cut, unless the text ends there.
        found = found[: len(found) - (last < len(text))] if side else found[first > 0 :][::-1]
        if len(found) >= n or (last == len(text) if side else first == 0):
            return [(m.start(), m.end(), m[0].encode().lower()) for m in found[PASSAGE if side else 0 : n]]
        size *= 4


def beside(batches):
    """What stands beside the windows listed with each text: left of those of side 0, right of those of side 1, the next
    SPREAD - 1 words outward, as hashes of all words so far; of own windows also where each begins or ends, and its line."""
    names = ["node", "side", "own", "rid", "tag", "at", "hashes", "points", "lines"]
    for batch in batches:
        rows = []
        for rid, tag, value, listed in zip(batch.column("rid").to_pylist(), batch.column("tag").to_pylist(), batch.column("text"), batch.column("listed"), strict=True):
            text = value.as_py() or ""
            for x in listed.as_py():
                side, at = x["side"], x["at"]
                words = outward(text, at, side)
                digest, hashes = xxhash.xxh3_64(), []
                for _, _, word in words:
                    digest.update(word + b" ")
                    hashes.append((digest.intdigest() & 0xFFFFFFFF) - 0x80000000)
                points = [end if side else start for start, end, _ in words] if x["own"] else None
                lines = None
                if x["own"] and side == 0:
                    line = text.count("\n", 0, at)
                    lines = [line - text.count("\n", start, at) for start, _, _ in words]
                rows.append((x["node"], side, x["own"], rid, tag, at, hashes, points, lines))
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        types = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int32())] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def widened(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """``passages`` that are to be removed, word by word as long as the first of their cluster goes on alike.

    An end of what two texts have in common is at most SPREAD - 1 words from its last window, so these are all. Words are
    compared by 32 bits of a hash of all so far. The window at an end, its node, leads to the first that has it."""
    ends = ((0, "head"), (1, "tail"))
    own = union_all([passages.select("rid", "tag", F.lit(side).alias("side"), F.col(f"{name}.start").alias("at"), F.col(f"{name}.node").alias("node"), F.lit(True).alias("own")) for side, name in ends])
    first = union_all([passages.select(F.col(f"{name}.first.rid").alias("rid"), F.col(f"{name}.first.tag").alias("tag"), F.lit(side).alias("side"), F.col(f"{name}.first.start").alias("at"), F.col(f"{name}.node").alias("node"), F.lit(False).alias("own")) for side, name in ends])
    listed = own.unionByName(first.distinct()).groupBy("rid", "tag").agg(F.collect_list(F.struct("node", "side", "own", "at")).alias("listed"))
    found = texts.join(bounded(listed, MAX_BROADCAST), ["rid", "tag"]).select("rid", "tag", "text", "listed")
    found = materialise(found.mapInArrow(beside, "node long, side int, own boolean, rid long, tag long, at int, hashes array<int>, points array<int>, lines array<int>"))
    other = found.where(~F.col("own")).select("node", "side", F.col("hashes").alias("other"))
    alike = F.size(F.filter(F.zip_with("hashes", "other", lambda x, y: x == y), lambda x: x))
    more = found.where("own").join(other, ["node", "side"]).withColumn("more", alike).where("more > 0")
    more = more.select("rid", "tag", "side", "at", "more", F.get("points", F.col("more") - 1).alias("point"), F.get("lines", F.col("more") - 1).alias("line"))
    # Rows equal in id and text were read, and answered, more than once.
    more = materialise(more.dropDuplicates(["rid", "tag", "side", "at"]))
    left = more.where("side = 0").select("rid", "tag", F.col("at").alias("_head"), F.col("more").alias("_more0"), F.col("point").alias("_point0"), F.col("line").alias("_line0"))
    right = more.where("side = 1").select("rid", "tag", F.col("at").alias("_tail"), F.col("more").alias("_more1"), F.col("point").alias("_point1"))
    out = passages.withColumns({"_head": F.col("head.start"), "_tail": F.col("tail.start")}).join(left, ["rid", "tag", "_head"], "left").join(right, ["rid", "tag", "_tail"], "left")
    n_words = F.col("n_words") + F.coalesce("_more0", F.lit(0)) + F.coalesce("_more1", F.lit(0))
    return out.withColumns({"start": F.coalesce("_point0", "start"), "end": F.coalesce("_point1", "end"), "paragraph": F.coalesce("_line0", "paragraph"), "n_words": n_words}).select(passages.columns)


def repeated(docs: DataFrame) -> DataFrame:
    """A row for each line or passage that has a near-duplicate: doc_id, kind, paragraph (number of its first line), start,
    end (code points), n_words, cluster_doc_id and cluster_paragraph (the first of its cluster) and removed (false for
    the first)."""
    rows = members(docs)
    lines = rows.where(F.col("kind") == LINE).select("kind", "rid", "tag", "paragraph", "start", "end", "n_words", "first", "removed").distinct()
    ordered = Window.partitionBy("rid", "tag").orderBy("start")
    goes = F.struct("removed", "first.rid", "first.tag")
    windows = rows.where(F.col("kind") == WINDOW).select("kind", "node", "rid", "tag", "paragraph", "word", "start", "end", "n_words", "first", "removed").distinct()
    new = F.coalesce((F.lag("end").over(ordered) < F.col("start")) | (F.lag(goes).over(ordered) != goes), F.lit(True))
    windows = windows.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(ordered))
    n_words = (F.max(F.col("word") + F.col("n_words")) - F.min("word")).alias("n_words")
    at = F.struct("word", "start", "node", "first")
    passages = windows.groupBy("kind", "rid", "tag", "island").agg(
        F.min("paragraph").alias("paragraph"), F.min("start").alias("start"), F.max("end").alias("end"), n_words, F.min("first").alias("first"), F.max("removed").alias("removed"), F.min(at).alias("head"), F.max(at).alias("tail")).drop("island")
    passages = materialise(passages)
    passages = passages.where(~F.col("removed")).unionByName(widened(identified(docs).select("rid", "tag", "text"), passages.where("removed"))).drop("head", "tail")
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return lines.unionByName(passages).select(
        known("rid").alias("doc_id"), F.get(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("kind"), "paragraph", "start", "end", F.col("n_words").cast("long").alias("n_words"), known("first.rid").alias("cluster_doc_id"), F.col("first.paragraph").alias("cluster_paragraph"), "removed"
    )


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without what lies in ``spans`` (start, end; they may overlap), and without lines that have nothing left."""
    spans, k, at, out = sorted(spans), 0, 0, []
    for line in text.split("\n"):
        end, left, done = at + len(line), [], at
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        j = k
        while j < len(spans) and spans[j][0] < end:
            left.append(text[done : max(done, spans[j][0])])
            done = max(done, min(end, spans[j][1]))
            j += 1
        rest = "".join(left) + text[done:end]
        if rest.strip() or j == k:
            out.append(rest)
        at = end + 1
    return "\n".join(out)
