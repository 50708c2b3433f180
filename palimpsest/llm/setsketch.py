"""MinHash near-duplicates by SetSketch registers (operator 13).

A document's set holds its distinct two-word shingles (lower-cased in ASCII); a document of one word has that word. Two
documents are linked if their sets have a Jaccard similarity of SIMILARITY percent or more, and equal sets are one node.

A sketch has REGISTERS registers. Each is the minimum over the set of exponential values of rate RATE (one hash of the
shingle per register), on a scale of powers of BASE, truncated: floor(1 - log_BASE(minimum)), from 0 to LIMIT + 1. So the
register of a union is the greater of the two, which `merged` does and which long texts use, piece by piece; and equal
registers tell of common elements, at similarity 0.8 with a probability of 0.8. ROWS registers in a row make a band. At
similarity 0.8 two sets differ in all bands with probability (1 - 0.8^4)^32, below 0.0000001. Sets that agree in a band
share a bucket.

Links are found in two steps, and each link is confirmed on the full sets (sorted 64-bit hashes of all shingles):

1. In each bucket every member is compared with one pivot, its least node. Pairs are first judged by their registers: the
   numbers of registers that are greater, less and equal, and the exact sizes, have a likelihood for each similarity. Where
   the best one is e^DOUBT times likelier than the asked one, the pair goes. A bucket whose members are all in one component
   after that is settled; so a group of close copies, however large, costs as many comparisons as it has members.
2. What is left are buckets of members of several components (the pivot's own pairs are decided). They are gathered by
   clusters of members that share a bucket, each set once. A cluster is cut into blocks, and a task compares two blocks; two
   blocks of the cluster's largest component aren't compared. Clusters of more than MAX_BLOCKS blocks go by buckets instead
   of clusters, cut in the same way. So no group meets in one task and no pair that shares a bucket is lost; members that
   belong to no component, times the members of their bucket, are what this costs.

Of the links in a task a spanning forest leaves it. Components over all of them give the classes.

Nulls: a null or text without words has an empty set (n_shingles 0), linked with nothing. A null doc_id never names a
component unless all its ids are null (then null, and kept). Rows that repeat a doc_id are rows of their own texts; equal
texts are linked. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import NULL_ID, bounded, connected_components, materialise, partitions

SHINGLE, SEED = 2, 7
SIMILARITY = 80
REGISTERS, ROWS = 128, 4
BASE, RATE, LIMIT = 1.01, 20.0, (1 << 16) - 2
#: Log-likelihood by which a pair may fall behind before it goes without a look at its sets; about one in 10^8 linked pairs does.
DOUBT = 16
#: Members of a block and blocks of a cluster; nodes of a table that may travel to all executors; bytes of sets a task.
BLOCK, MAX_BLOCKS, MAX_NODES, TASK_BYTES = 512, 64, 200_000, 32 << 20
#: Elements hashed at once, and shared shingles compared at once.
PIECE, COLUMNS = 256, 8192


_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (2, REGISTERS), dtype=np.uint64)
#: Of the hash of each register.
FACTORS, OFFSETS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1]
    parts = {joined[s:e] for s, e in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)}
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(p, SEED) for p in parts), dtype=np.uint64, count=len(parts)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set: exponentially spaced, truncated minima, merged piece by piece."""
    out = np.zeros(REGISTERS, np.uint16)
    for at in range(0, len(hashes), PIECE):
        low = (hashes[at : at + PIECE, None] * FACTORS + OFFSETS).min(axis=0)
        u = (low >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
        out = merged(out, np.clip(np.floor(1 - np.log(-np.log1p(-u) / RATE) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16))
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def log_likelihood(more: np.ndarray, less: np.ndarray, share: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Of a similarity, for numbers of registers that are greater and less in the first set, which has ``share`` of the
    sizes' sum."""
    scale = math.log(BASE)
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / scale, 1e-12, 1)
    first, second = p(share - (1 - share) * similarity), p(1 - share - share * similarity)
    return more * np.log(first) + less * np.log(second) + (REGISTERS - more - less) * np.log(np.clip(1 - first - second, 1e-12, 1))


def estimated(ku: np.ndarray, kv: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest similarity (on a grid of 0.01) of pairs of sketches, and how far the asked one falls behind."""
    more, less = (ku > kv).sum(axis=1), (ku < kv).sum(axis=1)
    share, most = nu / (nu + nv), np.minimum(nu, nv) / np.maximum(nu, nv)
    grid = np.linspace(0, 1, 101)[None, :] * most[:, None]
    each = log_likelihood(more[:, None], less[:, None], share[:, None], grid)
    best, asked = each.argmax(axis=1), log_likelihood(more, less, share, np.minimum(SIMILARITY / 100, most))
    return grid[np.arange(len(best)), best], each.max(axis=1) - asked


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``rid`` and ``tag`` (id and text hash), ``key`` (128-bit hash of the set), ``n`` (its size), ``sketch``."""
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("rid"), F.xxhash64("text").alias("tag"), "text")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            keys, sizes, sketches = [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                h = shingles(text.as_py() or b"")
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                sketches.append(registers(h).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "rid", "tag")), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "rid", "tag", "key", "n", "sketch"])

    return rows.mapInArrow(run, f"doc_id {kind}, rid long, tag long, key binary, n long, sketch binary")


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pivot``, ``node`` pairs that their registers don't rule out."""
    own = nodes.select("node", F.col("n").alias("nv"), F.col("sketch").alias("kv"))
    other = nodes.select(F.col("node").alias("pivot"), F.col("n").alias("nu"), F.col("sketch").alias("ku"))
    close = 100 * F.least("nu", "nv") >= SIMILARITY * F.greatest("nu", "nv")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                ku, kv = (np.frombuffer(b"".join(some.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("ku", "kv"))
                nu, nv = (np.asarray(some.column(c), dtype=np.float64) for c in ("nu", "nv"))
                best, behind = estimated(ku, kv, nu, nv)
                keep = pa.array((100 * best >= SIMILARITY) | (behind <= DOUBT))
                yield some.select(["pivot", "node"]).filter(keep)

    return pairs.join(own, "node").join(other, "pivot").where(close).select("pivot", "node", "ku", "kv", "nu", "nv").mapInArrow(run, "pivot long, node long")


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and ``hashes`` (its set) of ``nodes``: ``node``, ``rid`` and ``tag`` of a document that has it."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("rid"), F.xxhash64("text").alias("tag"), "text")

    def run(batches):
        for batch in batches:
            found = [shingles(x.as_py() or b"").tobytes() for x in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "hashes"])

    found = texts.join(bounded(nodes, MAX_NODES), ["rid", "tag"]).select("node", "text").mapInArrow(run, "node long, hashes binary")
    return found.dropDuplicates(["node"])


def forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what a symmetric matrix of links joins."""
    found, left = [], np.ones(len(link), bool)
    for start in range(len(link)):
        queue = [start] if left[start] else []
        left[start] = False
        while queue:
            x = queue.pop()
            near = np.flatnonzero(link[x] & left)
            left[near] = False
            found += [(x, int(y)) for y in near]
            queue += near.tolist()
    return found


def links_between(side: np.ndarray, hashes: list[bytes]) -> list[tuple[int, int]]:
    """A spanning forest of the links between left (side 0) and right (1) members, and those that are both (2)."""
    sets = [np.frombuffer(h, np.uint64) for h in hashes]
    sizes, tokens = np.array([len(s) for s in sets]), np.concatenate(sets)
    _, token, times = np.unique(tokens, return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(sets)), sizes), times[token] > 1
    # Only shingles of two members or more can be in common; they are numbered anew.
    number = np.cumsum(times > 1) - 1
    owner, token = owner[shared], number[token[shared]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    common = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
        some = slice(*np.searchsorted(token, [at, at + COLUMNS]))
        has = np.zeros((len(sets), COLUMNS), bool)
        has[owner[some], token[some] - at] = True
        bits = np.packbits(has, axis=1).view(np.uint64)
        right_bits = bits[right]
        for k, x in enumerate(left):
            common[k] += np.bitwise_count(right_bits & bits[x]).sum(axis=1, dtype=np.int64)
    near = 100 * common >= SIMILARITY * (sizes[left][:, None] + sizes[right][None, :] - common)
    link = np.zeros((len(sets), len(sets)), bool)
    link[np.ix_(left, right)] = near
    return forest(link | link.T)


def compared(groups: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """``a``, ``b``: links within the groups (``g``, ``part``) of ``node`` and ``side``, each confirmed on its full sets."""

    def told(nodes, sides, hashes):
        found = links_between(np.concatenate(sides), hashes)
        nodes = np.concatenate(nodes)
        a, b = (np.array([x[k] for x in found], dtype=np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

    def run(batches):
        open_group, nodes, sides, hashes = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            g, part, node, side = (np.asarray(batch.column(c)) for c in ("g", "part", "node", "side"))
            starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (part[1:] != part[:-1])])
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(g)], strict=True):
                if (g[start], part[start]) != open_group:
                    if len(hashes) > 1:
                        yield told(nodes, sides, hashes)
                    open_group, nodes, sides, hashes = (g[start], part[start]), [], [], []
                nodes.append(node[start:end])
                sides.append(side[start:end])
                hashes += batch.column("hashes").slice(start, end - start).to_pylist()
        if len(hashes) > 1:
            yield told(nodes, sides, hashes)

    rows = groups.join(sets, "node").repartition(n, "g", "part").sortWithinPartitions("g", "part")
    return rows.select("g", "part", "node", "side", "hashes").mapInArrow(run, "a long, b long")


def stars(pairs: DataFrame) -> DataFrame:
    """Groups of a pivot and BLOCK of its members, about."""
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = pairs.join(parts, "pivot").select(F.col("pivot").alias("g"), F.pmod(F.xxhash64("node"), "parts").alias("part"), "node", F.lit(1).alias("side"))
    return dealt.unionByName(parts.select(F.col("pivot").alias("g"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.col("pivot").alias("node"), F.lit(0).alias("side")))


def blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``g``, ``node``, ``comp`` rows with ``block``, ``mains`` and ``others``, the numbers of blocks: first those of the
    group's largest component; and the number of blocks per group."""
    of_comp = members.groupBy("g", "comp").agg(F.count("*").alias("rows"))
    most = of_comp.groupBy("g").agg(F.max(F.struct("rows", "comp")).alias("main"), F.sum("rows").alias("rows"))
    sizes = most.select("g", F.col("main.comp").alias("main"), F.ceil(F.col("main.rows") / BLOCK).alias("mains"), F.ceil((F.col("rows") - F.col("main.rows")) / BLOCK).alias("others"))
    hashed = F.xxhash64("node")
    block = F.when(F.col("comp") == F.col("main"), F.pmod(hashed, "mains")).otherwise(F.col("mains") + F.pmod(hashed, F.greatest("others", F.lit(1))))
    return members.join(sizes, "g").withColumn("block", block).drop("main"), sizes


def block_pairs(dealt: DataFrame) -> DataFrame:
    """Groups of each two blocks, a block with itself too, but none of two blocks of the largest component."""
    partners = F.expr("filter(sequence(0L, mains + others - 1), x -> x >= mains OR block >= mains)")
    each = dealt.select("g", "node", "block", (F.col("mains") + F.col("others")).alias("width"), F.explode(partners).alias("other"))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return each.select("g", (F.least("block", "other") * F.col("width") + F.greatest("block", "other")).alias("part"), "node", side.alias("side"))


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a``, ``b``: links between ``nodes`` (node, n, sketch, rid, tag) whose components are those of all links."""
    spark = docs.sparkSession
    width = 2 * ROWS
    bands = [F.xxhash64(F.lit(k), F.substring("sketch", k * width + 1, width)) for k in range(REGISTERS // ROWS)]
    rows = nodes.select(F.explode(F.array(*bands)).alias("bucket"), "node")
    # Buckets with the same members are one.
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("pivot"), F.bit_xor(F.xxhash64("node")).alias("same")).where("size > 1")
    shared = bounded(shared.groupBy("size", "pivot", "same").agg(F.min("bucket").alias("bucket")).drop("same"), MAX_NODES)
    members = materialise(rows.join(shared, "bucket").where("node <> pivot"))
    pairs = materialise(likely(members.select("pivot", "node").distinct(), nodes))
    in_need = pairs.select("node").union(pairs.select("pivot")).unionByName(members.where("size > 2").select("node")).distinct()
    sets = materialise(sets_of(docs, nodes.join(in_need, "node", "left_semi").select("node", "rid", "tag")))
    n = max(partitions(spark), math.ceil((sets.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) / TASK_BYTES))
    found = materialise(compared(stars(pairs), sets, n))
    comps = materialise(connected_components(found))
    # What is still open: buckets of members of more than one component.
    left = members.where("size > 2").select("bucket", "node").join(comps, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("comp"))
    still = left.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.min("node").alias("hub")).where("least < most").select("bucket", "hub")
    left = materialise(left.join(still, "bucket"))
    cluster = connected_components(left.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    whole = left.select("node", "comp").distinct().join(cluster, "node").select(F.col("root").alias("g"), "node", "comp")
    dealt, sizes = blocks(whole)
    small = F.col("mains") + F.col("others") <= MAX_BLOCKS
    groups = block_pairs(dealt.where(small))
    large = sizes.where(~small).select("g")
    if not large.isEmpty():
        of_bucket = left.join(cluster.join(large, cluster["root"] == large["g"]).select("node"), "node", "left_semi")
        groups = groups.unionByName(block_pairs(blocks(of_bucket.select(F.col("bucket").alias("g"), "node", "comp"))[0]))
    tree = comps.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return tree.unionByName(compared(groups, sets, n))


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id reachable over links) and ``kept`` of each row."""
    rows = materialise(sketched(docs))
    nodes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.min(F.struct("rid", "tag")).alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = materialise(nodes.select("key", "first", "one.*", "n", "sketch").withColumn("node", F.monotonically_increasing_id()))
    roots = connected_components(links(docs, nodes.select("node", "n", "sketch", "rid", "tag")))
    rooted = nodes.join(roots, "node", "left").select("key", "first", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_key = rooted.join(named, "root").select("key", "component_id")
    found = rows.where("n > 0").join(by_key, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    found = found.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
