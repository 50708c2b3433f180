"""Merkle manifest of a dataset (operator 12): a content-addressed DAG of digests, with a proof for every row.

A row's leaf is the SHA-256 of its fields, each written with its length. The leaves of a source, in the order of doc_id,
are taken by runs of FAN; a run's node is the digest of its children's, and so on up to one node, the source's subroot.
Subroots, in the order of sources, make the root the same way. What is stored are records `digest -> children`, one for
each different digest: equal subtrees share theirs.

Proofs are read from these records alone. A request knows its rank, whose digits (base FAN) say which child to follow.
All requests descend from the root together, level by level: at each level the digests reached are joined to their
records, the children asked for are followed, and what stands left and right of them is added to the path. Requests
below one node share its path until they part, so a level has as many rows as nodes asked for, and none is hot. In the
last step a run's requests pick their own digit, and the path is reversed: from the leaf up.

Ranks come from a range partitioning by (source, doc_id, leaf): each partition is sorted, counted per source, and the
counts before it are added. So no source, however large, meets in one task, nor do all sources. Texts are read once and
never shuffled; digests are.

Nulls: a null field is written `-`, a null source or doc_id comes first. Rows equal in all fields are leaves each (their
proofs are equal in all but place, and they take each other's in any order). Of rows that share a doc_id the lesser leaf
is first. An empty table gives an empty result, a table of one row a root equal to its leaf, with an empty proof. Other
columns aren't read.
"""

from __future__ import annotations

import functools
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import MAX_TOTALS, bounded, materialise, partitions, union_all

FAN = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Rows whose id has a checksum that this divides are tampered with by the registered query.
EVERY = 5


def leaf(text: Column) -> Column:
    """The digest of a row's fields, with ``text`` for its text."""
    of = {name: F.col(name).cast("string") for name in FIELDS[:-1]} | {"text": text}
    written = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in of.values()]
    return F.sha2(F.concat(*written), 256)


def tampered_text() -> Column:
    """The text in lower case (A-Z) where EVERY divides the id's CRC-32, else as it is."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % EVERY == 0
    return F.when(F.coalesce(chosen, F.lit(False)), F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))


def tree_of(source: str = "source") -> Column:
    """A source as a key without nulls that keeps the order: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (with ``tree``), materialised, with ``rank`` from 0 in their tree by ``order`` and ``size`` of the tree."""
    n = partitions(nodes.sparkSession)
    at = nodes.repartitionByRange(n, "tree", *order).sortWithinPartitions("tree", *order)
    # A row's place in its sorted partition is what the generated id counts.
    at = materialise(at.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    of_part = at.groupBy("tree", "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    earlier, whole = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("tree")
    base = of_part.select("tree", "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_base"), F.sum("_rows").over(whole).alias("size"))
    found = at.join(bounded(base, MAX_TOTALS), ["tree", "_part"])
    return found.withColumn("rank", F.col("_place") + F.col("_base")).drop("_part", "_place", "_base")


def height(size: Column | str) -> Column:
    """Levels above the leaves of a tree of so many leaves."""
    size = F.col(size) if isinstance(size, str) else size
    return functools.reduce(Column.__add__, [(size > FAN**k).cast("int") for k in range(15)])


@dataclass
class Forest:
    """Trees over ranked leaves: ``records[k]`` has ``digest`` and ``children`` of level k + 1, ``roots`` has ``tree``, ``digest`` and ``height``."""

    records: list[DataFrame]
    roots: DataFrame


def built(leaves: DataFrame) -> Forest:
    """The forest of ``tree``, ``rank``, ``digest``, ``height`` rows, level by level; each level is a sixteenth of the last."""
    level, records, roots = leaves.select("tree", "rank", "digest", "height"), [], []
    top = leaves.agg(F.max("height")).first()[0] or 0
    for k in range(top + 1):
        roots.append(level.where(F.col("height") == k).select("tree", "digest", "height"))
        if k == top:
            break
        runs = level.where(F.col("height") > k).groupBy("tree", F.expr(f"rank DIV {FAN}").alias("rank"), "height")
        runs = runs.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda c: c["digest"]).alias("children"))
        runs = materialise(runs.withColumn("digest", F.sha2(F.array_join("children", ""), 256)))
        records.append(runs.select("digest", "children").dropDuplicates(["digest"]))
        level = runs.drop("children")
    return Forest(records, union_all(roots))


def _segment(children: Column, digit: Column) -> Column:
    """What stands left and right of a child."""
    return F.struct(F.array_join(F.slice(children, 1, digit), "").alias("left"), F.array_join(F.slice(children, digit + 2, FAN), "").alias("right"))


def descended(forest: Forest, tops: DataFrame, wanted: DataFrame, last: int) -> DataFrame:
    """From each tree's root in ``tops`` (tree, digest, height, path, and other columns) down to level ``last`` (or the
    root's, if that is lower) of all nodes that ``wanted`` (tree, rank of a leaf) passes; ``rank`` is the node's own."""
    reached = {}
    for k in range(len(forest.records), last - 1, -1):
        start = tops.where(F.col("height") == k if k > last else F.col("height") <= last).withColumn("rank", F.lit(0).cast("long"))
        here = start.unionByName(reached[k + 1]) if k + 1 in reached else start
        if k == last:
            return here
        asked = wanted.select("tree", F.expr(f"rank DIV {FAN ** (k - 1)}").alias("_next")).distinct()
        asked = asked.withColumns({"rank": F.expr(f"_next DIV {FAN}"), "_digit": (F.col("_next") % FAN).cast("int")})
        step = here.join(forest.records[k - 1], "digest").join(asked, ["tree", "rank"])
        step = step.withColumns({"path": F.concat("path", F.array(_segment(F.col("children"), F.col("_digit")))), "digest": F.col("children")[F.col("_digit")], "rank": F.col("_next")})
        reached[k] = step.select(start.columns)
    return tops.withColumn("rank", F.lit(0).cast("long"))


@dataclass
class Manifest:
    """``leaves`` (tree, rank, digest, height and the columns given), the forest of the sources and the tree of subroots."""

    leaves: DataFrame
    sources: Forest
    above: Forest
    subroots: DataFrame

    @property
    def root(self) -> DataFrame:
        """One row with the root's ``digest``; none for an empty table."""
        return self.above.roots.select("digest")

    @property
    def records(self) -> DataFrame:
        """All ``digest``, ``children`` records, each digest once."""
        stored = [*self.sources.records, *self.above.records]
        return union_all(stored).dropDuplicates(["digest"]) if stored else self.root.select("digest", F.array("digest").alias("children")).limit(0)


def manifest(rows: DataFrame, also: list[str] = ()) -> Manifest:
    """The manifest of ``rows``: ``doc_id``, ``source``, ``leaf`` and the columns ``also``, which the leaves keep."""
    leaves = ranked(rows.select("doc_id", tree_of().alias("tree"), F.col("leaf").alias("digest"), *also), ["doc_id", "digest"])
    leaves = leaves.withColumn("height", height("size")).drop("size")
    sources = built(leaves)
    subroots = sources.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.col("height").alias("own"))
    subroots = ranked(subroots, ["name"]).withColumn("height", height("size")).drop("size")
    return Manifest(leaves, sources, built(subroots), subroots)


def proven(made: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (``tree``, ``rank`` and other columns) with ``subroot``, ``root`` and ``path``: structs of what stands
    ``left`` and ``right`` at each level, from the leaf up. Only nodes that a request passes are visited."""
    names = requests.select(F.col("tree").alias("name")).distinct()
    asked = made.subroots.join(names, "name", "left_semi")
    nothing = F.array().cast("array<struct<left: string, right: string>>")
    top = made.above.roots.select("tree", "digest", "height", F.col("digest").alias("root"), nothing.alias("path"))
    tops = descended(made.above, top, asked.select("tree", "rank"), 0)
    tops = tops.drop("height", "tree").join(asked.select("rank", F.col("name").alias("tree"), F.col("own").alias("height")), "rank").drop("rank")
    runs = descended(made.sources, tops.withColumn("subroot", F.col("digest")), requests.select("tree", "rank"), 1)
    # A run's requests pick their own digit; the lone leaf of a source has no run.
    if made.sources.records:
        runs = runs.join(made.sources.records[0], "digest", "left")
    else:
        runs = runs.withColumn("children", F.lit(None).cast("array<string>"))
    runs = runs.select("tree", F.col("rank").alias("_run"), "root", "subroot", F.col("path").alias("_path"), "children")
    here = requests.withColumn("_run", F.expr(f"rank DIV {FAN}")).join(runs, ["tree", "_run"])
    own = F.when(F.col("children").isNotNull(), F.array(_segment(F.col("children"), (F.col("rank") % FAN).cast("int")))).otherwise(nothing)
    return here.withColumn("path", F.concat(own, F.reverse("_path"))).drop("_run", "_path", "children")


def folded(digest: str | Column, path: str = "path") -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, F.col(digest) if isinstance(digest, str) else digest, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def verified(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its leaf, subroot, root, the digest of its proof, and the root that its leaf folds to after
    tampering: ``verified`` says whether that is the root still."""
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), leaf(tampered_text()).alias("found"))
    made = manifest(rows, ["found"])
    found = proven(made, made.leaves.select("tree", "rank", "doc_id", F.col("digest").alias("leaf"), "found"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    found = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded("found").alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
