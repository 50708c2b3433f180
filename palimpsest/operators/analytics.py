"""Aggregations over trajectories, observations, scores, vectors and replicas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.steps import counted, summed


def trajectories(steps: DataFrame) -> DataFrame:
    """Per (session, day): the ordered signature of tools, its length and success (no step named error)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "tool"))), lambda x: x["tool"])
    return steps.groupBy("session", "day").agg(ordered.alias("tools")).select("session", "day", F.array_join("tools", "->").alias("signature"), F.size("tools").alias("steps"), (~F.array_contains("tools", "error")).alias("success"))


def mined_procedures(runs: DataFrame, alpha: float = 1.0, success: float = 0.7, least: int = 2) -> DataFrame:
    """Signatures frequent enough (at least ``least`` and alpha x log2 of the sessions) and successful: procedures."""
    sessions = runs.agg(F.count_distinct("session").alias("_s"))
    floor = F.greatest(F.lit(least), F.ceil(alpha * F.log2(F.col("_s"))))
    found = runs.groupBy("signature").agg(F.count("*").alias("runs"), F.avg(F.col("success").cast("double")).alias("rate"))
    kept = found.join(F.broadcast(sessions)).where((F.col("runs") >= floor) & (F.col("rate") >= success))
    return kept.select("signature", "runs", F.round("rate", 6).alias("rate"), F.concat(F.lit("sop_"), F.substring(F.sha2("signature", 256), 1, 8)).alias("id"))


def distribution(values: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, population variance and deviation, least and greatest of a numeric parameter."""
    c = F.col(value)
    return values.groupBy(by).agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.var_pop(c), 4).alias("variance"), F.round(F.stddev_pop(c), 6).alias("deviation"), F.min(c).alias("least"), F.max(c).alias("greatest"))


#: Sums of rewards up to this are nothing but rounding.
NOTHING = 1e-9


def session_success(steps: DataFrame) -> DataFrame:
    """Success of a session: its mean reward and its last are not negative, or its total is positive. Rewards are added up
    in order of ``seq``, however rows are dealt, so that a total of zero has the same last bit everywhere."""
    so_far = F.sum("reward").over(Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last, total = F.max_by("reward", "seq"), F.max_by("_so_far", "seq")
    summed_up = steps.withColumn("_so_far", so_far).groupBy("session").agg(F.count("*").alias("steps"), total.alias("_total"), last.alias("_last"))
    good = ((F.col("_total") >= 0) & (F.col("_last") >= 0)) | (F.col("_total") > NOTHING)
    return summed_up.select("session", "steps", F.round("_total", 4).alias("total"), good.alias("success"))


def discrepancy(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Numeric expectations (name, expected) against observations (name, value): relative error and its level."""
    error = F.abs(F.col("value") - F.col("expected")) / F.greatest(F.abs("expected"), F.abs("value"), F.lit(1.0))
    joined = observed.join(expected, "name").withColumn("error", F.round(error, 6))
    level = F.when(F.col("error") <= 0.10, "none").when(F.col("error") <= 0.50, "moderate").otherwise("critical")
    return joined.withColumn("level", level)


def temperature(errors: DataFrame, successes: DataFrame, cooling: float = 0.75) -> DataFrame:
    """Per entity the mean squared error, cooled by each success."""
    hot = errors.groupBy("entity").agg(F.avg(F.col("error") * F.col("error")).alias("_t"))
    cool = successes.groupBy("entity").agg(F.count("*").alias("successes"))
    out = hot.join(cool, "entity", "left").withColumn("successes", F.coalesce("successes", F.lit(0)))
    return out.select("entity", "successes", F.round(F.col("_t") * F.pow(F.lit(cooling), F.col("successes")), 6).alias("temperature"))


def reputation(claims: DataFrame, trusted: float = 0.5) -> DataFrame:
    share = F.avg(F.col("valid").cast("double"))
    return claims.groupBy("peer").agg(F.count("*").alias("claims"), F.round(share, 6).alias("score"), (share >= trusted).alias("trusted"))


def duplicate_groups(facts: DataFrame) -> DataFrame:
    """Facts with the same content up to white space: hash, size and the key to keep (highest tier, newest, longest key)."""
    norm = F.trim(F.regexp_replace("value", r"\s+", " "))
    tier = F.when(F.col("key").startswith("rule:"), 3).when(F.col("key").startswith("fact:"), 2).otherwise(1)
    hashed = facts.select("key", F.sha2(norm, 256).alias("hash"), F.struct(tier.alias("tier"), "ts", F.length("key").alias("n"), "key").alias("order"))
    return hashed.groupBy("hash").agg(F.count("*").alias("size"), F.max("order").alias("keep")).where("size > 1").select("hash", "size", F.col("keep.key").alias("keep"))


def cluster_labels(docs: DataFrame, cluster: str, terms: DataFrame, k: int = 2) -> DataFrame:
    """The k terms of each cluster with the highest tf x ln(1 + N / (gf + 1)); ``terms``: cluster, term, tf."""
    overall = terms.groupBy("term").agg(F.sum("tf").alias("gf"))
    n = docs.agg(F.count("*").alias("_n"))
    scored = terms.join(overall, "term").join(F.broadcast(n)).withColumn("weight", F.round(F.col("tf") * F.log(1.0 + F.col("_n") / (F.col("gf") + 1)), 6))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.col("weight").desc(), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(cluster, "term", "weight", "rank")


def calibration_metrics(sample: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score, expected calibration error and area under the ROC curve of (score, label); one row."""
    p, y = F.col("score"), F.col("label").cast("double")
    brier = sample.agg(F.count("*").alias("n"), F.avg((p - y) * (p - y)).alias("brier"))
    binned = sample.withColumn("bin", F.least(F.floor(p * bins), F.lit(bins - 1))).groupBy("bin").agg(F.count("*").alias("k"), F.avg(y).alias("acc"), F.avg(p).alias("conf"))
    ece = binned.agg(F.sum(F.col("k") * F.abs(F.col("acc") - F.col("conf"))).alias("_e"))
    # Rank sums over distinct scores: ties share the mean rank, so one row a score is enough.
    by_score = sample.groupBy("score").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    auc = summed(by_score, "score", ["neg"]).withColumn("_w", F.col("pos") * (F.col("_before_neg") + 0.5 * F.col("neg"))).agg(F.sum("_w").alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    rows = F.broadcast(brier).join(F.broadcast(ece)).join(F.broadcast(auc))
    area = F.when((F.col("_p") == 0) | (F.col("_n") == 0), 1.0).otherwise(F.col("_u") / (F.col("_p") * F.col("_n")))
    return rows.select("n", F.round("brier", 6).alias("brier"), F.round(F.col("_e") / F.col("n"), 6).alias("ece"), F.round(area, 6).alias("auc"))


def threshold_search(sample: DataFrame, precision: float) -> DataFrame:
    """Over thresholds .05, .06, ... 1.10: counts, and the one with the least errors among those precise enough.

    Scores are counted by hundredth first, so the grid meets at most as many rows as it has steps.
    """
    grid = sample.sparkSession.range(5, 111).select(F.col("id").alias("step"))
    counts = sample.groupBy(F.floor(F.round(F.col("score") * 100, 6)).alias("h")).agg(F.sum(F.col("label")).alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    met = grid.join(F.broadcast(counts), F.col("h") >= F.col("step"), "left").groupBy("step").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    total = sample.agg(F.sum("label").alias("_p"))
    cost = met.join(F.broadcast(total)).withColumn("cost", F.col("fp") + F.col("_p") - F.col("tp"))
    ok = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")) > precision).otherwise(False)
    return cost.where(ok).orderBy("cost", F.col("tp").desc(), "step").limit(1).select((F.col("step") / 100.0).alias("threshold"), "tp", "fp", "cost")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 for a zero vector or vectors of different length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def six_places(x: np.ndarray) -> np.ndarray:
    """Rounds by scaling, halves away from zero, as ``scoring.scaled_round`` does."""
    scaled = x * 1e6
    whole = np.trunc(scaled)
    return (whole + np.where(np.abs(scaled - whole) >= 0.5, np.sign(scaled), 0.0)) / 1e6


#: Vectors of a block that meet others in one task, about, and rows of them that are multiplied at once.
MEET, TILE = 2_048, 256


def blocked_pairs(vectors: DataFrame, block: str, least: float, meet: int = MEET) -> DataFrame:
    """Pairs within a block with a cosine of at least ``least``, never all against all. Each block is dealt in parts of some
    ``meet`` vectors, and each two parts are multiplied in a task of their own, a tile at a time; pairs near enough are
    added up again in order, so that the last bit is that of ``cosine``."""
    known = vectors.where("vector is not null").where(F.forall("vector", lambda x: x.isNotNull())).select(F.col(block).alias("_block"), "id", "vector")
    sizes = counted(known.groupBy("_block").agg(F.ceil(F.count("*") / meet).cast("int").alias("_parts")))
    part = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")
    dealt = known.join(sizes, "_block").withColumn("p", part).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = dealt.select("_block", "id", "vector", "p", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"))
    types = {f.name: f.dataType.simpleString() for f in dealt.schema}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        if not len(rows):
            return
        kinds = rows.schema
        own, i, j = (rows.column(c).to_numpy() for c in ("p", "i", "j"))
        ids, lists = rows.column("id").to_numpy(), rows.column("vector").combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        sides = []
        for place in (i, j):
            side = {}
            for size in np.unique(lengths[own == place]):
                at = np.flatnonzero((own == place) & (lengths == size))
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
                square = np.zeros(len(at))
                for n in range(size):
                    square += x[:, n] * x[:, n]
                side[size] = ids[at], x, np.sqrt(square)
            sides.append(side)
        for size, (a, x, nx) in sides[0].items():
            for other, (b, y, ny) in sides[1].items():
                for at in range(0, len(a), TILE):
                    r = slice(at, at + TILE)
                    if size == other:
                        with np.errstate(divide="ignore", invalid="ignore"):
                            near = x[r] @ y.T / (nx[r, None] * ny)
                        near[nx[r, None] * ny == 0] = 0.0
                    else:
                        near = np.zeros((len(a[r]), len(b)))
                    # A part that meets itself has each pair twice. What isn't a number is greater than any, as in Spark.
                    ok = ~(near < least - 2e-6)
                    if i[0] == j[0]:
                        ok &= a[r, None] < b
                    left, right = np.nonzero(ok)
                    left += at
                    cos = np.zeros(len(left))
                    if size == other:
                        for n in range(size):
                            cos += x[left, n] * y[right, n]
                        norm = nx[left] * ny[right]
                        cos = np.where(norm == 0, 0.0, cos / np.where(norm == 0, 1.0, norm))
                    cos = six_places(cos)
                    kept = ~(cos < least)
                    one, two, cos = a[left[kept]], b[right[kept]], cos[kept]
                    if len(cos):
                        first = pa.repeat(rows.column("_block")[0], len(cos))
                        yield pa.RecordBatch.from_arrays([first, pa.array(np.where(one < two, one, two), kinds.field("id").type), pa.array(np.where(one < two, two, one), kinds.field("id").type), pa.array(cos)], names=[block, "a", "b", "cos"])

    return dealt.groupBy("_block", "i", "j").applyInArrow(pairs, f"`{block}` {types['_block']}, a {types['id']}, b {types['id']}, cos double")


#: Query vectors that travel to all vectors, and vectors of a part, about, where they are more.
MOST_ASKED, VECTORS_A_PART = 10_000, 50_000


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, least: float, block: int = 1_000) -> DataFrame:
    """The k nearest vectors (id, vector) of each query vector (query_id, query) with a cosine of at least ``least``, but
    for the one with its own id. Up to MOST_ASKED queries travel to the vectors in blocks of ``block``; each task
    multiplies them with its vectors and hands on its best k of each, so that vectors stay where they lie. More of them
    are dealt in blocks, and each block meets each part of the vectors in a task of its own. Vectors of another length
    than the query's, and those of zeros, are no hits."""
    if queries.limit(MOST_ASKED + 1).count() > MOST_ASKED:
        return top_of_each(paired(queries.where("query is not null"), vectors, k, least, block), k)
    asked = sorted((r.query_id, r.query) for r in queries.select("query_id", "query").where("query is not null").toLocalIterator())
    found = [nearest(asked[at : at + block], vectors, k, least) for at in range(0, len(asked), block)] or [nearest([], vectors, k, least)]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return top_of_each(out, k)


def top_of_each(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cos").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "cos", "rank")


def paired(queries: DataFrame, vectors: DataFrame, k: int, least: float, block: int) -> DataFrame:
    """``query_id``, ``id`` and ``cos`` of the best k of each query in each part of the vectors."""
    spark = queries.sparkSession
    n = max(1, -(-queries.count() // block))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // VECTORS_A_PART))
    every = lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "query", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("b"), every(parts, "p"))
    known = vectors.where("vector is not null").select(F.col("id").cast("long").alias("id"), "vector", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("p"), every(n, "b"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        a, b = (list(zip(t.column(x).to_pylist(), t.column(y).to_pylist(), strict=True)) for t, x, y in ((left, "query_id", "query"), (right, "id", "vector")))
        for size in {len(v) for _, v in a}:
            some, others = [x for x in a if len(x[1]) == size], [x for x in b if len(x[1]) == size]
            if not others:
                continue
            ids = np.array([i for i, _ in others], np.int64)
            cosines = np.round(unit(np.array([v for _, v in some], np.float64)) @ unit(np.array([v for _, v in others], np.float64)).T, 6)
            for (name, _), row in zip(some, cosines, strict=True):
                ok = np.flatnonzero((row >= least) & (ids != name))
                ok = ok[np.lexsort([ids[ok], -row[ok]])[:k]]
                out += [(name, int(ids[i]), float(row[i])) for i in ok]
        q, i, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "cos": pa.array(c, pa.float64())})

    return asked.groupBy("b", "p").cogroup(known.groupBy("b", "p")).applyInArrow(best, "query_id long, id long, cos double")


def nearest(asked: list, vectors: DataFrame, k: int, least: float) -> DataFrame:
    """``query_id``, ``id`` and ``cos`` of the best k vectors of each query in each partition."""
    size = len(asked[0][1]) if asked else 0
    same = [(q, v) for q, v in asked if len(v) == size]
    names = np.array([q for q, _ in same], np.int64)
    matrix = unit(np.array([v for _, v in same], np.float64).reshape(len(same), size))
    shared = vectors.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches):
        names, matrix = shared.value
        kept = [(np.zeros(0), np.zeros(0, np.int64))] * len(names)
        for batch in batches:
            rows = [(i, v) for i, v in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist(), strict=True) if v is not None and len(v) == matrix.shape[1]]
            if not rows:
                continue
            ids = np.array([i for i, _ in rows], np.int64)
            cosines = np.round(matrix @ unit(np.array([v for _, v in rows], np.float64)).T, 6)
            for n, name in enumerate(names):
                ok = (cosines[n] >= least) & (ids != name)
                c, i = np.concatenate([kept[n][0], cosines[n][ok]]), np.concatenate([kept[n][1], ids[ok]])
                order = np.lexsort([i, -c])[:k]
                kept[n] = c[order], i[order]
        if len(names) and sum(len(c) for c, _ in kept):
            counts = [len(c) for c, _ in kept]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, counts)), pa.array(np.concatenate([i for _, i in kept])), pa.array(np.concatenate([c for c, _ in kept]))], names=["query_id", "id", "cos"])

    return vectors.select(F.col("id").cast("long"), "vector").mapInArrow(run, "query_id long, id long, cos double")


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; zeros stay zeros."""
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def lww_merge(adds: DataFrame, removes: DataFrame) -> DataFrame:
    """Last-writer-wins set of replicas: per element the dominant add and remove (information, clock, time, node), and
    whether it is present; ties favour the add."""
    order = F.struct(F.round("info", 6).alias("info"), "clock", "ts", "node")
    a = adds.groupBy("element").agg(F.max(order).alias("a"))
    r = removes.groupBy("element").agg(F.max(order).alias("r"))
    return a.join(r, "element", "full").select("element", (F.col("a").isNotNull() & (F.col("r").isNull() | (F.col("a") >= F.col("r")))).alias("present"), F.col("a.node").alias("added_by"), F.col("r.node").alias("removed_by"))


def clock_relation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two vector clocks (doc, node, count): before, after, equal or concurrent, and the merged total."""
    both = a.select("doc", "node", F.col("count").alias("x")).join(b.select("doc", "node", F.col("count").alias("y")), ["doc", "node"], "full")
    x, y = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    agg = both.groupBy("doc").agg(F.bool_and(x <= y).alias("le"), F.bool_and(x >= y).alias("ge"), F.sum(F.greatest(x, y)).alias("merged"))
    return agg.select("doc", F.when(F.col("le") & F.col("ge"), "equal").when(F.col("le"), "before").when(F.col("ge"), "after").otherwise("concurrent").alias("relation"), "merged")


def arbitrated(pairs: DataFrame, margin: float = 0.05) -> DataFrame:
    """Which of two claims stands: information (precision x confidence) beyond a margin, then newer, then as confident."""
    precision = lambda c: F.when(c == "user_explicit", 2.5).when(c == "tool_output", 1.5).when(c == "external_doc", 1.2).otherwise(1.0)
    new, old = precision(F.col("new_source")) * F.col("new_conf"), precision(F.col("old_source")) * F.col("old_conf")
    wins = F.when(new > old + margin, True).when(old > new + margin, False).when(F.col("new_ts") != F.col("old_ts"), F.col("new_ts") > F.col("old_ts")).otherwise(F.col("new_conf") >= F.col("old_conf"))
    return pairs.withColumn("new_wins", wins)


def compacted(turns: DataFrame, every: int = 8, shown: int = 4) -> DataFrame:
    """Windows of ``every`` turns: the first ``shown`` of them, whole, and how many more there are."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    df = turns.withColumn("window", F.floor(n / every)).withColumn("_line", F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "_line"))), lambda x: x["_line"])
    out = df.groupBy("conv_id", "window").agg(lines.alias("lines"))
    return out.select("conv_id", "window", F.array_join(F.slice("lines", 1, shown), "\n").alias("summary"), F.greatest(F.size("lines") - shown, F.lit(0)).alias("omitted"))
