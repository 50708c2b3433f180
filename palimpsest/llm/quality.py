"""Quality rules whose cutoffs are certified on labelled holdouts (operator 1, DataFrame functions only).

Five ratios of a document (symbols, repeated words, repeated lines, capitals, exclamation marks), each over its nominal
value, make one score, the highest of them; a document is rejected if its score is above the cutoff of its stratum (the
language; null is a stratum of its own). A cutoff is used only if labelled good documents prove, by an exact binomial
test, that it falsely rejects at most ``ALPHA`` of the good ones of the stratum. The cutoffs are fixed beforehand.

Multiple testing: within a stratum the cutoffs are tested from the mildest to the strictest, up to the first that isn't
proven (fixed sequence, each at the stratum's whole error). The error ``DELTA`` is divided over the strata by Holm's rule:
a stratum whose every cutoff is proven hands its share to the rest. Hence, with probability 1 - DELTA, no stratum loses
more than ALPHA of its good documents to the rules. Among the proven cutoffs of a stratum, the one that rejects most
labelled bad documents is taken, each good one counting ``GOOD_WEIGHT`` bad ones.

Nulls: a null text has no words and fails the base rule. Labels with a null or repeated id: null ids match nothing, a
document with contradicting labels counts as good. Repeated rows are judged one by one; other columns pass unread.
An empty table gives an empty result, a stratum with too few labels has no cutoff and loses nothing to the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACE_CHARS, bounded, materialise

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Fraction of good documents of a stratum that a cutoff may reject; error probability of that promise.
ALPHA, DELTA = 0.1, 0.05
GOOD_WEIGHT = 10
#: Cutoffs of the score, from the mildest to the strictest.
CUTOFFS = [8.0, 6.0, 5.0, 4.0, 3.0, 2.5, 2.0, 1.5, 1.2, 1.0]
#: Ratios and their nominal values.
RULES = {
    "symbols": ("n_symbols / word_chars", 0.1),
    "repeats": ("n_repeat_words / n_words", 0.1),
    "lines": ("n_dup_lines / n_words", 0.03),
    "capitals": ("n_capitals / word_chars", 0.3),
    "exclaims": ("n_exclaims / word_chars", 0.01),
}
MAX_STRATA, MAX_BROADCAST = 10_000, 500_000


def count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of the base rules; each whole text is measured within its row, without a shuffle."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_words", F.split(F.btrim(body, F.lit(SPACE_CHARS)), r"[ \t\n\x0B\f\r]+"))
    df = df.withColumn("n_words", F.when(F.btrim(body, F.lit(SPACE_CHARS)) == "", 0).otherwise(F.size("_words")).cast("long"))
    df = df.withColumn("word_chars", F.length(F.translate(body, SPACE_CHARS, "")).cast("long"))
    df = df.withColumn("n_symbols", count_of(body, SYMBOLS)).withColumn("n_capitals", count_of(body, CAPITALS)).withColumn("n_exclaims", count_of(body, "!"))
    df = df.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # A window of words is known by its 64-bit hash; only texts with a hash found twice sort theirs.
    hashes = F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]))
    df = df.withColumn("_hashes", F.when(F.size("_words") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    once = F.size("_hashes") == F.size(F.array_distinct("_hashes"))
    df = df.withColumn("_sorted", F.when(~once, F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter("_sorted", lambda e, j: ((j > 0) & (F.get("_sorted", j - 1)["h"] == e["h"])) | F.coalesce(F.get("_sorted", j + 1)["h"] == e["h"], F.lit(False)))
    df = df.withColumn("_starts", F.array_sort(F.transform(again, lambda e: e["i"])))
    covered = F.transform("_starts", lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1) - i, F.lit(WINDOW))).cast("long"))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long")))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return df.drop("_words", "_lines", "_hashes", "_sorted", "_starts")


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), exactly summed from the k-th term downwards; 1 for k at or above n p."""
    odds = p / (1 - p)
    log_last = F.aggregate(F.sequence(F.lit(0).cast("long"), k), n * F.log(F.lit(1 - p)), lambda a, i: a + F.when(i == 0, 0.0).otherwise(F.log((n - i + 1) / i * F.lit(odds))))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        i = k - j  # ratio of term i to term i + 1
        term = acc["term"] * (i + 1) / ((n - i) * F.lit(odds))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < n * p, F.exp(log_last) * F.aggregate(steps, start, add, lambda acc: acc["sum"])).otherwise(1.0)


def cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``stratum`` and ``cutoff`` of the strata with a certified one that rejects bad documents. Give materialised
    ``features``: they are read several times."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    held = features.where(~F.col("base_failed")).join(known, "doc_id")
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(c).alias("cutoff")) for i, c in enumerate(CUTOFFS)])
    long = held.select("stratum", "good", "score", F.explode(levels).alias("l"))
    over = F.col("score") > F.col("l.cutoff")
    counts = long.groupBy("stratum", "l.level", "l.cutoff").agg(
        F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("n"),
        F.sum(F.when((F.col("good") == 1) & over, 1).otherwise(0)).alias("k"),
        F.sum(F.when((F.col("good") != 1) & over, 1).otherwise(0)).alias("bad"),
    )
    tested = materialise(counts.withColumn("p", binomial_cdf(F.col("k"), F.col("n"), alpha)))
    # Holm: strata by their worst p-value, as long as each is proven at its share; a row a stratum.
    worst = tested.groupBy("stratum").agg(F.max("p").alias("worst"))
    by_worst = Window.orderBy("worst", "stratum")
    all_strata = by_worst.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.lit(delta) / (F.count("*").over(all_strata) - F.row_number().over(by_worst) + 1)
    ranked = worst.withColumn("n_strata", F.count("*").over(all_strata)).withColumn("ok", F.col("worst") <= share)
    ranked = ranked.withColumn("done", F.min("ok").over(by_worst.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("n_done", F.sum(F.col("done").cast("int")).over(all_strata))
    so_far = Window.partitionBy("stratum").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    proven = F.col("done") | (F.col("p") <= F.lit(delta) / (F.col("n_strata") - F.col("n_done")))
    gain = F.col("bad") - GOOD_WEIGHT * F.col("k")
    return (
        tested.join(ranked.select("stratum", "n_strata", "done", "n_done"), "stratum")
        .withColumn("proven", F.min(proven).over(so_far))
        .where("proven")
        .withColumn("gain", gain)
        .where("gain > 0")
        .groupBy("stratum")
        .agg(F.max_by("cutoff", F.struct("gain", "cutoff")).alias("cutoff"))
    )


def scored(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``stratum`` and ``text``) with the counts and the score."""
    df = measured(docs).drop("text")
    score = F.greatest(*[F.expr(ratio) / F.lit(nominal) for ratio, nominal in RULES.values()])
    return df.withColumn("score", F.when(F.col("n_words") > 0, score).otherwise(0.0))


def stratum() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null")).alias("stratum")


def verdict() -> Column:
    """True if neither the base rules nor the cutoff reject; one expression, so that it stays above the measures."""
    return F.when(F.col("base_failed"), F.lit(False)).otherwise(~F.coalesce(F.col("score") > F.col("cutoff"), F.lit(False)))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts and verdict for each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, score, and the cutoff of its stratum (null: none). The texts are read once; what is measured is
    narrow."""
    narrow = materialise(scored(docs.select("doc_id", stratum(), "text")))
    out = narrow.join(bounded(cutoffs(narrow, labels), MAX_STRATA), "stratum", "left").withColumn("kept", verdict())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "cutoff")


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, as they were. Only labelled documents are measured for the cutoffs; then
    all are where they lie, rather than shuffled to their verdicts: a filter without an exchange of texts."""
    known = bounded(labels.where("doc_id is not null and quality is not null").select("doc_id").distinct(), MAX_BROADCAST)
    narrow = materialise(scored(docs.join(known, "doc_id", "left_semi").select("doc_id", stratum(), "text")))
    limits = bounded(cutoffs(narrow, labels), MAX_STRATA)
    rows = scored(docs.select(F.struct("*").alias("_row"), stratum(), "text"))
    return rows.join(limits, "stratum", "left").where(verdict()).select("_row.*")
