import math
import re
from collections import Counter

import duckdb
import pytest
from llm_cases import SF, documents
from pyspark.sql import functions as F

from palimpsest.llm import quality, queries, sql


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(repeated), n < 10 or 100 * len(repeated) > 20 * n


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 0), (1, None, 0), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for docs in (edge_docs, documents(spark)):
        got = Counter((r.doc_id, *[r[c] for c in COLUMNS]) for r in quality.judged(docs, labels).collect())
        assert got == Counter((r.doc_id, *base(r.text)) for r in docs.collect())
    assert quality.judged(no_docs, labels.limit(0)).count() == 0
    kept = quality.passing(edge_docs, labels)
    assert kept.columns == edge_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in edge_docs.collect() if not base(r.text)[-1])


def test_repeats_overlap(spark):
    texts = ["a b c d e f a b c d e", "a a a a a a a", "a b c d e x a b c d e y a b c d e", "1 2 3 4 5 6 7 8 9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_repeat_words for r in quality.measured(docs).orderBy("doc_id").collect()] == [base(t)[4] for t in texts]


def tail(k, n, p):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def test_binomial_tail(spark):
    cases = [(0, 50, 0.1), (3, 80, 0.05), (9, 1000, 0.01), (0, 5, 0.01), (40, 5000, 0.01), (500, 60_000, 0.01)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == pytest.approx(tail(k, n, p), rel=1e-6)


def test_cutoffs_are_proven_and_spare_good_documents(spark):
    """Enough labels in one stratum, too few in the other."""
    good = " ".join(f"plain{i} word{i}" for i in range(20))
    junk = " ".join(f"w{i}%%%##" for i in range(40))
    rows = [(i, good + f" {i}", "en") for i in range(2000)] + [(2000 + i, junk + f" {i}", "en") for i in range(200)]
    rows += [(3000 + i, good + f" {i}", "de") for i in range(20)] + [(3100 + i, junk + f" {i}", "de") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.when(F.col("text").contains("%"), 0).otherwise(1).alias("quality"))
    kept = {r.doc_id: r.kept for r in quality.judged(docs, labels).collect()}
    assert all(kept[i] for i in range(2000)) and not any(kept[2000 + i] for i in range(200))
    assert all(kept[i] for i in kept if i >= 3000)


def holm(tails, delta):
    """Cutoffs proven per stratum by the step-down rule, told plainly."""
    left, share = {s: list(p) for s, p in tails.items()}, len(tails)
    for s in sorted(left, key=lambda s: (max(left[s]), s)):
        if max(left[s]) > delta / share:
            break
        share -= 1
        left[s] = [0.0] * len(left[s])
    return {s: next((i for i, p in enumerate(ps) if p and p > delta / share), len(ps)) for s, ps in left.items()}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sql_agrees(spark, sf):
    con, folder = duckdb.connect(), SF.replace("0.001", sf)
    for name in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    got = queries.op1_quality_rules(spark, folder)
    rows = con.sql(sql.QUALITY)
    order = lambda x: (x[0], str(x))
    found = sorted(map(tuple, got.select(*rows.columns).collect()), key=order)
    assert found == sorted(rows.fetchall(), key=order)
    # Some hundred labels certify cutoffs, and these reject documents that the base rules keep.
    assert sf == "0.001" or sum(r[-1] is not None for r in found) > len(found) / 2 < sum(not r[6] and not r[7] for r in found) * 100


def score(text):
    n, chars, symbols, lines, repeats, _ = base(text)
    capitals, exclaims = sum("A" <= c <= "Z" for c in text or ""), (text or "").count("!")
    return max(symbols / chars / 0.1, repeats / n / 0.1, lines / n / 0.03, capitals / chars / 0.3, exclaims / chars / 0.01) if n else 0.0


def plainly_kept(rows, labels):
    """Whether each of the rows (doc_id, text, lang) is kept, by the rule told plainly; labels: (doc_id, quality)."""
    good = {}
    for d, q in labels:
        if d is not None and q is not None:
            good[d] = max(q, good.get(d, 0))
    held = {}
    for d, text, lang in rows:
        if d in good and not base(text)[-1]:
            held.setdefault(lang, []).append((score(text), good[d]))
    over = lambda s, c, g: sum(x > c for x, q in held[s] if (q == 1) == g)
    sizes = {s: sum(q == 1 for _, q in x) for s, x in held.items()}
    tails = {s: [tail(over(s, c, True), sizes[s], quality.ALPHA) if over(s, c, True) < sizes[s] * quality.ALPHA else 1.0 for c in quality.CUTOFFS] for s in held}
    cut = {}
    for s, k in holm({f"={s}": p for s, p in tails.items()}, quality.DELTA).items():
        gains = [(over(s[1:], c, False) - quality.GOOD_WEIGHT * over(s[1:], c, True), c) for c in quality.CUTOFFS[:k]]
        if gains and max(gains)[0] > 0:
            cut[s[1:]] = max(gains)[1]
    return [not base(text)[-1] and not (lang in cut and score(text) > cut[lang]) for _, text, lang in rows]


def test_verdicts_against_the_plain_rule(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want = dict(zip([r[0] for r in rows], plainly_kept(rows, [(r.doc_id, r.quality) for r in labels.collect()]), strict=True))
    assert {r.doc_id: r.kept for r in quality.judged(docs, labels).collect()} == want
    assert Counter(r.doc_id for r in quality.passing(docs, labels).collect()) == Counter(d for d, ok in want.items() if ok)


def test_error_is_divided_over_strata(spark):
    """Strata of many sizes and false rejections against the plain step-down rule."""
    sizes = {"a": (400, 5), "b": (45, 0), "c": (35, 0), "d": (30, 0), "e": (60, 6)}
    rows, n = [], 0
    for lang, (good, over) in sizes.items():
        for i in range(good):
            score = (i % 4 + 1) * 1.3 if i < over else 0.0
            rows.append((n, f"={lang}", False, score, 1))
            n += 1
        rows += [(n + i, f"={lang}", False, 9.0, 0) for i in range(20)]
        n += 20
    features = spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean, score double, quality int")
    tails = {f"={s}": [tail(sum((i % 4 + 1) * 1.3 > c for i in range(over)), good, quality.ALPHA) for c in quality.CUTOFFS] for s, (good, over) in sizes.items()}
    proven = holm(tails, quality.DELTA)
    got = {r.stratum: r.cutoff for r in quality.cutoffs(features.drop("quality"), features.select("doc_id", "quality")).collect()}
    assert set(got) == {s for s, k in proven.items() if k} and len(got) >= 2
    assert all(quality.CUTOFFS.index(c) < proven[s] for s, c in got.items())
