"""Secret scans: patterns, and a randomness test battery under false-discovery control (operator 2).

Patterns give the base spans. Beside them, all runs of ``LEAST_RUN`` or more code characters that hold a digit and a
letter, values inside base spans included, are tested for randomness in the smallest usual encoding that has all their
characters: their symbols must be uniform over the alphabet (chi-squared over as many bins as the length bears), rise
and fall about the middle as chance does (runs test), and not follow each other (lag-1 correlation). The three p-values
are combined by Fisher's method; of true random strings the combined value is uniform, of words and numbers it is next
to zero.

Length-aware control: for each encoding and length class (powers of two) the values of the corpus's different runs are
counted in twentieths, so that a name that occurs often counts once. What is above one half shows how many random strings there are; whatever a class has above a cut beyond
their share counts as false. The lowest cut at which false ones are at most ``FDR`` of what is above holds for that
class. A class without such a cut, mostly since it is small, takes that of its length class over all encodings, else
that of all runs, else none. Only these counts (encodings x length classes x 20) meet on the driver. A run above its
cut is random; one that overlaps no base span is a span of its own, the others confirm the spans they are in.

Nulls: a null text is empty. Repeated ids and rows are judged one by one; an empty table gives an empty result; texts
are scanned whole, wherever they lie, in one pass; extra columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import as_long, materialise

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX, LEAST_RUN = 6, 20, 24, 12
RUN = re.compile(r"[A-Za-z0-9+/_-]{12,}")
DIGIT = re.compile(r"[0-9]")
BINS = 20
FDR = 0.1
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet to the largest.
ENCODINGS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
VALUES = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches in a text, sorted."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def coded(text: str) -> bool:
    """Whether a text has digits, as all runs that are tested have."""
    return DIGIT.search(text) is not None


def chi2_sf(x: float, df: int) -> float:
    """P(X > x) for X chi-squared with df degrees of freedom: the finite sums for even and for odd df."""
    half = x / 2
    if half > 700:
        return 0.0
    if df % 2 == 0:
        term = total = math.exp(-half)
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return min(1.0, total)
    total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range(1, (df - 1) // 2 + 1):
        total += term
        term *= half / (i + 0.5)
    return min(1.0, total)


def encoding_of(run: str) -> str | None:
    symbols = set(run)
    return next((name for name, values in VALUES.items() if symbols <= values.keys()), None)


def randomness(run: str, encoding: str) -> float:
    """Fisher's combination of the battery's p-values."""
    values, size, n = VALUES[encoding], len(ENCODINGS[encoding]), len(run)
    x = np.array([values[c] for c in run], np.int64)
    bins = max(2, min(size, n // 5))
    expected = np.bincount(np.arange(size) * bins // size, minlength=bins) * (n / size)
    seen = np.bincount(x * bins // size, minlength=bins)
    uniform = chi2_sf(float(((seen - expected) ** 2 / expected).sum()), bins - 1)
    above = x >= size // 2
    a = int(above.sum())
    b = n - a
    if a == 0 or b == 0 or x.min() == x.max():
        return 0.0
    runs = 1 + int((above[1:] != above[:-1]).sum())
    mean = 1 + 2 * a * b / n
    var = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    by_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 1.0
    c = x - x.mean()
    by_lag = math.erfc(abs(float((c[1:] * c[:-1]).sum() / (c * c).sum()) + 1 / n) * math.sqrt(n / 2))
    return chi2_sf(-2 * sum(math.log(max(p, 1e-300)) for p in (uniform, by_runs, by_lag)), 6)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    found = []
    for m in RUN.finditer(text):
        run, start, end = m[0], m.start(), m.end()
        if not (DIGIT.search(run) and any(c.isalpha() for c in run)):
            continue
        if (encoding := encoding_of(run)) is not None:
            own = not any(s < end and start < e for s, _, e in base)
            found.append({"start": start, "end": end, "own": own, "hash": as_long(xxhash.xxh64_intdigest(run)), "class": f"{encoding}:{len(run).bit_length()}", "p": randomness(run, encoding)})
    return found


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])
CANDIDATE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("own", T.BooleanType()), T.StructField("hash", T.LongType()), T.StructField("class", T.StringType()), T.StructField("p", T.DoubleType())])


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` (spans of patterns) and ``runs`` (tested runs) of each document."""
    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("base", T.ArrayType(SPAN)), T.StructField("runs", T.ArrayType(CANDIDATE))])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("own", pa.bool_()), ("hash", pa.int64()), ("class", pa.string()), ("p", pa.float64())]))

    def run(batches):
        for batch in batches:
            bases, runs = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                code = coded(text)
                base = base_spans(text)
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                runs.append(candidates(text, base) if code else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bases, span_type), pa.array(runs, run_type)], names=["doc_id", "base", "runs"])

    return rows.mapInArrow(run, schema)


def cut(bins: dict[int, int], fdr: float) -> float | None:
    """The lowest p-value above which at most ``fdr`` are false, from counts in twentieths; None if there is none."""
    above = [sum(n for b, n in bins.items() if b >= k) for k in range(BINS + 1)]
    for k in range(1, BINS // 2 + 1):
        random_share = above[BINS // 2] * (BINS - k) / (BINS / 2)
        if above[k] and (1 + max(0.0, above[k] - random_share)) / above[k] <= fdr:
            return k / BINS
    return None


def cuts(counts: dict[str, dict[int, int]], fdr: float = FDR) -> dict[str, float]:
    """For each class its cut, or that of its length class or of all; classes without any are left out."""
    pooled: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for name, bins in counts.items():
        for b, n in bins.items():
            for pool in (name, name.split(":")[1], ""):
                pooled[pool][b] += n
    limits = {pool: cut(bins, fdr) for pool, bins in pooled.items()}
    found = {}
    for name in counts:
        tried = [limits[pool] for pool in (name, name.split(":")[1], "") if limits[pool] is not None]
        if tried:
            found[name] = tried[0]
    return found


def secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """``doc_id``, ``base`` (spans of patterns), ``spans`` (all spans: start, kind, end), ``tested`` and ``random`` (runs
    that the battery has judged, and those that it calls random, in base spans or not) of each document."""
    found = materialise(scanned(docs))
    tested = found.select(F.explode("runs").alias("r")).select("r.hash", F.col("r.class").alias("name"), F.least(F.floor(F.col("r.p") * BINS), F.lit(BINS - 1)).alias("bin")).distinct().groupBy("name", "bin").count()
    counts: dict[str, dict[int, int]] = defaultdict(dict)
    for name, b, n in tested.collect():  # at most encodings x length classes x BINS rows
        counts[name][int(b)] = n
    limits = cuts(counts, fdr)

    def passes(r):
        ok = F.lit(False)
        for name, least in sorted(limits.items()):
            ok = ok | ((r["class"] == name) & (r["p"] >= least))
        return ok

    found = found.withColumn("random", F.filter("runs", passes))
    added = F.transform(F.filter("random", lambda r: r["own"]), lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"), F.size("runs").cast("long").alias("tested"), F.size("random").cast("long").alias("random"))


def joined(spans: str):
    """kind:start:end of each span, comma-joined, as a column."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: list[tuple[int, int]]) -> str:
    """A text with each span (start, end; they may overlap) replaced by a mark."""
    out, at = [], 0
    for start, end in sorted(spans):
        if end > at:
            out += [text[at : max(at, start)], "[secret]" if start >= at else ""]
            at = end
    return "".join(out) + text[at:]
