import hashlib
import math
import random
import re
import string
from collections import Counter

from llm_cases import SF, documents
from pyspark.sql import functions as F

from palimpsest.llm import queries, secret_scan


def brute(text):
    found = []
    for kind, pattern, least in [
        ("assign", r"""(?i:(?a:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
        ("access", r"AKIA[A-Z0-9]+", 20),
        ("hex", r"[0-9a-f]+", 24),
    ]:
        for m in re.finditer(pattern, text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), ["assign", "access", "hex"].index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


def test_base_spans(spark, edge_docs, no_docs):
    extra = ["PassWord = 'abc+/=_.-1' api_key:zzzzzz apikey=12345", "password: token: abcdefgh", "é🙂 secret=ABCDEFG1 " + "0123456789abcdef" * 3, "tokenx=abcdefg token==abcdefg", "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "é"]
    more = spark.createDataFrame(list(enumerate(extra, 100)), "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").unionByName(more).unionByName(documents(spark).select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = Counter((r.doc_id, r.base) for r in secret_scan.secrets(docs).select("doc_id", secret_scan.joined("base").alias("base")).collect())
    assert got == Counter((r.doc_id, brute(r.text)) for r in docs.collect())
    for text in extra:
        assert ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in secret_scan.base_spans(text)) == brute(text)
    for r in documents(spark).collect():
        assert ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in secret_scan.base_spans(r.text)) == brute(r.text)
    assert secret_scan.secrets(no_docs).count() == 0
    assert secret_scan.secrets(edge_docs).count() == edge_docs.count()


def test_digest_columns(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op2_secret_battery(spark, str(tmp_path)).join(documents(spark), "doc_id").collect():
        base = brute(r.text)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(k) for k in ("assign:", "access:", "hex:"))
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_counts_of_each_kind(spark, tmp_path):
    """Spans of one kind are counted for that kind alone, wherever they stand in their text."""
    key, run = "AKIA" + "B" * 16, "0123456789abcdef" * 2
    texts = ["token=abcdef", key, run, f"{run} {key} token=abcdef secret: 'ABCDEF'", f"token=abcdef {key} {run} {key}", "no span", None, "secret=short api_key=abcde", f"password=abcdef {run} {run} {run}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in queries.op2_secret_battery(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        base = brute(text)
        assert got[i] == (*(base.count(k) for k in ("assign:", "access:", "hex:")), hashlib.sha256(base.encode()).hexdigest())
    assert got[3][:3] == (2, 1, 1) and got[4][:3] == (1, 2, 1) and got[8][:3] == (1, 0, 3)


def test_chi_squared_tail_by_integration():
    for df in (1, 2, 5, 6, 15):
        for x in (0.5, 3.0, 20.0):
            steps = 100_000
            width = 120 / steps
            density = sum(math.exp((df / 2 - 1) * math.log(t) - t / 2) for t in (x + (i + 0.5) * width for i in range(steps))) * width
            assert abs(density / (2 ** (df / 2) * math.gamma(df / 2)) - secret_scan.chi2_sf(x, df)) < 1e-4


def test_battery_tells_random_from_made_up(spark):
    r = random.Random(4)
    keys = ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(400)]
    plain = ["-".join(r.choice(["river", "stone", "cloud", "ember"]) for _ in range(7)) + f"-{r.randrange(9)}" for _ in range(400)]
    plain += ["2024010" + str(r.randrange(10)) * 25 + "abc" for _ in range(300)]
    docs = spark.createDataFrame([(i, f"see {t} now") for i, t in enumerate(keys + plain)], "doc_id long, text string")
    found = {x.doc_id for x in secret_scan.secrets(docs).where("exists(spans, s -> s.kind = 3)").collect()}
    hit, false = sum(i < 400 for i in found), sum(i >= 400 for i in found)
    assert hit > 300 and false <= 0.15 * len(found)


def test_secrets_without_keywords_are_added(spark):
    """Random keys of several encodings and lengths among prose with numbers, versions and dates; few keys, pooled."""
    r = random.Random(8)
    keys, rows = {}, []
    for i in range(600):
        words = [r.choice(["river", "stone", "build-2024-11-28", "v1.2.3-rc4", "chapter12section7", "2024-11-28T06-56-36", "a1a1a1a1a1a1a1"]) for _ in range(40)]
        if i % 10 == 0:
            alphabet, n = [(string.ascii_letters + string.digits, 32), (string.digits + "ABCDEF", 40), (string.ascii_lowercase + string.digits, 24)][i // 10 % 3]
            keys[i] = "".join(r.choice(alphabet) for _ in range(n))
            words.insert(r.randrange(40), keys[i])
        rows.append((i, " ".join(words)))
    found = {x.doc_id: x.spans for x in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    named = {texts[i][s.start : s.end] for i, spans in found.items() for s in spans if s.kind == 3}
    assert len(named & set(keys.values())) >= 0.85 * len(keys) and len(named - set(keys.values())) <= 0.15 * len(named)


def test_values_of_the_tables_reach_the_battery(spark):
    found = queries.op2_secret_battery(spark, SF.replace("0.001", "0.1")).agg(F.sum("n_tested"), F.sum("n_random")).first()
    assert found[0] >= 10 and found[1] >= 0.7 * found[0]


def test_redaction():
    assert secret_scan.redacted("a key here", [(2, 5)]) == "a [secret] here"
    assert secret_scan.redacted("abcdef", [(1, 4), (2, 5)]) == "a[secret]f"
