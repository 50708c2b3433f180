"""Text of memory records: cleaning, tokens, stems, key coordinates and the predicates of the read and write gates.

Every function takes and returns columns and stays within built-in expressions. Nulls give null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lists that decide what a gate lets through.
TRIVIAL = ["cześć", "czesc", "siema", "hej", "witaj", "hello", "hi", "dzięki", "dzieki", "super", "ok", "dobrze", "jasne", "thanks"]
CONTINUATION = ["kontynuuj", "kontynuacja", "dalej", "nastepny", "następny", "continue", "next", "more"]
CHURN = ["[user]", "[assistant]", "mission order", "### session", "traceback (most recent call last)", "conversation___user", "chciałbym, abyś", "test 1: test", "test aktywnego użycia"]
CHURN_KEYS = ["fact:conversation", "conversation___user", "conversation:"]
PERSISTENT = ["fact:", "rule:", "preference:", "constraint:", "config:", "system:", "user:", "hermes:", "prompt-", "mnemosyne:"]
PROTECTED = ["hermes:", "fact:", "prompt-", "mnemosyne:", "rule:", "preference:", "constraint:", "config:"]
NOT_PII = ["token", "tokens", "token_budget", "tokenizer", "max_tokens", "shared_secret"]
STEM_SUFFIXES = ["ach", "ami", "owi", "em", "om", "ow", "a", "e", "i", "o", "u"]
PROTECTED_ROOTS = [
    "node", "code", "cache", "base", "pipeline", "cookie", "zombie", "calorie", "movie", "rookie", "queue", "state", "engine", "scope", "table", "file",
    "rule", "mode", "core", "type", "gate", "route", "service", "database", "message", "trace", "interface", "profile", "storage", "source", "module",
    "time", "rate", "device", "price", "space", "phase", "case", "size", "line", "site", "side", "name", "guideline", "outline", "baseline", "timeline",
    "share", "software", "hardware", "client", "server", "cluster", "vector", "tensor",
]

RULE_PREFIXES = ["rule:", "user_rule:", "user:rule:", "preference:", "constraint:"]


def sanitised(text: Column) -> Column:
    """Without C0 (but tab, newline, return), C1 and zero-width characters."""
    return F.regexp_replace(text, "[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{7F}-\\x{9F}\\x{200B}-\\x{200D}\\x{FEFF}]", "")


def tokens(text: Column, least: int = 3) -> Column:
    """Lower-case runs of letters and digits of at least ``least`` characters; `_ : -` separate."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= least)


def stem(word: Column) -> Column:
    """Light stem: protected roots stay; diacritics folded (then y to i); the first fitting suffix goes."""
    low = F.lower(word)
    plain = F.translate(low, "ąćęłńóśźż", "acelnoszz")
    folded = F.when(plain != low, F.replace(plain, F.lit("y"), F.lit("i"))).otherwise(plain)
    cut = folded
    for suffix in reversed(STEM_SUFFIXES):
        fits = folded.endswith(suffix) & (F.length(folded) > len(suffix) + 2)
        cut = F.when(fits, folded.substr(F.lit(1), F.length(folded) - len(suffix))).otherwise(cut)
    return F.when(low.isin(PROTECTED_ROOTS) | plain.isin(PROTECTED_ROOTS), plain).when(folded.isin(PROTECTED_ROOTS), folded).otherwise(cut)


def bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", ""))


def is_trivial(text: Column) -> Column:
    """A greeting or thanks: a listed token alone or first, or one of the first two of at most four words."""
    clean = bare(text)
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    starts = F.exists(F.array(*map(F.lit, TRIVIAL)), lambda t: (clean == t) | clean.startswith(F.concat(t, F.lit(" "))))
    early = F.exists(F.slice(words, 1, 2), lambda w: w.isin(TRIVIAL)) & (F.size(words) <= 4)
    return starts | early


def is_continuation(text: Column) -> Column:
    clean = F.trim(F.lower(text))
    return F.exists(F.array(*map(F.lit, CONTINUATION)), lambda t: (clean == t) | clean.startswith(F.concat(t, F.lit(" "))))


def entities(text: Column) -> Column:
    """Keys with colons, then letters followed by digits, each once."""
    keys = F.regexp_extract_all(text, F.lit(r"\b[A-Za-z0-9_-]+:[A-Za-z0-9_:-]+\b"), F.lit(0))
    nodes = F.regexp_extract_all(text, F.lit(r"\b[A-Za-z]+[0-9]+\b"), F.lit(0))
    return F.array_distinct(F.concat(keys, nodes))


def is_symbolic(text: Column) -> Column:
    """An identifier rather than prose."""
    q = F.trim(text)
    mark = F.lit("[:_-]")
    words = F.split(q, r"\s+")
    single = ~q.contains(" ") & ((F.length(q) > 3) | F.regexp_like(q, mark))
    first = F.regexp_like(words[0], mark) & ~words[0].endswith(":")
    few = (F.size(words) <= 3) & ~q.contains("?") & F.regexp_like(q, mark)
    return (q != "") & (single | first | few)


def is_churn(key: Column, content: Column) -> Column:
    """Raw conversation, prompt noise or a traceback."""
    k, c = F.lower(key), F.lower(content)
    noise = F.exists(F.array(*map(F.lit, CHURN)), lambda x: k.contains(x) | c.contains(x))
    return noise | F.exists(F.array(*map(F.lit, CHURN_KEYS)), lambda x: k.startswith(x))


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: text.startswith(p))


def effective_session(key: Column, session_id: Column) -> Column:
    """Of a key: the id after `session:` or `session_`; global for persistent keys; else the record's session id."""
    low = F.lower(key)
    colon = F.split(key, ":")
    under = key.substr(F.lit(9), F.length(key))
    stamped = F.regexp_extract(key, r"(?i)^session_([0-9]{8}_[0-9]{6}_[a-f0-9]+)", 1)
    plain = F.split(key, "_", 3)
    session = F.when(key.contains(":"), F.split(under, ":")[0]).when(stamped != "", stamped).when(F.size(plain) >= 3, plain[1]).otherwise(under)
    return F.when(low.startswith("session:"), colon[1]).when(low.startswith("session_"), session).when(starts_with_any(low, PERSISTENT), F.lit("global")).otherwise(F.when(session_id != "", session_id))


def session_accessible(effective: Column, requested: Column) -> Column:
    """Shared records are open to all, the default session to the default one, others to their own session."""
    wanted = F.trim(F.replace(F.coalesce(requested, F.lit("")), F.lit("session_"), F.lit("")))
    own = F.trim(F.replace(effective, F.lit("session_"), F.lit("")))
    return F.when(effective.isNull() | (effective == "global"), True).when(own.isin("default", ""), wanted.isin("default", "")).otherwise((wanted != "") & (wanted == own))


# Patterns of personal data and secrets.
PII_MAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PII_NAMED = r"(?i)(?:\b|_)(api[-_\s]?key|password|client[-_\s]?secret|app[-_\s]?secret|bearer[-_\s]?token|secret[-_\s]?token|secret[-_\s]?key)(?:\b|_)"
PII_ASSIGNED = r"(?i)\bsecret\s*(?:\b|_)?\s*[:=]\s*\S"


def is_pii(text: Column) -> Column:
    low = F.lower(F.trim(text))
    found = F.regexp_like(text, F.lit(PII_MAIL)) | F.regexp_like(text, F.lit(PII_NAMED)) | F.regexp_like(text, F.lit(PII_ASSIGNED))
    return F.when(text.isNull() | (text == "") | low.isin(NOT_PII), False).otherwise((low == "secret") | found)


#: Fixed values, in this order: what is taken out of a free subject to leave its entity.
ROOT_STEPS = [
    (r"^(?:hermes:memory_md:|memory_md:|hermes:|kv:|fact:|sop::|sop:|rule:|preference:|constraint:)+", ""),
    (r"\bv[0-9]+(?:\.[0-9]+)*\b", " "),
    (r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[t ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?\b", " "),
    (r"\b[0-9]{1,2}\.[0-9]{1,2}(?:\.[0-9]{1,4})?\b", " "),
    (r"\b(?:final|release|tag|starego|nowy|nowa|nowe|wydanie|wydania)\b", " "),
    (r"\b(?:backup|plus|main|branch)\b", " "),
    (r"\b[a-z_][a-z0-9_]{1,30}=([0-9a-f]{7,40})\b", " "),
    (r"\b[0-9a-f]{7,40}\b", " "),
    (r"[\s(),=:/|+]+", " "),
]


def entity_root(subject: Column) -> Column:
    """The entity of a free subject, without transport prefixes, versions, dates, hashes and noise words."""
    out = F.lower(F.trim(F.coalesce(subject, F.lit(""))))
    for pattern, to in ROOT_STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def is_rule(subject: Column) -> Column:
    low = F.lower(subject)
    return starts_with_any(low, RULE_PREFIXES) | low.contains(":rule:")


def authority(subject: Column) -> Column:
    """Authority of a record's namespace, 30 to 110."""
    s = F.lower(subject)
    return (
        F.when(is_rule(subject), 110)
        .when(s.startswith("hermes:user_md:") | s.startswith("hermes:memory_md:"), 100)
        .when(s.startswith("mnemosyne:canonical_facts:"), 70)
        .when(s.startswith("mnemosyne:mnemosyne_working_memory:"), 30)
        .when(s.startswith("fact:"), 80)
        .when(s.startswith("database_") | ~s.contains(":"), 90)
        .otherwise(50)
    )


def veracity(source_type: Column) -> Column:
    s = F.lower(F.coalesce(source_type, F.lit("user_explicit")))
    return F.when(s == "user_explicit", 1.0).when(s == "tool_output", 0.85).when(s == "external_doc", 0.65).otherwise(0.5)


def estimated_tokens(subject: Column, body: Column) -> Column:
    """Tokens of a rendered record."""
    size = F.length(F.coalesce(subject, F.lit(""))) + F.least(F.length(F.coalesce(body, F.lit(""))), F.lit(1200)) + 5
    return F.greatest(F.lit(1), F.ceil(size / 3.5) + 1).cast("long")
