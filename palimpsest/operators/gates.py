"""Gates of the write and maintenance paths: which keys, entities, relations and inputs a store takes, keeps or drops.

Column functions give a flag or a reason for a row; DataFrame functions filter or mark tables. Nulls count as empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import is_pii, starts_with_any, stem

# Words that are no entities, questions and particles that are no subjects, and stems of such.
NOISE_ENTITIES = [
    "w", "z", "na", "do", "i", "o", "to", "nie", "się", "sie", "jest", "być", "byc", "dla", "oraz", "ale", "jak", "jaki", "jaka", "jakie", "gdzie",
    "kiedy", "czy", "że", "ze", "co", "po", "za", "od", "przez", "przy", "nad", "pod", "przed", "przecież", "przeciez", "ale_jak", "ma", "mam", "masz",
    "mają", "ten", "ta", "te", "tym", "tego", "tej", "tych", "tylko", "już", "juz", "jeszcze", "bardzo", "fact", "working", "working_fact",
    "stated_memory", "episodic_event", "canonical_spec", "set", "is_set", "implemented", "is_implemented", "true", "false", "none", "null", "user",
    "assistant", "conversation", "default", "unknown", "test", "ok",
]
NOISE_TOKENS = [
    "cztli", "czyli", "albo", "poniewaz", "ponieważ", "jakby", "oraz", "lecz", "wiec", "więc", "zeby", "żeby", "jezeli", "jeżeli", "jesli", "jeśli",
    "gdy", "wtedy", "dlaczego", "kiedy", "gdzie", "skad", "skąd", "dokad", "dokąd", "jak", "co", "kto", "czy", "oto", "otoz", "otóż", "takze", "także",
    "rowniez", "również", "chociaz", "chociaż", "choc", "choć", "jednak", "natomiast", "zatem", "przeciez", "przecież", "chyba", "moze", "może", "raczej",
    "tam", "tu", "tutaj", "teraz", "bądź", "badz", "ani", "zarówno", "zarowno", "aczkolwiek", "wszakże", "wszakze", "which", "what", "where", "when",
    "why", "how", "who", "whom", "whose", "that", "this", "these", "those", "then", "than", "thus", "also", "and", "or", "but", "so", "because",
    "although", "since", "unless", "either", "neither", "nor", "if", "whether", "well", "actually", "basically",
]
QUESTION_WORDS = [
    "jest", "są", "był", "była", "było", "byli", "będzie", "będą", "być", "gdzie", "kiedy", "dlaczego", "skąd", "dokąd", "jaki", "jaka", "jakie",
    "jakiego", "jakiej", "jakim", "jakich", "który", "która", "które", "którego", "czy", "oraz", "albo", "więc", "żeby", "gdyby", "gdybyś", "jeśli",
    "jeżeli", "mój", "moja", "moje", "moich", "moim", "twój", "twoja", "twoje", "twoich", "nasz", "nasza", "nasze", "naszych", "swój", "swoje", "swoich",
    "pamiętasz", "pamiętam", "wiadomo", "wiesz", "powiedz", "opisz", "wyjaśnij", "podaj", "pokaż", "znajdź", "sprawdź", "odnośnie", "dotyczące",
    "dotyczą", "kwestii", "temat", "ustalenia", "notatkach", "notatek",
]
QUESTION_STEMS = [
    "bic", "gdzi", "kied", "dlacz", "skad", "jak", "ktor", "gdibi", "jesl", "moj", "twoj", "nasz", "swoj", "wiado", "wiedz", "powie", "opic", "wyjas",
    "nie", "czy", "cz", "obecni", "wart", "ktori", "ktory", "z",
]
PROSE_PREDICATES = ["stated_memory", "raw_content", "documentation", "source_doc"]
BARE_ANSWERS = ["nie", "tak", "no", "yes", "true", "false", "ok"]
CONTROL_PREFIXES = ["sys:", "lock:", "checkpoint:"]


def valid_entity(name: Column) -> Column:
    """Whether a name may be a graph node: short, on one line, of seven words at most, no number and no noise word."""
    s = F.trim(F.coalesce(name, F.lit("")))
    low = F.btrim(F.lower(s), F.lit("._-:;,()[]{}\"' "))
    dump = F.regexp_like(s, F.lit(r"(?i)[\n\r]|<!--|\[user\]|\[conversation\]"))
    number = F.regexp_like(low, F.lit(r"^[0-9.]*[0-9][0-9.]*$"))
    return (F.length(s) <= 80) & ~dump & (low != "") & ~low.isin(NOISE_ENTITIES) & ~number & (F.size(F.split(low, r"\s+")) <= 7)


def discourse_subject(subject: Column) -> Column:
    """Whether a subject begins with a question word, a pronoun or a particle, so that it names no entity."""
    parts = F.filter(F.split(F.lower(F.trim(F.coalesce(subject, F.lit("")))), r"[-_\s]+"), lambda w: w != "")
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    return (first != "") & (first.isin(QUESTION_WORDS) | stem(first).isin(QUESTION_STEMS))


def speech_act(subject: Column, predicate: Column, value: Column) -> Column:
    """``conversational_turn`` for questions and talk about them, else ``epistemic_assertion``."""
    asks = F.coalesce(value, F.lit("")).contains("?") | F.coalesce(predicate, F.lit("")).contains("?")
    return F.when(discourse_subject(subject) | asks, "conversational_turn").otherwise("epistemic_assertion")


def grounding(key: Column, value: Column, has_relation: Column) -> Column:
    """Why a key is, or isn't, grounded: namespaced_entity and grounded are, all other reasons aren't."""
    k = F.trim(F.coalesce(key, F.lit("")))
    low = F.lower(k)
    digits = F.regexp_like(low, F.lit("^[0-9]+$"))
    spaced = F.regexp_like(k, F.lit("[:/.]")) & (F.length(F.split(k, ":")[0]) > 1)
    typo = F.exists(F.array(*[F.lit(w) for w in NOISE_TOKENS if len(w) >= 4]), lambda w: F.levenshtein(low, w) <= 1)
    answer = F.lower(F.btrim(F.trim(F.coalesce(value, F.lit(""))), F.lit("\"'"))).isin(BARE_ANSWERS)
    return (
        F.when(k == "", "empty_key")
        .when(spaced, "namespaced_entity")
        .when(low.isin(NOISE_TOKENS), "noise_token")
        .when((F.length(low) >= 4) & ~digits & typo, "noise_typo")
        .when((F.length(low) < 3) & ~digits, "short_token")
        .when(answer & ~has_relation, "bare_answer")
        .otherwise("grounded")
    )


def is_grounded(key: Column) -> Column:
    return grounding(key, F.lit(""), F.lit(True)).isin("namespaced_entity", "grounded")


def relations(triples: DataFrame) -> DataFrame:
    """The (subject, predicate, object) rows that may become edges: no prose, secrets, self loops or ungrounded ends."""
    s, p, o = (F.trim(c) for c in ("subject", "predicate", "object"))
    prose = F.lower(p).isin(PROSE_PREDICATES) | (F.length(o) - F.length(F.replace(o, F.lit(" "))) > 6) & F.regexp_like(o, F.lit("[.,;!?]"))
    secret = is_pii(F.col("subject")) | is_pii(F.col("predicate")) | is_pii(F.col("object"))
    return triples.where(~prose & ~secret & (s != o) & is_grounded(F.col("subject")) & is_grounded(F.col("object")))


def causal_adjacency(triples: DataFrame) -> DataFrame:
    """Edges along which effects may spread: no prose predicates and no secret ends."""
    return triples.where(~F.lower(F.trim("predicate")).isin(PROSE_PREDICATES) & ~is_pii(F.col("subject")) & ~is_pii(F.col("object")))


def may_set_state(is_state: Column, source_type: Column, promotion: Column) -> Column:
    """Whether a record may be written as a state variable: inferred ones only once arbitration has promoted them."""
    return is_state & ((source_type != "shadow_inference") | F.coalesce(promotion == "arbitration_promoted", F.lit(False)))


def active_candidates(facts: DataFrame) -> DataFrame:
    """What consolidation looks at: no control keys, nothing superseded, a text of three characters or more."""
    return facts.where(~starts_with_any(F.col("key"), CONTROL_PREFIXES) & ~F.col("superseded") & (F.length(F.trim("value")) >= 3))


def raw_chat(text: Column, least: int = 1024) -> Column:
    """Whether a value is a dumped conversation: long, with a turn's mark or two separating bars."""
    bars = F.size(F.split(text, r"\s\|\s")) - 1
    return (F.length(text) >= least) & (F.regexp_like(F.lower(text), F.lit(r"\[(user|assistant)\]|(^|\n)(user|assistant):")) | (bars >= 2))


def key_class(key: Column, keep: list[str], delete: list[str]) -> Column:
    """``keep`` for listed prefixes, ``delete`` for keys that match a glob (``*`` and ``?``), else ``unmatched``."""
    patterns = ["^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in g) + "$" for g in delete]
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.regexp_like(key, F.lit(p))
    return F.when(starts_with_any(key, keep), "keep").when(hit, "delete").otherwise("unmatched")


def purged(facts: DataFrame, exact: list[str], prefixes: list[str]) -> DataFrame:
    """``facts`` without probe keys: those listed, and those with a listed prefix."""
    return facts.where(~F.col("key").isin(exact) & ~starts_with_any(F.col("key"), prefixes))


def input_fault(key: Column, value: Column, longest_key: int = 256, longest: int = 10_000) -> Column:
    """Why an input is refused, or ``ok``: empty, a NUL, a way out of a folder, or too long."""
    k = F.coalesce(key, F.lit(""))
    return (
        F.when(F.trim(k) == "", "empty")
        .when(F.contains(k, F.lit("\0")) | F.contains(F.coalesce(value, F.lit("")), F.lit("\0")), "nul")
        .when(F.regexp_like(k, F.lit(r"(^|[/\\])\.\.([/\\]|$)")), "traversal")
        .when((F.length(k) > longest_key) | (F.length(F.coalesce(value, F.lit(""))) > longest), "too_long")
        .otherwise("ok")
    )


def tombstoned_entities(nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """``nodes`` with ``tombstoned``: the entity is marked; its edges are left as they are."""
    return nodes.join(marks.select("node").distinct().withColumn("_dead", F.lit(True)), "node", "left").withColumn("tombstoned", F.coalesce("_dead", F.lit(False))).drop("_dead")


def view_purge(views: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rows of derived views to purge: a listed prefix on key or subject, or superseded, each with the reason."""
    reason = F.when(starts_with_any(F.col("key"), prefixes), "key").when(starts_with_any(F.col("subject"), prefixes), "subject").when(F.col("superseded"), "tombstone")
    return views.withColumn("reason", reason).where("reason is not null")


def visible_points(points: DataFrame, session: str) -> DataFrame:
    """Vector points that a session may see: its own, shared ones, and those of no session. A filter on a column, so that
    it reaches the scan before any similarity is computed."""
    own = [session, f"session_{session}", "global", "hermes_persistent"]
    return points.where(F.col("session_id").isNull() | F.col("session_id").isin(own))
