"""DuckDB SQL with the results of the registered queries that SQL can express."""

from palimpsest.llm import decontam, divergence, merkle, quality

_LEVELS = ", ".join(f"({i}, CAST({c} AS DOUBLE))" for i, c in enumerate(quality.CUTOFFS))
_SCORE = "greatest(" + ", ".join(f"CAST({e.split(' / ')[0]} AS DOUBLE) / {e.split(' / ')[1]} / CAST({v} AS DOUBLE)" for e, v in quality.RULES.values()) + ")"
_P, _DELTA = f"CAST({quality.ALPHA} AS DOUBLE)", f"CAST({quality.DELTA} AS DOUBLE)"
_ODDS = f"(({_P}) / (1 - {_P}))"

#: One pass: counts in each text; labelled scores over every cutoff; exact binomial tail; Holm over strata; first failure ends.
QUALITY = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, 'null') AS stratum, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT rid, i, w[i:i + {quality.WINDOW - 1}] AS win FROM words, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS t(i) WHERE len(w) >= {quality.WINDOW}),
repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM repeated, unnest(range(0, {quality.WINDOW})) AS t(k) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
duplicate_lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
counts AS (
  SELECT d.rid, d.doc_id, d.stratum, CAST(len(w.w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    length(regexp_replace(d.text, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(d.text, '[^!]', '', 'g')) AS n_exclaims,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(w.w) < {quality.MIN_WORDS} OR 100 * coalesce(c.n, 0) > {quality.MAX_REPEAT_PERCENT} * len(w.w) AS base_failed
  FROM docs d JOIN words w USING (rid) LEFT JOIN duplicate_lines l USING (rid) LEFT JOIN covered c USING (rid)),
scores AS (SELECT *, CASE WHEN n_words > 0 THEN {_SCORE} ELSE 0 END AS score FROM counts),
good AS (SELECT doc_id, max(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
levels AS (SELECT * FROM (VALUES {_LEVELS}) AS t(level, cutoff)),
tallies AS (
  SELECT stratum, level, cutoff, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND score > cutoff) AS k, count(*) FILTER (good <> 1 AND score > cutoff) AS bad
  FROM scores JOIN good USING (doc_id), levels WHERE NOT base_failed GROUP BY ALL),
tails AS (
  SELECT *, CASE WHEN k < n * ({_P}) THEN list_sum(list_transform(range(0, k + 1), lambda j: exp(
      n * ln(1 - {_P}) + coalesce(list_sum(list_transform(range(1, j + 1), lambda i: ln(CAST(n - i + 1 AS DOUBLE) / i * {_ODDS}))), 0)))) ELSE 1 END AS p
  FROM tallies),
worst AS (SELECT stratum, max(p) AS worst, count(*) OVER () AS m FROM tails GROUP BY stratum),
ranked AS (SELECT *, worst <= {_DELTA} / (m - row_number() OVER (ORDER BY worst, stratum) + 1) AS ok FROM worst),
done AS (SELECT *, bool_and(ok) OVER (ORDER BY worst, stratum) AS done FROM ranked),
shares AS (SELECT stratum, done, m - count(*) FILTER (done) OVER () AS others FROM done),
proven AS (
  SELECT *, bool_and(done OR p <= {_DELTA} / others) OVER (PARTITION BY stratum ORDER BY level) AS ok
  FROM tails JOIN shares USING (stratum)),
best AS (
  SELECT stratum, cutoff FROM proven WHERE ok AND bad - {quality.GOOD_WEIGHT} * k > 0
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY bad - {quality.GOOD_WEIGHT} * k DESC, cutoff DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(score > cutoff, FALSE) AS kept, cutoff
FROM scores LEFT JOIN best USING (stratum)
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{decontam.UPPER}', '{decontam.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_N = decontam.WINDOW

#: All windows of documents joined to all windows of items; the words inside those found are counted once.
DECONTAMINATION = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, w[i:i + {_N - 1}] AS win FROM items, unnest(range(1, greatest(len(w) - {_N - 2}, 2))) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT len(win) AS n FROM wins),
found AS (
  SELECT rid, i, n, item_id
  FROM (SELECT rid, i, n, w[i:i + n - 1] AS win FROM docs, lengths, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n) JOIN wins USING (win)),
hits AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS t(k) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{decontam.UPPER}', '{decontam.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
_SHARE = f"1 + ({{}} + 1)::HUGEINT * {divergence.SCALE} // ({{}} + v)"

#: Every group against every kept term of its language, zero counts too; then every two sources over all of them.
DIVERGENCE = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
words AS (SELECT rid, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS of_lang FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= {divergence.MIN_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
langs AS (SELECT lang, sum(of_lang) AS all_total, count(*) AS v FROM kept GROUP BY lang),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_SHARE.format("coalesce(c.n, 0)", "coalesce(s.total, 0)")} AS p, {_SHARE.format("k.of_lang", "all_total")} AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= {divergence.TOP}
"""

_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f"CAST({c} AS VARCHAR)") for c in merkle.FIELDS[:-1]) + " || " + _FIELD.format("{0}") + ")"
_FAN = merkle.FAN
_CHOSEN = f"crc % {merkle.EVERY} = 0"

#: DuckDB has no CRC-32, so the table of 256 remainders is made by its rule. Trees of sources and the one above them alike.
MANIFEST = rf"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS c FROM range(256) AS t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
remainders AS (SELECT list(c ORDER BY i) AS r FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id IS NOT NULL),
checks AS (SELECT id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(id, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, r[xor(c & 255, x) + 1])), 4294967295) AS crc FROM ids, remainders),
rows AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_LEAF.format("text")} AS leaf,
    CASE WHEN {_CHOSEN} THEN {_LEAF.format(f"translate(text, '{decontam.UPPER}', '{decontam.LOWER}')")} ELSE {_LEAF.format("text")} END AS found
  FROM documents LEFT JOIN checks ON id = CAST(doc_id AS VARCHAR)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n FROM rows),
nodes AS (
  SELECT 0 AS level, tree, rank, leaf AS digest, n FROM leaves
  UNION ALL SELECT level + 1, tree, rank // {_FAN}, sha256(string_agg(digest, '' ORDER BY rank)), (n + {_FAN - 1}) // {_FAN} FROM nodes WHERE n > 1 GROUP BY level, tree, rank // {_FAN}, n),
subroots AS (SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS m FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place AS rank, subroot AS digest, m FROM subroots
  UNION ALL SELECT level + 1, rank // {_FAN}, sha256(string_agg(digest, '' ORDER BY rank)), (m + {_FAN - 1}) // {_FAN} FROM tops WHERE m > 1 GROUP BY level, rank // {_FAN}, m),
root AS (SELECT digest AS root FROM tops WHERE m = 1),
requests AS (SELECT row_number() OVER () AS rid, leaves.*, subroot, height, place FROM leaves JOIN subroots USING (tree)),
beside AS (
  SELECT rid, level, n.rank < r.rank // CAST(pow({_FAN}, level) AS BIGINT) AS earlier, n.rank, digest
  FROM requests r JOIN nodes n ON n.tree = r.tree AND n.n > 1 AND n.rank // {_FAN} = r.rank // CAST(pow({_FAN}, level + 1) AS BIGINT) AND n.rank <> r.rank // CAST(pow({_FAN}, level) AS BIGINT)
  UNION ALL SELECT rid, height + level, n.rank < r.place // CAST(pow({_FAN}, level) AS BIGINT), n.rank, digest
  FROM requests r JOIN tops n ON n.m > 1 AND n.rank // {_FAN} = r.place // CAST(pow({_FAN}, level + 1) AS BIGINT) AND n.rank <> r.place // CAST(pow({_FAN}, level) AS BIGINT)),
proofs AS (SELECT rid, string_agg(digest, '' ORDER BY level, rank) AS proof FROM beside GROUP BY rid),
sides AS (SELECT rid, level, coalesce(string_agg(digest, '' ORDER BY rank) FILTER (earlier), '') AS l, coalesce(string_agg(digest, '' ORDER BY rank) FILTER (NOT earlier), '') AS r FROM beside GROUP BY rid, level),
levels AS (SELECT max(level) AS top FROM tops),
folds AS (
  SELECT rid, 0 AS level, found AS digest, height + top AS ends FROM requests, levels
  UNION ALL SELECT f.rid, f.level + 1, sha256(coalesce(l, '') || digest || coalesce(r, '')), ends FROM folds f LEFT JOIN sides s ON s.rid = f.rid AND s.level = f.level WHERE f.level < ends)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM requests JOIN root ON TRUE LEFT JOIN proofs USING (rid) JOIN folds USING (rid) WHERE level = ends
"""
