"""DuckDB statements of the queries that SQL can express.

Language fusion, sharding, fingerprints, the classifier and piece counts rest on hashes, sequential choices or models that SQL lacks; tests
hold those against brute force.
"""

from __future__ import annotations

from tidewatch.llm import chat, decontamination, divergence, secret_ledger

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _secrets() -> str:
    parts = []
    for place, rule in enumerate(secret_ledger.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, '{rule.name}' AS kind, {place} AS place, {rule.least} AS least, string_split_regex(x, '{pattern}') AS pieces, "
                     f"regexp_extract_all(x, '{pattern}', 0) AS hits, regexp_extract_all(x, '{pattern}', {rule.group}) AS tested FROM t WHERE regexp_matches(x, '{pattern}')")
    counts = ", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in secret_ledger.RULES)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
m AS ({' UNION ALL '.join(parts)}),
spots AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
found AS (
  SELECT doc_id, kind, place, CAST(list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS s, length(hits[i]) AS n
  FROM spots WHERE length(tested[i]) >= least),
per AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, place) AS spans FROM found GROUP BY doc_id)
SELECT t.doc_id, {', '.join(f'coalesce(n_{r.name}, 0) AS n_{r.name}' for r in secret_ledger.RULES)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN per USING (doc_id)"""


_RULES = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS win, unnest(range(1, len(w) - 3)) AS pos FROM t WHERE len(w) >= 5),
twice AS (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows),
steps AS (SELECT doc_id, least(5, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, 5)) AS step FROM twice WHERE n > 1),
again AS (SELECT doc_id, CAST(sum(step) AS BIGINT) AS n_repeat_words FROM steps GROUP BY doc_id),
lined AS (SELECT *, list_filter(string_split(x, chr(10)), lambda l: length(translate(l, {_BLANKS}, '')) > 0) AS lines FROM t),
m AS (
  SELECT doc_id, x, CAST(len(w) AS BIGINT) AS n_words, length(translate(x, {_BLANKS}, '')) AS word_chars, length(x) - length(translate(x, '#*$%&|<>', '')) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(regexp_extract_all(x, '\\p{{Lu}}')) AS n_upper, len(regexp_extract_all(x, '[0-9]')) AS n_digits, length(x) - length(translate(x, '!?', '')) AS n_calls
  FROM lined LEFT JOIN again USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 0.05::DOUBLE * word_chars OR n_upper > 0.4::DOUBLE * word_chars OR n_calls > 0.08::DOUBLE * word_chars
    OR n_dup_lines > 0.5::DOUBLE * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_digits > 0.5::DOUBLE * word_chars) AS kept
FROM b"""


def _tokens(source: str, key: str) -> str:
    """CTEs up to ``<source>_toks`` (key, form, p, token, slot): template tokens (form 0) and literal words (form 1) of ``source`` (key, x)."""
    d = decontamination
    units, spelled = (", ".join(f"'{w}'" for w in words) for words in (d.UNITS, d.SPELLED))
    stuck = rf"(?i)^([0-9]+)({'|'.join(d.UNITS)})\z"
    bare = r"regexp_replace(w, '[^\p{L}\p{N}]+', '', 'g')"
    return rf"""
{source}_free AS (SELECT {key}, translate(x, chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6), '      ') AS x FROM {source}),
{source}_words AS (SELECT {key}, i, {bare} AS bare, regexp_matches(w, '[.!?:][^\p{{L}}\p{{N}}]*\z') AS stop
  FROM (SELECT {key}, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT {key}, {_WORDS.format('x')} AS ws FROM {source}_free))),
{source}_parts AS (
  SELECT {key}, 2 * i AS i, regexp_extract(bare, '{stuck}', 1) AS bare, false AS stop FROM {source}_words WHERE regexp_matches(bare, '{stuck}')
  UNION ALL SELECT {key}, 2 * i + 1, regexp_extract(bare, '{stuck}', 2), stop FROM {source}_words WHERE regexp_matches(bare, '{stuck}')
  UNION ALL SELECT {key}, 2 * i, bare, stop FROM {source}_words WHERE NOT regexp_matches(bare, '{stuck}') AND (bare <> '' OR stop)),
{source}_runs AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, regexp_matches(bare, '^\p{{Lu}}') AND coalesce(lag(regexp_matches(bare, '^\p{{Lu}}') AND NOT stop) OVER (PARTITION BY {key} ORDER BY i), false) AS goes_on FROM {source}_parts)),
{source}_units AS (SELECT {key}, run, string_agg(bare, chr(3) ORDER BY i) AS plain FROM {source}_runs GROUP BY {key}, run),
{source}_near AS (SELECT *, regexp_matches(plain, '^[0-9]+\z') OR lower(plain) IN ({spelled}) AS number FROM {source}_units),
{source}_kinds AS (
  SELECT {key}, run, plain, CASE WHEN number THEN '{d.NUMBER}' WHEN regexp_matches(plain, '^\p{{Lu}}') THEN '{d.NAME}'
    WHEN lower(plain) IN ({units}) AND coalesce(lag(number) OVER (PARTITION BY {key} ORDER BY run), false) THEN '{d.UNIT}' END AS kind FROM {source}_near),

{source}_toks AS (
  SELECT {key}, 0 AS form, row_number() OVER (PARTITION BY {key} ORDER BY run) - 1 AS p, coalesce(kind, lower(plain)) AS token, CASE WHEN kind IS NOT NULL THEN plain END AS slot FROM {source}_kinds WHERE plain <> ''
  UNION ALL SELECT {key}, 1, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1, bare, NULL FROM (SELECT {key}, i, lower(bare) AS bare FROM {source}_words) WHERE bare <> ''),
{source}_wins AS (
  SELECT {key}, form, p, list(token) OVER run AS tokens, list(slot) OVER run AS slots
  FROM {source}_toks WINDOW run AS (PARTITION BY {key}, form ORDER BY p ROWS BETWEEN CURRENT ROW AND {d.WIDTH - 1} FOLLOWING))"""


def _traces() -> str:
    d = decontamination
    # Values of the slots in order; a window with fewer literals has them in its name.
    cut = f"""p, n, vals, array_to_string(tokens[1:n], chr(30)) || CASE WHEN n - len(vals) >= least({d.LITERALS}, n) THEN '' ELSE chr(31) || array_to_string(vals, chr(30)) END AS win
  FROM (SELECT *, list_filter(slots[1:n], lambda s: s IS NOT NULL) AS vals FROM"""
    return f"""
WITH docs AS (SELECT doc_id, text AS x FROM documents WHERE text IS NOT NULL),
items AS (SELECT DISTINCT text AS item, text AS x FROM benchmark WHERE text IS NOT NULL),
{_tokens('docs', 'doc_id')},
{_tokens('items', 'item')},
sizes AS (SELECT item, form, count(*) AS length, least(count(*), {d.WIDTH}) AS n FROM items_toks GROUP BY item, form),
item_cuts AS (SELECT item, form, length, {cut} items_wins JOIN sizes USING (item, form) WHERE len(tokens) >= n)),
grams AS (SELECT *, count(*) OVER (PARTITION BY item, form) AS windows FROM (SELECT item, form, length, n, win, min(p) AS place, arg_min(vals, p) AS mine FROM item_cuts GROUP BY item, form, length, n, win)),
doc_cuts AS (SELECT doc_id, form, {cut} docs_wins, (SELECT DISTINCT n FROM sizes) WHERE len(tokens) >= n)),
met AS (SELECT doc_id, item, form, p - place AS diagonal, place, n, length, windows, mine, vals, CAST(floor((p - place) / greatest(1, length // 4)) AS BIGINT) AS band FROM doc_cuts JOIN grams USING (form, n, win)),
spread AS (
  SELECT *, 'd' || diagonal AS line FROM met UNION ALL SELECT *, 'b' || band FROM met UNION ALL SELECT *, 'b' || (band - 1) FROM met),
steps AS (
  SELECT *, least(n, coalesce(lead(place) OVER along - place, n)) AS words, place - row_number() OVER along AS island
  FROM (SELECT DISTINCT doc_id, item, form, line, place, n, length, windows FROM spread) WINDOW along AS (PARTITION BY doc_id, item, form, line ORDER BY place)),
covers AS (SELECT doc_id, item, form, line, any_value(length) AS length, count(*) / any_value(windows) AS by_windows, sum(words) AS words FROM steps GROUP BY doc_id, item, form, line),
longest AS (SELECT doc_id, item, form, line, max(k) AS words FROM (SELECT doc_id, item, form, line, island, count(*) + any_value(n) - 1 AS k FROM steps GROUP BY ALL) GROUP BY ALL),
pairs AS (SELECT DISTINCT doc_id, item, form, line, unnest(mine) AS a, unnest(vals) AS b FROM spread),
slots AS (SELECT doc_id, item, form, line, count(*) = count(DISTINCT a) AS consistent, bool_and(a = b) AS same FROM pairs GROUP BY ALL),
hits AS (
  SELECT c.doc_id, c.item, greatest(by_windows, c.words / length) AS share, coalesce(same, true) AS same
  FROM covers c JOIN longest l USING (doc_id, item, form, line) LEFT JOIN slots s USING (doc_id, item, form, line)
  WHERE coalesce(consistent, true) AND (by_windows >= {d.COVERAGE} OR (c.words / length >= {d.COVERAGE} AND c.words >= {d.LEAST_WORDS}) OR (line LIKE 'd%' AND l.words >= {d.RUN}))),
named AS (SELECT DISTINCT doc_id, item_id, share, same FROM hits JOIN benchmark ON benchmark.text = hits.item)
SELECT doc_id, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS item_ids, count(DISTINCT item_id) AS n_items, max(share) AS coverage, bool_or(same) AS verbatim
FROM named GROUP BY doc_id"""


_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {s}) & 31 AS INT) + 1, 1)" for s in (15, 10, 5, 0))
_ARCHIVES = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
h AS (SELECT page_id, x, strlen(x) AS payload_bytes, sha1(x) AS hex, min(page_id) OVER (PARTITION BY x) AS least FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(list_transform(range(8), lambda g: CAST('0x' || substr(hex, g * 5 + 1, 5) AS BIGINT)), lambda v: {_DIGITS}), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM h"""

_MIX = f"""
WITH sized AS (SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
turns AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM per),
weighed AS (SELECT *, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3 * source_size AS lim FROM turns),
reaches AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(lim) OVER before, 0) AS DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS reach
  FROM weighed WINDOW before AS (ORDER BY lim / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT *, least(CAST(lim AS DOUBLE), max(reach) OVER () * weight) AS target FROM reaches),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
drawn AS (SELECT s.doc_id, size, source_size, target, rate, CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
counted AS (SELECT *, CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM drawn)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted"""



def _chat() -> str:
    def escaped(x: str) -> str:
        grown = " + ".join(f"(length({x}) - length(replace({x}, '{c}', ''))) / {len(c)}" for c in ("\\", *chat.CONTROLS))
        return f"(length({x}) + {grown})"

    marks = {role: sum(map(len, shape)) for shape, role in (((a, mid, z), role) for a, role, mid, z in chat.SHAPES)}
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(i))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({escaped('text')} + CASE role WHEN 'user' THEN {marks['user']} WHEN 'assistant' THEN {marks['assistant']} ELSE {marks[None]} + {escaped('role')} END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


_DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT row, lang, source, term, count(*) AS n FROM (SELECT row, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(*) >= {divergence.LEAST}),
cells AS (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce((SELECT sum(n) FROM cells c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total, (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS terms
  FROM (SELECT DISTINCT lang, source FROM d) g),
every AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + ({divergence.SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.terms) AS HUGEINT) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, CAST(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS BIGINT) AS value
             FROM every x JOIN every y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) v
    ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
whole AS (SELECT lang, sum(total) AS total, any_value(terms) AS terms FROM groups GROUP BY lang),
of_lang AS (SELECT lang, term, CAST(1 + ({divergence.SCALE}::HUGEINT * (sum(n) + 2)) // (any_value(total) + 2 * any_value(terms)) AS HUGEINT) AS q FROM cells JOIN whole USING (lang) GROUP BY lang, term),
standing AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM every JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) FROM standing)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}"""

SQL = {
    "op2_secret_scan": _secrets(),
    "op3_quality_rules": _RULES,
    "op5_decontamination": _traces(),
    "op7_arc_to_warc": _ARCHIVES,
    "op9_mixing": _MIX,
    "op12_chat_formatting": _chat(),
    "op13_source_divergence": _DIVERGENCE,
}
