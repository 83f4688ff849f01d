"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import license_scan, quality, secret_scan

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
    SELECT item, i AS j, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
    FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
places AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM pos, (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)),
met AS (SELECT places.doc_id, places.i, places.n, win.item, win.j FROM places JOIN win USING (n, s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS h FROM met GROUP BY 1),
runs AS (SELECT doc_id, item, n, i - j AS d, i - row_number() OVER (PARTITION BY doc_id, item, i - j ORDER BY i) AS g FROM (SELECT DISTINCT doc_id, item, i, j, n FROM met)),
base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256 FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)),
longest AS (SELECT doc_id, CAST(max(m) AS BIGINT) AS longest_match FROM (SELECT doc_id, count(*) + any_value(n) - 1 AS m FROM runs GROUP BY doc_id, item, d, g) GROUP BY 1)
SELECT base.*, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated, coalesce(longest_match, 0) AS longest_match FROM base LEFT JOIN longest USING (doc_id)
"""

WORDS = r"[^\x20\x09-\x0D]+"
OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM documents),
sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
),
el AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS k, any_value(a.n) AS m, any_value(b.n) AS n FROM el a JOIN el b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT p, q FROM common WHERE 100 * k >= 85 * (m + n - k)),
edge AS (SELECT p, q FROM link UNION ALL SELECT q, p FROM link),
reach AS (SELECT doc_id AS a, doc_id AS z FROM sets UNION SELECT reach.a, edge.q FROM reach JOIN edge ON reach.z = edge.p)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(z) FROM reach WHERE a = sets.doc_id) AS component_id FROM sets
"""

def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_PART = """{name}_m AS (
    SELECT r, i, len(p) AS before, m, g FROM (
        SELECT r, unnest(string_split_regex(text, {rx})) AS p, unnest(list_append(regexp_extract_all(text, {rx}, 0), NULL)) AS m, unnest(list_append(regexp_extract_all(text, {rx}, {group}), NULL)) AS g, unnest(range(0, len(regexp_extract_all(text, {rx}, 0)) + 1)) AS i FROM d
    )
),
{name} AS (SELECT r, {rank} AS rank, e - len(m) AS s, e FROM (SELECT *, sum(before + coalesce(len(m), 0)) OVER (PARTITION BY r ORDER BY i) AS e FROM {name}_m) WHERE m IS NOT NULL AND {keep})"""


def _part(name: str, rank: int, pattern: str, keep: str = "true", group: int = 0) -> str:
    return _PART.format(name=name, rank=rank, rx=_q(pattern), keep=keep, group=group)


_S = secret_scan
OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{_part("t_assign", 0, _S.ASSIGN, "len(g) >= 6", 2)},
{_part("t_access", 1, _S.ACCESS, "len(m) >= 20")},
{_part("t_hex", 2, _S.HEX)},
{_part("t_ident", 3, _S.IDENT)},
{_part("t_value", 4, _S.VALUE, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')")},
{_part("t_endpoint", 5, _S.ENDPOINT)},
base AS (SELECT * FROM t_assign UNION ALL SELECT * FROM t_access UNION ALL SELECT * FROM t_hex),
around AS (SELECT r, s - 300 AS s, e + 300 AS e FROM t_access UNION ALL SELECT r, s - 300, e + 300 FROM t_ident),
edges AS (SELECT *, max(e) OVER (PARTITION BY r ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM around),
scopes AS (SELECT r, g, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN so_far IS NULL OR s > so_far THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM edges) GROUP BY 1, 2),
ids AS (SELECT r, s, e FROM t_access UNION ALL SELECT r, s, e FROM t_ident),
apart AS (
    SELECT * FROM (SELECT * FROM t_value UNION ALL SELECT * FROM t_hex) v
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT r, s, e FROM ids UNION ALL SELECT r, s, e FROM t_endpoint) x WHERE x.r = v.r AND v.s < x.e AND v.e > x.s)
),
proof AS (
    SELECT r, s, e FROM apart UNION ALL
    SELECT r, s, e FROM t_assign a WHERE NOT EXISTS (SELECT 1 FROM ids x WHERE x.r = a.r AND a.s < x.e AND a.e > x.s)
),
linked AS (SELECT * FROM scopes c WHERE EXISTS (SELECT 1 FROM proof p WHERE p.r = c.r AND p.s < c.e AND p.e > c.s)),
weak AS (SELECT w.* FROM (SELECT * FROM t_ident UNION ALL SELECT * FROM apart WHERE rank = 4 UNION ALL SELECT * FROM t_endpoint) w WHERE EXISTS (SELECT 1 FROM linked c WHERE c.r = w.r AND w.s < c.e AND w.e > c.s)),
named AS (SELECT r, s, rank, rank <= 2 AS is_base, ['assign', 'access', 'hex', 'ident', 'value', 'endpoint'][rank + 1] || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR) AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
per AS (SELECT r, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c, string_agg(x, ',' ORDER BY s, rank) FILTER (is_base) AS bs, string_agg(x, ',' ORDER BY s, rank) AS sp FROM named GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(sp, '') AS spans FROM d LEFT JOIN per USING (r)
"""


def _license_sql() -> str:
    """Three cuts of the texts; the third goes line by line, and paragraph by paragraph."""
    rows = lambda pairs: ", ".join(f"({_q(a)}, {_q(b)})" for a, b in pairs)
    rules = ", ".join(f"({n}, {_q(r[0])}, {_q(r[1])}, {_q(r[2])}, {_q(',' + ',(?:[^,]+,)*'.join(r[3]) + ',')})" for n, r in enumerate(license_scan.RULES))
    tidy = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9\\x01]+', ' ', 'g')"
    found = lambda name, parts: f"""{name} AS (
    SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids FROM (
        SELECT r, i, coalesce(k.id, h.id, m.id) AS id FROM (
            SELECT r, i, x, regexp_replace(x, {_q(license_scan.HOLDER)}, 'the name of holder may be used to endorse') AS y, regexp_extract(x, {_q(license_scan.NAMED)}, 1) AS z
            FROM (SELECT r, trim(unnest(parts)) AS x, unnest(range(0, len(parts))) AS i FROM {parts})
        ) LEFT JOIN known k ON k.sentence = x LEFT JOIN known h ON h.sentence = y LEFT JOIN named m ON m.name = z
    ) WHERE id IS NOT NULL GROUP BY 1
)"""  # noqa: E731
    cut = lambda breaks: f"(SELECT r, string_split({tidy(f"regexp_replace(text, '{breaks}', chr(1), 'g')")}, chr(1)) AS parts FROM d)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
known(sentence, id) AS (VALUES {rows(license_scan.KNOWN.items())}),
named(name, id) AS (VALUES {rows((k, f"name-{v}") for k, v in license_scan.NAMES.items())}),
rules(place, rule, license, kind, rx) AS (VALUES {rules}),
{found("by_line", cut(r"[.!?;:]+[ \t\n\x0B\f\r]+|\n"))},
{found("wrapped", cut(r"[.!?;:]+[ \t\n\x0B\f\r]+"))},
bare AS (
    SELECT r, list_transform(string_split(regexp_replace(text, '\r\n?|\x02', chr(10), 'g'), chr(10)), lambda x: CASE
        WHEN regexp_matches(x, '^[^\pL\pN]*(?:(?:rem|dnl)[ \t]+[^\pL\pN]*)?(?:copyright\b.*(?:(?:19|20)[0-9][0-9]|\(c\)|©|\[yyyy\]|<year>)|\(c\)[ \t]*(?:19|20)[0-9][0-9]|©|(?:begin|end) license block)', 'i') THEN chr(2)
        ELSE regexp_replace(regexp_replace(regexp_replace(x, '^[^\pL\pN]+', ''), '^(?:rem|dnl)(?:[ \t]+[^\pL\pN]*|$)', '', 'i'), '^[0-9][0-9]?\)[^\pL\pN]+', '') END) AS lines FROM d
),
paragraphs AS (
    SELECT r, string_split_regex(regexp_replace(regexp_replace(array_to_string(lines, chr(10)), '\bv\.\s+([0-9])', 'v \1', 'gi'), 'spdx-license-identifier:([^\n\x02]*)', chr(2) || 'spdx license identifier \1' || chr(2), 'gi'), '\n\n+|\x02') AS parts
    FROM bare
),
notices AS (SELECT r, flatten(list_transform(parts, lambda p: list_transform(string_split_regex(p, '[.!?;:]+\s+'), lambda x: {tidy("x")}))) AS parts FROM paragraphs),
{found("headed", "notices")},
hits AS (SELECT r, min(place) AS place FROM (SELECT r, ids FROM by_line UNION ALL SELECT r, ids FROM wrapped UNION ALL SELECT r, ids FROM headed) v JOIN rules ON regexp_matches(',' || ids || ',', rx) GROUP BY 1),
best AS (SELECT r, max_by(n, (n, -place)) AS n, max_by(ids, (n, -place)) AS ids FROM (SELECT 1 AS place, * FROM by_line UNION ALL SELECT 2, * FROM wrapped UNION ALL SELECT 3, * FROM headed) GROUP BY 1)
SELECT doc_id, coalesce(best.n, 0) AS n_sentences, coalesce(best.ids, '') AS sentence_ids, rule, license, kind
FROM d LEFT JOIN best USING (r) LEFT JOIN hits USING (r) LEFT JOIN rules USING (place)
"""


_R = quality.LineRules()
_LINES = rf"""
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM d),
full_lines AS (
    SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again, len(regexp_extract_all(line, '{WORDS}')) AS words, len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
        len(regexp_extract_all(line, {_q(quality.SEPARATORS.pattern)})) AS seps, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols
    FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
judged AS (
    SELECT *, (words <= {_R.fragment_words} AND NOT regexp_matches(rtrim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), {_q("[" + "".join("\\" + c if c in "]" else c for c in quality.ENDS) + "]$")}))
        OR (seps >= {_R.separators} AND words - seps <= {_R.label_words} * (seps + 1))
        OR (symbols > 0 AND 100 * symbols >= {_R.symbol_percent} * len(line))
        OR (words <= {_R.boilerplate_words} AND regexp_matches(line, {_q(quality.BOILERPLATE.pattern)}, 'i')) AS fails
    FROM full_lines
),
per_line AS (SELECT r, count(*) FILTER (again) AS dups, count(*) FILTER (fails) AS removed, coalesce(sum(chars) FILTER (fails), 0) AS lost FROM judged GROUP BY 1)"""
OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
at8 AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM at8) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1),
{_LINES.strip()},
base AS (
    SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        coalesce(dups, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(removed, 0) AS n_removed_lines, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
    FROM d LEFT JOIN rep USING (r) LEFT JOIN per_line USING (r)
),
failed AS (SELECT *, n_words < {_R.least_words} OR 100 * n_repeat_words > {_R.repeat_percent} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= {_R.lost_percent} * word_chars AS kept, n_removed_lines, lost_chars FROM failed
"""

ORACLE = {"op2_decontamination": OP2, "op6_ngram_jaccard": OP6, "op7_quality_rules": OP7, "op8_secret_scan": OP8, "op9_license_scan": _license_sql()}
