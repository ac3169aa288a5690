"""DuckDB statements that check queries of this subpackage."""

from __future__ import annotations

from glyphgate.llm import licenses, quotes


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def groups(n: int, percent: int) -> str:
    """Components of documents by shingle similarity, from all pairs with a common shingle."""
    return rf"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= {n}
    THEN list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM split),
each AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT doc_id AS start, doc_id AS node FROM sets UNION SELECT start, b FROM reached JOIN edges ON node = a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.node) AS component_id
FROM sets s JOIN reached r ON r.start = s.doc_id GROUP BY s.doc_id, len(s.s)"""


def _own(lines: str) -> str:
    quoted, intro = lit(quotes.QUOTED), lit(quotes.INTRODUCTION)
    return (f"regexp_replace(array_to_string(list_filter({lines}, lambda x, i: NOT regexp_matches(x, {quoted})"
            f" AND NOT (regexp_matches(x, {intro}) AND regexp_matches(coalesce({lines}[i + 1], ''), {quoted}))), chr(10)),"
            r" '^\n+|\n+$', '', 'g')")


def _units(text: str) -> str:
    normal = r"trim(regexp_replace(lower(x), '[ \t\r\n\f\x0B]+', ' ', 'g'))"
    return (rf"list_distinct(list_filter(list_transform([{text}] || regexp_split_to_array({text}, '\n[ \t]*\n')"
            rf" || string_split({text}, chr(10)), lambda x: {normal}), lambda x: x <> ''))")


def conversations() -> str:
    """Quotation linking over ``conversations``."""
    marks = lit(quotes.MARKS)
    return rf"""
WITH RECURSIVE lines AS (SELECT *, regexp_split_to_array(text, '\r?\n') AS l FROM conversations),
own AS MATERIALIZED (SELECT conv_id AS conv, turn, role, {_own('l')} AS text FROM lines),
flat AS (SELECT DISTINCT conv_id AS conv, turn, md5(text) AS copy, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM lines
    WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
levels AS (SELECT *, length(regexp_replace(regexp_extract(line, {marks}), '[^>]', '', 'g')) AS level FROM flat),
changed AS (SELECT *, CASE WHEN level = lag(level) OVER m THEN 0 ELSE 1 END AS new FROM levels
    WINDOW m AS (PARTITION BY conv, turn, copy ORDER BY pos)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY conv, turn, copy ORDER BY pos) AS run FROM changed),
passages AS (SELECT conv, turn, level, string_agg(regexp_replace(line, {marks}, ''), chr(10) ORDER BY pos) AS passage
    FROM runs WHERE level > 0 GROUP BY conv, turn, copy, run, level),
quoted AS (SELECT conv, turn, level, unnest({_units('passage')}) AS unit FROM passages),
here AS (SELECT unit, conv, min(turn) AS here_turn FROM (SELECT conv, turn, unnest({_units('text')}) AS unit FROM own
    WHERE conv IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL) GROUP BY unit, conv),
first AS (SELECT unit, min(conv) AS conv, arg_min(here_turn, conv) AS turn FROM here WHERE length(unit) >= {quotes.ACROSS_CHARS} GROUP BY unit),
found AS (SELECT q.conv, q.turn, q.level, length(q.unit) AS size,
    CASE WHEN h.here_turn < q.turn THEN q.conv WHEN f.conv < q.conv THEN f.conv END AS parent_conv,
    CASE WHEN h.here_turn < q.turn THEN h.here_turn WHEN f.conv < q.conv THEN f.turn END AS parent_turn
    FROM quoted q LEFT JOIN here h ON h.unit = q.unit AND h.conv = q.conv LEFT JOIN first f ON f.unit = q.unit),
linked AS (SELECT * FROM found WHERE parent_conv IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY conv, turn ORDER BY level, size DESC, parent_conv, parent_turn) = 1),
edges AS MATERIALIZED (SELECT conv AS a, parent_conv AS b FROM found WHERE conv <> parent_conv
    UNION SELECT parent_conv, conv FROM found WHERE conv <> parent_conv),
reached AS (SELECT DISTINCT a AS start, a AS node FROM edges UNION SELECT start, b FROM reached JOIN edges ON node = a),
threads AS (SELECT start AS conv, min(node) AS thread FROM reached GROUP BY start)
SELECT o.conv AS conv_id, o.turn, o.role, o.text, coalesce(t.thread, o.conv) AS thread_id,
    row_number() OVER (PARTITION BY coalesce(t.thread, o.conv)
        ORDER BY o.conv NULLS FIRST, o.turn NULLS FIRST, o.role NULLS FIRST, o.text NULLS FIRST) - 1 AS position,
    l.parent_conv, l.parent_turn, CAST(l.level AS INTEGER) AS level
FROM own o LEFT JOIN threads t ON t.conv = o.conv LEFT JOIN linked l ON l.conv = o.conv AND l.turn = o.turn"""


def license_scan(short_words: int) -> str:
    """License scan over ``documents`` as files."""
    marker, file = lit(licenses.MARKER), lit(licenses.LICENSE_FILE)
    listed = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in licenses.TEMPLATES)
    return rf"""
WITH files AS MATERIALIZED (SELECT doc_id AS id, concat_ws('/', source, lang, CASE WHEN regexp_matches(text, {marker})
        AND len(regexp_split_to_array(text, '\s+')) <= {short_words} THEN 'LICENSE-' ELSE 'text-' END || doc_id) AS path, text FROM documents),
known AS (SELECT row_number() OVER () AS t, * FROM (VALUES {listed}) AS v(license, body)),
counted AS (SELECT t, license, term, count(*) AS tf FROM (SELECT t, license, unnest(regexp_extract_all(lower(body), '{licenses.TERM}')) AS term
    FROM known) GROUP BY ALL),
rarity AS (SELECT term, ln((1 + (SELECT count(*) FROM known)) / (1 + count(DISTINCT t))) + 1 AS idf FROM counted GROUP BY term),
weighed AS (SELECT t, license, term, (1 + ln(tf)) * idf AS w FROM counted JOIN rarity USING (term)),
vectors AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS tw FROM weighed),
marked AS (SELECT *, regexp_matches(path, {file}) AS whole FROM files WHERE regexp_matches(text, {marker}) OR regexp_matches(path, {file})),
parts AS (SELECT id, path, list_filter(regexp_split_to_array(text, '\r?\n') || regexp_split_to_array(text, '\r?\n[ \t]*\r?\n'),
    lambda x: regexp_matches(x, {marker})) || CASE WHEN whole THEN [text] ELSE [] END AS p FROM marked),
statements AS (SELECT DISTINCT id, path, trim(unnest(p)) AS statement FROM parts),
terms AS (SELECT id, path, statement, term, count(*) AS tf FROM (SELECT *, unnest(regexp_extract_all(lower(statement), '{licenses.TERM}')) AS term
    FROM statements) GROUP BY ALL),
weights AS (SELECT id, path, statement, term, (1 + ln(tf)) * coalesce(idf, ln(1 + (SELECT count(*) FROM known)) + 1) AS w
    FROM terms LEFT JOIN rarity USING (term)),
lengths AS (SELECT id, path, statement, sqrt(sum(w * w)) AS norm FROM weights GROUP BY ALL),
dots AS (SELECT id, path, statement, t, license, sum(weights.w * tw) AS dot FROM weights JOIN vectors USING (term) GROUP BY ALL),
found AS (SELECT id, path, license, round(dot / norm, 4) AS cosine FROM dots JOIN lengths USING (id, path, statement)),
own AS MATERIALIZED (SELECT * FROM found WHERE cosine >= {licenses.MIN_COSINE}
    QUALIFY row_number() OVER (PARTITION BY id, path ORDER BY cosine DESC, license) = 1),
dirs AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, license, cosine FROM own WHERE regexp_matches(path, {file})
    QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY cosine DESC, license) = 1),
leaves AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS leaf FROM files),
near AS (SELECT leaf, dir, license, cosine FROM leaves JOIN dirs ON leaf = dir OR dir = '' OR starts_with(leaf, dir || '/')
    QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY length(dir) DESC) = 1)
SELECT f.id AS doc_id, f.path, coalesce(o.license, n.license) AS license,
    CASE WHEN o.license IS NOT NULL THEN 'own' WHEN n.license IS NOT NULL THEN 'inherited' END AS origin,
    CASE WHEN o.license IS NOT NULL THEN o.cosine ELSE n.cosine END AS cosine, CASE WHEN o.license IS NULL THEN n.dir END AS from_dir
FROM files f LEFT JOIN own o ON o.id = f.id AND o.path = f.path LEFT JOIN near n ON n.leaf = regexp_replace(f.path, '/?[^/]*$', '')"""
