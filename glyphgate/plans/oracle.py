"""DuckDB statements of the scan rules, for checking the operators.

Written against RE2, lists and recursive expressions; shares only the fixed values
with the Spark side.
"""

from __future__ import annotations

from glyphgate.functions import fixed


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(text: str, pattern: str, fold: bool) -> str:
    return f"regexp_matches({text}, {lit(pattern)}, '{'i' if fold else 'c'}')"


def base64_test(text: str) -> str:
    decoded = "CAST(from_base64(rtrim(c, '=') || repeat('=', (4 - length(rtrim(c, '=')) % 4) % 4)) AS VARCHAR)"
    return (
        f"length(list_filter(regexp_extract_all({text}, {lit(fixed.BASE64_RUN)}), lambda c:"
        f" CASE WHEN length(rtrim(c, '=')) % 4 = 1 THEN false"
        f" ELSE NOT regexp_matches({decoded}, '\\\\x(0[0-8]|0E|0F|1)')"
        f" AND {matches(decoded, fixed.BASE64_KEYWORD, True)} END)) > 0"
    )


def signature_tests(text: str = "text") -> dict[str, str]:
    tests = {i: matches(text, p, f) for i, p, f in fixed.STRUCTURAL}
    tests[fixed.BASE64_ID] = base64_test(text)
    tests.update({i: matches(text, p, f) for i, p, f in fixed.LEXICAL})
    return tests


def hmac(secret: str, message: str) -> str:
    """HMAC-SHA256 of a text expression, in hex."""
    key = secret.encode().ljust(64, b"\0")
    inner, outer = (bytes(k ^ pad for k in key).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def hits_cte(source: str = "texts", id_col: str = "doc_id", name: str = "hits") -> str:
    """``name(id, sigs, n, joined)``: the ordered hit list of each text."""
    cases = ", ".join(f"CASE WHEN {t} THEN '{i}' END" for i, t in signature_tests().items())
    return (f"{name} AS MATERIALIZED (SELECT {id_col}, sigs, length(sigs) AS n, array_to_string(sigs, ',') AS joined"
            f" FROM (SELECT {id_col}, list_filter([{cases}], lambda x: x IS NOT NULL) AS sigs FROM {source}))")


STRUCTURAL_IDS = ", ".join(lit(i) for i in [*(i for i, _, _ in fixed.STRUCTURAL), fixed.BASE64_ID])
CONFIDENCE = (
    "CASE WHEN n > 0 THEN least(0.99, round(0.72 + least(0.06 * n, 0.18)"
    f" + CASE WHEN list_has_any(sigs, [{STRUCTURAL_IDS}]) THEN 0.08 ELSE 0 END"
    " + CASE WHEN n >= 3 THEN 0.04 ELSE 0 END, 4))::DOUBLE END"
)

# --- personal data -----------------------------------------------------------------

_D = "regexp_replace(v, '\\D', '', 'g')"
_SAME = f"replace({_D}, left({_D}, 1), '') = ''"


def _digits(upto: int, weight: str, d: str = _D) -> str:
    return f"list_sum(list_transform(range(1, {upto + 1}), lambda i: CAST(substr({d}, i, 1) AS INT) * ({weight})))"


_LUHN = (
    f"list_sum(list_transform(range(1, length({_D}) + 1), lambda i: CASE WHEN (length({_D}) - i) % 2 = 0"
    f" THEN CAST(substr({_D}, i, 1) AS INT) ELSE CAST(substr({_D}, i, 1) AS INT) * 2"
    f" - CASE WHEN CAST(substr({_D}, i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
)
_IBAN = (
    "list_reduce(list_transform(string_split(upper(substr(v, 5) || left(v, 4)), ''), lambda c:"
    " CASE WHEN c BETWEEN 'A' AND 'Z' THEN ascii(c) - 55 ELSE ascii(c) - 48 END),"
    " lambda r, c: CASE WHEN c > 9 THEN (r * 100 + c) % 97 ELSE (r * 10 + c) % 97 END, 0) = 1"
)
_NIF = (f"substr('{fixed.NIF_LETTERS}', CAST(replace(replace(replace(left(upper(v), length(v) - 1), 'X', '0'), 'Y', '1'),"
        " 'Z', '2') AS INT) % 23 + 1, 1) = right(upper(v), 1)")


def _date_rule(year: int) -> str:
    a, b, c = (f"CAST(string_split_regex(v, '[/-]')[{k}] AS INT)" for k in (1, 2, 3))
    iso = f"({b} BETWEEN 1 AND 12 AND {c} BETWEEN 1 AND 31 AND {a} BETWEEN 1900 AND {year})"
    full = f"(CASE WHEN {c} < 100 THEN CASE WHEN {c} > 30 THEN 1900 + {c} ELSE 2000 + {c} END ELSE {c} END)"
    swapped = f"({b} > 12 AND {a} <= 12)"
    plain = (f"((({swapped} AND {a} >= 1 AND {b} <= 31) OR (NOT {swapped} AND {b} BETWEEN 1 AND 12 AND {a} BETWEEN 1 AND 31))"
             f" AND {full} BETWEEN 1900 AND {year})")
    return f"CASE WHEN regexp_full_match(v, '\\d{{4}}-.*') THEN {iso} ELSE {plain} END"


def rules(year: int) -> dict[str, str]:
    return {
        "IBAN": _IBAN,
        "CREDIT_CARD": f"NOT {_SAME} AND {_LUHN}",
        "CPF": (f"NOT {_SAME} AND ({_digits(9, '11 - i')} * 10) % 11 % 10 = CAST(substr({_D}, 10, 1) AS INT)"
                f" AND ({_digits(10, '12 - i')} * 10) % 11 % 10 = CAST(substr({_D}, 11, 1) AS INT)"),
        "NHS_NUMBER": f"NOT {_SAME} AND (11 - {_digits(9, '11 - i')} % 11) % 11 = CAST(substr({_D}, 10, 1) AS INT)",
        "NIF_NIE": _NIF,
        "SSN": "NOT regexp_matches(v, '^(000|666|9)|-00-|0000$')",
        "PASSPORT": "regexp_matches(v, '\\d')",
        "DATE_OF_BIRTH": _date_rule(year),
        "PHONE": f"length({_D}) BETWEEN 9 AND 15 AND NOT {_SAME}",
    }


MASK = ("CASE WHEN length(v) <= 4 THEN left(v, 1) || repeat('*', greatest(length(v) - 1, 1))"
        " ELSE left(v, 2) || repeat('*', least(length(v) - 4, 8)) || right(v, 2) END")


def candidate_ctes(year: int, source: str = "texts", id_col: str = "doc_id", checked: bool = True) -> list[str]:
    """``c1 .. c13 (id, p, type, v, s, e)``: pattern matches of each type with offsets."""
    rule = rules(year)
    out = []
    for k, (type_, pattern, fold) in enumerate(fixed.PERSONAL_DATA, 1):
        p = lit(("(?i)" if fold else "") + pattern)
        check = f" WHERE {rule[type_]}" if checked and type_ in rule else ""
        out.append(
            f"c{k} AS MATERIALIZED (SELECT * FROM (SELECT {id_col}, {k} AS p, '{type_}' AS type, v,"
            f" CAST(sum(g) OVER w + sum(length(v)) OVER w - length(v) AS BIGINT) AS s,"
            f" CAST(sum(g) OVER w + sum(length(v)) OVER w AS BIGINT) AS e"
            f" FROM (SELECT {id_col}, generate_subscripts(m, 1) AS k, unnest(m) AS v, unnest(g[1:length(m)]) AS g"
            f" FROM (SELECT {id_col}, regexp_extract_all(text, {p}) AS m,"
            f" list_transform(string_split_regex(text, {p}), lambda x: length(x)) AS g FROM {source})"
            f" WHERE length(m) > 0) WINDOW w AS (PARTITION BY {id_col} ORDER BY k)){check})")
    return out


def entity_ctes(year: int, source: str = "texts", id_col: str = "doc_id") -> str:
    """``ents(id, p, type, v, s, e)``: accepted entities, each type against all earlier ones."""
    parts = candidate_ctes(year, source, id_col)
    n = len(parts)
    parts.append("a1 AS MATERIALIZED (SELECT * FROM c1)")
    for k in range(2, n + 1):
        parts.append(
            f"a{k} AS MATERIALIZED (SELECT * FROM a{k - 1} UNION ALL SELECT * FROM c{k} x WHERE NOT EXISTS"
            f" (SELECT 1 FROM a{k - 1} y WHERE y.{id_col} = x.{id_col} AND y.s < x.e AND x.s < y.e))")
    parts.append(f"ents AS MATERIALIZED (SELECT * FROM a{n})")
    return ", ".join(parts)


def redacted_cte(source: str = "texts", id_col: str = "doc_id", shown: str = "'[' || type || ']'",
                 name: str = "clean") -> str:
    """``name(id, redacted)`` for texts with entities."""
    return (
        f"{name} AS (SELECT t.{id_col}, string_agg(substr(t.text, x.b + 1, x.s - x.b) || x.shown, '' ORDER BY x.s)"
        f" || substr(any_value(t.text), max(x.e) + 1) AS redacted"
        f" FROM (SELECT *, CAST(coalesce(lag(e) OVER (PARTITION BY {id_col} ORDER BY s), 0) AS BIGINT) AS b,"
        f" {shown} AS shown FROM ents) x"
        f" JOIN {source} t ON t.{id_col} = x.{id_col} GROUP BY t.{id_col})")


def report_ctes(year: int, source: str = "texts", id_col: str = "doc_id") -> str:
    """``rep(id, joined, sigs, n, entities, verdict, confidence, sha256)``: the full scan."""
    entity = ("'{\"type\":\"' || type || '\",\"value\":\"' || " + MASK +
              " || '\",\"start\":' || s || ',\"end\":' || e || '}'")
    return ", ".join([
        hits_cte(source, id_col), entity_ctes(year, source, id_col),
        f"packed AS (SELECT {id_col}, count(*) AS k, string_agg({entity}, ',' ORDER BY s) AS list FROM ents GROUP BY {id_col})",
        f"judged AS (SELECT h.*, coalesce(k, 0) AS k, coalesce(list, '') AS list, {CONFIDENCE} AS confidence,"
        f" CASE WHEN n > 0 THEN 'BLOCKED' WHEN k > 0 THEN 'ANONYMIZED' ELSE 'CLEARED' END AS verdict"
        f" FROM hits h LEFT JOIN packed USING ({id_col}))",
        f"rep AS (SELECT {id_col}, joined, sigs, n, k, list, verdict, confidence,"
        " sha256('{\"verdict\":\"' || verdict || '\",\"signaturesMatched\":['"
        " || CASE WHEN n > 0 THEN '\"' || array_to_string(sigs, '\",\"') || '\"' ELSE '' END"
        " || '],\"entities\":[' || list || ']}') AS sha256 FROM judged)",
    ])
