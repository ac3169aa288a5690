"""Signature and personal-data rules given as a table.

A rule has an id, a layer (``structural`` or ``semantic`` for signatures, ``privacy`` for personal data), a pattern in the ECMAScript dialect, a
priority, and for personal data the name of a check.  :func:`compile_rules` parses each pattern, refuses what can't be translated, and
derives literals of which every match holds one.  A scan looks for all rules' literals in one pass over the text,
with one pattern that shares their common beginnings, and runs a rule's own pattern only where one of each of its sets of literals was found.
Literals that stand at the start of a word in every match are looked for at word starts only, in a pass of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from re import _constants as sre, _parser as sre_parser

from pyspark.sql import DataFrame, Row, functions as F

from glyphgate.functions import checks, regex
from glyphgate.functions.columns import name, once, sql_string
from glyphgate.operators import personal_data

RULE_SCHEMA = "id string, layer string, pattern string, ignore_case boolean, priority int, validator string"
LAYERS = ("structural", "semantic", "privacy")
VALIDATORS = {"iban": checks.iban, "credit_card": checks.credit_card, "cpf": checks.cpf, "nhs_number": checks.nhs_number,
              "nif_nie": checks.nif_nie, "ssn": checks.ssn, "passport": checks.passport, "phone": checks.phone}
MAX_RULES = 2_000          # rules are configuration: they become part of the plan
MIN_LITERAL, MAX_ALTERNATIVES, MAX_NEXT = 3, 64, 4
START = "\b"                # in front of a literal: no ASCII word character comes before it
_NO_WORD = [(sre.CATEGORY, sre.CATEGORY_NOT_WORD)]


@dataclass(frozen=True)
class Rule:
    id: str
    layer: str
    pattern: str                       # as Spark runs it
    priority: int
    validator: str | None
    literals: frozenset[str] | None    # lower case; every match holds one of them; None: no gate
    needs: tuple[frozenset[str], ...] = ()     # all such sets, ``literals`` among them


def _ascii(text: str) -> str:
    """The text in lower case when all of it folds alike in every dialect, else ''."""
    return text.lower() if text.isascii() and START not in text else ""


def _is_word(text: str) -> bool:
    return text.isascii() and text.replace("_", "a").isalnum()


def _class_of(op, value):
    """Members of a class that must come at least once, else None."""
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0 and len(value[2]) == 1:
        op, value = value[2][0]
    return value if op is sre.IN else None


def _next_letters(op, value) -> list[str]:
    """The letters of a short class that must come next, else none."""
    members = _class_of(op, value) or []
    letters = [_ascii(chr(v)) if o is sre.LITERAL else "" for o, v in members]
    return letters if all(letters) and len(letters) <= MAX_NEXT else []


def _best(found: list[set[str]]) -> set[str] | None:
    # the rarest gate is the one whose shortest literal is longest
    return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _implied(parsed) -> set[str] | None:
    """The best set of literals of which every match of a parsed sequence holds one."""
    return _best(_all_implied(parsed))


def _all_implied(parsed) -> list[set[str]]:
    """The sets of literals of which every match of a parsed sequence holds one each."""
    found: list[set[str]] = []
    run = ""
    fresh = False       # whether a word character at this place starts a word

    def close(more: Sequence[str] = ("",)):
        nonlocal run
        if len(run.removeprefix(START)) >= MIN_LITERAL:
            found.append({run + m for m in more})
        run = ""

    for op, value in parsed:
        letter = _ascii(chr(value)) if op is sre.LITERAL else ""
        if letter:
            run += START + letter if fresh and not run and _is_word(letter) else letter
            fresh = False
            continue
        close(_next_letters(op, value) or ("",))
        fresh = (op is sre.AT and value is sre.AT_BOUNDARY) or _class_of(op, value) == _NO_WORD
        if op is sre.SUBPATTERN:
            inner = _implied(value[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            inner = _implied(value[2]) if value[0] > 0 else None
        elif op is sre.ATOMIC_GROUP:
            inner = _implied(value)
        elif op is sre.BRANCH:
            parts = [_implied(branch) for branch in value[1]]
            inner = set().union(*parts) if all(parts) else None
        else:
            inner = None
        if inner and len(inner) <= MAX_ALTERNATIVES:
            found.append(inner)
    close()
    return found


def compile_rule(id: str, layer: str, pattern: str, ignore_case: bool = False, priority: int = 0, validator: str | None = None) -> Rule:
    """Check and translate one rule; raises ValueError for what can't be run as it is meant."""
    if layer not in LAYERS:
        raise ValueError(f"rule {id}: unknown layer {layer!r}")
    if validator and (layer != "privacy" or validator not in VALIDATORS):
        raise ValueError(f"rule {id}: unknown validator {validator!r}")
    try:
        java = regex.java(pattern, bool(ignore_case))
        parsed = sre_parser.parse(pattern)
    except (ValueError, re.error) as e:
        raise ValueError(f"rule {id}: {e}") from e
    if parsed.getwidth()[0] == 0:
        raise ValueError(f"rule {id}: the pattern matches the empty text")
    found = _all_implied(parsed)
    literals = _best(found)
    return Rule(id, layer, regex.plain_bounds(java), priority or 0, validator, frozenset(literals) if literals else None,
                tuple(dict.fromkeys(map(frozenset, found))))


def compile_rules(rows: Iterable[Row | dict]) -> list[Rule]:
    """Rules of a small table's rows (``table.collect()``), by priority, then id; ids are unique."""
    out = []
    for row in rows:
        given = row.asDict() if isinstance(row, Row) else dict(row)
        out.append(compile_rule(**given))
    if len(out) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if len({r.id for r in out}) < len(out):
        raise ValueError("rule ids repeat")
    return sorted(out, key=lambda r: (r.priority, r.id))


def _trie(words: Sequence[str]) -> str:
    """A pattern for the longest of the words at a place, common beginnings shared."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = []
    for head, tails in sorted(heads.items()):
        tail = _trie(tails)
        if "" in tails and tail:
            tail = f"(?:{tail})?"
        elif len({t[0] for t in tails if t}) > 1:
            tail = f"(?:{tail})"
        parts.append(re.escape(head) + tail)
    return "|".join(parts)


def gates(rules: Sequence[Rule], starting: bool = False) -> tuple[str | None, dict[str, list[str]]]:
    """The pattern that finds all literals at all places, and per rule the found values that open it.

    ``starting`` takes the literals that start words, else the others.  At each place only the longest literal is found, so a literal
    also counts as found through longer ones that begin with it.
    """
    words = sorted({w[starting:] for r in rules for group in r.needs for w in group if w.startswith(START) == starting})
    if not words:
        return None, {}
    opens = {r.id: _opening(r.literals, words, starting) for r in rules if r.literals}
    return f"{regex.WORD_START if starting else ''}(?=({_trie(words)}))", opens


def _opening(literals: Iterable[str], words: Sequence[str], starting: bool) -> list[str]:
    """The words that begin with one of the literals of their kind."""
    own = tuple(x[starting:] for x in literals if x.startswith(START) == starting)
    return [w for w in words if w.startswith(own)] if own else []


def scan_rules(df: DataFrame, id_col: str, text_col: str, rules: Sequence[Rule]) -> DataFrame:
    """``id``, ``signatures`` (ids of matching signature rules by priority) and ``entities`` of the privacy rules, earlier priorities first in overlaps.

    Null texts have nulls in both.
    """
    signing = [r for r in rules if r.layer != "privacy"]
    private = [r for r in rules if r.layer == "privacy"]
    body = name(text_col)
    keep = [id_col, text_col]
    kinds = [(starting, finder) for starting in (False, True) if (finder := gates(signing, starting)[0])]
    words = {starting: sorted({w[starting:] for r in signing for group in r.needs for w in group if w.startswith(START) == starting})
             for starting, _ in kinds}
    # letters fold as in the rules' own patterns, A to Z only
    staged = once(df.select(*keep), keep, **{
        f"__found_{int(starting)}": f"transform(array_distinct(regexp_extract_all({body}, {sql_string('(?i)' + finder)}, 1)), w -> lower(w))"
        for starting, finder in kinds}) if kinds else df.select(*keep)

    def held(group: frozenset[str]) -> str:
        tests = [f"arrays_overlap(__found_{int(starting)}, array({', '.join(map(sql_string, opening))}))"
                 for starting, ws in words.items() if (opening := _opening(group, ws, starting))]
        return f"({' OR '.join(tests)})"

    def test(r: Rule) -> str:
        run = f"{body} RLIKE {sql_string(r.pattern)}"
        return f"CASE WHEN {' AND '.join(map(held, r.needs))} THEN {run} ELSE false END" if r.needs else run

    hits = ", ".join(f"if({test(r)}, {sql_string(r.id)}, NULL)" for r in signing)
    listed = f"array_compact(array({hits}))" if hits else "cast(array() AS array<string>)"
    signed = once(staged, keep, __hits=f"CASE WHEN {body} IS NOT NULL THEN {listed} END")
    types = tuple(personal_data.DataType(r.id, r.pattern, VALIDATORS[r.validator] if r.validator else None) for r in private)
    if not types:
        return signed.select(id_col, F.col("__hits").alias("signatures"), F.expr(
            f"CASE WHEN {body} IS NOT NULL THEN cast(array() AS array<struct<type:string,value:string,start:int,end:int>>) END").alias("entities"))
    spans = personal_data.find(signed, text_col, types)
    return spans.select(id_col, F.col("__hits").alias("signatures"),
                        F.when(F.expr(f"{body} IS NOT NULL"), personal_data.entities("__found", text_col, types)).alias("entities"))
