"""Injection signatures over a text column.

Each signature is one ``rlike``.  A regex pass over every text is the whole cost
of the scan, so a signature only runs where cheap literals its pattern implies
are present: one lower-cased copy of the text, one ``contains`` per literal
(shared by all signatures), then the exact pattern.  The stages stay separate
projections, all inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphgate.functions import fixed, regex
from glyphgate.functions.columns import name, once, sql_string, utf16_spread_sql


@dataclass(frozen=True)
class Signature:
    """One signature.

    ``needs`` lists groups of lower-case literals: a matching text holds one of each
    group.  A matching text also satisfies ``gate`` or holds one of ``gate_words``.
    ``late`` lists groups like ``needs`` that are looked for only where the tests before passed.
    """

    id: str
    layer: str
    pattern: str
    needs: tuple[tuple[str, ...], ...] = ()
    gate: str | None = None
    gate_words: tuple[str, ...] = ()
    late: tuple[tuple[str, ...], ...] = ()

    @property
    def language(self) -> str | None:
        tail = self.id.rsplit("_", 1)[-1]
        return tail if tail in fixed.LANGUAGE_SUFFIXES else None

    @classmethod
    def custom(cls, id: str, pattern: str, ignore_case: bool = True, layer: str = "lexical") -> "Signature":
        """A user signature, written in the same dialect as the fixed ones."""
        if "," in id or not id:
            raise ValueError(f"bad signature id {id!r}")
        return cls(id, layer, regex.java(pattern, ignore_case))


# literals that every match of the signature contains
_MODES = ("do anything now", "jailbreak mode", "developer mode enabled")
_OVERRIDE = (("ignor",), ("instru",))
_NEEDS = {
    "FAKE_SYSTEM_TOKEN": (("sys",),),
    "DELIMITER_INJECTION": (
        ("sys", "assistant", "ignor", "instru", "now", "developer", "disregard", "override"),),
    "PROMPT_LEAKAGE_REQUEST": (("prompt", "instru", "guidelines", "rules", "directive"),),
    "NESTED_INSTRUCTION": (("ignor", "disregard", "forget", "override", "instru", "sys"),),
    "AUTHORITY_CLAIM": (
        ("developer", "creator", "admin", "owner", "master", "anthropic", "openai", "the system"),),
    "INSTRUCTION_OVERRIDE_EN": _OVERRIDE,
    "INSTRUCTION_OVERRIDE_ES": _OVERRIDE,
    "INSTRUCTION_OVERRIDE_FR": _OVERRIDE,
    "INSTRUCTION_OVERRIDE_DE": (("ignor",), ("anweisungen",)),
    "INSTRUCTION_OVERRIDE_PT": _OVERRIDE,
    "INSTRUCTION_OVERRIDE_ZH": (("指令",),),
    "INSTRUCTION_OVERRIDE_JA": (("指示",),),
    "ROLE_HIJACK_EN": (("you are now", "act as "),),
    "ROLE_HIJACK_ES": (("ahora eres", "actúa como"),),
    "ROLE_HIJACK_FR": (("maintenant", "agissez comme"),),
    "ROLE_HIJACK_DE": (("du bist jetzt", "agiere als"),),
    "ROLE_HIJACK_PT": (("você", "aja como"),),
    "JAILBREAK_DAN": (("dan", *_MODES),),
    "HYPOTHETICAL_FRAME": (("hypothetical", "restrictions", "imagine you"),),
    "CONFIDENCE_MANIPULATION": (("comply", "instru"),),
}
# a cheaper pattern that every match of the signature also satisfies
_GATES = {
    "DELIMITER_INJECTION": r"[-=#*~_`<>|]{3}",
    "JAILBREAK_DAN": r"(?i)dan(?<![0-9a-z_]dan)(?![0-9a-z_])",
    # "://" or a dot inside a name
    "DATA_EXFILTRATION": r"[.:](?:(?<=:)//|(?<=\.)[a-zA-Z0-9-])",
}
# literals that stand in for the gate pattern
_GATE_WORDS = {"JAILBREAK_DAN": _MODES, "DATA_EXFILTRATION": ("curl", "wget", "exfiltrate")}

# literals that every match contains as well, too many or too seldom asked for to be looked for in every text
_LATE = {
    "PROMPT_LEAKAGE_REQUEST": (
        ("reveal", "repeat", "print", "show", "display", "output", "give me", "tell me", "what are", "what were"),),
    "NESTED_INSTRUCTION": (
        ("say", "read", "state", "contain", "tell"),
        ("document", "text", "message", "note", "email", "content", "file", "comment", "review", "data", "paragraph")),
    "DATA_EXFILTRATION": (
        ("send", "post", "upload", "exfiltrate", "transmit", "forward", "leak", "deliver", "email", "curl", "wget", "fetch"),),
    "AUTHORITY_CLAIM": (("as your ", "i'm your ", "i am your ", "override", "say", "said", "told", "instruct", "require", "demand"),),
}


def _fixed_signature(id: str, layer: str, pattern: str, fold: bool) -> Signature:
    return Signature(id, layer, regex.tight(regex.java(pattern, fold)),
                     _NEEDS.get(id, ()), _GATES.get(id), _GATE_WORDS.get(id, ()), _LATE.get(id, ()))


BASE64 = Signature(fixed.BASE64_ID, "structural", fixed.BASE64_RUN)
SIGNATURES: tuple[Signature, ...] = (
    *(_fixed_signature(i, "structural", p, f) for i, p, f in fixed.STRUCTURAL),
    BASE64,
    *(_fixed_signature(i, "lexical", p, f) for i, p, f in fixed.LEXICAL),
)
BY_ID = {s.id: s for s in SIGNATURES}


def base64_payload(text: str) -> str:
    """SQL test: a base64 run decodes to printable text that holds an instruction keyword."""
    core = "regexp_replace(run, '=+$', '')"
    decoded = f"make_valid_utf8(cast(unbase64({core}) AS string))"
    hides_keyword = (
        f"CASE WHEN length({core}) % 4 = 1 THEN false"
        f" ELSE {decoded} RLIKE {sql_string(regex.java(fixed.BASE64_KEYWORD, True))}"
        f" AND NOT {decoded} RLIKE {sql_string(fixed.BASE64_CONTROL)} END"
    )
    # a run holds no space, so only the long space-separated words can hold one
    words = f"concat_ws(' ', filter(split({text}, ' '), w -> octet_length(w) >= 16))"
    return f"exists(regexp_extract_all({words}, {sql_string(fixed.BASE64_RUN)}, 0), run -> {hides_keyword})"


def _literals(sigs: Sequence[Signature]) -> list[str]:
    return list(dict.fromkeys(w for s in sigs for group in (*s.needs, s.gate_words) for w in group))


def _any_of(tests: Iterable[str]) -> str:
    return f"({' OR '.join(tests)})"


def _flag(sig: Signature, text: str, has: Mapping[str, str], lower: str) -> str:
    if sig is BASE64:
        return base64_payload(text)
    tests = [_any_of(has[w] for w in group) for group in sig.needs]
    if sig.gate:
        tests.append(_any_of([*(has[w] for w in sig.gate_words), f"{text} RLIKE {sql_string(sig.gate)}"]))
    tests += [_any_of(has.get(w, f"contains({lower}, {sql_string(w)})") for w in group) for group in sig.late]
    # bounded distances count UTF-16 units
    body = utf16_spread_sql(text) if "{0," in sig.pattern else text
    return " AND ".join([*tests, f"{body} RLIKE {sql_string(sig.pattern)}"])


def _flagged(df: DataFrame, text_col: str, sigs: Sequence[Signature],
             when: Column | None) -> tuple[DataFrame, dict[str, str]]:
    """Stage the literal tests; returns the frame and one SQL test per signature id."""
    keep = [name(c) for c in df.columns]
    text = name(text_col)
    if when is not None:
        df = df.select("*", F.when(when, F.col(text)).alias("__probe"))
        text = "__probe"
    words = _literals(sigs)
    has = {w: f"__has_{i}" for i, w in enumerate(words)}
    if words or any(s.late for s in sigs):
        df = df.selectExpr("*", f"lower({text}) AS __lower")
        df = df.selectExpr(*keep, *({text} - set(keep)), *(["__lower"] if any(s.late for s in sigs) else []),
                           *[f"contains(__lower, {sql_string(w)}) AS {has[w]}" for w in words])
    return df, {s.id: f"coalesce({_flag(s, text, has, '__lower')}, false)" for s in sigs}


def signature_flags(df: DataFrame, text_col: str = "text", sigs: Sequence[Signature] = SIGNATURES,
                    prefix: str = "sig_") -> DataFrame:
    """Add one boolean column per signature."""
    keep = [name(c) for c in df.columns]
    staged, tests = _flagged(df, text_col, sigs, None)
    return staged.selectExpr(*keep, *[f"{test} AS {name(prefix + id)}" for id, test in tests.items()])


def signatures(df: DataFrame, text_col: str = "text", sigs: Sequence[Signature] = SIGNATURES,
               out_col: str = "signatures", when: Column | None = None) -> DataFrame:
    """Add the ordered ``array<string>`` of matched signature ids.

    ``when`` restricts the rows that are looked at; the others have no hits.
    """
    keep = df.columns
    if not sigs:
        return df.withColumn(out_col, F.array().cast("array<string>"))
    staged, tests = _flagged(df, text_col, sigs, when)
    listed = ", ".join(f"if({test}, {sql_string(id)}, NULL)" for id, test in tests.items())
    hits = once(staged, keep, __hits=f"concat_ws(',', {listed})")
    return hits.selectExpr(
        *map(name, keep), f"if(__hits = '', cast(array() AS array<string>), split(__hits, ',')) AS {name(out_col)}")


def signature_catalog(spark: SparkSession, sigs: Sequence[Signature] = SIGNATURES) -> DataFrame:
    rows = [(i + 1, s.id, s.layer, s.language) for i, s in enumerate(sigs)]
    return spark.createDataFrame(rows, "ordinal int, signature string, layer string, lang string")


def signature_hits(df: DataFrame, id_col: str, text_col: str = "text",
                   sigs: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """Exploded hit table ``(id, signature, ordinal)``; ordinal counts from 1 within a text."""
    hit = signatures(df.select(id_col, text_col), text_col, sigs)
    return hit.select(id_col, F.posexplode("signatures").alias("__pos", "signature")).select(
        id_col, "signature", (F.col("__pos") + 1).alias("ordinal"))


def signature_stats(df: DataFrame, text_col: str = "text",
                    sigs: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """How often signatures occur alone (``with_signature`` null) and together.

    Pairs come from one row's own hits, at most one per pair of signatures, so
    the pair list of a row is bounded by the catalogue and no self join is needed.
    """
    hits = signatures(df.select(text_col), text_col, sigs).select("signatures")
    pairs = F.flatten(F.transform("signatures", lambda a, i: F.concat(
        F.array(F.struct(a.alias("signature"), F.lit(None).cast("string").alias("with_signature"))),
        F.transform(F.slice("signatures", i + 2, F.size("signatures")),
                    lambda b: F.struct(a.alias("signature"), b.alias("with_signature"))))))
    return (hits.where(F.size("signatures") > 0).select(F.inline(pairs))
            .groupBy("signature", "with_signature").agg(F.count("*").alias("n")))


def signatures_expression(text: str, sigs: Sequence[Signature] = SIGNATURES) -> str:
    """The hit list as one SQL expression, for callers that have no DataFrame stages."""
    has = {w: f"contains(lower({text}), {sql_string(w)})" for w in _literals(sigs)}
    listed = ", ".join(f"if(coalesce({_flag(s, text, has, f'lower({text})')}, false), {sql_string(s.id)}, NULL)" for s in sigs)
    return f"array_compact(array({listed}))"


def confidence_sql(hits: str, structural_ids: str) -> str:
    """Score of a hit list; ``structural_ids`` lists quoted ids."""
    n = f"size({hits})"
    bonus = f"arrays_overlap({hits}, array({structural_ids}))" if structural_ids else "false"
    score = (
        f"{fixed.CONFIDENCE_BASE}D + least({n} * {fixed.CONFIDENCE_PER_HIT}D, {fixed.CONFIDENCE_HIT_CAP}D)"
        f" + if({bonus}, {fixed.CONFIDENCE_STRUCTURAL}D, 0D)"
        f" + if({n} >= {fixed.CONFIDENCE_MULTIPLE_FROM}, {fixed.CONFIDENCE_MULTIPLE}D, 0D)"
    )
    return f"CASE WHEN {n} > 0 THEN least(round({score}, 4), {fixed.CONFIDENCE_MAX}D) END"


def confidence(hits: str, structural: Sequence[str] | None = None) -> Column:
    """Score of a hit-list column; null without hits."""
    ids = structural if structural is not None else [s.id for s in SIGNATURES if s.layer == "structural"]
    return F.expr(confidence_sql(name(hits), ", ".join(map(sql_string, ids))))
