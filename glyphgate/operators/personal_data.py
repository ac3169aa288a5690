"""Personal data in a text column: candidates, checks, span resolution, redaction.

Per type, ``regexp_extract_all`` gives the matches and ``split`` by the same
pattern the gaps between them; running lengths give offsets.  Candidates that
pass their check are resolved by type priority: a span that overlaps an accepted
span of an earlier type is dropped.  Rows without any candidate stop after one or
two cheap passes, see ``_GATES``.

All loops over one text are near-linear in its number of matches, so a text with
very many entities does not stall its task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from glyphgate.functions import checks, columns, fixed, regex
from glyphgate.functions.columns import name, once, sql_string

_SPAN = "struct<s:int,e:int,p:int,v:string>"
_EMPTY = f"cast(array() AS array<{_SPAN}>)"
_CHUNK = 256
_RUN = 64


@dataclass(frozen=True)
class DataType:
    """One kind of personal data; earlier kinds win overlaps.

    ``check`` maps the name of a lambda variable to a SQL condition.  ``gate`` is a
    pattern implied by every match that passes the check; ``digit_tail`` likewise,
    but as what follows some digit of the match.  ``tail_always``: the pattern alone
    implies the digit tail, so it also holds for matches that aren't checked.
    """

    type: str
    pattern: str
    check: Callable[[str], str] | None = None
    gate: str | None = None
    digit_tail: str | None = None
    tail_always: bool = False

    @classmethod
    def custom(cls, type: str, pattern: str, ignore_case: bool = False,
               check: Callable[[str], str] | None = None) -> "DataType":
        return cls(type, regex.java(pattern, ignore_case), check)


_LOCAL = "[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]"
_GATES = {
    "EMAIL": r"@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z0-9]",
    "IPV6": r":(?::|[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:)",
    "PASSPORT": r"[A-Z][0-9A-Z]{6}",
}
_DIGIT_TAILS = {
    "IBAN": r"\d[A-Za-z0-9]{11}",
    "CREDIT_CARD": r"(?:[ -]?\d){12}",
    "IPV4": r"\.\d{1,3}\.\d{1,3}\.\d",
    "CPF": r"\d{2}\.\d{3}\.\d{3}-\d{2}",
    "CURP": r"\d{5}[HMhm][A-Za-z]{5}",
    "NHS_NUMBER": r"\d{2}[ -]?\d{3}[ -]?\d{4}",
    "NIF_NIE": r"\d{6}[A-Za-z]",
    "SSN": r"\d{2}-\d{2}-\d{4}",
    "PASSPORT": r"(?<=[A-Z]\d)",
    "DATE_OF_BIRTH": r"[/-]\d{1,2}[/-]\d",
    "PHONE": rf"\d[\s{regex.WIDE_SPACE}.-]\d{{2,4}}[\s{regex.WIDE_SPACE}.-]\d{{2}}",
}
# how a match begins: the cheapest test comes first at every place of a text
_BEGINS = {
    **dict.fromkeys(("CREDIT_CARD", "IPV4", "CPF", "NHS_NUMBER", "SSN", "DATE_OF_BIRTH"), r"\d"),
    "NIF_NIE": r"[\dXYZxyz]", "PASSPORT": "[A-Z]", "PHONE": r"[+(\d]",
}
_TAILS_BY_CHECK = ("PASSPORT",)     # a passport number holds a digit only because its check asks for one
_CHECKS = {
    "IBAN": checks.iban, "CREDIT_CARD": checks.credit_card, "CPF": checks.cpf, "NHS_NUMBER": checks.nhs_number,
    "NIF_NIE": checks.nif_nie, "SSN": checks.ssn, "PASSPORT": checks.passport, "PHONE": checks.phone,
}


def _java_pattern(kind: str, pattern: str, fold: bool) -> str:
    p = regex.tight(regex.java(pattern, fold))
    if kind == "EMAIL":
        # a match starts where its run of local characters starts (or where the last match
        # ended), so the run is taken whole: linear on long runs.  Nothing follows the labels,
        # so their loop is possessive as well, which keeps the matcher's stack flat.
        run, domain = p.split("@", 1)
        return rf"(?:(?<!{_LOCAL})|\G){run}+@{domain}+"
    if kind == "IPV6":
        return p.replace("(?i)", "(?i)(?=[A-F0-9]{0,4}:)", 1)
    if kind in _BEGINS:
        flag = "(?i)" if p.startswith("(?i)") else ""
        return f"{flag}(?={_BEGINS[kind]}){p.removeprefix(flag)}"
    return p


def data_types(as_of_year: int | None = None) -> tuple[DataType, ...]:
    """The fixed kinds in priority order.  ``as_of_year`` bounds dates of birth (default: today's year)."""
    year = str(as_of_year) if as_of_year is not None else "year(to_utc_timestamp(current_timestamp(), current_timezone()))"
    out = []
    for type_, pattern, fold in fixed.PERSONAL_DATA:
        kind = type_ if type_ != "IP_ADDRESS" else ("IPV6" if fold else "IPV4")
        check = _CHECKS.get(kind)
        if kind == "DATE_OF_BIRTH":
            def check(v, year=year):
                return checks.date_of_birth(v, year)
        out.append(DataType(type_, _java_pattern(kind, pattern, fold), check,
                            _GATES.get(kind), _DIGIT_TAILS.get(kind), kind in _DIGIT_TAILS and kind not in _TAILS_BY_CHECK))
    return tuple(out)


# --- candidates --------------------------------------------------------------

def _append(item: str, empty: str) -> tuple[str, str]:
    """Append ``item`` to ``a.full`` / ``a.tail`` in two levels: long arrays are not copied per element."""
    is_full = f"size(a.tail) >= {_CHUNK}"
    return (f"if({is_full}, concat(a.full, array(a.tail)), a.full)",
            f"concat(if({is_full}, {empty}, a.tail), array({item}))")


def _spans(pieces: str) -> str:
    """Offsets from ``(p, v, g)`` pieces: per type a running sum of gap and match lengths."""
    before = "if(x.p = a.p, a.pos, 0) + x.g"
    full, tail = _append(before, "cast(array() AS array<int>)")
    step = f"(a, x) -> named_struct('p', x.p, 'pos', {before} + length(x.v), 'full', {full}, 'tail', {tail})"
    starts = (f"aggregate({pieces}, named_struct('p', 0, 'pos', 0, 'full', cast(array() AS array<array<int>>),"
              f" 'tail', cast(array() AS array<int>)), {step}, a -> concat(flatten(a.full), a.tail))")
    return (f"zip_with({pieces}, {starts},"
            " (x, s) -> named_struct('s', s, 'e', s + length(x.v), 'p', x.p, 'v', x.v))")


def _numeric_gate(body: str, types: Sequence[DataType]) -> str:
    tails = [t.digit_tail for t in types if t.digit_tail]
    return f"{body} RLIKE {sql_string(rf'\d(?:{"|".join(tails)})')}" if tails else "false"


def _matches(t: DataType, body: str, numeric: str) -> str:
    """All matches of a type, null where its gate says there are none."""
    found = f"regexp_extract_all({body}, {sql_string(t.pattern)}, 0)"
    if t.digit_tail:
        return f"CASE WHEN {numeric} AND {body} RLIKE {sql_string(rf'\d{t.digit_tail}')} THEN {found} END"
    return f"CASE WHEN {body} RLIKE {sql_string(t.gate)} THEN {found} END" if t.gate else found


def _pieces(types: Sequence[DataType], body: str, ref: Callable[[int], str]) -> str:
    """Matches ``v`` of all types ``p`` with the length ``g`` of the gap before; ``ref(i)`` names the matches of type i."""
    def of_type(i: int, t: DataType) -> str:
        gaps = f"split({body}, {sql_string(t.pattern)}, -1)"
        return (f"CASE WHEN size({ref(i)}) > 0 THEN zip_with({ref(i)}, {gaps},"
                f" (v, g) -> named_struct('p', {i + 1}, 'v', v, 'g', length(g))) END")

    any_match = " OR ".join(f"coalesce(size({ref(i)}), 0) > 0" for i in range(len(types)))
    listed = ", ".join(of_type(i, t) for i, t in enumerate(types))
    # the gap after the last match has no match to go with
    return f"CASE WHEN {any_match} THEN filter(flatten(array_compact(array({listed}))), x -> x.v IS NOT NULL) END"


def _with_pieces(df: DataFrame, text: str, types: Sequence[DataType], when: Column | None,
                 checked: bool = True) -> DataFrame:
    """Stage column ``__pieces``."""
    keep = df.columns
    if not checked:  # a digit tail may be implied by the check only
        types = [t if t.tail_always else replace(t, digit_tail=None) for t in types]
    body = name(text)
    if when is not None:
        df, body = df.select("*", F.when(when, F.col(body)).alias("__body")), "__body"
    df = df.selectExpr("*", f"{_numeric_gate(body, types)} AS __numeric")
    staged = once(df, [*keep, *({"__body"} & {body})],
                  **{f"__m_{i}": _matches(t, body, "__numeric") for i, t in enumerate(types)})
    return once(staged, keep, __pieces=_pieces(types, body, lambda i: f"__m_{i}"))


def _checked(spans: str, types: Sequence[DataType]) -> str:
    rules = " ".join(f"WHEN {i + 1} THEN {t.check('x.v')}" for i, t in enumerate(types) if t.check)
    return f"filter({spans}, x -> CASE x.p {rules} ELSE true END)" if rules else spans


def _candidates(types: Sequence[DataType], checked: bool, pieces: str = "__pieces") -> str:
    spans = _spans(pieces)
    return f"CASE WHEN size({pieces}) > 0 THEN {_checked(spans, types) if checked else spans} END"


def candidates(df: DataFrame, text_col: str = "text", types: Sequence[DataType] | None = None,
               out_col: str = "candidates", checked: bool = False) -> DataFrame:
    """Add every pattern match with its offsets (code points), before overlap resolution.

    ``checked`` keeps only those that pass the check of their type.
    """
    types = types or data_types()
    keep = df.columns
    staged = once(_with_pieces(df, text_col, types, None, checked), keep, __c=_candidates(types, checked))
    return staged.selectExpr(
        *map(name, keep),
        f"transform(coalesce(__c, {_EMPTY}), x -> named_struct('type', {_type_of('x.p', types)}, 'priority', x.p,"
        f" 'value', x.v, 'start', x.s, 'end', x.e)) AS {name(out_col)}")


# --- resolution ----------------------------------------------------------------

def _resolve(c: str) -> str:
    """Accepted spans of a start-sorted candidate array, by priority.

    Without any overlap the array is accepted as it is.  Otherwise it is cut into runs of
    spans that touch each other, and each run (a handful of spans) is settled on its own.
    """
    empty_run, empty_runs = _EMPTY, f"cast(array() AS array<array<{_SPAN}>>)"
    full, tail = _append("a.run", empty_runs)
    new_run = "x.s >= a.reach"
    runs = (
        f"aggregate({c}, named_struct('reach', 0, 'run', {empty_run},"
        f" 'full', cast(array() AS array<array<array<{_SPAN}>>>), 'tail', {empty_runs}),"
        f" (a, x) -> named_struct('reach', greatest(a.reach, x.e),"
        f" 'run', if({new_run}, array(x), concat(a.run, array(x))),"
        f" 'full', if({new_run}, {full}, a.full), 'tail', if({new_run}, {tail}, a.tail)),"
        f" a -> concat(flatten(a.full), a.tail, array(a.run)))"
    )
    by_priority = "array_sort(transform(r, y -> named_struct('p', y.p, 's', y.s, 'e', y.e, 'v', y.v)))"
    accepted = (
        f"aggregate({by_priority}, cast(array() AS array<struct<p:int,s:int,e:int,v:string>>),"
        " (b, y) -> if(exists(b, z -> z.s < y.e AND y.s < z.e), b, concat(b, array(y))))"
    )
    settled = (f"if(size(r) <= 1, r, array_sort(transform({accepted},"
               " y -> named_struct('s', y.s, 'e', y.e, 'p', y.p, 'v', y.v))))")
    clash = (f"exists(zip_with(slice({c}, 1, size({c}) - 1), slice({c}, 2, size({c})),"
             f" (x, y) -> x.e > y.s), b -> b)")
    return f"if(size({c}) > 1 AND {clash}, flatten(transform({runs}, r -> {settled})), {c})"


def find(df: DataFrame, text_col: str = "text", types: Sequence[DataType] | None = None,
         when: Column | None = None, out_col: str = "__found") -> DataFrame:
    """Add the accepted spans ``array<struct<s,e,p,v>>`` in position order (code points, raw values)."""
    types = types or data_types()
    keep = df.columns
    pieces = _with_pieces(df, text_col, types, when)
    ordered = once(pieces, keep, __c=f"array_sort({_candidates(types, True)})")
    return once(ordered, keep, **{out_col: f"CASE WHEN size(__c) > 0 THEN {_resolve('__c')} ELSE {_EMPTY} END"})


def _type_of(p: str, types: Sequence[DataType]) -> str:
    return f"element_at(array({', '.join(sql_string(t.type) for t in types)}), {p})"


_ASTRAL = r"[\x{10000}-\x{10FFFF}]"
_NOT_ASTRAL = r"[^\x{10000}-\x{10FFFF}]"


def entities(found: str, text: str, types: Sequence[DataType] | None = None,
             offsets: str = "utf16", masked: bool = True) -> Column:
    """Public entity array ``type, value, start, end`` from the span column ``found`` of ``text``.

    ``offsets='utf16'`` counts UTF-16 units: characters outside the BMP before a
    position count twice; only texts that hold any pay for it.
    """
    if offsets not in ("utf16", "codepoint"):
        raise ValueError(f"offsets must be 'utf16' or 'codepoint', not {offsets!r}")
    types = types or data_types()
    spans, body = name(found), name(text)

    def build(at: Callable[[str], str]) -> str:
        return (f"transform({spans}, x -> named_struct('type', {_type_of('x.p', types)},"
                f" 'value', {columns.mask_sql('x.v') if masked else 'x.v'}, 'start', {at('x.s')}, 'end', {at('x.e')}))")

    plain = build(lambda p: p)
    if offsets == "codepoint":
        return F.expr(plain)
    def count(part: str) -> str:
        return f"length(regexp_replace({part}, {sql_string(_NOT_ASTRAL)}, ''))"

    def at(p: str) -> str:
        return f"{p} + w + {count(f'substring(c.t, 1, {p} - c.b)')}"

    shifted = build(at).replace(f"transform({spans},", "transform(c.run,", 1)
    wide = f"flatten({_by_chunk(spans, body, f'transform(array({count(f"substring({body}, 1, c.b)")}), w -> {shifted})[0]')})"
    return F.expr(f"CASE WHEN size({spans}) > 0 AND {body} RLIKE {sql_string(_ASTRAL)} THEN {wide} ELSE {plain} END")


def _by_chunk(spans: str, body: str, inner: str) -> str:
    """``inner`` per run of spans, with ``c``: the spans ``run``, the text ``t`` around them and its offset ``b``.

    Positions in a string are found by counting from its start, so a text with very many
    spans is cut into pieces first.
    """
    first = f"k * {_RUN}"
    begin = f"if(k = 0, 0, {spans}[{first} - 1].e)"
    end = f"{spans}[least(size({spans}), {first} + {_RUN}) - 1].e"
    chunk = (f"named_struct('b', {begin}, 't', substring({body}, {begin} + 1, {end} - {begin}),"
             f" 'run', slice({spans}, {first} + 1, {_RUN}))")
    return (f"transform(sequence(0, int((size({spans}) - 1) div {_RUN})),"
            f" k -> transform(array({chunk}), c -> {inner})[0])")


def replace_spans(text: str, found: str, shown: str) -> Column:
    """The text with each span replaced by ``shown`` (SQL over the span ``x``); null without spans."""
    spans, body = name(found), name(text)
    cut = "if(i = 0, c.b, c.run[i - 1].e)"
    pieces = f"transform(c.run, (x, i) -> concat(substring(c.t, {cut} - c.b + 1, x.s - {cut}), {shown}))"
    whole = _by_chunk(spans, body, f"array_join({pieces}, '')")
    rest = f"substring({body}, element_at({spans}, -1).e + 1)"
    return F.expr(f"CASE WHEN size({spans}) > 0 THEN concat(array_join({whole}, ''), {rest}) END")


def redacted(text: str, found: str, types: Sequence[DataType] | None = None, mode: str = "redact") -> Column:
    """Redact in place: ``redact`` writes ``[TYPE]``, ``mask`` the masked value."""
    types = types or data_types()
    if mode == "redact":
        return replace_spans(text, found, f"concat('[', {_type_of('x.p', types)}, ']')")
    if mode == "mask":
        return replace_spans(text, found, columns.mask_sql("x.v"))
    raise ValueError(f"unknown redaction mode {mode!r}")


def entities_expression(text: str, types: Sequence[DataType] | None = None) -> str:
    """Masked entities of a text as one SQL expression, for callers that have no DataFrame stages.

    Intermediate values are bound by one-element ``transform`` calls.  Offsets count UTF-16 units.
    """
    types = types or data_types()

    def let(var: str, value: str, body: str) -> str:
        return f"transform(array({value}), {var} -> {body})[0]"

    matched = ", ".join(f"'__m_{i}', {_matches(t, text, 'true')}" for i, t in enumerate(types))
    def at(p: str) -> str:
        return f"cast({columns.utf16_length_sql(f'substring({text}, 1, {p})')} AS int)"

    public = (f"transform(found, x -> named_struct('type', {_type_of('x.p', types)}, 'value', {columns.mask_sql('x.v')},"
              f" 'start', {at('x.s')}, 'end', {at('x.e')}))")
    chosen = f"CASE WHEN size(cands) > 0 THEN {_resolve('cands')} ELSE {_EMPTY} END"
    return let("hit", f"named_struct({matched})", let(
        "parts", _pieces(types, text, lambda i: f"hit.__m_{i}"), let(
            "cands", f"array_sort({_candidates(types, True, 'parts')})", let("found", chosen, public))))


# --- tables --------------------------------------------------------------------

def personal_data(df: DataFrame, id_col: str, text_col: str = "text",
                  types: Sequence[DataType] | None = None, offsets: str = "utf16",
                  masked: bool = True) -> DataFrame:
    """Entity table ``(id, ordinal, type, value, start, end)``, one row per accepted entity."""
    types = types or data_types()
    found = find(df.select(id_col, text_col), text_col, types)
    some = found.where(F.size("__found") > 0)
    listed = some.select(id_col, entities("__found", text_col, types, offsets, masked).alias("__e"))
    return listed.select(id_col, F.posexplode("__e").alias("__pos", "__x")).select(
        id_col, (F.col("__pos") + 1).alias("ordinal"), "__x.type", "__x.value", "__x.start", "__x.end")


def redact(df: DataFrame, text_col: str = "text", types: Sequence[DataType] | None = None,
           mode: str = "redact", out_col: str = "redacted") -> DataFrame:
    """Add the redacted text; null where the text holds no personal data."""
    types = types or data_types()
    keep = [F.col(f"`{c}`") for c in df.columns]
    found = find(df, text_col, types)
    return found.select(*keep, redacted(text_col, "__found", types, mode).alias(out_col))


def profile(df: DataFrame, id_col: str, text_col: str, by: Sequence[str],
            types: Sequence[DataType] | None = None) -> DataFrame:
    """Entities and affected texts per group and type.

    Counted inside the row first: each text yields one row per type it holds, so no
    distinct aggregate is needed.
    """
    types = types or data_types()
    found = find(df.select(id_col, *by, text_col), text_col, types).where(F.size("__found") > 0)
    names = list(dict.fromkeys(t.type for t in types))
    counts = ", ".join(f"named_struct('type', {sql_string(n)}, 'k', size(filter(__kinds, k -> k = {sql_string(n)})))"
                       for n in names)
    return (found.selectExpr(*map(name, by), f"transform(__found, x -> {_type_of('x.p', types)}) AS __kinds")
            .selectExpr(*map(name, by), f"inline(filter(array({counts}), c -> c.k > 0))")
            .groupBy(*by, "type")
            .agg(F.sum("k").alias("entities"), F.count("*").alias("texts")))


def overlaps(df: DataFrame, id_col: str, text_col: str = "text",
             types: Sequence[DataType] | None = None, width: int = 64) -> DataFrame:
    """Pairs of checked candidates of different types that overlap.

    Each span is filed under the ``width``-sized cells it covers; the few spans of a cell are
    paired in one row, and a pair is reported only in the cell where its overlap begins.
    Texts are read once and spans shuffled once.
    """
    types = types or data_types()
    spans = (candidates(df.select(id_col, text_col), text_col, types, "c", checked=True)
             .where(F.size("c") > 1).select(id_col, F.explode("c").alias("x")).select(id_col, "x.*")
             .withColumn("cell", F.explode(F.expr(f"sequence(start div {width}, (end - 1) div {width})"))))
    cells = (spans.groupBy(id_col, "cell").agg(F.collect_list(F.struct("type", "priority", "start", "end")).alias("c"))
             .where("size(c) > 1").select(id_col, "cell", "c", F.explode("c").alias("l")))
    met = ("filter(c, r -> l.priority < r.priority AND l.start < r.end AND r.start < l.end"
           f" AND cell = greatest(l.start, r.start) div {width})")
    return cells.select(id_col, "l", F.explode(F.expr(met)).alias("r")).select(
        id_col, *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "lr" for c in ("type", "start", "end")])
