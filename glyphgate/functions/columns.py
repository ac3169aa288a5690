"""Scalar column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from glyphgate.functions import fixed, regex


ASTRAL = r"[\x{10000}-\x{10FFFF}]"
NOT_ASTRAL = r"[^\x{10000}-\x{10FFFF}]"


def utf16_length_sql(text: str) -> str:
    """UTF-16 units of a text: characters outside the BMP count twice; plain ASCII is not searched for them."""
    return (f"(length({text}) + if(octet_length({text}) = length({text}), 0,"
            f" length(regexp_replace({text}, {sql_string(NOT_ASTRAL)}, ''))))")


def utf16_spread_sql(text: str) -> str:
    """The text with two private-use characters for each one outside the BMP, so that distances count units."""
    return (f"if(octet_length({text}) = length({text}), {text},"
            f" regexp_replace({text}, {sql_string(ASTRAL)}, '\ue000\ue000'))")


def trim_wide(c: Column) -> Column:
    """Trim every ECMAScript blank, not just U+0020."""
    return F.regexp_replace(c, rf"^{regex.SPACE}+|{regex.SPACE}+\z", "")


def is_valid_input(c: Column) -> Column:
    return F.coalesce(c.rlike(rf"[^\s{regex.WIDE_SPACE}]"), F.lit(False))


def bearer(header: Column) -> Column:
    """Token of an ``Authorization`` header; null when missing or empty."""
    token = F.when(F.lower(F.substring(header, 1, 7)) == "bearer ", trim_wide(F.substr(header, F.lit(8))))
    return F.nullif(token, F.lit(""))


def key_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def key_prefix(c: Column, n: int = fixed.KEY_PREFIX_LENGTH) -> Column:
    return F.concat(F.left(c, F.lit(n)), F.lit("..."))


def client_ip(forwarded: Column, fallback: Column | None = None) -> Column:
    """First hop of the forwarding header, else the peer address, else 'unknown'."""
    first = F.when(F.length(forwarded) > 0, trim_wide(F.substring_index(forwarded, ",", 1)))
    rest = [F.nullif(fallback, F.lit(""))] if fallback is not None else []
    return F.coalesce(first, *rest, F.lit("unknown"))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def iso_millis(ts: Column) -> Column:
    """ISO text in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def norm_email(c: Column) -> Column:
    return trim_wide(F.lower(c))


def is_email_shape(c: Column) -> Column:
    return F.coalesce(c.rlike(regex.java(fixed.EMAIL_SHAPE)), F.lit(False))


def lookup(mapping: Mapping[str, object], key: Column) -> Column:
    """Value of a fixed mapping, null when the key is unknown."""
    entries = ", ".join(sql_string(x) if isinstance(x, str) else str(x) for pair in mapping.items() for x in pair)
    return F.try_element_at(F.expr(f"map({entries})"), key)


def mask(v: Column) -> Column:
    """Hide the middle of a value; never echoes the raw value."""
    n = F.length(v)
    short = F.concat(F.left(v, F.lit(1)), F.repeat(F.lit("*"), F.greatest(n - 1, F.lit(1))))
    long = F.concat(F.left(v, F.lit(2)), F.repeat(F.lit("*"), F.least(n - 4, F.lit(8))), F.right(v, F.lit(2)))
    return F.when(n <= 4, short).otherwise(long)


def mask_sql(v: str) -> str:
    """:func:`mask` as SQL over a lambda variable."""
    return (f"if(length({v}) <= 4, concat(left({v}, 1), repeat('*', greatest(length({v}) - 1, 1))),"
            f" concat(left({v}, 2), repeat('*', least(length({v}) - 4, 8)), right({v}, 2)))")


def sql_string(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    """A quoted column name."""
    return "`" + column.replace("`", "``") + "`"


def once(df: DataFrame, keep: Sequence[str], **computed: str) -> DataFrame:
    """Select ``keep`` and expensive computed columns so that each is evaluated once per row.

    Filters and projections that refer to a plain computed column are rewritten by the
    optimizer to repeat its expression.  As output of a one-row generator it is computed,
    kept and referred to.  Filters on the ``keep`` columns still pass below.
    """
    fields = ", ".join(f"'{alias}', {sql}" for alias, sql in computed.items())
    return df.selectExpr(*map(name, keep), f"inline(array(named_struct({fields})))")
