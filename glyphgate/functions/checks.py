"""Checksum and range rules of the personal-data types.

Each rule is a SQL expression over a lambda variable that holds one matched
value, so it runs inside the array functions of the scan job.
"""

from __future__ import annotations

from glyphgate.functions import fixed

_DIGITS = "regexp_replace({v}, '[^0-9]', '')"


def _digit(text: str, i: str) -> str:
    return f"int(substring({text}, {i}, 1))"


def _one_digit_only(digits: str) -> str:
    return f"replace({digits}, left({digits}, 1), '') = ''"


def _weighted(digits: str, count: int, weight: str) -> str:
    return f"aggregate(sequence(1, {count}), 0, (t, i) -> t + {_digit(digits, 'i')} * ({weight}))"


def credit_card(v: str) -> str:
    d = _DIGITS.format(v=v)
    return f"luhn_check({d}) AND NOT {_one_digit_only(d)}"


def iban(v: str) -> str:
    turned = f"upper(concat(substring({v}, 5), left({v}, 4)))"
    step = "if(c >= 'A', r * 100 + ascii(c) - 55, r * 10 + int(c)) % 97"
    return f"aggregate(transform(sequence(1, length({v})), i -> substring({turned}, i, 1)), 0, (r, c) -> {step}) = 1"


def cpf(v: str) -> str:
    d = _DIGITS.format(v=v)
    first = f"{_weighted(d, 9, '11 - i')} * 10 % 11 % 10 = {_digit(d, '10')}"
    second = f"{_weighted(d, 10, '12 - i')} * 10 % 11 % 10 = {_digit(d, '11')}"
    return f"NOT {_one_digit_only(d)} AND {first} AND {second}"


def nhs_number(v: str) -> str:
    d = _DIGITS.format(v=v)
    # a remainder that calls for check digit 10 equals no single digit
    return f"NOT {_one_digit_only(d)} AND (11 - {_weighted(d, 9, '11 - i')} % 11) % 11 = {_digit(d, '10')}"


def nif_nie(v: str) -> str:
    number = f"int(translate(upper(left({v}, length({v}) - 1)), 'XYZ', '012'))"
    return f"substring('{fixed.NIF_LETTERS}', {number} % 23 + 1, 1) = upper(right({v}, 1))"


def ssn(v: str) -> str:
    return (f"left({v}, 3) NOT IN ('000', '666') AND left({v}, 1) <> '9'"
            f" AND substring({v}, 5, 2) <> '00' AND right({v}, 4) <> '0000'")


def passport(v: str) -> str:
    return f"{v} RLIKE '[0-9]'"


def date_of_birth(v: str, as_of_year: str) -> str:
    """Plausible day, month and year; no month lengths.  Day and month swap when only that fits."""
    part = f"split({v}, '[/-]')"
    a, b, c = (f"int({part}[{k}])" for k in range(3))
    iso = f"length({part}[0]) = 4"
    swap = f"({b} > 12 AND {a} <= 12)"
    year = f"if({iso}, {a}, if({c} >= 100, {c}, if({c} > 30, {c} + 1900, {c} + 2000)))"
    month = f"if({iso}, {b}, if({swap}, {a}, {b}))"
    day = f"if({iso}, {c}, if({swap}, {b}, {a}))"
    return (f"{month} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND 31"
            f" AND {year} BETWEEN 1900 AND {as_of_year}")


def phone(v: str) -> str:
    d = _DIGITS.format(v=v)
    return f"length({d}) BETWEEN 9 AND 15 AND NOT {_one_digit_only(d)}"
