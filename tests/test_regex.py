"""The pattern dialect: rewrites must not change what a pattern means."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glyphgate.functions import fixed, regex

ALL = fixed.STRUCTURAL + fixed.LEXICAL + fixed.PERSONAL_DATA
PIECES = [
    "reveal", "the", "your", "system", "prompt", "rules", " ", "-", ".", "\n", "é", "_", "a@b.co", "x@y", "123",
    "45", "6789", "12345678", "Z", "AB", "GB82", "WEST12345698765432", "10.0.0.1", "send", "www.", "abc-d", ".com",
    "DAN", "as your owner", "admin", "override", "says", "document", "ignore", "/", "+", "(", ")", "::", "fe80:",
    " ", "curl", "api", "GODE561231HDFRRN09", " ", "word",
]


def _python(p):
    return re.compile(p.replace(r"\z", r"\Z"), re.ASCII)


def test_tight_boundaries_equal_general_form():
    rng = random.Random(7)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(1, 12))) for _ in range(3000)]
    for _, pattern, fold in ALL:
        general = regex.java(pattern, fold)
        short = regex.tight(general)
        if short == general:
            continue
        a, b = _python(general), _python(short)
        for t in texts:
            assert [m.span() for m in a.finditer(t)] == [m.span() for m in b.finditer(t)], (pattern, t)


def test_ascii_boundary_and_wide_space():
    ssn = _python(regex.java(dict((t, p) for t, p, _ in fixed.PERSONAL_DATA)["SSN"]))
    assert ssn.search("é123-45-6789")
    assert not ssn.search("x123-45-6789")
    assert _python(regex.java(r"a\sb")).search("a b")
    assert _python(regex.java(r"a[\s.-]b")).search("a　b")
    assert not _python(regex.java(r"a.b")).search("a b")


def test_accented_case_folding():
    p = _python(regex.java("vous êtes", True))
    assert p.search("VOUS ÊTES") and p.search("vous êtes")
    assert not _python(regex.java("system", True)).search("ſystem")


def test_classes_that_differ(spark):
    def matches(pattern, text):
        return spark.range(1).select(F.lit(text).rlike(regex.java(pattern))).first()[0]

    assert not matches(r"a\Sb", "a b") and matches(r"a\Sb", "axb")
    assert matches(r"^[a&&z]$", "a") and matches(r"^[a&&z]$", "&")
    assert matches(r"a\Bb", "ab") and not matches(r"a\B ", "a b") and matches(r"^[\S]$", "x") and not matches(r"^[\S]$", " ")
    for refused in (r"\u{61}", r"\p{L}"):
        with pytest.raises(ValueError):
            regex.java(refused)
