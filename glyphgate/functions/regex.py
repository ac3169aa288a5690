"""Pattern dialects.

The fixed patterns follow ECMAScript rules.  Spark runs ``java.util.regex``,
which differs in places that change results:

* ``\\b`` is Unicode-aware up to Java 18 -> spelled with ASCII look-arounds,
* ``\\s`` and ``\\S`` know ASCII blanks only -> spelled as an explicit class,
* ``&&`` in a class intersects -> escaped,
* ``.`` also stops at U+0085 and ``$`` also matches before a final newline,
* ``(?i)`` folds ASCII only -> accented letters list both cases.
"""

from __future__ import annotations

import re

# members of the ECMAScript white-space class beyond Java's \s
WIDE_SPACE = r"\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = rf"[\s{WIDE_SPACE}]"
_WORD = "[0-9A-Za-z_]"
WORD_START = _ENTER = rf"(?<!{_WORD})"
_LEAVE = rf"(?!{_WORD})"
_OPENS = re.compile(r"(?:\(\?:)*(?:[A-Za-z0-9]|\\d|\[[A-Z])")
BOUNDARY = rf"(?:(?<={_WORD}){_LEAVE}|{_ENTER}(?={_WORD}))"
INSIDE = rf"(?:(?<={_WORD})(?={_WORD})|{_ENTER}{_LEAVE})"


def java(pattern: str, ignore_case: bool = False) -> str:
    """Rewrite an ECMAScript pattern for ``rlike`` / ``regexp_*`` in Spark.

    Raises ValueError for ``\\u{...}`` and ``\\p{...}``, whose meaning depends on a flag that patterns here don't have.
    """
    out = ["(?i)"] if ignore_case else []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            pair = pattern[i:i + 2]
            i += 2
            if pair == r"\s":
                out.append(rf"\s{WIDE_SPACE}" if in_class else SPACE)
            elif pair == r"\S":
                out.append(rf"[^\s{WIDE_SPACE}]")
            elif pair == r"\b" and not in_class:
                out.append(BOUNDARY)
            elif pair == r"\B" and not in_class:
                out.append(INSIDE)
            elif pair in (r"\u", r"\p", r"\P") and pattern[i:i + 1] == "{":
                raise ValueError(f"{pair}{{...}} can't be translated")
            else:
                out.append(pair)
            continue
        i += 1
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
        elif ch in "[&":
            out.append("\\" + ch)
        elif ch == "]" and in_class:
            in_class = False
            out.append(ch)
        elif ch == "." and not in_class:
            out.append(r"[^\n\r\u2028\u2029]")
        elif ch == "$" and not in_class:
            out.append(r"\z")
        elif ignore_case and ord(ch) > 127 and ch.upper() != ch.lower():
            both = ch.lower() + ch.upper()
            out.append(both if in_class else f"[{both}]")
        else:
            out.append(ch)
    return "".join(out)


def plain_bounds(pattern: str) -> str:
    """Shorten boundaries beside a plain ASCII letter, digit or underscore: there one look-around says the same.

    The character has to come once at least, and not as part of an escape.
    """
    first, *rest = pattern.split(BOUNDARY)
    out = first
    for part in rest:
        if re.match(r"[0-9A-Za-z_](?![?*{])", part):
            out += _ENTER + part
        elif re.search(r"(?:^|[^\\]{5})[0-9A-Za-z_]\Z", out):
            out += _LEAVE + part
        else:
            out += BOUNDARY + part
    return out


def tight(pattern: str) -> str:
    """Shorten boundaries whose word side is certain.

    Only for the fixed patterns: there a ``\\b`` before a letter, digit or group
    of words always opens a word, and one after a letter, digit or group always
    closes one (``tests/test_regex.py`` compares both forms).  User patterns keep
    the general form.
    """
    first, *rest = pattern.split(BOUNDARY)
    out = first
    for part in rest:
        body = out.removeprefix("(?i)")
        after_word = body.endswith((")", "]", r"\d")) or body[-1:].isalnum() or body.endswith("}") and not part
        if _OPENS.match(part) and not after_word:
            out += _ENTER + part
        elif after_word:
            out += _LEAVE + part
        else:
            out += BOUNDARY + part
    return out
