"""Path globs as regular expressions, compiled once on the driver.

* and ? stay within a path segment; a class may match anything; a leading **/ means any depth, the top included; a
trailing /** means strictly below. The whole key must match.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import col


class BadPattern(ValueError):
    pass


def one(char: str) -> str:
    return f"\\x{{{ord(char):x}}}"


def class_regex(text: str) -> tuple[str, int]:
    """The class that text starts with, and how long it is."""
    at, body = 1, []
    negated = text[at : at + 1] == "^"
    at += negated

    def char() -> str:
        nonlocal at
        if text[at : at + 1] == "\\":
            at += 1
        if at >= len(text):
            raise BadPattern("class without end")
        at += 1
        return text[at - 1]

    while True:
        if text[at : at + 1] == "]" and body:
            return f"[{'^' * negated}{''.join(body)}]", at + 1
        if text[at : at + 1] in ("", "]", "-"):
            raise BadPattern("bad class")
        low = char()
        if text[at : at + 1] == "-":
            at += 1
            if text[at : at + 1] in ("]", "-"):
                raise BadPattern("bad range")
            body.append(f"{one(low)}-{one(high)}" if low <= (high := char()) else "")
        else:
            body.append(one(low))


def glob_regex(glob: str) -> str:
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        if c == "[":
            regex, n = class_regex(glob[at:])
            out.append(regex)
            at += n
            continue
        if c == "\\":
            at += 1
            if at == len(glob):
                raise BadPattern("nothing after a backslash")
            out.append(one(glob[at]))
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c))
        at += 1
    return "".join(out)


def key_regex(pattern: str) -> str:
    """A regex that the whole key must match."""
    bare, deep, below = pattern, pattern.startswith("**/"), False
    bare = bare[3:] if deep else bare
    below = bare.endswith("/**")
    bare = bare[:-3] if below else bare
    if not bare:
        raise BadPattern("empty pattern")
    if "**" in bare:
        raise BadPattern("** in the middle")
    return ("(?:.*/)?" if deep else "") + glob_regex(bare) + ("/.*" if below else "")


def either(patterns: list[str]) -> str:
    return "(?s)(?:" + "|".join(map(key_regex, patterns)) + ")"


def matches(key, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Excluded keys do not match; without include patterns all others do."""
    hit = lambda patterns: col(key).rlike(rf"\A{either(patterns)}\z")
    out = F.lit(True) if not include else hit(include)
    return out & ~hit(exclude) if exclude else out
