"""A Unicode regex dialect on Java's and Python's engines: no look-around, no back references (such
patterns match nothing), "$" only at the end of the text, "." all but a line feed.

Both engines backtrack. Repetition of what itself repeats, like (a+)+, may take them a time that doubles
with each sign of the text, so such patterns run in Python with a limit of TIMEOUT_S a page; a page on which one
takes longer is as one without a match."""

from __future__ import annotations

import functools
import re

_REFUSED = re.compile(r"(?<!\\)(?:\\\\)*(?:\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\k<)")


def _ends(pattern: str, end: str) -> str:
    """Unescaped $ outside classes becomes the end of the text (unless the pattern is multi-line)."""
    if re.match(r"\(\?[a-z]*m", pattern):
        return pattern
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(end if c == "$" and not inside else c)
        i += 1
    return "".join(out)


TIMEOUT_S = 1.0
_NESTED = re.compile(r"\((?:[^()\\]|\\.|\([^()]*\))*(?:[+*]|\{\d+,)(?:[^()\\]|\\.|\([^()]*\))*\)(?:[+*]|\{\d)")


def nested(pattern: str) -> bool:
    """Whether a repeated group has a repetition inside."""
    return _NESTED.search(pattern) is not None


def to_java(pattern: str, *, nesting: bool = False) -> str | None:
    """None where the dialect has no such pattern or, without ``nesting``, it needs a limit of time."""
    if _REFUSED.search(pattern) or (nested(pattern) and not nesting):
        return None
    return "(?Ud)" + _ends(pattern.replace("(?P<", "(?<"), r"\z")


def matches(pattern: str, text: str) -> list:
    """All matches, in order."""
    p = to_python(pattern)
    if p is None:
        return []
    if not nested(pattern):
        return list(p.finditer(text))
    import regex

    try:
        return list(regex.compile(p.pattern).finditer(text, timeout=TIMEOUT_S))
    except (TimeoutError, regex.error):
        return []


@functools.lru_cache(maxsize=1000)
def to_python(pattern: str) -> re.Pattern | None:
    if _REFUSED.search(pattern):
        return None
    try:
        return re.compile(_ends(re.sub(r"\(\?<(?![=!])", "(?P<", pattern).replace(r"\z", r"\Z"), r"\Z"))
    except re.error:
        return None
