"""Dynamic JSON values as text: numbers are doubles, arrays and objects are rendered with quoted elements."""

from __future__ import annotations

import json
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Unicode White_Space property.
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trim(s: str) -> str:
    return s.strip(WHITE)


def trim_column(c: Column) -> Column:
    """trim() in the JVM."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def number_text(x: float) -> str:
    """Shortest digits that give the double again, never with an exponent."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    if x == int(x):
        return ("-" if str(x).startswith("-") and x == 0 else "") + str(int(Decimal(repr(x))))
    return format(Decimal(repr(x)), "f")


def from_json(text: str):
    """None where the text is no JSON; integers become doubles. Returns (ok, value)."""
    def bad(_):
        raise ValueError

    try:
        return True, json.loads(text, parse_int=float, parse_constant=bad)
    except (ValueError, RecursionError, TypeError):
        return False, None


def json_text(v) -> str:
    """The value as JSON, with sorted keys."""
    if isinstance(v, list):
        return "[" + ",".join(map(json_text, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(json.dumps(k) + ":" + json_text(x) for k, x in sorted(v.items())) + "}"
    return number_text(v) if isinstance(v, float) else json.dumps(v)


def quoted(v) -> str | None:
    s = stringify(v)
    return None if s is None else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def stringify(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int | float):
        return number_text(float(v))
    if isinstance(v, str):
        return v
    if isinstance(v, list):
        return "[" + ",".join(x for x in map(quoted, v) if x is not None) + "]"
    pairs = ((k, quoted(x)) for k, x in sorted(v.items(), key=lambda kv: kv[0].encode()))
    return "{" + ",".join('"' + k.replace("\\", "\\\\").replace('"', '\\"') + '":' + x for k, x in pairs if x is not None) + "}"


def json_path(path: str | None) -> list | None:
    """Keys and indices; None if the path can't be read. Grammar: $, .key, [n]."""
    if path is None:
        return []
    out: list = []
    for m in re.finditer(r"\$|\.([^.\[\]]+)|\[(\d+)\]|(.)", trim(path), re.S):
        if m[3] is not None:
            return None
        if m[1] is not None:
            out.append(m[1])
        elif m[2] is not None:
            out.append(int(m[2]))
    return out


def json_select(text: str, path: str | None):
    """(found, value)."""
    ok, v = from_json(text)
    steps = json_path(path)
    if not ok or steps is None:
        return False, None
    for s in steps:
        if isinstance(s, int) and isinstance(v, list) and s < len(v):
            v = v[s]
        elif isinstance(s, str) and isinstance(v, dict) and s in v:
            v = v[s]
        else:
            return False, None
    return True, v
