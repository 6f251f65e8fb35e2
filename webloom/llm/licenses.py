"""Licence scans.

One Aho-Corasick automaton finds identifier tags and notice phrases in every text, whatever its
length. White space, with the line-comment marks that follow a line's end, counts as one space, so
notices are found across lines. A tag's expression is read to the end of its line, comment or quotation; a shunting-yard parser brings it to postfix
(WITH binds before AND, AND before OR), which is evaluated against what is allowed. A document's
licences must all be allowed: its expressions and notices are joined by AND.

Defined cases: null and empty texts and texts without finding give no row; an expression that can't be
parsed is "invalid" and not allowed; an unknown identifier is not allowed; repeated findings count
once; a phrase inside a longer one that is found too doesn't count; repeated rows are scanned each; an
empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.llm.common import named, small_batches

TAGS = ("spdx-license-identifier:", "license-expression:")
#: Notice phrase (lower case) to identifier.
PHRASES = {
    "apache license, version 2.0": "Apache-2.0",
    "apache-2.0 license": "Apache-2.0",
    "mit license": "MIT",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
    "redistribution and use in source and binary forms, with or without modification": "BSD-3-Clause",
    "bsd 3-clause license": "BSD-3-Clause",
    "bsd 2-clause license": "BSD-2-Clause",
    "isc license": "ISC",
    "mozilla public license, version 2.0": "MPL-2.0",
    "mozilla public license, v. 2.0": "MPL-2.0",
    "gnu general public license, version 2": "GPL-2.0-only",
    "gnu general public license, version 3": "GPL-3.0-only",
    "gnu lesser general public license, version 2.1": "LGPL-2.1-only",
    "gnu lesser general public license, version 3": "LGPL-3.0-only",
    "gnu affero general public license, version 3": "AGPL-3.0-only",
    "cc by 4.0": "CC-BY-4.0",
    "cc by-sa 4.0": "CC-BY-SA-4.0",
    "cc by-nc 4.0": "CC-BY-NC-4.0",
    "cc by-nc-sa 4.0": "CC-BY-NC-SA-4.0",
    "cc by-nd 4.0": "CC-BY-ND-4.0",
    "cc0 1.0": "CC0-1.0",
    "released into the public domain": "CC0-1.0",
    "all rights reserved": "LicenseRef-all-rights-reserved",
}
ALLOWED = frozenset({"apache-2.0", "mit", "mit-0", "bsd-2-clause", "bsd-3-clause", "0bsd", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0", "bsl-1.0", "python-2.0"})
#: Notices as the Free Software Foundation words them. The SQL doesn't know them.
FSF_PHRASES = {
    f"gnu {name} version {v} as published by the free software foundation" if by is None else f"gnu {name} as published by the free software foundation{by} version {v} of the license": f"{i}-{v if '.' in v else v + '.0'}-{'or-later' if by and 'either' in by else 'only'}"
    for name, i, versions in (("general public license", "GPL", ("2", "3")), ("library general public license", "LGPL", ("2",)), ("lesser general public license", "LGPL", ("2.1", "3")), ("affero general public license", "AGPL", ("3",)))
    for v in versions
    for by in (None, ",", ";", ", either", "; either")
}
NOTICES = PHRASES | FSF_PHRASES
#: Allowed only with the exception.
ALLOWED_WITH = frozenset({("gpl-2.0-only", "classpath-exception-2.0"), ("gpl-2.0-or-later", "classpath-exception-2.0"), ("apache-2.0", "llvm-exception"), ("gpl-3.0-or-later", "gcc-exception-3.1")})

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.:+-]*)")
_FOLD = re.compile(r"[^\S\n]*\n\s*(?:(?:[/*#;%>|!]+|--+|dnl\b|rem\b)\s*)*|[^\S\n]{2,}|[^\S\n ]")
_LINE_END = re.compile(r"[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]|-->|\*/|#\}")
_BORDER = re.compile(r"\s+[-#*/%;|]+$|-+$")  # of a comment; names no licence
_QUOTES = ("'", '"', "`")


def postfix(expression: str) -> list[str]:
    """Shunting-yard. ValueError where the expression is none."""
    out: list[str] = []
    stack: list[str] = []
    operand, at = True, 0  # operand: whether one must come next
    expression = expression.strip()
    while at < len(expression):
        m = _TOKEN.match(expression, at)
        if not m:
            raise ValueError(expression)
        token, at = m[1], m.end()
        low = token.lower()
        if low in _PRECEDENCE:
            if operand:
                raise ValueError(expression)
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif token == "(":
            if not operand:
                raise ValueError(expression)
            stack.append("(")
        elif token == ")":
            if operand:
                raise ValueError(expression)
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError(expression)
            stack.pop()
        else:
            if not operand:
                raise ValueError(expression)
            out.append(token)
            operand = False
    if operand:
        raise ValueError(expression)
    while stack:
        if stack[-1] == "(":
            raise ValueError(expression)
        out.append(stack.pop())
    return out


def evaluate(rpn: list[str]) -> bool:
    """Whether a postfix expression allows the use. WITH takes two identifiers."""
    stack: list = []
    value = lambda x: x if isinstance(x, bool) else x.lower() in ALLOWED
    for token in rpn:
        if token not in _PRECEDENCE:
            stack.append(token)
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            if isinstance(left, bool) or isinstance(right, bool):
                raise ValueError(token)
            stack.append((left.lower(), right.lower()) in ALLOWED_WITH or left.lower() in ALLOWED)
        elif token == "and":
            stack.append(value(left) and value(right))
        else:
            stack.append(value(left) or value(right))
    return value(stack.pop())


def allowed(expression: str) -> bool | None:
    """None: no expression."""
    try:
        return evaluate(postfix(expression))
    except ValueError:
        return None


@functools.lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word in (*TAGS, *NOTICES):
        a.add_word(word, word)
    a.make_automaton()
    return a


def expression_of(text: str, start: int, end: int) -> str:
    """The whole expression after the tag at start to end, whatever it has; postfix says whether it is one."""
    stop = _LINE_END.search(text, end)
    line = text[end : stop.start() if stop else len(text)].strip()
    before = text[max(start - 1, 0) : start]
    if before in _QUOTES and before:
        line = line.partition(before)[0]  # the quotation that the tag is in
    elif line[:1] in _QUOTES and line and line.rstrip(",;").endswith(line[0]):
        line = line.rstrip(",;")[1:-1]
    line = line.rstrip("".join(_QUOTES) + " \t")
    return " ".join(_BORDER.sub("", line).split())


def folded(text: str) -> tuple[str, list[int], list[int]]:
    """The text with each space of _FOLD as one, and after each fold its place there and here."""
    parts, there, here, at, n = [], [], [], 0, 0
    for m in _FOLD.finditer(text):
        parts.append(text[at : m.start()])
        n += m.start() - at + 1
        at = m.end()
        there.append(n)
        here.append(at)
    return " ".join([*parts, text[at:]]), there, here


def scan(text: str) -> list[tuple[str, str]]:
    """(kind, expression or identifier) of what a text says, in order of place, each once."""
    low = text.lower()
    flat, there, here = folded(low)
    hits = [(end - len(word) + 1, end + 1, word) for end, word in automaton().iter(flat)]
    hits.sort(key=lambda h: (h[0], -h[1]))
    found, upto = [], 0
    for a, b, word in hits:
        if b <= upto:
            continue
        upto = max(upto, b)
        if word in NOTICES:
            found.append(("notice", NOTICES[word]))
        else:
            line = low if len(low) != len(text) else text  # some lower-case forms are longer
            k = bisect.bisect_right(there, a)  # a tag has no white space: one fold's shift is that of all of it
            shift = here[k - 1] - there[k - 1] if k else 0
            found.append(("tag", expression_of(line, a + shift, b + shift)))
    return list(dict.fromkeys(found))


def scans(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (sorted, joined by AND), n_tags, n_notices, verdict (allowed, denied,
    invalid) for each document that names a licence."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, licenses string, n_tags int, n_notices int, verdict string"
    rows = docs.select(named(docs, "doc_id").cast("long").alias("doc_id"), named(docs, "text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                found = scan(text.as_py() or "")
                if not found:
                    continue
                names = sorted({x if kind == "notice" or re.fullmatch(r"\S*", x) else f"({x})" for kind, x in found})
                verdicts = [allowed(x) for _, x in found]
                verdict = "invalid" if None in verdicts else "allowed" if all(verdicts) else "denied"
                tags = sum(kind == "tag" for kind, _ in found)
                out.append((doc.as_py(), " AND ".join(names), tags, len(found) - tags, verdict))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["doc_id", "licenses", "n_tags", "n_notices", "verdict"])

    return rows.mapInArrow(run, schema)


def oracle() -> str:
    """DuckDB SQL for tables without identifier tags and FSF notices, where a phrase is in no other and on one line."""
    phrases = ", ".join("('{}', '{}', {})".format(p.replace("'", "''"), i, str(i.lower() in ALLOWED).lower()) for p, i in PHRASES.items())
    return f"""
WITH phrase(p, id, ok) AS (VALUES {phrases}),
found AS (SELECT DISTINCT d.rowid AS r, d.doc_id, id, ok FROM (SELECT row_number() OVER () AS rowid, doc_id, lower(text) AS t FROM documents) d JOIN phrase ON contains(t, p))
SELECT doc_id, string_agg(id, ' AND ' ORDER BY id) AS licenses, CAST(0 AS INTEGER) AS n_tags, CAST(count(*) AS INTEGER) AS n_notices,
       CASE WHEN bool_and(ok) THEN 'allowed' ELSE 'denied' END AS verdict
FROM found GROUP BY r, doc_id"""
