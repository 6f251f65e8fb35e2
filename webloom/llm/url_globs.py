"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed, one after another, into masks of as many 64-bit words as they need. A
state stands before each character that a rule asks for; "*" is a loop on the state before it. One
step on character c takes every state of every rule at once: D = (shift(D) & B[c]) | (D & LOOPS),
the shift carrying between words (Shift-And with gaps). The URLs of a slice step together; how many
they are follows from the size of the masks, so memory doesn't grow with the rules times the URLs. A rule
matches if its last state is set when the URL ends: rules are anchored at both ends.

Rules: "*" any run, "?" one character, "[abc]", "[a-z]", "[!x]" one of (or none of) a set, "\\" takes
the next character as it is. Characters beyond ASCII are matched by their UTF-8 bytes.

URLs are first made canonical: white space around them, the fragment, tracking parameters, default
ports and an empty query go; scheme and host are lower case; an empty path is "/".

Defined cases: a null URL has null canonical form and is denied ("null"); an empty one is "" ; a rule
without states ("") matches the empty URL only; a URL that a deny rule matches is denied even if an
allow rule matches; with allow rules, what none of them matches is denied; repeated rows are judged
each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import named, small_batches
from webloom.llm.wordpieces import flat_bytes

DENY = (
    "*://spam-farm.*",
    "*://*.spam-farm.*",
    "*cheap-pills*",
    "*casino*",
    "*://*/login*",
    "*://*/wp-admin/*",
    "*.[jJ][pP][gG]",
    "*.png",
    "*.exe",
    "*.zip",
    "*[?&]sessionid=*",
    "*://*:[0-9]*/*",
)
ALLOW = ("http://*", "https://*")
#: Bytes of the states and hits of the URLs that step together.
MASK_BYTES = 32_000_000
TRACKING = "utm_[a-z]+|fbclid|gclid|mc_cid|mc_eid|ref"


def canonical(url: Column) -> Column:
    url = F.regexp_replace(url, r"^\s+|\s+$", "")
    url = F.regexp_replace(url, r"#.*$", "")
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    tail = F.substr(url, F.length(head) + 1)
    head = F.regexp_replace(F.regexp_replace(F.lower(head), r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    tail = F.regexp_replace(tail, rf"([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+", "$1")
    tail = F.regexp_replace(tail, r"[?&]+$", "")
    return F.concat(head, F.when((head != "") & ~tail.startswith("/"), F.lit("/")).otherwise(F.lit("")), tail)


@dataclass(frozen=True)
class Globs:
    """by: for each byte the states that it enters; loops, starts, ends: masks. [..., words]."""

    by: np.ndarray
    loops: np.ndarray
    starts: np.ndarray
    ends: list[int]

    @classmethod
    def pack(cls, rules) -> Globs:
        by: list[set[int]] = [set() for _ in range(256)]
        loops, starts, ends, state = [], [], [], 0
        for rule in rules:
            starts.append(state)
            for kind, chars in _parts(rule):
                if kind == "*":
                    loops.append(state)
                else:
                    state += 1
                    for c in chars:
                        by[c].add(state)
            ends.append(state)
            state += 1
        words = state // 64 + 1

        def mask(states) -> np.ndarray:
            out = np.zeros(words, np.uint64)
            for s in states:
                out[s >> 6] |= np.uint64(1) << np.uint64(s & 63)
            return out

        return cls(np.stack([mask(b) for b in by]), mask(loops), mask(starts), ends)

    def match(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[URL, rule]: whether it matches."""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")  # those that go on are the first ones
        d = np.tile(self.starts, (len(length), 1))
        begin, size = offsets[:-1][order], length[order]
        for at in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -at))  # URLs longer than at
            now = d[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            d[:n] = moved & self.by[raw[begin[:n] + at]] | now & self.loops
        out = np.empty((len(length), len(self.ends)), bool)
        for i, e in enumerate(self.ends):
            out[order, i] = (d[:, e >> 6] >> np.uint64(e & 63) & np.uint64(1)).astype(bool)
        return out


def _parts(rule: str) -> Iterator[tuple[str, list[int]]]:
    """("*", []) or ("", the bytes that may come)."""
    b, at = rule.encode(), 0
    while at < len(b):
        c = b[at : at + 1]
        close = b.find(b"]", at + 2 + (b[at + 1 : at + 2] == b"!")) if c == b"[" else -1
        if c == b"*":
            yield "*", []
        elif c == b"?":
            yield "", list(range(256))
        elif c == b"\\" and at + 1 < len(b):
            at += 1
            yield "", [b[at]]
        elif close > 0:
            body, out = b[at + 1 : close], set()
            wrong = body.startswith(b"!")
            body, i = body[wrong:], 0
            while i < len(body):
                if body[i + 1 : i + 2] == b"-" and i + 2 < len(body):
                    out.update(range(body[i], body[i + 2] + 1))
                    i += 3
                else:
                    out.add(body[i])
                    i += 1
            yield "", sorted(set(range(256)) - out if wrong else out)
            at = close
        else:
            yield "", [b[at]]
        at += 1


def _judge(deny, allow):
    kind = T.StructType([T.StructField("denied_by", T.StringType()), T.StructField("allowed_by", T.StringType())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        globs, rules = Globs.pack([*deny, *allow]), [*deny, *allow]
        names = pa.array(rules + [None], pa.string())
        most = max(1, MASK_BYTES // (3 * 8 * len(globs.loops) + len(rules)))
        for urls in batches:
            found = [np.zeros((0, 2), np.int64)]
            for at in range(0, len(urls), most):
                hit = globs.match(*flat_bytes(urls.slice(at, most)))
                first = lambda m, base: np.where(m.any(1), m.argmax(1) + base, len(rules)) if m.shape[1] else np.full(len(m), len(rules))
                found.append(np.stack([first(hit[:, : len(deny)], 0), first(hit[:, len(deny) :], len(deny))], axis=1))
            by = np.concatenate(found)
            yield pa.StructArray.from_arrays([names.take(pa.array(by[:, i])) for i in (0, 1)], names=["denied_by", "allowed_by"])

    return F.arrow_udf(run, kind)


def judged(pages: DataFrame, *, deny=DENY, allow=ALLOW) -> DataFrame:
    """page_id, url (canonical), denied_by (the first such rule), keep."""
    small_batches(pages.sparkSession)
    rows = pages.select(named(pages, "page_id").alias("page_id"), canonical(named(pages, "url")).alias("url"))
    rows = rows.withColumn("m", _judge(tuple(deny), tuple(allow))("url"))
    reason = F.when(F.col("url").isNull(), F.lit("null")).when(F.col("m.denied_by").isNotNull(), F.col("m.denied_by"))
    if allow:
        reason = reason.when(F.col("m.allowed_by").isNull(), F.lit("no allow rule"))
    return rows.select("page_id", "url", reason.alias("denied_by"), reason.isNull().alias("keep"))


def oracle(deny=DENY, allow=ALLOW) -> str:
    tail = r"regexp_replace(regexp_replace(substr(u, length(h) + 1), '([?&])(?:(?:" + TRACKING + r")=[^&]*(?:&|$))+', '\1', 'g'), '[?&]+$', '')"
    cases = " ".join(f"WHEN url GLOB '{g}' THEN '{g}'" for g in deny)
    ok = " OR ".join(f"url GLOB '{g}'" for g in allow)
    return rf"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(url, '^\s+|\s+$', '', 'g'), '#.*$', '') AS u FROM pages),
b AS (SELECT *, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1) AS h FROM a),
c AS (SELECT page_id, h, regexp_replace(regexp_replace(lower(h), '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') AS h2, {tail} AS t FROM b),
d AS (SELECT page_id, h2 || CASE WHEN h2 <> '' AND NOT starts_with(t, '/') THEN '/' ELSE '' END || t AS url FROM c),
e AS (SELECT page_id, url, CASE WHEN url IS NULL THEN 'null' {cases} WHEN NOT ({ok}) THEN 'no allow rule' END AS denied_by FROM d)
SELECT page_id, url, denied_by, denied_by IS NULL AS keep FROM e"""
