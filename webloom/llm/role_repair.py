"""Chat formatting by minimum-cost role repair.

The legal sequences of a conversation are those of an automaton: an optional system turn, then user
and assistant in turn, beginning with user and ending with assistant. For each conversation dynamic
programming over (turns read, state of the automaton) chooses, at least total cost, for every turn to
keep its role, to give it another (relabel), to merge it into the turn before, which must have its
role after any relabelling, and where to put empty turns; then the repaired turns are rendered.

Conversations with the same short sequence of roles share one plan. One shuffle brings the turns of a
conversation together; nothing else moves. A conversation is one cell of the result, so all of it meets
in one task. What looks like a marker in a text is escaped: "<|" is rendered as "<\\|" and each "<", backslashes, "|"
with one more backslash, so that a text forges no turn and can be read back.

Defined cases: roles are compared trimmed and in lower case, and common names map to the three (human
-> user, bot, gpt, model -> assistant); a null or unknown role must be relabelled; a null text is an
empty one; turns with the same number are in the order of their role and text, and repeated rows are
turns of their own; null turn numbers come first; a row with a null conv_id is a conversation of its own; ties
of cost go to the earlier of keep, merge, relabel, insert; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import named, small_batches

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
COST = {"merge": 2, "relabel": 3, "insert": 4}
#: Relabelling what has no known role costs this.
UNKNOWN = 1
#: state -> roles that may come next, with the state then; START has seen nothing.
NEXT = {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
ROLE_OF = {"system": "system", "user": "user", "assistant": "assistant"}
FINAL = "assistant"
_STATES = ("start", *ROLES)

Step = tuple[str, str]  # (keep | merge | relabel | merge+relabel | insert, role)


#: Plans of so many turns at most are remembered, so many of them.
SHORT, REMEMBERED = 32, 50_000


def plan(roles: tuple[str, ...]) -> tuple[int, tuple[Step, ...]]:
    """Least cost and its steps; every step but insert reads one turn."""
    return _short(roles) if len(roles) <= SHORT else _plan(roles)


@functools.lru_cache(maxsize=REMEMBERED)
def _short(roles: tuple[str, ...]) -> tuple[int, tuple[Step, ...]]:
    return _plan(roles)


def _plan(roles: tuple[str, ...]) -> tuple[int, tuple[Step, ...]]:
    best: dict[str, tuple[int, tuple | None]] = {"start": (0, None)}
    trail: list[dict[str, tuple]] = []

    def inserts(costs: dict[str, tuple[int, tuple]]) -> None:
        """Empty turns, until no state becomes cheaper."""
        changed = True
        while changed:
            changed = False
            for state in _STATES:
                if state not in costs:
                    continue
                for role, then in NEXT[state].items():
                    c = costs[state][0] + COST["insert"]
                    if role != "system" and (then not in costs or c < costs[then][0]):
                        costs[then] = (c, ("insert", role, state))
                        changed = True

    layers = [dict(best)]
    inserts(layers[0])
    for given in roles:
        now: dict[str, tuple[int, tuple]] = {}
        for state in _STATES:
            if state not in layers[-1]:
                continue
            base = layers[-1][state][0]
            for role in ROLES:
                relabel = 0 if role == given else COST["relabel"] if given in ROLES else UNKNOWN
                kind = "relabel" if relabel else "keep"
                options = [(NEXT[state][role], kind, relabel)] if role in NEXT[state] else []
                if state != "start" and ROLE_OF[state] == role:
                    options.append((state, "merge+relabel" if relabel else "merge", relabel + COST["merge"]))
                for then, what, extra in options:
                    key = (base + extra, ("keep", "merge", "relabel", "merge+relabel").index(what))
                    old = now.get(then)
                    if old is None or key < (old[0], ("keep", "merge", "relabel", "merge+relabel").index(old[1][0])):
                        now[then] = (base + extra, (what, role, state))
        inserts(now)
        layers.append(now)
    if not roles:
        return 0, ()
    steps: list[Step] = []
    at, state = len(roles), FINAL
    cost = layers[-1][FINAL][0]
    while layers[at][state][1] is not None:
        what, role, before = layers[at][state][1]
        steps.append((what, role))
        state = before
        at -= what != "insert"
    return cost, tuple(reversed(steps))


def normal(role: str | None) -> str:
    role = (role or "").strip().lower()
    return ALIASES.get(role, role)


def repair(turns: list[tuple[str | None, str | None]]) -> tuple[int, tuple[Step, ...], list[tuple[str, str]]]:
    """(cost, steps, repaired turns)."""
    cost, steps = plan(tuple(normal(r) for r, _ in turns))
    out: list[tuple[str, str]] = []
    texts = iter(turns)
    for what, role in steps:
        text = "" if what == "insert" else next(texts)[1] or ""
        if what.startswith("merge"):
            before = out.pop()[1]
            text = before + "\n" + text if before and text else before or text
        out.append((role, text))
    return cost, steps, out


_MARKER = re.compile(r"<(\\*)\|")


def escaped(text: str) -> str:
    return _MARKER.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{escaped(text)}\n<|end|>\n" for role, text in turns)


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns (before), n_repaired, cost, edits (what was done, but keep), chat."""
    c = conversations
    small_batches(c.sparkSession)
    rows = c.select(named(c, "conv_id").cast("long").alias("conv_id"), F.struct(named(c, "turn").cast("long").alias("turn"), named(c, "role").cast("string").alias("role"), named(c, "text").cast("string").alias("text")).alias("t"))
    whole = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    grouped = whole.unionByName(rows.filter("conv_id is null").select("conv_id", F.array("t").alias("turns"))).select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv, roles, texts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                cost, steps, turns = repair(list(zip(roles, texts)))
                edits = " ".join(f"{what}:{role}" for what, role in steps if what != "keep")
                out.append((conv, len(roles), len(turns), cost, edits, render(turns)))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=["conv_id", "n_turns", "n_repaired", "cost", "edits", "chat"])

    return grouped.mapInArrow(run, "conv_id long, n_turns int, n_repaired int, cost int, edits string, chat string")
