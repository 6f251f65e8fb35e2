"""Streaming forms of the stateful frontier operators. Input: step, key or url, arrival_ms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.operators.frontier import RATE_WINDOW_MS


def dedup(requests: DataFrame, key: str = "url", *, ttl: str | None = None, time: str | None = None) -> DataFrame:
    """First of each (step, key), for ever or, with an event time, within ttl."""
    if ttl and time:
        return requests.withWatermark(time, ttl).dropDuplicatesWithinWatermark(["step", key])
    return requests.dropDuplicates(["step", key])


_OUT = "step string, seq long, arrival_ms long, admitted_ms long"


def _admit(requests: DataFrame, schema: str, function) -> DataFrame:
    rows = requests.select("step", "seq", "arrival_ms")
    return rows.groupBy("step").applyInPandasWithState(function, _OUT, schema, "append", GroupStateTimeout.NoTimeout)


def interval_gate(requests: DataFrame, interval_ms: int) -> DataFrame:
    """admitted_ms by step; the state is when the next request may go."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["arrival_ms", "seq"])
        out = []
        for t in rows["arrival_ms"].tolist():
            at = t if free is None else max(t, free)
            free = at + interval_ms
            out.append(at)
        if free is not None:
            state.update((free,))
        yield rows.assign(step=key[0], admitted_ms=out)[["step", "seq", "arrival_ms", "admitted_ms"]]

    return _admit(requests, "next_ms long", run)


def rate_limit(requests: DataFrame, per_minute: int) -> DataFrame:
    """admitted_ms by step; the state is the admissions of the last window."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["arrival_ms", "seq"])
        out = []
        for t in rows["arrival_ms"].tolist():
            at = max([t, *([hits[-per_minute] + RATE_WINDOW_MS + 1] if len(hits) >= per_minute else [])])
            hits = (hits + [at])[-per_minute:]
            out.append(at)
        state.update((hits,))
        yield rows.assign(step=key[0], admitted_ms=out)[["step", "seq", "arrival_ms", "admitted_ms"]]

    return _admit(requests, "hits array<long>", run)
