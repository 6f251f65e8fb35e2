"""Schedulers: what is waiting, what is being done. A task is a FRONTIER row, known by its seq."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import frontier as ops
from webloom.schemas import FRONTIER
from webloom.tables import stored


class Scheduler(ABC):
    """All tasks that were enqueued are leased once; a leased one is in flight until it is acknowledged or,
    with nack, goes back to the front. Frames given are read later: they must be stored."""

    @abstractmethod
    def open(self, spark: SparkSession) -> None: ...

    @abstractmethod
    def enqueue(self, tasks: DataFrame) -> None: ...

    @abstractmethod
    def lease(self, now_ms: int, per_host: int, at_once: int | None) -> DataFrame | None:
        """The tasks that go next, stored; None if none is ready."""

    @abstractmethod
    def ack(self, done: DataFrame) -> None:
        """done: seq."""

    @abstractmethod
    def nack(self, failed: DataFrame) -> None:
        """failed: seq; the tasks are ready again, before all others, with one nack more."""

    @abstractmethod
    def has_pending(self) -> bool:
        """Whether any task is waiting or in flight."""

    @abstractmethod
    def next_ms(self) -> int | None:
        """When the next waiting task is ready."""

    @abstractmethod
    def pending(self) -> DataFrame:
        """All tasks waiting or in flight."""


class TableScheduler(Scheduler):
    """Tables in the shared folder. A lease reads what waits once and writes what is left; what is enqueued
    in between is a list of tables."""

    def open(self, spark: SparkSession) -> None:
        self.spark = spark
        self.waiting: list[DataFrame] = []
        self.inflight: list[DataFrame] = []

    def _all(self, parts: Iterable[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), parts, self.spark.createDataFrame([], FRONTIER))

    def enqueue(self, tasks: DataFrame) -> None:
        self.waiting.append(tasks.select(*FRONTIER.names))

    def lease(self, now_ms: int, per_host: int, at_once: int | None) -> DataFrame | None:
        queue = self._all(self.waiting)
        todo = stored(ops.leased(queue, now_ms, per_host, at_once), "wave")
        if todo.isEmpty():
            return None
        self.waiting = [stored(queue.join(todo.select("seq"), "seq", "left_anti").select(*FRONTIER.names), "frontier")]
        self.inflight.append(todo)
        return todo

    def ack(self, done: DataFrame) -> None:
        if any(d is done for d in self.inflight):  # all of a lease
            self.inflight = [d for d in self.inflight if d is not done]
            return
        left = stored(self._all(self.inflight).join(done.select("seq"), "seq", "left_anti").select(*FRONTIER.names), "inflight")
        self.inflight = [] if left.isEmpty() else [left]

    def nack(self, failed: DataFrame) -> None:
        again = self._all(self.inflight).join(failed.select("seq").distinct(), "seq", "left_semi")
        again = stored(again.withColumns({"nacks": F.col("nacks") + 1, "priority": F.lit(-1)}).select(*FRONTIER.names), "again")
        if not again.isEmpty():
            self.ack(again)
            self.enqueue(again)

    def has_pending(self) -> bool:
        return any(not d.isEmpty() for d in (*self.waiting, *self.inflight))

    def next_ms(self) -> int | None:
        if not self.waiting:
            return None
        r = self._all(self.waiting).agg(F.min(F.coalesce("ready_at_ms", F.lit(0))).alias("t")).first()
        return r.t

    def pending(self) -> DataFrame:
        return self._all([*self.waiting, *self.inflight])
