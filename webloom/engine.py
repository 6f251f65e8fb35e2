"""Crawls as waves of DataFrames.

A wave leases the next requests of the scheduler (so many a host, so many in all), runs request hooks,
fetches, runs response hooks, dispatches to the step, filters items through the pipelines and puts follow
requests on the frontier. What a wave made is written to the shared folder, which cuts the lineage and survives
lost executors. The driver sees only counts. The clock is virtual: it goes on to the next delayed
request when nothing is ready. A crawl goes on until the frontier is empty; one that max_waves or
shutdown ends before that gives what is left as Result.frontier.

A row on its way has the columns of FRONTIER and, once fetched, those of the response, whose headers and body
take the place of the request's; the request as it was asked is the struct ``request``.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.errors import EngineFailure, PluginError
from webloom.operators import frontier as ops
from webloom.operators.scheduler import Scheduler, TableScheduler
from webloom.plans import planner
from webloom.plans.rules import Compiled, Middleware, PluginRegistry, Settings, chain_of, load
from webloom.requests import Request, frame
from webloom.schemas import ERROR, FRONTIER
from webloom.sinks import Chain, ItemOutput, ItemPipeline
from webloom.sources.fetch import Fetcher, Router
from webloom.tables import stored

ITEMS = "page_url string, step string, item string"
LOG = "src_url string, link_name string, url string, meta map<string,string>"
DEAD = "url string, step string, kind string, message string"
ROUNDS = "seq long, page_url string, step string, items long, follows long"
_PENDING = "flow IS NULL"
_AFTER = (("download", "process_response"), ("spider", "process_request"), ("download", "process_exception"), ("spider", "process_response"), ("spider", "process_exception"))


class Hook:
    """A middleware: each hook gets the rows still going on and gives them columns flow (continue,
    drop, retry), flow_reason and backoff_ms, or leaves them as they are. ``error`` (kind, message) is set where
    process_exception is called. A hook of type download has its say before and after the fetch, one of
    type spider before and after the dispatch; there process_exception gets what dispatch failed on."""

    def process_request(self, rows: DataFrame) -> DataFrame:
        return rows

    def process_response(self, rows: DataFrame) -> DataFrame:
        return rows

    def process_exception(self, rows: DataFrame) -> DataFrame:
        return rows

    def acts(self, method: str) -> bool:
        return getattr(type(self), method) is not getattr(Hook, method)


class CookiesHook(Hook):
    """Does nothing."""


class ProxyHook(Hook):
    """Does nothing."""


class DedupHook(Hook):
    def __init__(self, options: dict):
        key = options.get("key", "url")
        self.key = key if key == "url" or (isinstance(key, str) and key.startswith("meta.")) else None

    def keyed(self, rows: DataFrame) -> DataFrame:
        if self.key is None:
            return rows.withColumn("_key", F.lit(None).cast("string"))
        if self.key == "url":
            return rows.withColumn("_key", F.col("url"))
        raw = F.try_element_at("meta", F.lit(self.key[5:]))
        return rows.withColumn("_key", F.when(raw.startswith('"'), raw))

    def acts(self, method: str) -> bool:
        return method == "process_request"


def _numbers(v) -> list:
    return [int(x) for x in v if isinstance(x, int | float) and not isinstance(x, bool)] if isinstance(v, list) else []


def _count(options: dict) -> int:
    """A number that is not in a list is not read."""
    n = _numbers(options.get("count"))
    return n[0] if n else 1


class StatusRetry(Hook):
    def __init__(self, options: dict):
        self.count, self.backoff, self.statuses = _count(options), _numbers(options.get("backoff_ms")), _numbers(options.get("status"))

    def process_response(self, rows: DataFrame) -> DataFrame:
        return ops.retry_by_status(rows, self.statuses, self.count, self.backoff)


class ErrorRetry(Hook):
    def __init__(self, options: dict):
        self.count, self.backoff = _count(options), _numbers(options.get("backoff_ms"))

    def process_exception(self, rows: DataFrame) -> DataFrame:
        return ops.retry_by_error(rows, self.count, self.backoff, kinds=None)


class GateHook(Hook):
    def __init__(self, options: dict, key: str):
        v = options.get(key)
        self.key, self.value = key, int(v) if isinstance(v, int | float) and not isinstance(v, bool) else 0

    def acts(self, method: str) -> bool:
        return method == "process_request" and self.value > 0


BUILT_IN: dict[str, Callable[[dict], Hook]] = {
    "retry_by_status": StatusRetry,
    "retry_by_error": ErrorRetry,
    "dedup": DedupHook,
    "interval_gate": lambda o: GateHook(o, "interval_ms"),
    "rate_limit": lambda o: GateHook(o, "rate_per_minute"),
    "cookies": lambda o: CookiesHook(),
    "proxy": lambda o: ProxyHook(),
}


def build_chain(entries: dict[str, Middleware], factories: dict[str, Callable[[dict], Hook]]) -> list[tuple[str, Middleware, Hook]]:
    """Every entry is made, those that are off too; then the ones that are on, by order (stable)."""
    made = []
    for key in sorted(entries):
        factory = BUILT_IN.get(key) or factories.get(key)
        if factory is None:
            raise EngineFailure(f"unknown middleware key: {key}")
        made.append((key, entries[key], factory(entries[key].options)))
    return sorted((m for m in made if m[1].enabled), key=lambda m: m[1].order)


Callback = Callable[[DataFrame], tuple[DataFrame | None, DataFrame | None]]


@dataclass
class Spider:
    """callbacks: name -> function of a responses DataFrame to (items: page_url, item; requests: src_url, url and
    any others of FRONTIER). What it gives belongs to the response of the same seq, if it keeps seq, else to
    the first response of that URL."""

    name: str
    start_urls: list[str] = field(default_factory=list)
    allowed_domains: list[str] = field(default_factory=list)
    rules: dict | Compiled | None = None
    callbacks: dict[str, Callback] = field(default_factory=dict)
    start_requests: list[Request] = field(default_factory=list)

    def callback(self, f: Callable) -> Callable:
        self.callbacks[f.__name__] = f
        return f

    def compiled(self) -> Compiled | None:
        return self.rules if self.rules is None or isinstance(self.rules, Compiled) else load(self.rules)

    def call(self, name: str, rows: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """A spider without a function of the name parse has no items and no requests."""
        if name in self.callbacks:
            return self.callbacks[name](rows)
        if name == "parse":
            return None, None
        raise EngineFailure(f"unknown callback: {name}")


@dataclass(frozen=True)
class Result:
    items: DataFrame
    requests: DataFrame
    dead_letter: DataFrame
    waves: int
    rounds: int  #: Responses that were dispatched without an error.
    fetches: int
    frontier: DataFrame  #: What max_waves or shutdown left undone, else empty.
    by_round: DataFrame  #: Items and follow requests of each of them: ROUNDS.


class ShutdownHandle:
    """Ends a crawl after its wave, from any thread."""

    def __init__(self) -> None:
        self._flag = threading.Event()

    def stop(self) -> None:
        self._flag.set()

    def is_stopped(self) -> bool:
        return self._flag.is_set()


class Engine:
    def __init__(self, fetcher: Fetcher, settings: Settings | None = None, scheduler: Scheduler | None = None):
        self.fetcher = fetcher if isinstance(fetcher, Router) else Router(fetcher)
        self.settings = settings or Settings()
        self.scheduler = scheduler or TableScheduler()
        self.hooks: list[tuple[int, Middleware, Hook]] = []
        self.factories: dict[str, Callable[[dict], Hook]] = {}
        self.pipelines: list[ItemPipeline | Callable[[DataFrame], DataFrame]] = []
        self.outputs: list[ItemOutput] = []
        self._stop = ShutdownHandle()
        self._inbox: list[Request | str] = []
        self._lock = threading.Lock()

    def add_middleware(self, hook: Hook, order: int = 100, *, type: str = "download", enabled: bool = True) -> Engine:
        self.hooks.append((order, Middleware(enabled, type, order), hook))
        return self

    def register_middleware(self, key: str, factory: Callable[[dict], Hook]) -> Engine:
        self.factories[key] = factory
        return self

    def with_pipeline(self, *stages: ItemPipeline | Callable[[DataFrame], DataFrame]) -> Engine:
        """In order: pipelines, or DataFrame functions that filter and change items."""
        self.pipelines += stages
        return self

    def with_output(self, *outputs: ItemOutput) -> Engine:
        self.outputs += outputs
        return self

    def load_plugins(self, registry: PluginRegistry) -> Engine:
        for p in registry.by_kind("middleware"):
            if p.name not in self.factories and p.name not in BUILT_IN:
                raise PluginError(f"no factory for middleware plugin: {p.name}")
        return self

    def shutdown(self) -> None:
        """No wave begins after this."""
        self._stop.stop()

    def shutdown_handle(self) -> ShutdownHandle:
        return self._stop

    def enqueue(self, *requests: Request | str) -> None:
        """For a crawl that goes on for ever: from any thread, for its next wave."""
        with self._lock:
            self._inbox += requests

    def run(self, spark: SparkSession, spider: Spider, *, max_waves: int | None = None, now_ms: int = 0, forever: bool = False) -> Result:
        """forever: with an empty frontier look for more every settings.idle_ms, until shutdown."""
        pipeline = Chain(*self.pipelines)
        pipeline.open(spider.name)
        try:
            return _Run(self, spark, spider, pipeline).go(max_waves, now_ms, forever)
        finally:
            pipeline.close(spider.name)

    def stream(self, requests: DataFrame, spider: Spider, items: str, checkpoint: str):
        """A crawl for each micro-batch of a stream of URLs (url): its items are appended to a table in the folder
        ``items``. Gives the query, whose stop ends it."""
        from webloom.sinks import TableOutput

        engine = Engine(self.fetcher, self.settings)
        engine.hooks, engine.factories, engine.pipelines, engine.outputs = self.hooks, self.factories, self.pipelines, [*self.outputs, TableOutput(items)]

        def batch(df: DataFrame, number: int) -> None:
            pipeline = Chain(*engine.pipelines)
            pipeline.open(spider.name)
            try:
                _Run(engine, df.sparkSession, spider, pipeline, seeds=df).go(None, 0, False)
            finally:
                pipeline.close(spider.name)

        return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


class _Run:
    """One crawl."""

    def __init__(self, engine: Engine, spark: SparkSession, spider: Spider, pipeline: ItemPipeline, seeds: DataFrame | None = None):
        self.engine, self.spark, self.spider, self.pipeline = engine, spark, spider, pipeline
        self.settings, self.scheduler = engine.settings, engine.scheduler
        self.rules = spider.compiled()
        self.steps = {s.id: s for s in self.rules.steps} if self.rules else {}
        self.names = sorted({*self.steps, "parse"})
        own = [("", m, h) for _, m, h in sorted(engine.hooks, key=lambda h: h[0]) if m.enabled]
        # the engine's own hooks go before the step's, whatever their orders
        self.chains = {n: own + build_chain(chain_of(self.settings, self.steps.get(n)), engine.factories) for n in self.names}
        self.chains[None] = own
        self.seen: list[tuple[int, DataFrame]] = []
        self.last: dict[tuple[str, str], list[int]] = {}
        self.items: list[tuple[int, DataFrame]] = []
        self.log: list[tuple[int, DataFrame]] = []
        self.dead: list[tuple[int, DataFrame]] = []
        self.done: list[tuple[int, DataFrame]] = []
        self.waves = self.rounds = self.fetches = self.top = 0  # top: all numbers so far are below
        self.scheduler.open(spark)
        if seeds is None:
            self._take([*spider.start_urls, *spider.start_requests])
        else:
            known = {c: seeds[c] for c in FRONTIER.names if c in seeds.columns and c != "seq"}
            self._follow(seeds.select(F.monotonically_increasing_id().alias("seq"), *(c.alias(n) for n, c in known.items())), ("seq",))

    def _take(self, requests: list[Request | str]) -> None:
        if requests:
            self.scheduler.enqueue(stored(frame(self.spark, requests, self.top), "frontier"))
            self.top += len(requests)

    def go(self, max_waves: int | None, now_ms: int, forever: bool) -> Result:
        engine = self.engine
        while (max_waves is None or self.waves < max_waves) and not engine._stop.is_stopped():
            if forever:
                with engine._lock:
                    new, engine._inbox = engine._inbox, []
                self._take(new)
            todo = self.scheduler.lease(now_ms, self.settings.concurrent_requests_per_domain, self.settings.concurrent_requests)
            if todo is not None:
                self.waves += 1
                self._wave(todo, now_ms)
                continue
            after = self.scheduler.next_ms()
            if after is not None:
                now_ms = max(now_ms + 1, after)
            elif not forever:
                break
            else:
                time.sleep(self.settings.idle_ms / 1000)
        empty = self.spark.createDataFrame
        items = _all(self.items) if self.items else empty([], "seq long, " + ITEMS)
        done = _all(self.done) if self.done else empty([], "seq long, page_url string, step string")
        log = _all(self.log) if self.log else empty([], "seq long, " + LOG)
        n = lambda d, name: d.groupBy("seq").agg(F.count("*").alias(name))
        by_round = done.join(n(items, "items"), "seq", "left").join(n(log, "follows"), "seq", "left").fillna(0, ["items", "follows"])
        return Result(items.drop("seq"), log.drop("seq"), _all(self.dead) if self.dead else empty([], DEAD), self.waves, self.rounds, self.fetches, self.scheduler.pending(), by_round)

    def _wave(self, todo: DataFrame, now_ms: int) -> None:
        none = F.lit(None).cast("string")
        rows = todo.withColumns({"step": F.coalesce(_text_of("next_step"), F.lit("parse")), "retries": F.coalesce(F.try_element_at("meta", F.lit("_retry_times")).cast("int"), F.lit(0)), "flow": none, "flow_reason": none, "backoff_ms": F.lit(None).cast("bigint")})
        asked = self._phase(rows, "download", "process_request", now_ms).withColumn("request", F.struct(*FRONTIER.names))
        if any(self._acting(n, "download", "process_request") for n in self.chains):
            asked = stored(asked, "asked")
        fetched = stored(self.engine.fetcher.fetch(asked.filter(_PENDING)), "fetched")  # once, whatever reads it
        good = self._phase(fetched.filter("error is null"), "download", "process_response", now_ms)
        good = self._phase(good, "spider", "process_request", now_ms)
        bad = self._phase(fetched.filter("error is not null"), "download", "process_exception", now_ms)
        answers = good.unionByName(bad)
        if any(not isinstance(h, StatusRetry | ErrorRetry) for n in self.chains for k, m in _AFTER for _, h in self._acting(n, k, m)):
            answers = stored(answers, "answers")  # what others' hooks say may not be the same twice
        ok = answers.filter(f"({_PENDING}) AND error IS NULL")

        made, follows, failures = [], [], []
        for name, rows in self._routed(ok):
            a, b, c = self._dispatch(name, rows)
            made += a
            follows += b
            failures += c
        if self.rules:
            lost = ok.filter(~F.col("step").isin(list(self.steps)))
            if self.settings.dispatch_callbacks:
                lost = lost.filter(~self._called())
            failures.append(_failed(lost, "engine", F.concat(F.lit("step not found: "), F.col("step"))))
        judged = ok
        if failures:
            failed = _union(failures).groupBy("seq").agg(F.min_by(F.struct("kind", "message"), "message").alias("_failed"))
            judged = ok.join(failed, "seq", "left").withColumn("error", F.col("_failed")).select(*ok.columns)
        # spider hooks have their say about each response and each failure
        if any(self._acting(n, "spider", m) for n in self.chains for m in ("process_response", "process_exception")):
            fine = self._phase(judged.filter("error is null"), "spider", "process_response", now_ms)
            judged = fine.unionByName(self._phase(judged.filter("error is not null"), "spider", "process_exception", now_ms))

        cells = ("seq", "url", "step", "request", "flow", "flow_reason", "backoff_ms")
        outcome = asked.filter(f"NOT ({_PENDING})").select(*cells, F.lit(None).cast(ERROR).alias("error"), F.lit(False).alias("fetched"))
        for d in (answers.filter(f"NOT ({_PENDING}) OR error IS NOT NULL"), judged):
            outcome = outcome.unionByName(d.select(*cells, F.col("error").cast(ERROR).alias("error"), F.lit(True).alias("fetched")))
        outcome = stored(outcome, "outcome")
        fine, wrong = f"({_PENDING}) AND error IS NULL", f"({_PENDING}) AND error IS NOT NULL"
        n = outcome.agg(*(F.count_if(F.expr(c)).alias(k) for k, c in (("fetched", "fetched"), ("fine", fine), ("wrong", wrong), ("again", "flow = 'retry'")))).first()
        self.fetches += n.fetched
        self.rounds += n.fine
        success = outcome.filter(fine).select("seq", F.col("url").alias("page_url"), "step")
        _add(self.done, success, "done")
        if n.again:
            again = outcome.filter("flow = 'retry'").select("request.*", "flow_reason", "backoff_ms")
            again = ops.rescheduled(again, now_ms, F.col("flow_reason"), F.col("backoff_ms"))
            self.scheduler.enqueue(stored(again.select(*FRONTIER.names), "again"))
        if n.wrong:
            failed = outcome.filter(wrong)
            last = F.col("request.nacks") >= self.settings.max_nacks
            _add(self.dead, failed.filter(last).select("url", "step", "error.kind", "error.message"), "dead")
            self.scheduler.nack(failed.filter(~last).select("seq"))
        self.scheduler.ack(todo)
        whole = n.wrong == 0 and not n.again and n.fine == n.fetched  # then nothing made is to be left out
        left = (lambda d: d) if whole else lambda d: d.join(success.select("seq"), "seq", "left_semi")
        if made:
            self._emit(left(_union(made)))
        if follows:
            follow = left(_union(follows))
            if self.settings.resolve_urls:
                follow = follow.withColumn("url", _joined(F.col("src_url"), F.col("url")))
            self._follow(ops.allowed_domains(follow, self.spider.allowed_domains), ("seq", "link_index", "value_index"))

    def _follow(self, rows: DataFrame, by: tuple[str, ...]) -> None:
        """Numbers go up in the order of ``by``, without one task that sees all."""
        numbered = rows.withColumn("src_seq", F.col("seq")).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("seq", F.monotonically_increasing_id() + F.lit(self.top))
        default = {"mode": F.lit("http"), "method": F.lit("GET"), "meta": F.create_map(), "dont_filter": F.lit(False), "priority": F.lit(0), "nacks": F.lit(0)}
        cells = []
        for f in FRONTIER.fields:
            c = F.col(f.name) if f.name in numbered.columns else F.lit(None)
            cells.append((F.coalesce(c, default[f.name]) if f.name in default else c).cast(f.dataType).alias(f.name))
        origin = [c for c in ("src_seq", "src_url", "link_name") if c in numbered.columns]
        tasks = stored(numbered.select(*cells, *origin), "frontier")
        top = tasks.agg(F.max("seq")).first()[0]
        if top is None:
            return
        self.top = top + 1
        self.scheduler.enqueue(tasks)
        if "src_url" in origin:
            _add(self.log, tasks.select(F.col("src_seq").alias("seq"), "src_url", "link_name", "url", "meta"), "log")

    def _emit(self, made: DataFrame) -> None:
        """The wave's items through the pipelines to the outputs. A pipeline that fails has dead letters."""
        if self.engine.pipelines:  # read again where one fails
            made = stored(made, "made")
        try:
            out = self.pipeline.process(made, self.spider.name)
            if "error" in out.columns:
                out = stored(out, "processed")
                _add(self.dead, out.filter("error is not null").select(F.col("page_url").alias("url"), "step", F.lit("pipeline").alias("kind"), F.col("error").alias("message")), "dead")
                out = out.filter("error is null")
            seq = F.col("seq") if "seq" in out.columns else F.lit(None).cast("long").alias("seq")
            out = stored(out.select(seq, "page_url", "step", "item"), "items")
        except Exception as e:
            if not self.engine.pipelines:
                raise
            message = f"{type(e).__name__}: {e}"[:2000]
            _add(self.dead, made.select(F.col("page_url").alias("url"), "step", F.lit("pipeline").alias("kind"), F.lit(message).alias("message")), "dead")
            return
        _add(self.items, out, "items")
        for sink in self.engine.outputs:
            sink.write(out.drop("seq"))

    # --- hooks -----------------------------------------------------------------------------------------

    def _acting(self, step: str | None, kind: str, method: str) -> list[tuple[str, Hook]]:
        return [(k, h) for k, m, h in self.chains[step] if m.type == kind and h.acts(method)]

    def _phase(self, rows: DataFrame, kind: str, method: str, now_ms: int) -> DataFrame:
        """Each step's hooks of a kind, in order; rows of steps that have none pass as one."""
        chains = {n: c for n in (*self.names, None) if (c := self._acting(n, kind, method))}
        if not chains:
            return rows
        named_, parts = F.col("step").isin(self.names), []
        for name, chain in chains.items():
            own = rows.filter(F.col("step") == name if name is not None else ~named_)
            for key, hook in chain:
                if isinstance(hook, DedupHook):
                    own = self._dedup(own, hook, name)
                elif isinstance(hook, GateHook):
                    own = self._gate(own, key, hook, name, now_ms)
                else:
                    own = _step_flow(own, getattr(hook, method))
            parts.append(own)
        idle = [n for n in self.names if n not in chains]
        if idle or None not in chains:
            rest = F.col("step").isin(idle) if idle else F.lit(False)
            parts.append(rows.filter(rest | ~named_ if None not in chains else rest))
        return _union(parts)

    def _dedup(self, rows: DataFrame, hook: DedupHook, step: str | None) -> DataFrame:
        keyed = hook.keyed(rows)
        bound = f"({_PENDING}) AND _key IS NOT NULL AND NOT coalesce(dont_filter, false)"
        free, held = keyed.filter(f"NOT coalesce({bound}, false)"), keyed.filter(bound)
        held = stored(held.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("priority", "seq"))), "keyed")
        known = _all(self.seen).filter(F.col("step").eqNullSafe(F.lit(step))).select("_key", F.lit(True).alias("_known")) if self.seen else None
        marked = held.join(known, "_key", "left") if known is not None else held.withColumn("_known", F.lit(None).cast("boolean"))
        marked = stored(marked, "marked")
        fresh = "_n = 1 AND _known IS NULL"
        _add(self.seen, stored(marked.filter(fresh).select(F.lit(step).cast("string").alias("step"), "_key"), "seen"), "seen")
        drop = ~F.expr(fresh)
        out = marked.withColumn("flow", F.when(drop, F.lit("drop")).otherwise(F.col("flow"))).withColumn("flow_reason", F.when(drop, F.lit("duplicate")).otherwise(F.col("flow_reason")))
        return out.select(*rows.columns).unionByName(free.select(*rows.columns))

    def _gate(self, rows: DataFrame, key: str, hook: GateHook, step: str | None, now_ms: int) -> DataFrame:
        pending = stored(rows.filter(_PENDING), "gated")
        before = self.last.setdefault((step or "", key), [])
        n = pending.count()
        numbered = ops.attempt_number(pending.withColumn("_one", F.lit(0)), key=("_one",), order=("priority", "seq"), name="_place").drop("_one")
        if hook.key == "interval_ms":
            free = before[-1] if before else now_ms
            admitted = max(free, now_ms) + hook.value * F.col("_place").cast("long")
            if max(free, now_ms) == now_ms and n:
                before[:] = [now_ms + hook.value]
        else:
            recent = [t for t in before if now_ms - t <= ops.RATE_WINDOW_MS]
            room = max(0, hook.value - len(recent))
            wait = (recent[0] if recent else now_ms) + ops.RATE_WINDOW_MS + 1
            admitted = F.when(F.col("_place") < room, F.lit(now_ms)).otherwise(F.lit(wait)).cast("long")
            before[:] = recent + [now_ms] * min(room, n)
        at = numbered.withColumn("_at", admitted)
        late = F.col("_at") > now_ms
        out = at.withColumns({"flow": F.when(late, F.lit("retry")), "flow_reason": F.when(late, F.lit(key)), "backoff_ms": F.when(late, (F.col("_at") - now_ms).cast("bigint"))})
        return out.select(*rows.columns).unionByName(rows.filter("flow IS NOT NULL"))

    # --- dispatch --------------------------------------------------------------------------------------

    def _called(self) -> Column:
        return F.coalesce(F.col("request.callback").isin(list(self.spider.callbacks)), F.lit(False))

    def _routed(self, ok: DataFrame):
        """(step, its responses); with dispatch_callbacks a request's callback goes before its step."""
        if self.settings.dispatch_callbacks:
            for name in self.spider.callbacks:
                yield f"callback:{name}", ok.filter(F.col("request.callback") == name)
            ok = ok.filter(~self._called())
        for name in self.names:
            if self.rules is None:
                yield name, ok  # without rules parse gets every response
            elif name in self.steps:
                yield name, ok.filter(F.col("step") == name)

    def _dispatch(self, name: str, rows: DataFrame):
        step = self.steps.get(name)
        if step is not None and step.impl == "dsl":
            parsed, sources = planner.parsed(rows, step)
            cells = [c for c in ("seq", "url", "step", "mode", "meta", "headers", "_found") if c in parsed.columns]
            parsed = stored(parsed.select(*cells), "parsed")  # a page is parsed once
            made, links, bad = [], [], []
            if step.fields:
                found = planner.packed_items(parsed, step, ("seq", "url", "step"), sources)
                made = [found.filter("error IS NULL").select("seq", F.col("url").alias("page_url"), "step", F.to_json("item", {"ignoreNullFields": "false"}).alias("item"))]
                bad.append(found)
            if step.links:
                found = planner.requests(parsed, step, ("seq",), sources)
                links = [found.filter("error IS NULL").drop("error")]
                bad.append(found)
            may = any(f.required for f in (*step.fields, *step.links))
            return made, links, [d.filter("error IS NOT NULL").select("seq", F.lit("parse").alias("kind"), F.col("error").alias("message")) for d in bad if may]
        called = name.removeprefix("callback:") if name.startswith("callback:") else step.callback if step is not None else name
        try:
            made, follow = self.spider.call(called, rows)
        except EngineFailure as e:
            return [], [], [_failed(rows, e.kind, F.lit(str(e)))]
        a, b = [], []
        if made is not None:
            a = [_owned(made, rows, "page_url").select("seq", "page_url", "step", "item")]
        if follow is not None:
            index = {"link_index": F.lit(0), "value_index": F.lit(0), "link_name": F.lit(called), "mode": F.lit("http"), "meta": F.create_map().cast("map<string,string>")}
            whole = follow.withColumns({k: v for k, v in index.items() if k not in follow.columns})
            b = [_owned(whole, rows, "src_url").drop("step")]
        return a, b, []


def _owned(made: DataFrame, rows: DataFrame, url: str) -> DataFrame:
    """What a callback made, with seq, step and URL of its response."""
    drop = [c for c in ("step",) if c in made.columns]
    if "seq" in made.columns:
        return made.drop(*drop, *([url] if url in made.columns else [])).join(rows.select("seq", F.col("url").alias(url), "step"), "seq")
    first = rows.groupBy(F.col("url").alias(url)).agg(F.min_by(F.struct("seq", "step"), "seq").alias("_own")).select(url, "_own.seq", "_own.step")
    return made.drop(*drop).join(first, url)


def _failed(rows: DataFrame, kind: str, message: Column) -> DataFrame:
    return rows.select("seq", F.lit(kind).alias("kind"), message.alias("message"))


def _joined(base: Column, url: Column) -> Column:
    """A relative URL against the page that has it."""

    def run(bases: pa.Array, urls: pa.Array) -> pa.Array:
        def one(b: str | None, u: str | None) -> str | None:
            try:
                return urljoin(b or "", u) if u is not None else None
            except ValueError:
                return u

        return pa.array([one(b.as_py(), u.as_py()) for b, u in zip(bases, urls)], pa.string())

    return F.arrow_udf(run, "string").asNondeterministic()(base, url)


def _text_of(key: str):
    raw = F.try_element_at("meta", F.lit(key))
    return F.when(raw.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"])


def _step_flow(rows: DataFrame, hook: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A hook on the rows that no hook before has stopped."""
    columns = rows.columns
    out = hook(rows.filter(_PENDING))
    out = out.withColumn("flow", F.when(F.col("flow").isin("drop", "retry"), F.col("flow")))
    return out.select(*columns).unionByName(rows.filter("flow IS NOT NULL"))


#: So many tables of as many waves are made one, lest the plan grow with the waves.
FOLD = 16


def _add(parts: list[tuple[int, DataFrame]], part: DataFrame, name: str) -> None:
    size = 1
    parts.append((size, part))
    while sum(n == size for n, _ in parts) >= FOLD:
        one = stored(_union(d for n, d in parts if n == size), name)
        parts[:] = [p for p in parts if p[0] != size] + [(size * FOLD, one)]
        size *= FOLD


def _all(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    return _union(d for _, d in parts)


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
