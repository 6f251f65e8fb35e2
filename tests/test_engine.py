"""Waves over stub corpora, and streams against batch."""

import inspect
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

import webloom.engine
from webloom.engine import Engine, Hook, Spider
from webloom.hooks import SignatureHook, StatsHook
from webloom.operators.scheduler import TableScheduler
from webloom.errors import EngineFailure, PluginError
from webloom.plans.rules import Middleware, Plugin, PluginRegistry, Settings
from webloom.requests import Request
from webloom.sinks import Collector, Each, LogPipeline, TableOutput
from webloom.sources.fetch import CorpusFetcher
from webloom.streaming import operators as streams

SHELF = {"id": "parse", "impl": "dsl", "parse": {"links": [{"name": "book", "source": "html", "selector_type": "css", "selector": ["li > a"], "allow": [r"/books/[a-z]+$"], "deny": ["lost$"], "to": {"next_step": "book", "meta_patch": {"shelf": "A"}}}]}}
BOOK = {"id": "book", "impl": "dsl", "parse": {"fields": [{"name": "name", "source": "html", "selector_type": "css", "selector": ["h2"]}, {"name": "shelf", "source": "meta.shelf", "selector_type": "css", "selector": ["x"]}, {"name": "row", "source": "meta.row", "selector_type": "css", "selector": ["x"], "default": "none"}]}}


def inline(*steps):
    return {"type": "inline", "options": {"value": {"steps": list(steps)}}}


def corpus(spark, rows, schema="url string, text string"):
    return CorpusFetcher(spark.createDataFrame(rows, schema))


def plain(**more):
    return Settings(retry_times=0, max_nacks=0, **more)


def test_shelf_to_book(spark):
    pages = [("https://lib.test/", "<ul><li><a href='https://lib.test/books/emma'>x</a><li><a href='https://lib.test/books/lost'>y</a></ul><a href='https://lib.test/books/not'>z</a>"), ("https://lib.test/books/emma", "<h2> Emma </h2>")]
    r = Engine(corpus(spark, pages), plain()).run(spark, Spider("s", ["https://lib.test/"], ["lib.test"], inline(SHELF, BOOK)))
    assert [(x.page_url, x.step, json.loads(x.item)) for x in r.items.collect()] == [("https://lib.test/books/emma", "book", {"name": "Emma", "row": "none", "shelf": "A"})]
    assert [(x.url, x.meta) for x in r.requests.collect()] == [("https://lib.test/books/emma", {"next_step": '"book"', "shelf": '"A"'})]
    assert r.fetches == 2 == r.rounds and r.dead_letter.count() == 0


def test_dedup_retry_and_dead_letters(spark):
    step = {"id": "parse", "impl": "dsl", "parse": {"fields": [{"name": "t", "source": "html", "selector_type": "css", "selector": ["p"]}]}}
    tries = [("http://a/", "<p>no", 500, 0), ("http://a/", "<p>yes", 200, 1)]
    fetcher = corpus(spark, tries, "url string, text string, status int, attempt int")
    s = Settings(retry_times=1, retry_http_codes=(500,), retry_backoff_ms=(10,), max_nacks=0, dedup=True)
    r = Engine(fetcher, s).run(spark, Spider("s", ["http://a/", "http://a/", "http://gone/"], rules=inline(step)))
    assert [json.loads(x.item) for x in r.items.collect()] == [{"t": "yes"}]
    assert [(x.url, x.kind) for x in r.dead_letter.collect()] == [("http://gone/", "download")]


def test_hooks_pipelines_and_callbacks(spark):
    class Deny(Hook):
        def process_request(self, rows):
            return rows.withColumns({"flow": F.when(F.col("url").contains("bad"), F.lit("drop")).otherwise(F.lit("continue")), "flow_reason": F.lit("denied")})

    spider = Spider("s", ["http://a/good", "http://a/bad"])

    @spider.callback
    def parse(rows):
        return rows.select(F.col("url").alias("page_url"), F.to_json(F.struct(F.length("text").alias("n"))).alias("item")), None

    engine = Engine(corpus(spark, [("http://a/good", "abc"), ("http://a/bad", "d")]), plain()).add_middleware(Deny()).with_pipeline(lambda d: d.withColumn("item", F.upper("item")))
    r = engine.run(spark, spider)
    assert [(x.page_url, x.item) for x in r.items.collect()] == [("http://a/good", '{"N":3}')] and r.fetches == 1


def test_a_crawl_goes_on_until_the_frontier_is_empty(spark, monkeypatch):
    monkeypatch.setattr(webloom.engine, "FOLD", 2)
    step = {"id": "parse", "impl": "dsl", "parse": {"fields": [{"name": "t", "source": "html", "selector_type": "css", "selector": ["p"]}]}}
    urls = ["http://a/0", "http://a/gone"]
    run = lambda **more: Engine(corpus(spark, [(urls[0], "<p>x")]), plain(concurrent_requests_per_domain=1)).run(spark, Spider("s", urls, rules=inline(step)), **more)
    r = run(max_waves=1)  # what a bound leaves is given back
    assert [x.page_url for x in r.items.collect()] == urls[:1] and [x.url for x in r.frontier.collect()] == urls[1:]
    r = run()
    assert inspect.signature(Engine.run).parameters["max_waves"].default is None and r.waves == 2
    assert [x.page_url for x in r.items.collect()] == urls[:1] and [x.url for x in r.dead_letter.collect()] == urls[1:] and r.frontier.count() == 0


def test_unknown_middleware_even_if_off(spark):
    s = plain(middlewares={"nope": Middleware(enabled=False)})
    with pytest.raises(EngineFailure, match="unknown middleware key: nope"):
        Engine(corpus(spark, [("u", "t")]), s).run(spark, Spider("s", []))


def titles(name="parse", **more):
    return {"id": name, "impl": "dsl", "parse": {"fields": [{"name": "t", "source": "html", "selector_type": "css", "selector": ["p"], **more}]}}


def test_a_url_that_comes_twice_is_two_requests(spark):
    """Each has its own items and follow requests, by rules and by a callback."""
    page = [("http://a/", "<p>x</p><a href='http://b/'>b</a>"), ("http://b/", "<p>y</p>")]
    links = [{"name": "b", "source": "html", "selector_type": "css", "selector": ["a"], "to": {"next_step": "b"}}]
    both = {"id": "parse", "impl": "dsl", "parse": {**titles()["parse"], "links": links}}
    r = Engine(corpus(spark, page), plain()).run(spark, Spider("s", ["http://a/"] * 2, rules=inline(both, titles("b"))))
    assert r.requests.count() == 2 and sorted(x.page_url for x in r.items.collect()) == ["http://a/"] * 2 + ["http://b/"] * 2
    spider = Spider("s", ["http://a/"] * 2)

    @spider.callback
    def parse(rows):
        out = rows.filter("url = 'http://a/'").select(F.col("url").alias("src_url"), F.lit("http://b/").alias("url"))
        return rows.select(F.col("url").alias("page_url"), F.lit("{}").alias("item")), out

    r = Engine(corpus(spark, page), plain()).run(spark, spider)
    assert r.requests.count() == 2 and r.items.count() == 4


def test_pipelines_that_fail_make_dead_letters(spark, tmp_path):
    pages = [(f"http://a/{i}", f"<p>{i}") for i in range(4)]
    urls = [u for u, _ in pages]

    def odd(item, spider):
        if item["t"] == "1":
            raise KeyError(spider)
        return item if int(item["t"]) else None

    said, kept = [], Collector()
    log = LogPipeline(said.append)
    e = Engine(corpus(spark, pages), plain()).with_pipeline(Each(odd), log).with_output(kept, TableOutput(str(tmp_path / "out")))
    r = e.run(spark, Spider("s", urls, rules=inline(titles())))
    assert sorted(x["t"] for x in kept.items()) == ["2", "3"] == sorted(json.loads(x.item)["t"] for x in r.items.collect())
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert [(x.url, x.kind, x.message) for x in r.dead_letter.collect()] == [("http://a/1", "pipeline", "KeyError: 's'")]
    assert said == ["s: open", "s: closed, 2 items"] and log.counts == {"parse": 2}
    # one that raises while Spark runs it ends no crawl
    bad = Engine(corpus(spark, pages), plain(concurrent_requests=2)).with_pipeline(lambda d: d.withColumn("item", F.when(F.col("page_url") == "http://a/3", F.raise_error(F.lit("no"))).otherwise(F.col("item"))))
    r = bad.run(spark, Spider("s", urls, rules=inline(titles())))
    assert sorted(x.page_url for x in r.items.collect()) == urls[:2] and sorted((x.url, x.kind) for x in r.dead_letter.collect()) == [(u, "pipeline") for u in urls[2:]]
    assert r.rounds == 4 and r.waves == 2


def test_limits_of_a_wave(spark):
    pages = [(f"http://h{i}/", "<p>x") for i in range(10)]
    run = lambda **more: Engine(corpus(spark, pages), plain(**more)).run(spark, Spider("s", [u for u, _ in pages], rules=inline(titles())), max_waves=1)
    assert run(concurrent_requests=4).frontier.count() == 6 and run(concurrent_requests=None).frontier.count() == 0


def test_spider_hooks_see_what_dispatch_fails_on(spark):
    rows = [("http://a/", "none", 0), ("http://a/", "<p>late", 1)]
    step = titles("book", required=True)
    again = {"retry_by_error": {"type": "spider", "options": {"count": [1], "backoff_ms": [5]}}}
    start = {"id": "parse", "impl": "code", "callback": "start"}
    spider = Spider("s", ["http://a/"], rules=inline(start, {**step, "MIDDLEWARES": again}))

    @spider.callback
    def start(rows):  # noqa: F811
        return None, rows.select("seq", F.lit("http://a/").alias("url"), F.create_map(F.lit("next_step"), F.lit('"book"')).alias("meta"))

    r = Engine(corpus(spark, rows, "url string, text string, attempt int"), plain()).run(spark, spider)
    assert [json.loads(x.item) for x in r.items.collect()] == [{"t": "late"}] and r.fetches == 3 and r.dead_letter.count() == 0

    class Deny(Hook):
        def process_response(self, rows):
            return rows.withColumns({"flow": F.lit("drop"), "flow_reason": F.lit("no")})

    r = Engine(corpus(spark, [("http://a/", "<p>x")]), plain()).add_middleware(Deny(), type="spider").run(spark, Spider("s", ["http://a/"], rules=inline(titles())))
    assert r.items.count() == 0 and r.rounds == 0 and r.fetches == 1  # what was parsed is discarded
    r = Engine(corpus(spark, [("http://a/", "<p>x")]), plain()).run(spark, Spider("s", ["http://a/"], rules=inline({"id": "parse", "impl": "code", "callback": "gone"})))
    assert [(x.kind, x.message) for x in r.dead_letter.collect()] == [("engine", "unknown callback: gone")]


def test_order_of_hooks_and_factories(spark):
    """The engine's own hooks go first, whatever their order; then those of the step, by order."""
    seen = []

    class Mark(Hook):
        def __init__(self, name):
            self.name = name

        def process_request(self, rows):
            seen.append(self.name)
            return rows.withColumn("headers", F.map_concat("headers", F.create_map(F.lit(self.name), F.array(F.lit(str(len(seen)))))))

    mw = {"late": Middleware(order=9), "early": Middleware(order=1), "off": Middleware(enabled=False), "cookies": Middleware(), "proxy": Middleware()}
    e = Engine(corpus(spark, [("http://a/", "x")]), plain(middlewares=mw)).add_middleware(Mark("own"), 500).add_middleware(Mark("never"), enabled=False)
    for k in ("late", "early", "off"):
        e.register_middleware(k, lambda o, k=k: Mark(k))
    spider, got = Spider("s", ["http://a/"]), []

    @spider.callback
    def parse(rows):
        got.extend(rows.select(F.map_keys("request.headers").alias("k")).first().k)
        return None, None

    e.run(spark, spider)
    assert seen[:3] == ["own", "early", "late"] == got
    registry = PluginRegistry()
    registry.register_all([Plugin("early", "middleware"), Plugin("x", "pipeline")])
    assert e.load_plugins(registry) is e
    registry.register(Plugin("missing", "middleware"))
    with pytest.raises(PluginError, match="missing"):
        e.load_plugins(registry)


def test_signatures_and_counters(spark):
    stats = StatsHook({"label": "x"})
    e = Engine(corpus(spark, [("http://a/ü", "x")]), plain()).add_middleware(SignatureHook({"secret": "k"})).add_middleware(stats)
    spider, got = Spider("s", start_requests=[Request("http://a/ü"), Request("http://gone/").with_header("X-Signature", "own")]), {}

    @spider.callback
    def parse(rows):
        got.update({r.url: r.h for r in rows.select("url", F.col("request.headers")["X-Signature"].alias("h")).collect()})
        return None, None

    e.run(spark, spider)
    h = 0
    for b in "khttp://a/ü".encode():
        h = (h * 31 + b) % 2**64
    assert got == {"http://a/ü": [f"sha256:{h:x}"]} and (stats.requests, stats.responses) == (2, 1)


def test_callbacks_of_requests_and_relative_urls(spark):
    pages = [("http://a/x/", "<p>1</p><a href='../b'>b</a>"), ("http://a/b", "<p>2")]
    links = [{"name": "b", "source": "html", "selector_type": "css", "selector": ["a"]}]
    spider = Spider("s", start_requests=[Request("http://a/x/"), Request("http://a/b").with_callback("other")], rules=inline({"id": "parse", "impl": "dsl", "parse": {"links": links}}))

    @spider.callback
    def other(rows):
        return rows.select("seq", F.lit('"other"').alias("item")), None

    r = Engine(corpus(spark, pages), plain(resolve_urls=True, dispatch_callbacks=True)).run(spark, spider)
    assert [(x.page_url, x.item) for x in r.items.collect()] == [("http://a/b", '"other"')] and [x.url for x in r.requests.collect()] == ["http://a/b"]
    r = Engine(corpus(spark, pages), plain()).run(spark, spider)
    assert r.items.count() == 0 and [x.url for x in r.requests.collect()] == ["../b"] and [x.url for x in r.dead_letter.collect()] == ["../b"]


def test_a_crawl_for_ever_ends_by_its_handle(spark):
    e = Engine(corpus(spark, [("http://a/", "<p>1"), ("http://b/", "<p>2")]), plain(idle_ms=50))
    out = {}
    thread = threading.Thread(target=lambda: out.update(r=e.run(spark, Spider("s", ["http://a/"], rules=inline(titles())), forever=True)))
    thread.start()
    e.enqueue("http://b/")
    for _ in range(600):
        if e.scheduler.__dict__.get("waiting") is not None and len(out) == 0 and e_done(e) >= 2:
            break
        time.sleep(0.1)
    handle = e.shutdown_handle()
    handle.stop()
    thread.join(120)
    assert handle.is_stopped() and sorted(x.page_url for x in out["r"].items.collect()) == ["http://a/", "http://b/"]


def e_done(engine):
    """Tasks that were acknowledged: of two there are none waiting, in flight or in the inbox."""
    try:
        return 2 if not engine._inbox and not engine.scheduler.has_pending() else 0
    except Exception:  # the other thread is between two tables
        return 0


def test_scheduler(spark):
    from webloom.requests import frame

    s = TableScheduler()
    s.open(spark)
    assert not s.has_pending() and s.lease(0, 8, None) is None and s.next_ms() is None
    s.enqueue(frame(spark, ["http://a/1", "http://a/2", "http://b/1"]))
    s.enqueue(frame(spark, ["http://c/"], 3).withColumn("ready_at_ms", F.lit(70).cast("long")))
    first = s.lease(0, 1, None)
    assert sorted(r.url for r in first.collect()) == ["http://a/1", "http://b/1"]
    s.nack(first.filter("url = 'http://b/1'").select("seq"))
    s.ack(first.filter("url = 'http://a/1'").select("seq"))
    again = s.lease(0, 8, 1)
    assert [(r.url, r.nacks) for r in again.collect()] == [("http://b/1", 1)]  # before what waited longer
    s.ack(again)
    assert [r.url for r in s.lease(0, 8, 1).collect()] == ["http://a/2"] and s.lease(0, 8, None) is None and s.next_ms() == 70
    assert s.has_pending() and [r.url for r in s.lease(70, 8, None).collect()] == ["http://c/"] and s.pending().count() == 2


def test_crawl_of_a_stream(spark, tmp_path):
    e = Engine(corpus(spark, [(f"http://a/{i}", f"<p>{i}") for i in range(3)]), plain())
    for i in range(3):
        spark.createDataFrame([(f"http://a/{i}",)], "url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = e.stream(stream, Spider("s", rules=inline(titles())), str(tmp_path / "items"), str(tmp_path / "check"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(json.loads(r.item)["t"] for r in spark.read.parquet(str(tmp_path / "items")).collect()) == ["0", "1", "2"]


def test_gates_in_parts_equal_windows(spark, monkeypatch):
    from webloom.operators import frontier as ops

    rows = [("a" if i % 3 else "b" if i % 2 else None, i, (i * 7919) % 500, f"http://h{i % 3}/") for i in range(300)]
    df = spark.createDataFrame(rows, "step string, seq long, arrival_ms long, url string").repartition(5)
    key = lambda d: sorted(map(str, d.select("seq", d.columns[-1]).collect()))
    runs = (lambda: ops.interval_gate(df, 100), lambda: ops.rate_limit(df, 4), lambda: ops.attempt_number(df, key=("step",)), lambda: ops.wave_of(df, 3, at_once=7))
    whole = [key(f()) for f in runs]
    monkeypatch.setattr(ops, "SORTED_ROWS", 10)
    assert [key(f()) for f in runs] == whole


def test_streams_equal_windows(spark, tmp_path):
    """Over several micro-batches, so that what one leaves in the state the next reads; and dedup."""
    from webloom.operators import frontier as ops

    rows = sorted((("a" if i % 3 else "b", i, (i * 7919) % 5000) for i in range(60)), key=lambda r: r[2])
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], "step string, seq long, arrival_ms long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    batch = spark.read.parquet(str(tmp_path / "in"))
    url = F.concat(F.lit("u"), (F.col("seq") % 7).cast("string"))
    ways = [
        (lambda d: streams.interval_gate(d, 100), ops.interval_gate(batch, 100), "admitted_ms"),
        (lambda d: streams.rate_limit(d, 4), ops.rate_limit(batch, 4), "admitted_ms"),
        (lambda d: streams.dedup(d.withColumn("url", url)), batch.withColumn("url", url).select("step", "url").distinct().withColumn("seq", F.lit(0)), "url"),
    ]
    for i, (streamed, made, column) in enumerate(ways):
        stream = streamed(spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(f"stream{i}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{i}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert len([p for p in q.recentProgress if p["numInputRows"]]) == 3
        key = lambda d: sorted((r.step, r.seq if column == "admitted_ms" else 0, r[column]) for r in d.collect())
        assert key(spark.table(f"stream{i}")) == key(made)
