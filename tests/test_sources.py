"""Fetchers against a server on this machine, requests as values, files of rules and plugins."""

import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from webloom.errors import PluginError, RequestBuildError, RulesError
from webloom.functions import extract as X
from webloom.functions.patterns import matches, nested, to_java, to_python
from webloom.plans.planner import packed_items, parsed, requests
from webloom.plans.rules import compile_rules, load, load_plugin_manifest
from webloom.requests import BrowserConfig, frame, HttpConfig, Request, request_mode
from webloom.sources.fetch import BrowserStub, CorpusFetcher, HttpFetcher, Router


class Handler(http.server.BaseHTTPRequestHandler):
    def _do(self):
        n = int(self.headers.get("content-length") or 0)
        said = {"method": self.command, "path": self.path, "cookie": self.headers.get("cookie"), "x": self.headers.get_all("x-a"), "body": self.rfile.read(n).decode()}
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("location", "/end")
        else:
            self.send_response(404 if self.path == "/gone" else 200)
        self.send_header("x-two", "1")
        self.send_header("x-two", "2")
        self.send_header("x-odd", "é")
        self.end_headers()
        self.wfile.write(b"\xff<p>" if self.path == "/bytes" else json.dumps(said).encode())

    do_GET = do_POST = _do

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http(spark, server):
    asked = [
        Request(server + "/a").with_http(HttpConfig(query={"q": "ü 1"}, cookies={"b": "2", "a": "1"})).with_header("x-a", "1"),
        Request(server + "/post").with_method("POST").with_body("hello"),
        Request(server + "/moved"),
        Request(server + "/moved").with_http(HttpConfig(allow_redirects=True)),
        Request(server + "/gone"),
        Request(server + "/bytes"),
        Request("http://127.0.0.1:1/"),
        Request("no scheme"),
        Request.in_browser(server + "/view"),
        Request(server + "/other"),
    ]
    rows = frame(spark, asked).withColumn("mode", F.when(F.col("seq") == 9, F.lit("ftp")).otherwise(F.col("mode")))
    got = {r.seq: r for r in Router(HttpFetcher(5)).fetch(rows).collect()}
    said = lambda i: json.loads(got[i].text)
    assert said(0)["path"] == "/a?q=%C3%BC+1" and said(0)["cookie"] in ("b=2; a=1", "a=1; b=2") and said(0)["x"] == ["1"]
    assert said(1)["method"] == "POST" and said(1)["body"] == "hello"
    assert got[2].status == 302 and got[2].url.endswith("/moved") and got[3].status == 200 and said(3)["path"] == "/end" and got[3].url.endswith("/moved")
    assert got[4].status == 404 and said(4)["path"] == "/gone"  # a status is an answer
    assert got[5].text == "�<p>" and bytes(got[5].body) == b"\xff<p>"
    assert got[0].headers["x-two"] == ["1", "2"] and "x-odd" not in got[0].headers and got[0].protocol in ("HTTP/1.0", "HTTP/1.1")
    assert got[0].ip_address == "127.0.0.1" == got[4].ip_address
    assert got[6].error.kind == got[7].error.kind == "download" and got[6].status is None
    assert (got[8].status, got[8].text, got[8].flags, got[8].protocol, got[8].error) == (200, "", ["browser"], "browser", None)
    assert got[9].error.message == "unsupported mode: ftp" and len(got) == len(asked)


def test_a_page_is_fetched_once_whatever_filters_it(spark, server):
    rows = HttpFetcher(5).fetch(frame(spark, [server + "/a"]))
    plan = rows.filter("error is null and status = 200").select("text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_guards_and_tries(spark):
    rows = frame(spark, [Request("http://a/"), Request.in_browser("http://a/"), Request("http://b/").with_meta("_retry_times", 5), Request("http://c/")])
    pages = spark.createDataFrame([("http://a/", "x", 0), ("http://b/", "first", 0), ("http://b/", "last", 1), (None, "n", 0)], "url string, text string, attempt int")
    got = {r.seq: r for r in CorpusFetcher(pages).fetch(rows).collect()}
    assert got[0].text == "x" and got[1].error.message == "http fetcher received a request of mode browser" and got[2].text == "last"
    assert got[3].error.message == "not in corpus: http://c/" and got[3].text is None and len(got) == 4
    assert BrowserStub().fetch(rows).filter("error is not null").count() == 3


def test_requests_have_one_kind_of_config():
    r = Request("u").with_browser(BrowserConfig().with_driver("d").with_headless(False).with_stealth(True).with_fingerprint_profile("f").with_wait_for("#x").with_viewport(1, 2))
    assert r.mode == "browser" and r.http is None and r.browser == BrowserConfig("d", None, False, True, "f", "#x", 1, 2)
    r = r.with_cookie("k", "v")
    assert r.mode == "http" and r.browser is None and r.http.cookies == {"k": "v"}
    assert r.with_mode("browser").with_mode("http").http == HttpConfig()
    r = Request("u").with_header("a", "1").with_header("a", "2").with_meta("m", {"b": 1}).merge_meta({"n": None}).with_callback("c").with_dont_filter()
    assert r.row(3)[4:9] == ({"a": ["1", "2"]}, None, {"m": '{"b":1}', "n": "null"}, "c", True)
    with pytest.raises(RequestBuildError, match="unsupported request mode: ftp"):
        request_mode("ftp")


def test_files_of_rules_and_plugins(tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"steps": [{"id": "a", "impl": "dsl"}]}))
    assert load({"type": "local", "options": {"path": str(tmp_path / "r.json")}}).step("a").fetch.mode == "http"
    for options in ({}, {"path": str(tmp_path / "none")}):
        with pytest.raises(RulesError):
            load({"type": "local", "options": options})
    (tmp_path / "p.toml").write_text('[[plugins]]\nname = "b"\nkind = "middleware"\nversion = "1"\n[plugins.options]\nx = 1\n[[plugins]]\nname = "a"\nkind = "pipeline"\noverride = true\n')
    assert [(p.name, p.kind, p.version, p.override, p.options) for p in load_plugin_manifest(str(tmp_path / "p.toml"))] == [("b", "middleware", "1", False, {"x": 1}), ("a", "pipeline", "", True, {})]
    (tmp_path / "q.toml").write_text("[[plugins]]\nkind = 1\n")
    for name in ("q.toml", "none.toml"):
        with pytest.raises(PluginError):
            load_plugin_manifest(str(tmp_path / name))


def test_a_step_is_parsed_once(spark):
    field = {"name": "t", "source": "html", "selector_type": "css", "selector": ["p"], "required": True}
    link = {"name": "l", "source": "html", "selector_type": "css", "selector": ["a"]}
    step = compile_rules({"steps": [{"id": "s", "impl": "dsl", "parse": {"fields": [field], "links": [link]}}]}).steps[0]
    pages = spark.createDataFrame([("u", "<p>x<a href=y>", {}, "http"), ("v", "", {}, "http")], "url string, text string, meta map<string,string>, mode string")
    rows, sources = parsed(pages, step)
    assert [(r.item.t, r.error) for r in packed_items(rows, step, ("url",), sources).orderBy("url").collect()] == [("x", None), (None, "required field missing: t")]
    assert [(r.src_url, r.url, r.k) for r in requests(rows.withColumn("k", F.lit(1)), step, ("k",), sources).collect()] == [("u", "y", 1)]


def test_patterns_that_may_hang():
    assert nested(r"(a+)+b") and nested(r"(?:x*y)*") and nested(r"((a|b)+)+") and not nested(r"(a+)b+") and not nested(r"\(a+\)+") and not nested("[(a+)]+x")
    began = time.time()
    assert matches(r"(a+)+b", "a" * 5000) == [] and time.time() - began < 5
    assert [m[0] for m in matches(r"(a+)+b", "aab ab")] == ["aab", "ab"] and matches(r"(?=a)", "a") == []
    assert to_java(r"(a+)+b") is None and to_java(r"(a+)+b", nesting=True) and to_python(r"(?=a)") is None


def test_sql_functions_and_values(spark):
    X.register(spark)
    row = spark.sql("""SELECT css('<p class=a>x</p>', 'p.a', 'text') AS c, css('<p id=k>', 'p', 'attr:id') AS a, xpath_all('<r><q>1</q></r>', '//q') AS x,
        regex_all('a1b22', '[0-9]+') AS r, json_all('{"k":[1,2]}', '$.k[1]') AS j, feed_items('<rss><channel><item><title>t</title></item></channel></rss>')[0].title AS f""").first()
    assert tuple(row) == (["x"], ["k"], ["1"], ["1", "22"], ["2"], "t")
    docs = spark.createDataFrame([('{"a": {"b": [1, 2.5, null, "x"], "a": true}}',), ("{",), (None,)], "t string")
    got = [r.v for r in docs.select(F.to_json(X.json("t", "$.a").value()).alias("v")).collect()]
    assert json.loads(got[0]) == {"a": True, "b": [1, 2.5, None, "x"]} and got[1:] == [None, None]
    assert docs.select(X.regex(F.lit("aab"), "(a+)+b").one().alias("v")).first().v == "aab"
