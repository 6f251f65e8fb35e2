"""Extraction without Spark: the fixtures of FIXTURES.md and the hazards."""

import time

import pytest

from webloom.errors import RulesError
from webloom.functions import feed
from webloom.functions.dom import parse_html, select
from webloom.functions.extract import Page, Spec
from webloom.functions.feed import feed_items, feed_title
from webloom.functions.patterns import to_java, to_python
from webloom.functions.values import json_select, number_text, stringify, trim
from webloom.plans.rules import Plugin, PluginRegistry, Runtime, Settings, chain_of, compile_rules, load, lower


def run(text, kind, selector, how="node", arg=""):
    return Page(text).run(Spec(kind, selector, how, arg))


def test_css_projections():
    assert run("<h3 class='price'> 12 EUR </h3>", "css", "h3.price::text") == ["12 EUR"]
    assert run("<a class='next' href='/shelf/2'>on</a>", "css", "a.next::attr(href)") == ["/shelf/2"]
    assert run("<p>a<b> b</b></p>", "css", "p", "html") == ["<p>a<b> b</b></p>"]
    assert run("<i>x</i><i title='t'>y</i>", "css", "i", "attr", "title") == ["t"]
    assert run("<a>x</a>", "css", "a::text, b::text") == []  # a suffix counts at the end only
    assert run("<a>x</a>", "css", "a[") == []


@pytest.mark.parametrize(
    ("selector", "expected"),
    [("ul > li:nth-child(2n+1)", ["1", "3"]), ("li + li", ["2", "3"]), ("li ~ li:last-child", ["3"]), ("li:not(.x)", ["1", "3"]), ("#k", ["3"]), ("li[class^=x]", ["2"]), ("*:root > body li:first-of-type", ["1"]), ("li.x, li#k", ["2", "3"])],
)
def test_selectors(selector, expected):
    root = parse_html("<ul><li>1<li class=x>2<li id=k>3</ul>")
    assert [n.text() for n in select(root, selector)] == expected


def test_tree_construction():
    assert "<p><b>a</b></p><p><b>c</b></p>" in parse_html("<p><b>a<p>c").outer()
    assert [n.text() for n in select(parse_html("<script>var t='</p>';</script><p>x"), "p")] == ["x"]
    assert [n.text() for n in select(parse_html("<title>a &amp; <b>b</title>"), "title")] == ["a & <b>b"]
    assert len(select(parse_html("<table><tr><td>1<td>2<tr><td>3</table>"), "tr")) == 2
    assert parse_html("").outer().count("<body>") == 1


@pytest.mark.parametrize(("source", "text"), [("a&amp", "a&"), ("a&amp;&amp", "a&&"), ("a&am", "a&am"), ("a&", "a&"), ("a&ampb", "a&b"), ("a&amp;amp;", "a&amp;")])
def test_references_without_semicolon(source, text):
    for tag in ("title", "h1"):
        assert run(f"<{tag}>{source}</{tag}>", "css", tag, "text") == [text]


@pytest.mark.parametrize(
    ("source", "body"),
    [
        ("<table><tr><td>1</table>", "<table><tbody><tr><td>1</td></tr></tbody></table>"),
        ("<table><td>1<td>2", "<table><tbody><tr><td>1</td><td>2</td></tr></tbody></table>"),
        ("a<table>b<tr><td>c</td>d</tr></table>e", "abd<table><tbody><tr><td>c</td></tr></tbody></table>e"),
        ("<table><tr><div>x</div><td>y", "<div>x</div><table><tbody><tr><td>y</td></tr></tbody></table>"),
        ("<table><b>x<tr><td>y</table>", "<b>x</b><table><tbody><tr><td>y</td></tr></tbody></table>"),
        ("<table><caption>c<tr><td><p>1<td>2<thead><tr><th>h", "<table><caption>c</caption><tbody><tr><td><p>1</p></td><td>2</td></tr></tbody><thead><tr><th>h</th></tr></thead></table>"),
        ("<table> <tr> <td><table><tr><td>in</table>out", "<table> <tbody><tr> <td><table><tbody><tr><td>in</td></tr></tbody></table>out</td></tr></tbody></table>"),
        ("<svg><path d=1 /><g><circle/></g></svg><p>x", '<svg><path d="1"></path><g><circle></circle></g></svg><p>x</p>'),
        ("<svg><g><p>x", "<svg><g></g></svg><p>x</p>"),
        ("<svg><foreignObject><p>x</p></foreignObject><a/></svg>y", "<svg><foreignobject><p>x</p></foreignobject><a></a></svg>y"),
    ],
)
def test_tables_and_foreign_content(source, body):
    assert select(parse_html(source), "body")[0].outer() == f"<body>{body}</body>"


def test_xpath_and_xml():
    assert run("<shop><name>Lamp</name></shop>", "xpath", "//name") == ["Lamp"]
    assert run("<bag><thing no='7'>cup</thing></bag>", "xml", "//thing", "attr", "no") == ["7"]
    assert run("<s>a<b> </b>z</s>", "xml", "/s", "text") == ["a", "", "z"]
    assert run("<p>unclosed", "xpath", "//p") == []
    assert run("<a/>", "xpath", "//a[") == []
    assert run("<a><b>1</b><b>2</b></a>", "xpath", "sum(//b) > 2 and count(//b) = 2") == ["true"]
    assert run("<a><b>1</b><b>2</b></a>", "xpath", "//b[position() = last()] | //b[1]") == ["1", "2"]


def test_json():
    assert run('{"cart":{"sum":19}}', "json", "$.cart.sum") == ["19"]
    assert json_select('{"*":1}', "$.*") == (True, 1.0)
    assert run('{"a":[1]}', "json", "$.a[-1]") == [] and run("{", "json", "$") == []
    assert stringify([1.0, "a", None]) == '["1","a"]'
    assert [number_text(x) for x in (42.0, 1e-5, 1e21, 0.1)] == ["42", "0.00001", "1" + "0" * 21, "0.1"]


def test_regex():
    assert run("order no=x17.", "regex", r"no=(\w+)", "all") == ["no=x17"]
    assert run("order no=x17.", "regex", r"no=(\w+)", "group", "1") == ["x17"]
    assert run("b", "regex", "(a)?(b)", "group", "1") == ["b"]  # the group that took no part is gone
    assert run("ab", "regex", "a(?=b)", "all") == [] and to_java("a(?=b)") is None
    assert to_python("a$").search("a\n") is None
    assert trim(" a ") == "a"


def test_feed():
    rss = "<rss><channel><title>T</title><item><title>1</title><description><![CDATA[<p>x</p>]]></description><author><name>Bob</name></author></item><item><title>2"
    assert feed_title(rss) == "T"
    assert [(i["title"], i["description"], i["author"]) for i in feed_items(rss)] == [("1", "<p>x</p>", "Bob")]  # what was whole before the error
    atom = '<feed><entry><link rel="self" href="a"/><link href="b"/><updated>u</updated><published>p</published></entry></feed>'
    assert [(i["link"], i["pub_date"]) for i in feed_items(atom)] == [("b", "p")]
    assert feed_items("") == [] and feed_title("") is None


def _rss(n):
    return "<rss><channel><title>All</title>" + "".join(f"<item><title>{i}</title><link>http://e/{i}</link><description><![CDATA[<i>s</i>]]></description></item>" for i in range(n)) + "</channel></rss>"


def test_feed_time_grows_as_its_items():
    times = []
    for n in (5_000, 40_000):
        began = time.process_time()
        assert len(feed_items(_rss(n))) == n
        times.append(time.process_time() - began)
    assert times[1] < 24 * times[0]  # 8 in proportion, 64 by the square


def test_feed_title_is_read_as_far_as_it_is(monkeypatch):
    monkeypatch.setattr(feed, "_CHUNK", 1_000)
    seen, events = [], feed._events
    monkeypatch.setattr(feed, "_events", lambda source: (seen.append(e) or e for e in events(source)))
    assert feed_title(_rss(1_000)) == "All"
    assert [e[0] for e in seen] == ["start", "start", "start", "text"]
    assert feed_title(_rss(1_000).replace("<title>All</title>", "")) is None  # those of items are not the feed's


@pytest.mark.parametrize("chunk", [1, 7, 1 << 18])
def test_feed_in_chunks(monkeypatch, chunk):
    monkeypatch.setattr(feed, "_CHUNK", chunk)
    source = "<rss><title>T é</title><item><link href='a>b/'/><title>don't</title></item><item><guid x='/'>1</guid><link>c</link></item><item>"
    assert feed_title(source) == "T é"
    assert [(i["link"], i["title"], i["guid"]) for i in feed_items(source)] == [("a>b/", "don't", None), ("c", None, "1")]


def _rules(**step):
    return {"steps": [{"id": "a", "impl": "dsl", **step}]}


@pytest.mark.parametrize(
    ("rules", "message"),
    [
        ([], "rules dsl must be an object"),
        ({}, "rules.steps must be an array"),
        ({"steps": [{"id": "a", "impl": "dsl"}, {"id": "a", "impl": "dsl"}]}, "duplicate step id: a"),
        (_rules(callback="x"), "step a with impl=dsl must not define callback"),
        ({"steps": [{"id": "a", "impl": "code"}]}, "step a with impl=code must define callback"),
        (_rules(fetch={"mode": "ftp"}), "step a has unsupported fetch.mode: ftp"),
        (_rules(parse={"fields": [{"name": "n", "source": "html", "selector_type": "unknown", "selector": []}]}), "unsupported selector_type: unknown"),
        (_rules(parse={"links": [{"name": "n", "source": "html", "selector_type": "css", "selector": [], "to": {}}]}), "step a link.to.next_step is required"),
    ],
)
def test_rule_errors(rules, message):
    with pytest.raises(RulesError, match=message.replace(".", r"\.").replace("[", r"\[").replace("*", r"\*")):
        compile_rules(rules)


def test_rules_and_settings():
    with pytest.raises(RulesError, match="unsupported rules source type"):
        load({"type": "redis"})
    step = compile_rules(_rules(MIDDLEWARES={"dedup": {"enabled": False}}, runtime={"schedule": {"interval_ms": 5}})).steps[0]
    assert step.middlewares["dedup"].order == 100  # an entry replaces the whole default
    chain = chain_of(Settings(dedup=True), step)
    assert not chain["dedup"].enabled and chain["interval_gate"].options == {"interval_ms": 5}
    assert sorted(lower(Runtime({"rate_per_minute": 1}, {"count": 3, "http_status": [500]}, {"enabled": True}))) == ["dedup", "rate_limit", "retry_by_error", "retry_by_status"]
    assert lower(Runtime(retry={"count": 3}))["retry_by_error"].options == {"count": [3.0]}


def test_plugins():
    from webloom.errors import PluginError

    r = PluginRegistry()
    r.register(Plugin("a", "middleware"))
    with pytest.raises(PluginError, match="conflict"):
        r.register(Plugin("a", "middleware"))
    r.register(Plugin("a", "middleware", override=True, version="2"))
    assert r.get("middleware", "a").version == "2" and r.by_kind("pipeline") == []
