"""One query for each operator, over the given tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.engine import Engine, Spider
from webloom.functions import extract as X
from webloom.functions.values import trim_column
from webloom.operators import frontier as ops
from webloom.plans import planner
from webloom.plans.rules import compile_rules
from webloom.sources.fetch import CorpusFetcher
from webloom.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """pages as responses."""
    return t(spark, sf, "pages").select("page_id", "url", F.col("html").alias("text"), F.create_map(F.lit("page"), F.col("page_id").cast("string")).alias("meta"), F.create_map().cast("map<string,array<string>>").alias("headers"), F.lit("http").alias("mode"))


def millis(c) -> F.Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def step_of(fields: list[dict] = (), links: list[dict] = ()):
    return compile_rules({"steps": [{"id": "parse", "impl": "dsl", "parse": {"fields": list(fields), "links": list(links)}}]}).steps[0]


def field(name: str, selector, source="html", kind="css", **more) -> dict:
    return {"name": name, "source": source, "selector_type": kind, "selector": selector if isinstance(selector, list) else [selector], **more}


_DECODE = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_HREFS = "SELECT page_id, url AS page, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages"
_HOST = "CASE WHEN contains(url, '://') THEN split_part(split_part(split_part(url, '://', 2), '/', 1), ':', 1) END"


# --- extraction over pages ---------------------------------------------------------------------------


@query(f"SELECT page_id, trim({_DECODE.format(chr(114) + 'egexp_extract(html, ' + chr(39) + '<title>(.*?)</title>' + chr(39) + ', 1)')}) AS title FROM pages")
def css_title_text(spark, sf):
    return t(spark, sf, "pages").select("page_id", X.css("html", "title::text").one().alias("title"))


@query(f"SELECT page_id, trim({_DECODE.format(chr(114) + 'egexp_extract(html, ' + chr(39) + '<h1>(.*?)</h1>' + chr(39) + ', 1)')}) AS h1 FROM pages")
def css_h1_text(spark, sf):
    return t(spark, sf, "pages").select("page_id", X.css("html", "h1").text().one().alias("h1"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def css_nav_href(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.explode(X.css("html", "nav ul > li a").attr("href").all()).alias("href"))


def _lists(spark, sf):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda n: F.concat(F.lit('<li id="'), n["n_nationkey"].cast("string"), F.lit('">'), n["n_name"], F.lit("</li>")))
    return t(spark, sf, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<ul>"), F.array_join(rows, ""), F.lit("</ul>")).alias("html"))


@query("SELECT n_regionkey, '<li id=\"' || n_nationkey || '\">' || n_name || '</li>' AS li FROM nation")
def css_html_outer(spark, sf):
    return _lists(spark, sf).select("n_regionkey", F.explode(X.css("html", "ul > li").html().all()).alias("li"))


@query("SELECT n_regionkey, n_name AS last_name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS k FROM nation) WHERE k = 1")
def css_nth(spark, sf):
    return _lists(spark, sf).select("n_regionkey", X.css("html", "li:last-child:not(.none)").text().one().alias("last_name"))


@query("SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS title FROM region")
def css_attr_missing(spark, sf):
    html = F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit('<i title="'), F.col("r_name"), F.lit('">x</i>'))).otherwise(F.lit("<i>x</i>"))
    return t(spark, sf, "region").select("r_regionkey", X.css(html, "i::attr(title)").one().alias("title"))


@query(f"SELECT page_id, trim({_DECODE.format(chr(114) + 'egexp_extract(html, ' + chr(39) + '<h1>(.*?)</h1>' + chr(39) + ', 1)')}) AS title FROM pages")
def css_selector_fallback(spark, sf):
    step = step_of([field("title", ["section h7", "article h1", "title"])])
    return planner.items(responses(spark, sf), step, keep=("page_id",)).select("page_id", "title")


@query(f"SELECT page_id, unnest([trim({_DECODE.format(chr(114) + 'egexp_extract(html, ' + chr(39) + '<title>(.*?)</title>' + chr(39) + ', 1)')}), trim({_DECODE.format(chr(114) + 'egexp_extract(html, ' + chr(39) + '<h1>(.*?)</h1>' + chr(39) + ', 1)')})]) AS v FROM pages")
def css_multi_selector_union(spark, sf):
    step = step_of([field("v", ["title", "h1"], multiple=True)])
    return planner.items(responses(spark, sf), step, keep=("page_id",)).select("page_id", F.explode("v").alias("v"))


# --- json, regex, headers, meta ------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path_scalar(spark, sf):
    return t(spark, sf, "events").select("event_id", X.json("props", "$.k").one().alias("k"))


@query("SELECT event_id, 'n/a' AS missing FROM events")
def json_path_missing_default(spark, sf):
    rows = t(spark, sf, "events").select("event_id", F.lit("u").alias("url"), F.col("props").alias("text"), F.create_map().cast("map<string,string>").alias("meta"))
    return planner.items(rows, step_of([field("missing", "$.none[0]", "json", "json", default="n/a")]), keep=("event_id",)).select("event_id", "missing")


@query("SELECT o_orderkey, o_orderpriority AS second FROM orders")
def json_index(spark, sf):
    text = F.to_json(F.struct(F.struct(F.array(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("l")).alias("d")))
    return t(spark, sf, "orders").select("o_orderkey", X.json(text, "$.d.l[1]").one().alias("second"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q FROM lineitem")
def json_number_format(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.json(F.to_json(F.struct(F.col("l_quantity").alias("q"))), "$.q").one().alias("q"))


@query("SELECT n_nationkey, '[\"' || n_nationkey || '\",\"' || n_name || '\"]' AS v FROM nation")
def stringify_nested(spark, sf):
    text = F.concat(F.lit('{"v":['), F.col("n_nationkey").cast("string"), F.lit(',null,"'), F.col("n_name"), F.lit('"]}'))
    return t(spark, sf, "nation").select("n_nationkey", X.json(text, "$.v").one().alias("v"))


@query("SELECT page_id, unnest(regexp_extract_all(url, '[0-9]+')) AS n FROM pages")
def regex_all(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.explode(X.regex("url", "[0-9]+").all()).alias("n"))


@query("SELECT page_id, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) AS n FROM pages")
def regex_group(spark, sf):
    return t(spark, sf, "pages").select("page_id", X.regex("url", "/([a-z]{2})/([0-9]+)").group(2).alias("n"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(html, 'utm_[a-z]+'), ''), 'none') AS tag FROM pages")
def regex_no_match_default(spark, sf):
    return planner.items(responses(spark, sf), step_of([field("tag", "utm_[a-z]+", "text", "regex", default="none")]), keep=("page_id",)).select("page_id", "tag")


@query("SELECT page_id, url AS v FROM pages UNION ALL SELECT page_id, url FROM pages")
def final_url_field(spark, sf):
    return planner.items(responses(spark, sf), step_of([field("v", ["a", "b"], "final_url", multiple=True)]), keep=("page_id",)).select("page_id", F.explode("v").alias("v"))


@query("SELECT n_nationkey, n_name AS v FROM nation")
def header_field(spark, sf):
    rows = t(spark, sf, "nation").select("n_nationkey", F.lit("u").alias("url"), F.lit("").alias("text"), F.create_map(F.lit("x-name"), F.array("n_name")).alias("headers"), F.create_map().cast("map<string,string>").alias("meta"))
    return planner.items(rows, step_of([field("v", ["X-Name", "x-name"], "headers")]), keep=("n_nationkey",)).select("n_nationkey", "v")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS v FROM orders")
def meta_string_only(spark, sf):
    value = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))).otherwise(F.col("o_orderkey").cast("string"))
    rows = t(spark, sf, "orders").select("o_orderkey", F.lit("u").alias("url"), F.lit("").alias("text"), F.create_map(F.lit("p"), value).alias("meta"))
    return planner.items(rows, step_of([field("v", "x", "meta.p")]), keep=("o_orderkey",)).select("o_orderkey", "v")


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS answers FROM pages")
def ai_selector(spark, sf):
    return t(spark, sf, "pages").select(F.size(X.ai("html", "what is this?").all()).alias("a")).agg(F.count("*").alias("n"), F.sum("a").alias("answers"))


@query("SELECT doc_id, trim(replace(text, chr(10), ' ')) AS v FROM documents")
def trim_unicode(spark, sf):
    return t(spark, sf, "documents").select("doc_id", trim_column(F.concat(F.lit(" \t\u00a0\u2003"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\u3000\u2028 \x85\n"))).alias("v"))


# --- filters and follow --------------------------------------------------------------------------------


@query(f"SELECT page_id, {_HOST} AS host FROM pages")
def extract_host(spark, sf):
    return t(spark, sf, "pages").select("page_id", ops.extract_host(F.col("url")).alias("host"))


@query(f"SELECT page_id FROM (SELECT page_id, {_HOST} AS h FROM pages) WHERE h = 'example.org' OR h LIKE '%.example.org' OR h LIKE '%.example.net'")
def allowed_domains(spark, sf):
    return ops.allowed_domains(t(spark, sf, "pages"), ["example.org", "example.net"]).select("page_id")


@query(f"SELECT page_id, href FROM ({_HREFS}) WHERE regexp_matches(href, '^/t') AND NOT regexp_matches(href, 'at$')")
def allow_deny(spark, sf):
    hrefs = css_nav_href(spark, sf)
    return hrefs.filter(planner.allowed_by(F.col("href"), ("^/t",), ("at$",)))


@query(f"SELECT page AS src_url, href AS url, '\"detail\"' AS next_step, CAST(page_id AS VARCHAR) AS page, 'true' AS from_list FROM ({_HREFS}) WHERE NOT regexp_matches(href, '^/the')")
def follow_requests(spark, sf):
    link = field("nav", "nav a", deny=["^/the"], to={"next_step": "detail", "meta_patch": {"from_list": True}})
    rows = planner.requests(responses(spark, sf), step_of(links=[link]))
    return rows.select("src_url", "url", F.col("meta")["next_step"].alias("next_step"), F.col("meta")["page"].alias("page"), F.col("meta")["from_list"].alias("from_list"))


@query(f"SELECT page_id FROM (SELECT page_id, {_HOST} AS h FROM pages) WHERE page_id % 7 = 0 OR h LIKE '%.example.org'")
def dont_filter_bypass(spark, sf):
    rows = t(spark, sf, "pages").withColumn("dont_filter", F.col("page_id") % 7 == 0)
    return ops.allowed_domains(rows, ["example.org"]).select("page_id")


@query(f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def host_counts(spark, sf):
    return extract_host(spark, sf).groupBy("host").agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN NOT contains(url, 'utm_') THEN 'required field missing: tag' END AS error FROM pages")
def required_missing(spark, sf):
    rows = responses(spark, sf).withColumn("text", F.col("url"))
    return planner.items(rows, step_of([field("tag", "utm_[a-z]+", "text", "regex", required=True)]), keep=("page_id",)).select("page_id", "error")


# --- XML, XPath, feeds -----------------------------------------------------------------------------------


def _part_xml(spark, sf):
    return spread(t(spark, sf, "part").select("p_partkey", "p_name")).select("p_partkey", "p_name", F.concat(F.lit('<p id="'), F.col("p_partkey").cast("string"), F.lit('"><n>'), F.col("p_name"), F.lit("</n></p>")).alias("xml"))


@query("SELECT p_partkey, trim(p_name) AS name FROM part")
def xpath_text(spark, sf):
    return _part_xml(spark, sf).select("p_partkey", X.xpath("xml", "//n").text().one().alias("name"))


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id FROM part")
def xpath_attr(spark, sf):
    return _part_xml(spark, sf).select("p_partkey", X.xpath("xml", "/p").attr("id").one().alias("id"))


@query("SELECT p_partkey, CAST(length(p_name) AS VARCHAR) AS n FROM part")
def xpath_function(spark, sf):
    return _part_xml(spark, sf).select("p_partkey", X.xpath("xml", "string-length(/p[@id]/n)").one().alias("n"))


@query("SELECT s_suppkey, 'a' || s_suppkey AS v FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, 'z' FROM supplier")
def xml_nested_text_nodes(spark, sf):
    xml = F.concat(F.lit("<s>a"), F.col("s_suppkey").cast("string"), F.lit("<b>"), F.col("s_name"), F.lit("</b>z</s>"))
    return spread(t(spark, sf, "supplier").select("s_suppkey", "s_name")).select("s_suppkey", F.explode(X.xml(xml, "/s").text().all()).alias("v"))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS found FROM pages")
def xpath_on_html_is_empty(spark, sf):
    return t(spark, sf, "pages").select(F.size(X.xpath("html", "//h1").all()).alias("k")).agg(F.count("*").alias("n"), F.sum("k").alias("found"))


def _rss(spark, sf):
    item = F.concat(F.lit("<item><title>"), F.col("doc_id").cast("string"), F.lit("</title><link>http://e/"), F.col("doc_id").cast("string"), F.lit("</link><description><![CDATA[<i>"), F.col("source"), F.lit("</i>]]></description></item>"))
    return t(spark, sf, "documents").groupBy("source").agg(F.array_join(F.collect_list(item), "").alias("items")).select("source", F.concat(F.lit("<rss><channel><title>All of "), F.col("source"), F.lit("</title>"), F.col("items"), F.lit("</channel></rss>")).alias("xml"))


@query("SELECT source, CAST(doc_id AS VARCHAR) AS title, 'http://e/' || doc_id AS link, '<i>' || source || '</i>' AS description FROM documents")
def feed_items_rss(spark, sf):
    return _rss(spark, sf).select("source", F.explode(X.feed("xml").items()).alias("i")).select("source", "i.title", "i.link", "i.description")


@query("SELECT page_id, replace(url, '&', '+') AS link, CAST(page_id AS VARCHAR) AS guid, 'Bob' AS author FROM pages")
def feed_items_atom(spark, sf):
    xml = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>'), F.col("page_id").cast("string"), F.lit('</id><link href="'), F.replace("url", F.lit("&"), F.lit("+")), F.lit('"/><author><name>Bob</name></author></entry></feed>'))
    return t(spark, sf, "pages").select("page_id", F.explode(X.feed(xml).items()).alias("i")).select("page_id", "i.link", "i.guid", "i.author")


@query("SELECT source, 'All of ' || source AS title, count(*) AS links FROM documents GROUP BY source")
def feed_titles_links(spark, sf):
    return _rss(spark, sf).select("source", X.feed("xml").title().alias("title"), F.size(X.feed("xml").links()).cast("long").alias("links"))


# --- frontier state ----------------------------------------------------------------------------------------


def _arrivals(spark, sf):
    return t(spark, sf, "events").select("event_id", F.col("event_id").alias("seq"), F.col("user_id").alias("step"), millis("ts").alias("arrival_ms"), "event_type")


_ARRIVALS = "SELECT event_id, user_id AS step, epoch_us(ts) // 1000 AS a, event_type FROM events"


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1")
def dedup_url(spark, sf):
    return ops.dedup(_arrivals(spark, sf), "event_type", partition=("step",)).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1 OR event_type = 'view'")
def dedup_meta_key(spark, sf):
    rows = _arrivals(spark, sf).withColumn("key", F.nullif(F.col("event_type"), F.lit("view")))
    return ops.dedup(rows, "key", partition=("step",)).select("event_id")


@query(f"SELECT event_id, n * 60000 + max(a - n * 60000) OVER (PARTITION BY step ORDER BY n ROWS UNBOUNDED PRECEDING) AS admitted_ms FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY a, event_id) - 1 AS n FROM ({_ARRIVALS}))")
def interval_gate(spark, sf):
    return ops.interval_gate(_arrivals(spark, sf), 60_000).select("event_id", "admitted_ms")


@query(f"SELECT event_id, CAST(j * 60001 + max(a - j * 60001) OVER (PARTITION BY step, r ORDER BY j ROWS UNBOUNDED PRECEDING) AS BIGINT) AS admitted_ms FROM (SELECT *, n % 3 AS r, n // 3 AS j FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY a, event_id) - 1 AS n FROM ({_ARRIVALS})))")
def rate_limit(spark, sf):
    return ops.rate_limit(_arrivals(spark, sf), 3).select("event_id", "admitted_ms")


_ATTEMPTS = "SELECT event_id, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS retries FROM events"


def _attempts(spark, sf):
    rows = t(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"))
    return ops.attempt_number(rows, key=("user_id",), order=("event_id",)).drop("user_id")


@query(f"SELECT event_id, CAST(retries AS INTEGER) AS retries FROM ({_ATTEMPTS})")
def attempt_numbers(spark, sf):
    return _attempts(spark, sf).select("event_id", "retries")


@query(f"SELECT event_id, CASE WHEN status IN (500, 503) AND retries < 20 THEN 'retry' ELSE 'continue' END AS flow FROM ({_ATTEMPTS})")
def retry_by_status(spark, sf):
    return ops.retry_by_status(_attempts(spark, sf), [500, 503], 20).select("event_id", "flow")


@query(f"SELECT event_id, CASE WHEN status = 500 AND retries < 30 THEN [10, 20, 40][least(retries, 2) + 1] END AS backoff_ms FROM ({_ATTEMPTS})")
def retry_backoff(spark, sf):
    return ops.retry_by_status(_attempts(spark, sf), [500], 30, [10, 20, 40]).select("event_id", F.col("backoff_ms").cast("int").alias("backoff_ms"))


@query(f"SELECT event_id, CASE WHEN status = 500 AND retries < 5 THEN 'retry' ELSE 'continue' END AS flow FROM ({_ATTEMPTS})")
def retry_by_error(spark, sf):
    error = F.when(F.col("status") == 500, F.struct(F.lit("download").alias("kind"), F.lit("reset").alias("message")))
    return ops.retry_by_error(_attempts(spark, sf).withColumn("error", error), 5).select("event_id", "flow")


@query("SELECT event_id FROM events WHERE epoch_us(ts) // 1000 <= 1705000000000 OR event_type = 'view'")
def delayed_ready(spark, sf):
    rows = _arrivals(spark, sf).withColumn("ready_at_ms", F.when(F.col("event_type") != "view", F.col("arrival_ms")))
    return ops.ready(rows, 1_705_000_000_000).select("event_id")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority LIKE '1%')")
def ack_anti(spark, sf):
    inflight = t(spark, sf, "customer").select(F.col("c_custkey").alias("url"))
    done = t(spark, sf, "orders").filter("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("url"))
    return ops.acked(inflight, done).select(F.col("url").alias("c_custkey"))


@query("SELECT c_custkey, CAST(-1 AS INTEGER) AS priority FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def nack_semi(spark, sf):
    inflight = t(spark, sf, "customer").select(F.col("c_custkey").alias("url"), F.col("c_custkey").alias("seq"))
    return ops.nacked(inflight, t(spark, sf, "orders").select(F.col("o_custkey").alias("url"))).select(F.col("url").alias("c_custkey"), "priority")


@query(f"SELECT page_id, (row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) - 1) // 8 AS wave FROM pages")
def concurrency_waves(spark, sf):
    return ops.wave_of(t(spark, sf, "pages"), 8, order=("page_id",)).select("page_id", "wave")


@query(f"SELECT count(DISTINCT page_id) AS rounds, count(*) AS follows, max(n) AS most FROM (SELECT page_id, count(*) OVER (PARTITION BY page_id) AS n FROM ({_HREFS}))")
def output_totals(spark, sf):
    per = css_nav_href(spark, sf).groupBy("page_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("rounds"), F.sum("n").alias("follows"), F.max("n").alias("most"))


@query("SELECT * FROM (VALUES (0, 'interval_gate'), (1, 'rate_limit'), (2, 'retry_by_status'), (3, 'retry_by_error'), (4, 'dedup')) v(place, key)")
def priority_order_chain(spark, sf):
    from webloom.engine import build_chain
    from webloom.plans.rules import Runtime, lower

    chain = build_chain(lower(Runtime({"interval_ms": 10, "rate_per_minute": 1}, {"count": 1, "http_status": [500]}, {"enabled": True})), {})
    return spark.createDataFrame([(i, k) for i, (k, _, _) in enumerate(chain)], "place int, key string")


def _graph(spark, sf) -> tuple[DataFrame, list[str]]:
    """Pages that link: a region to its nations, a nation back to its region and to the tenth nation on."""
    nation = t(spark, sf, "nation")
    link = lambda url: F.concat(F.lit('<a href="'), url, F.lit('">x</a>'))
    nat = lambda k: F.concat(F.lit("http://n.test/"), k.cast("string"))
    reg = lambda k: F.concat(F.lit("http://r.test/"), k.cast("string"))
    a = nation.groupBy("n_regionkey").agg(F.array_join(F.collect_list(link(nat(F.col("n_nationkey")))), "").alias("text")).select(reg(F.col("n_regionkey")).alias("url"), "text")
    b = nation.select(nat(F.col("n_nationkey")).alias("url"), F.concat(link(reg(F.col("n_regionkey"))), link(nat(F.col("n_nationkey") + 10))).alias("text"))
    return a.union(b), ["http://r.test/0"]


@query("""WITH RECURSIVE e AS (SELECT 'http://r.test/' || n_regionkey AS a, 'http://n.test/' || n_nationkey AS b FROM nation UNION SELECT 'http://n.test/' || n_nationkey, 'http://r.test/' || n_regionkey FROM nation UNION SELECT 'http://n.test/' || n_nationkey, 'http://n.test/' || (n_nationkey + 10) FROM nation),
p AS (SELECT DISTINCT a AS url FROM e), f(url) AS (SELECT 'http://r.test/0' UNION SELECT e.b FROM f JOIN e ON e.a = f.url)
SELECT url AS page_url FROM f JOIN p USING (url)""")
def bfs_frontier(spark, sf):
    from webloom.plans.rules import Settings

    corpus, start = _graph(spark, sf)
    rules = {"type": "inline", "options": {"value": {"steps": [{"id": "parse", "impl": "dsl", "parse": {"fields": [field("n", "a", attribute="attr:href", multiple=True)], "links": [field("all", "a")]}}]}}}
    result = Engine(CorpusFetcher(corpus), Settings(dedup=True, retry_times=0, max_nacks=0)).run(spark, Spider("graph", start, rules=rules))
    return result.items.select("page_url")


# --- crawls: small graphs of nations and regions ---------------------------------------------------------------


def _settings(**more):
    from webloom.plans.rules import Settings

    return Settings(**({"retry_times": 0, "max_nacks": 0, "concurrent_requests": None, "concurrent_requests_per_domain": 1000} | more))


def _rules(*steps: dict) -> dict:
    return {"type": "inline", "options": {"value": {"steps": list(steps)}}}


def _dsl(name: str, fields=(), links=(), **more) -> dict:
    return {"id": name, "impl": "dsl", "parse": {"fields": list(fields), "links": list(links)}, **more}


def _nation_url() -> F.Column:
    return F.concat(F.lit("http://n.test/"), F.col("n_nationkey").cast("string"))


def _nations(spark, sf) -> tuple[DataFrame, list[str]]:
    """A page for each nation, with its name and a link to its region's page, and those pages. All URLs of nations."""
    nation, region = t(spark, sf, "nation"), t(spark, sf, "region")
    reg = F.concat(F.lit("http://r.test/"), F.col("n_regionkey").cast("string"))
    a = nation.select(_nation_url().alias("url"), F.concat(F.lit("<h1>"), F.col("n_name"), F.lit('</h1><a href="'), reg, F.lit('">r</a>')).alias("text"))
    b = region.select(F.concat(F.lit("http://r.test/"), F.col("r_regionkey").cast("string")).alias("url"), F.concat(F.lit("<h1>"), F.col("r_name"), F.lit("</h1>")).alias("text"))
    return a.union(b), [r.url for r in nation.select(_nation_url().alias("url")).orderBy("n_nationkey").collect()]


def _crawl(spark, corpus: DataFrame, spider: Spider, *pipelines, **settings):
    return Engine(CorpusFetcher(corpus), _settings(**settings)).with_pipeline(*pipelines).run(spark, spider)


_N = "'http://n.test/' || n_nationkey"
_R = "'http://r.test/' || n_regionkey"


@query(f"SELECT {_R} AS url, 'detail' AS step, r_name AS said FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey % 2 = 0 UNION ALL SELECT {_R}, 'nowhere', 'step not found: nowhere' FROM nation WHERE n_regionkey % 2 = 1")
def step_routing(spark, sf):
    corpus, urls = _nations(spark, sf)
    links = [field("even", "a", allow=["[02468]$"], to={"next_step": "detail"}), field("odd", "a", deny=["[02468]$"], to={"next_step": "nowhere"})]
    r = _crawl(spark, corpus, Spider("s", urls, rules=_rules(_dsl("parse", links=links), _dsl("detail", [field("name", "h1")]))))
    items = r.items.select(F.col("page_url").alias("url"), "step", F.get_json_object("item", "$.name").alias("said"))
    return items.unionByName(r.dead_letter.select("url", "step", F.col("message").alias("said")))


@query(f"SELECT {_N} AS page_url, upper(substr(n_name, 1, 3)) || n_regionkey AS v FROM nation WHERE n_nationkey % 3 <> 0 AND n_regionkey <> 4")
def pipeline_filter_mutate(spark, sf):
    from webloom.sinks import Each, ItemPipeline

    corpus, urls = _nations(spark, sf)
    keep = lambda item, spider: None if item["region"].endswith("4") else {"v": item["name"][:3].upper() + item["region"][-1]}
    fields = [field("name", "h1"), field("region", "a", attribute="attr:href")]
    r = _crawl(spark, corpus, Spider("s", urls, rules=_rules(_dsl("parse", fields))), ItemPipeline(), lambda d: d.filter("regexp_extract(page_url, '[0-9]+$', 0) % 3 <> 0"), Each(keep))
    return r.items.select("page_url", F.get_json_object("item", "$.v").alias("v"))


@query(f"SELECT {_N} AS url, CASE WHEN n_nationkey % 5 = 0 THEN 'pipeline' ELSE 'item' END AS what, CASE WHEN n_nationkey % 5 = 0 THEN 'ValueError: no ' || n_name ELSE n_name END AS said FROM nation")
def pipeline_dead_letter(spark, sf):
    from webloom.sinks import Each

    def check(item: dict, spider: str) -> dict:
        if int(item["name"].split("_")[1]) % 5 == 0:
            raise ValueError("no " + item["name"])
        return item

    corpus, urls = _nations(spark, sf)
    r = _crawl(spark, corpus, Spider("s", urls, rules=_rules(_dsl("parse", [field("name", "h1")]))), Each(check))
    items = r.items.select(F.col("page_url").alias("url"), F.lit("item").alias("what"), F.get_json_object("item", "$.name").alias("said"))
    return items.unionByName(r.dead_letter.select("url", F.col("kind").alias("what"), F.col("message").alias("said")))


@query(f"SELECT {_N} AS src_url, {_R} AS url FROM nation, range(2)")
def duplicate_seeds(spark, sf):
    corpus, urls = _nations(spark, sf)
    r = _crawl(spark, corpus, Spider("s", urls * 2, rules=_rules(_dsl("parse", links=[field("r", "a")]))))
    return r.requests.select("src_url", "url")


@query(f"SELECT {_N} AS page_url, '{{\"x-key\":[\"' || n_nationkey || '\"]}}' AS asked, '{{\"set-cookie\":[\"second\"]}}' AS answered, CAST(1 AS BIGINT) AS retries FROM nation")
def retry_headers(spark, sf):
    from webloom.requests import Request

    corpus, urls = _nations(spark, sf)
    tries = spark.createDataFrame([(0, 500, "first"), (1, 200, "second")], "attempt int, status int, cookie string")
    both = corpus.crossJoin(F.broadcast(tries)).withColumn("headers", F.create_map(F.lit("set-cookie"), F.array("cookie")))
    spider = Spider("s", start_requests=[Request(u).with_header("x-key", u.rpartition("/")[2]) for u in urls])

    @spider.callback
    def parse(rows):
        seen = F.struct(F.to_json("request.headers").alias("asked"), F.to_json("headers").alias("answered"), F.col("retries").alias("retries"))
        return rows.select("seq", F.to_json(seen).alias("item")), None

    r = _crawl(spark, both, spider, retry_times=1, retry_http_codes=(500,))
    return r.items.select("page_url", F.get_json_object("item", "$.asked").alias("asked"), F.get_json_object("item", "$.answered").alias("answered"), F.get_json_object("item", "$.retries").cast("long").alias("retries"))


@query(f"SELECT {_N} AS page_url, '{{\"error\":\"' || n_name || '\",\"item\":null,\"seq\":\"' || n_name || '\",\"url\":\"' || {_R} || '\"}}' AS item FROM nation")
def field_named_url(spark, sf):
    corpus, urls = _nations(spark, sf)
    fields = [field("url", "a", attribute="attr:href"), field("seq", "h1"), field("error", "h1"), field("item", "h6")]
    return _crawl(spark, corpus, Spider("s", urls, rules=_rules(_dsl("parse", fields)))).items.select("page_url", "item")


@query("SELECT CAST(ceil(count(*) / 4.0) AS BIGINT) AS waves, count(*) AS fetches, count(*) AS rounds FROM nation")
def global_waves(spark, sf):
    corpus, urls = _nations(spark, sf)
    r = _crawl(spark, corpus, Spider("s", urls, rules=_rules(_dsl("parse", [field("n", "h1")]))), concurrent_requests=4)
    return spark.createDataFrame([(r.waves, r.fetches, r.rounds)], "waves long, fetches long, rounds long")


@query(f"SELECT page_id, CAST((row_number() OVER (ORDER BY w, page_id) - 1) // 20 AS BIGINT) AS wave FROM (SELECT page_id, (row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) - 1) // 3 AS w FROM pages)")
def concurrency_waves_at_once(spark, sf):
    return ops.wave_of(t(spark, sf, "pages"), 3, at_once=20, order=("page_id",)).select("page_id", "wave")


@query(f"SELECT {_N} AS page_url, 'retry by error: parse error: required field missing: name' AS reason, n_name AS name FROM nation")
def retry_parse_error(spark, sf):
    from webloom.plans.rules import Middleware

    corpus, urls = _nations(spark, sf)
    both = corpus.withColumn("attempt", F.lit(1)).union(corpus.withColumn("text", F.lit("<p>")).withColumn("attempt", F.lit(0)))
    fields = [field("name", "h1", required=True), field("reason", "x", "meta._retry_reason")]
    again = {"retry_by_error": Middleware(type="spider", options={"count": [1]})}
    r = _crawl(spark, both, Spider("s", urls, rules=_rules(_dsl("parse", fields))), middlewares=again)
    return r.items.select("page_url", F.get_json_object("item", "$.reason").alias("reason"), F.get_json_object("item", "$.name").alias("name"))


@query(f"SELECT {_N} AS page_url, 'parse' AS step, CAST(1 AS BIGINT) AS items, CAST(1 AS BIGINT) AS follows FROM nation UNION ALL SELECT {_R}, 'end', 1, 0 FROM (SELECT DISTINCT n_regionkey FROM nation)")
def rounds_of_a_crawl(spark, sf):
    corpus, urls = _nations(spark, sf)
    steps = _rules(_dsl("parse", [field("n", "h1")], [field("r", "a", to={"next_step": "end"})]), _dsl("end", [field("n", "h1")], MIDDLEWARES={"dedup": {}}))
    return _crawl(spark, corpus, Spider("s", urls, rules=steps)).by_round.select("page_url", "step", "items", "follows")


@query(f"SELECT {_N} AS url, CASE n_nationkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 200 END AS status, CASE n_nationkey % 3 WHEN 0 THEN 'HTTP/1.1' WHEN 1 THEN 'browser' END AS protocol, CASE n_nationkey % 3 WHEN 1 THEN 'browser' ELSE '' END AS flags, CASE WHEN n_nationkey % 3 = 2 THEN 'unsupported mode: telnet' END AS error FROM nation")
def mode_router(spark, sf):
    from webloom.sources.fetch import Router

    corpus, _ = _nations(spark, sf)
    mode = F.element_at(F.array(F.lit("http"), F.lit("browser"), F.lit("telnet")), F.col("n_nationkey") % 3 + 1)
    asked = t(spark, sf, "nation").select(_nation_url().alias("url"), mode.alias("mode"), F.create_map().cast("map<string,string>").alias("meta"))
    got = Router(CorpusFetcher(corpus)).fetch(asked)
    return got.select("url", "status", "protocol", F.array_join("flags", " ").alias("flags"), F.col("error.message").alias("error"))


@query(f"SELECT {_N} AS url, chr(65533) || n_name || chr(65533) AS text FROM nation")
def lossy_utf8(spark, sf):
    from webloom.sources.fetch import lossy_text

    body = F.concat(F.unhex(F.lit("FF")), F.col("n_name").cast("binary"), F.unhex(F.lit("C3")))
    return t(spark, sf, "nation").select(_nation_url().alias("url"), lossy_text(body).alias("text"))


@query("SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_nationkey), ' ') AS names, CAST(1 AS INTEGER) AS n FROM nation GROUP BY n_regionkey")
def header_grouping(spark, sf):
    from webloom.sources.fetch import collected_headers

    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    rows = t(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    pairs = F.concat(F.transform("n", lambda x: pair("x-name", x["n_name"])), F.transform("n", lambda x: pair("x-bad", F.concat(x["n_name"], F.lit("\u00e9")))))
    got = rows.select("n_regionkey", collected_headers(pairs).alias("h"))
    return got.select("n_regionkey", F.array_join(F.col("h")["x-name"], " ").alias("names"), F.size("h").alias("n"))


@query("SELECT CAST(v AS INTEGER) AS v, name FROM (VALUES (9, 'HTTP/0.9'), (10, 'HTTP/1.0'), (11, 'HTTP/1.1'), (20, 'HTTP/2'), (30, 'HTTP/3'), (99, 'HTTP/unknown')) x(v, name)")
def http_versions(spark, sf):
    from webloom.sources.fetch import http_version

    return spark.createDataFrame([(v, http_version(v)) for v in (9, 10, 11, 20, 30, 99)], "v int, name string")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS k FROM events) e WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id < 100 AND s.event_type = e.event_type AND s.user_id = e.user_id)")
def dedup_seen(spark, sf):
    rows = _arrivals(spark, sf)
    return ops.dedup(rows, "event_type", partition=("step",), seen=rows.filter("event_id < 100")).select("event_id")


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, trim(p_name) AS html, 'x' AS none FROM part")
def xpath_fields(spark, sf):
    rows = _part_xml(spark, sf).select("p_partkey", F.lit("u").alias("url"), F.col("xml").alias("text"), F.create_map().cast("map<string,string>").alias("meta"))
    fields = [field("id", "/p", "xml", "xml", attribute="attr:id"), field("name", "//n", "xml", "xpath"), field("html", "//n", "xml", "xpath", attribute="html"), field("none", "//q", "xml", "xpath", default="x")]
    return planner.items(rows, step_of(fields), keep=("p_partkey",)).select("p_partkey", "id", "name", "html", "none")


@query("SELECT p_partkey, p_name AS v FROM part")
def xpath_html(spark, sf):
    return _part_xml(spark, sf).select("p_partkey", X.xpath("xml", "/p/n").html().one().alias("v"))


@query(f"SELECT page_id, trim({_DECODE.format(chr(114) + 'egexp_extract(html, ' + chr(39) + '<title>(.*?)</title>' + chr(39) + ', 1)')}) AS title, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS INTEGER) AS links FROM pages")
def queries_together(spark, sf):
    found = X.together("html", title=X.css("html", "title").text(), links=X.css("html", "nav a").attr("href"))
    return t(spark, sf, "pages").select("page_id", found.alias("f")).select("page_id", F.get("f.title", F.lit(0)).alias("title"), F.size("f.links").alias("links"))


@query("SELECT page_id, nullif(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2), '') AS n FROM pages")
def regex_group_field(spark, sf):
    rows = responses(spark, sf).withColumn("text", F.col("url"))
    return planner.items(rows, step_of([field("n", "/([a-z]{2})/([0-9]+)", "text", "regex", attribute="group:2")]), keep=("page_id",)).select("page_id", "n")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS whole FROM events")
def json_value(spark, sf):
    rows = t(spark, sf, "events")
    return rows.select("event_id", F.try_variant_get(X.json("props", "$.k").value(), "$", "bigint").alias("k"), F.to_json(X.json("props").value()).alias("whole"))


@query(f"SELECT page_id, split_part(page, '/', 1) || '//' || split_part(page, '/', 3) || href AS url FROM ({_HREFS})")
def resolve_urls(spark, sf):
    from webloom.engine import _joined

    rows = t(spark, sf, "pages").select("page_id", "url", F.explode(X.css("html", "nav ul > li a").attr("href").all()).alias("href"))
    return rows.select("page_id", _joined(F.col("url"), F.col("href")).alias("url"))


@query(f"SELECT {_N} AS url, CAST(CASE WHEN n_nationkey % 2 = 0 THEN -1 ELSE 0 END AS INTEGER) AS priority, CAST(CASE WHEN n_nationkey < 10 AND n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS nacks FROM nation WHERE n_nationkey >= 10 AND false OR n_nationkey < 10 AND n_nationkey % 2 = 0 UNION ALL SELECT {_N}, 0, 0 FROM nation WHERE n_nationkey >= 10")
def scheduler_lease(spark, sf):
    """Ten tasks are leased; the even ones fail and come back, the odd ones are done."""
    from webloom.operators.scheduler import TableScheduler
    from webloom.requests import frame

    _, urls = _nations(spark, sf)
    s = TableScheduler()
    s.open(spark)
    s.enqueue(frame(spark, urls))
    leased = s.lease(0, 1000, 10)
    s.nack(leased.filter("seq % 2 = 0").select("seq"))
    s.ack(leased.filter("seq % 2 = 1").select("seq"))
    return s.pending().select("url", "priority", "nacks")


@query("""SELECT * FROM (VALUES ('http://a/', 'http', 'GET', CAST(NULL AS VARCHAR), true, false, CAST(NULL AS VARCHAR)),
('http://b/', 'browser', 'GET', NULL, false, true, '1024x768 firefox'), ('http://c/', 'http', 'POST', 'k=1', true, false, NULL),
('http://d/', 'browser', 'GET', NULL, false, true, '1280x720 chrome'), ('http://e/', 'http', 'GET', 'a=1 b=2', true, false, NULL)) v(url, mode, method, cookies, http, browser, view)""")
def request_builders(spark, sf):
    from webloom.requests import BrowserConfig, frame, Request

    made = [
        Request("http://a/"),
        Request.in_browser("http://b/").with_browser(BrowserConfig().with_viewport(1024, 768).with_engine("firefox")),
        Request.in_browser("http://c/").with_method("POST").with_body("x").with_cookie("k", "1"),
        Request("http://d/").with_cookie("k", "1").with_mode("browser").with_browser(BrowserConfig(engine="chrome")),
        Request("http://e/").with_cookies({"b": "2", "a": "1"}).with_meta("page", 1).merge_meta({"page": 2}),
    ]
    cookies = F.array_join(F.transform(F.array_sort(F.map_entries("http.cookies")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    view = F.concat_ws(" ", F.concat(F.col("browser.width").cast("string"), F.lit("x"), F.col("browser.height").cast("string")), "browser.engine")
    return frame(spark, made).select("url", "mode", "method", F.nullif(cookies, F.lit("")).alias("cookies"), F.col("http").isNotNull().alias("http"), F.col("browser").isNotNull().alias("browser"), F.when(F.col("browser").isNotNull(), view).alias("view"))


@query("SELECT * FROM (VALUES ('list', 'http', 'POST', 'v', 'b', CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER)), ('page', 'browser', 'GET', NULL, NULL, 'google_chrome', 800)) v(step, mode, method, header, body, engine, width)")
def fetch_plans(spark, sf):
    fetches = [("list", {"request": {"method": "POST", "headers": {"x-token": "v"}, "body": "b"}}), ("page", {"mode": "browser", "browser": {"engine": "google-chrome", "viewport": {"width": 800}}})]
    steps = compile_rules({"steps": [{"id": n, "impl": "dsl", "fetch": f} for n, f in fetches]}).steps
    rows = [(s.id, s.fetch.mode, s.fetch.method, (s.fetch.headers.get("x-token") or [None])[0], s.fetch.body.decode() if s.fetch.body else None, (s.fetch.browser or {}).get("engine"), (s.fetch.browser or {}).get("width")) for s in steps]
    return spark.createDataFrame(rows, "step string, mode string, method string, header string, body string, engine string, width int")


@query(f"SELECT n_nationkey, 'sha256:' || lower(to_hex(CAST(list_reduce(list_transform(string_split('secret' || {_N}, ''), lambda c: CAST(unicode(c) AS HUGEINT)), lambda a, b: (a * 31 + b) % 18446744073709551616::HUGEINT, 0::HUGEINT) AS UBIGINT))) AS signature FROM nation")
def signatures(spark, sf):
    from webloom.hooks import SignatureHook

    rows = t(spark, sf, "nation").select("n_nationkey", _nation_url().alias("url"), F.create_map().cast("map<string,array<string>>").alias("headers"))
    return SignatureHook({"secret": "secret"}).process_request(rows).select("n_nationkey", F.col("headers")["X-Signature"][0].alias("signature"))


def minimum_slice(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: a rules document over all pages."""
    step = step_of([field("title", ["article h1", "h1"]), field("nav", "nav a", attribute="attr:href", multiple=True)], [field("nav", "nav a", deny=["^/the"], to={"next_step": "parse"})])
    made = planner.items(responses(spark, sf), step, keep=("page_id", "url"))
    return made.select("page_id", "url", "title", F.size("nav").alias("n_links"))


QUERIES["rules_items"] = minimum_slice
ORACLES["rules_items"] = f"SELECT page_id, url, trim({_DECODE.format(chr(114) + 'egexp_extract(html, ' + chr(39) + '<h1>(.*?)</h1>' + chr(39) + ', 1)')}) AS title, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS INTEGER) AS n_links FROM pages"

