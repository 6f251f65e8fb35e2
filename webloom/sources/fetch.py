"""Fetchers: requests in, responses out. A response row keeps its request's columns but for those that a
response has itself (RESPONSE_COLUMNS; headers and body are then the response's); what can't be fetched
has an error of kind download."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VERSIONS = {9: "HTTP/0.9", 10: "HTTP/1.0", 11: "HTTP/1.1", 20: "HTTP/2", 30: "HTTP/3"}
RESPONSE_COLUMNS = ("status", "headers", "body", "text", "flags", "ip_address", "protocol", "error")


def http_version(number: int) -> str:
    return VERSIONS.get(number, "HTTP/unknown")


_HEADERS = "map<string,array<string>>"


def lossy_text(body: Column) -> Column:
    """UTF-8 with U+FFFD for what is none."""
    return F.make_valid_utf8(body.cast("string"))


def collected_headers(pairs: Column) -> Column:
    """map name -> values from an array of (name, value); values with control or non-ASCII signs go."""
    clean = F.filter(pairs, lambda p: p["value"].rlike(r"^[\t\x20-\x7e]*$"))
    names = F.array_distinct(F.transform(clean, lambda p: p["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(clean, lambda p: p["name"] == n), lambda p: p["value"])))


class Fetcher(ABC):
    mode = "http"

    def guard(self, requests: DataFrame) -> Column:
        """An error where the request is for another mode."""
        return F.when(F.col("mode") != self.mode, F.struct(F.lit("download").alias("kind"), F.concat(F.lit(f"{self.mode} fetcher received a request of mode "), F.col("mode")).alias("message")))

    @abstractmethod
    def fetch(self, requests: DataFrame) -> DataFrame: ...


class CorpusFetcher(Fetcher):
    """Offline: joins requests to a corpus of url, text and, if it has them, status, headers, attempt.

    With ``attempt`` the n-th try of a URL gets the row of attempt n (the last one from then on)."""

    def __init__(self, corpus: DataFrame, mode: str = "http"):
        self.mode = mode
        have = set(corpus.columns)
        self.corpus = corpus.select(
            F.col("url").alias("_url"),
            F.col("text").alias("_text"),
            (F.col("status").cast("int") if "status" in have else F.lit(200)).alias("_status"),
            (F.col("headers") if "headers" in have else F.create_map().cast(_HEADERS)).alias("_headers"),
            (F.col("attempt").cast("int") if "attempt" in have else F.lit(0)).alias("_attempt"),
        )

    def fetch(self, requests: DataFrame) -> DataFrame:
        wanted = requests.select(F.col("url").alias("_url")).filter("_url is not null").distinct()
        some = self.corpus.join(wanted, "_url", "left_semi")  # before anything is done with texts
        order = Window.partitionBy("_url").orderBy("_attempt")
        every = Window.partitionBy("_url")
        some = some.withColumns({"_i": F.row_number().over(order) - 1, "_last": F.count("*").over(every) - 1})
        tried = F.coalesce(F.try_element_at("meta", F.lit("_retry_times")).cast("int"), F.lit(0))
        on = (F.col("url") == F.col("_url")) & ((F.col("_i") == F.col("_tried")) | ((F.col("_i") == F.col("_last")) & (F.col("_tried") > F.col("_last"))))
        joined = requests.withColumn("_tried", tried).join(some, on, "left")
        missing = F.struct(F.lit("download").alias("kind"), F.concat(F.lit("not in corpus: "), F.col("url")).alias("message"))
        error = F.coalesce(self.guard(requests), F.when(F.col("_url").isNull(), missing))
        out = {"status": F.col("_status"), "headers": F.col("_headers"), "body": F.col("_text").cast("binary"), "text": F.col("_text"), "flags": F.array().cast("array<string>"), "ip_address": F.lit(None).cast("string"), "protocol": F.lit("HTTP/1.1"), "error": error}
        return joined.withColumns(out).drop("_url", "_text", "_status", "_headers", "_attempt", "_i", "_last", "_tried")


class BrowserStub(Fetcher):
    """Without a browser: 200, no body, flagged."""

    mode = "browser"

    def fetch(self, requests: DataFrame) -> DataFrame:
        return requests.withColumns({"status": F.lit(200), "headers": F.create_map().cast(_HEADERS), "body": F.lit(b""), "text": F.lit(""), "flags": F.array(F.lit("browser")), "ip_address": F.lit(None).cast("string"), "protocol": F.lit("browser"), "error": self.guard(requests)})


class Unsupported(Fetcher):
    """Nothing but errors."""

    mode = "none"

    def fetch(self, requests: DataFrame) -> DataFrame:
        error = F.struct(F.lit("download").alias("kind"), F.concat(F.lit("unsupported mode: "), F.col("mode")).alias("message"))
        text, none = F.lit(None).cast("string"), F.lit(None)
        return requests.withColumns({"status": none.cast("int"), "headers": none.cast(_HEADERS), "body": none.cast("binary"), "text": text, "flags": F.array().cast("array<string>"), "ip_address": text, "protocol": text, "error": error})


class Router(Fetcher):
    """Each request to the fetcher of its mode; one of another mode is an error."""

    def __init__(self, http: Fetcher, browser: Fetcher | None = None):
        self.by_mode = {"http": http, "browser": browser or BrowserStub()}

    def fetch(self, requests: DataFrame) -> DataFrame:
        mode = F.coalesce("mode", F.lit("http"))
        parts = [f.fetch(requests.filter(mode == m)) for m, f in self.by_mode.items()]
        parts.append(Unsupported().fetch(requests.filter(~mode.isin(list(self.by_mode)))))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: Pages that a worker holds as Python objects.
PAGES_AT_ONCE = 64


class HttpFetcher(Fetcher):
    """Over the network, with the standard library, on the executors. A page is fetched once a wave: the
    function is not deterministic, so no filter on its result calls it again."""

    def __init__(self, timeout_s: float = 30):
        self.timeout_s = timeout_s

    def fetch(self, requests: DataFrame) -> DataFrame:
        timeout = self.timeout_s
        kind = pa.struct([("status", pa.int32()), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("body", pa.binary()), ("ip_address", pa.string()), ("protocol", pa.string()), ("error", pa.string())])

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            done: list[pa.Array] = []
            for batch in batches:
                for at in range(0, len(batch), PAGES_AT_ONCE):
                    pages = [_get(r.as_py(), timeout) for r in batch[at : at + PAGES_AT_ONCE]]
                    done.append(pa.array(pages, kind))
                yield pa.concat_arrays(done or [pa.array([], kind)])
                done.clear()

        udf = F.arrow_udf(run, "struct<status:int,headers:array<struct<name:string,value:string>>,body:binary,ip_address:string,protocol:string,error:string>").asNondeterministic()
        rows = requests.withColumn("_r", udf(F.struct("url", "mode", "method", "headers", "body", "http")))
        error = F.when(F.col("_r.error").isNotNull(), F.struct(F.lit("download").alias("kind"), F.col("_r.error").alias("message")))
        return rows.withColumns({"status": F.col("_r.status"), "headers": collected_headers(F.col("_r.headers")), "body": F.col("_r.body"), "text": lossy_text(F.col("_r.body")), "flags": F.array().cast("array<string>"), "ip_address": F.col("_r.ip_address"), "protocol": F.col("_r.protocol"), "error": error}).drop("_r")


def _get(r: dict, timeout: float) -> dict:
    import urllib.error
    import urllib.parse
    import urllib.request

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *_):
            return None

    out = {"status": None, "headers": [], "body": None, "ip_address": None, "protocol": None, "error": None}
    if r["mode"] not in (None, "http"):
        return out | {"error": f"http fetcher received a request of mode {r['mode']}"}
    http = r["http"] or {"allow_redirects": True}
    url = r["url"]
    if http.get("query"):
        url += ("&" if "?" in url else "?") + urllib.parse.urlencode(http["query"])
    try:
        request = urllib.request.Request(url, data=r["body"], method=r["method"] or "GET")
        for name, values in (r["headers"] or []):
            for v in values:
                request.add_header(name, v)
        cookies = http.get("cookies") or []
        if cookies:
            request.add_header("Cookie", "; ".join(f"{k}={v}" for k, v in cookies))
        opener = urllib.request.build_opener(*([] if http.get("allow_redirects") else [Stay]))
        try:
            answer = opener.open(request, timeout=timeout)
        except urllib.error.HTTPError as e:  # a status is an answer
            answer = e
        with answer:
            ip = _peer(answer)
            return out | {"ip_address": ip, "status": answer.status, "headers": [{"name": k.lower(), "value": v} for k, v in answer.headers.items()], "body": answer.read(), "protocol": http_version(getattr(answer, "version", 11) or 11)}
    except (OSError, ValueError) as e:
        return out | {"error": str(e)}


def _peer(answer) -> str | None:
    """Address of the other side of an answer's socket."""
    inner = answer
    for name in ("fp", "raw", "_sock"):  # an error wraps its answer once more
        inner = getattr(inner, name, None) or inner
    inner = getattr(getattr(getattr(inner, "fp", None), "raw", None), "_sock", inner)
    try:
        return inner.getpeername()[0]
    except (AttributeError, OSError):
        return None
