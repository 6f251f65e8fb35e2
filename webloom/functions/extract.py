"""Selectors over page text as columns.

All selectors that a plan asks of one text run in one Arrow UDF, which parses the text at most once as
HTML, once as XML and once as JSON. Every selector is total: what can't be read gives an empty list.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, batched

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.dom import parse_html, select
from webloom.functions.feed import FIELDS, each_item, feed_title
from webloom.functions.patterns import matches, nested, to_java, to_python
from webloom.functions.values import json_select, json_text, stringify, trim, trim_column
from webloom.functions.xmlpath import parse_xml, xpath_strings

STRINGS = T.ArrayType(T.StringType())
FEED_ITEM = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])


@dataclass(frozen=True)
class Spec:
    """kind: css, xpath, xml, json, regex, ai. how: node, text, html, attr, all, group, one."""

    kind: str
    selector: str
    how: str
    arg: str = ""


class Page:
    """One text with its trees, made when first asked for."""

    def __init__(self, text: str):
        self.source = text
        self._html = self._xml = None
        self._seen: set[str] = set()

    def html(self):
        if self._html is None:
            self._html = parse_html(self.source)
        return self._html

    def xml(self):
        if "xml" not in self._seen:
            self._seen.add("xml")
            self._xml = parse_xml(self.source)
        return self._xml

    def run(self, s: Spec) -> list[str]:
        return getattr(self, "_" + ("xpath" if s.kind == "xml" else s.kind))(s)

    def _css(self, s: Spec) -> list[str]:
        selector, how, arg = s.selector, s.how, s.arg
        m = re.search(r"::(?:text|attr\(([^)]*)\))\s*$", selector)
        if m and how in ("node", "text", "html", "attr"):
            base = selector[: m.start()]
            if how == "node":
                how, arg = ("attr", m[1].strip()) if m[1] is not None else ("text", "")
            selector = base
        nodes = select(self.html(), selector)
        if how == "text":
            return [trim(n.text()) for n in nodes]
        if how == "attr":
            return [trim(n.attrs[arg]) for n in nodes if arg in n.attrs]
        return [n.outer() for n in nodes]

    def _xpath(self, s: Spec) -> list[str]:
        suffix = {"text": "//text()", "attr": f"//@{s.arg}"}.get(s.how, "")
        return [trim(x) for x in xpath_strings(self.xml(), s.selector + suffix)]

    def _json(self, s: Spec) -> list[str]:
        found, v = json_select(self.source, s.selector)
        if s.how == "value":
            return [json_text(v)] if found else []
        text = stringify(v) if found else None
        return [] if text is None else [trim(text)]

    def _regex(self, s: Spec) -> list[str]:
        found = matches(s.selector, self.source) if s.how != "group" or nested(s.selector) else None
        if s.how == "group":
            p = to_python(s.selector)
            m = (found[0] if found else None) if found is not None else p.search(self.source) if p is not None else None
            taken = [g for g in (m[0], *m.groups()) if g is not None] if m else []  # those that took no part shift the rest
            n = int(s.arg) if s.arg.isdigit() else 0
            return [trim(taken[n])] if n < len(taken) else []
        return [trim(m[0]) for m in found]

    def _ai(self, s: Spec) -> list[str]:
        return []


def extract(text: Column, specs: list[Spec]) -> Column:
    """Struct s0, s1, ... of arrays; a null text gives empty arrays."""
    kind = T.StructType([T.StructField(f"s{i}", STRINGS) for i in range(len(specs))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            columns: list[list[list[str]]] = [[] for _ in specs]
            for text_ in batch:  # one page at a time is a Python object
                page = Page(text_.as_py() or "")
                for out, s in zip(columns, specs):
                    out.append(page.run(s))
            yield pa.StructArray.from_arrays([pa.array(c, pa.list_(pa.string())) for c in columns], names=kind.names)

    return F.arrow_udf(run, kind)(text)


class Query:
    """A selector on a column, to be ended by one, all, value or group."""

    def __init__(self, column: Column, kind: str, selector: str | None, how: str = "node", arg: str = ""):
        self.column, self.spec = column, Spec(kind, selector if selector is not None else "$", how, arg)

    def _as(self, how: str, arg: str = "") -> Query:
        return Query(self.column, self.spec.kind, self.spec.selector, how, arg)

    def text(self) -> Query:
        return self._as("text")

    def html(self) -> Query:
        return self._as("html")

    def attr(self, name: str) -> Query:
        return self._as("attr", name)

    def group(self, n: int) -> Column:
        if self.spec.kind == "regex":
            return self._as("group", str(n)).one()
        return F.get(self.all(), F.lit(n))

    def all(self) -> Column:
        java = to_java(self.spec.selector) if self.spec.kind == "regex" and self.spec.how != "group" else None
        if self.spec.kind == "ai" or (self.spec.kind == "regex" and to_python(self.spec.selector) is None):
            return F.array().cast(STRINGS)
        if java is not None:  # stays in the JVM
            return F.transform(F.coalesce(F.regexp_extract_all(self.column, F.lit(java), F.lit(0)), F.array().cast(STRINGS)), trim_column)
        return extract(self.column, [self.spec])["s0"]

    def one(self) -> Column:
        return F.get(self.all(), F.lit(0))

    def value(self) -> Column:
        """Of a JSON query the value that was found, as a VARIANT; else as one()."""
        if self.spec.kind != "json":
            return self.one()
        return F.try_parse_json(F.get(extract(self.column, [Spec("json", self.spec.selector, "value")])["s0"], F.lit(0)))


def together(column, **queries: Query) -> Column:
    """A struct of the values that several queries give of one column, by one pass over its texts."""
    specs = [q.spec for q in queries.values()]
    found = extract(_column(column), list(dict.fromkeys(specs)))
    return F.struct(*(found[f"s{list(dict.fromkeys(specs)).index(q.spec)}"].alias(name) for name, q in queries.items()))


def css(column, selector: str) -> Query:
    return Query(_column(column), "css", selector)


def xpath(column, expression: str) -> Query:
    return Query(_column(column), "xpath", expression)


def xml(column, expression: str) -> Query:
    return Query(_column(column), "xml", expression)


def json(column, path: str | None = None) -> Query:
    return Query(_column(column), "json", path, "all")


def regex(column, pattern: str) -> Query:
    return Query(_column(column), "regex", pattern, "all")


def ai(column, prompt: str) -> Query:
    return Query(_column(column), "ai", prompt, "all")


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_ITEM = pa.struct([(f, pa.string()) for f in FIELDS])


def _items(source: str) -> pa.Array:
    """A feed's items; some thousands at a time are Python objects."""
    return pa.concat_arrays([pa.array([], _ITEM), *(pa.array(some, _ITEM) for some in batched(each_item(source), 10_000))])


def _lists(items: list[pa.Array]) -> pa.Array:
    ends = accumulate(map(len, items), initial=0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([pa.array([], _ITEM), *items]))


@functools.cache
def _feed():
    """One function for all that is asked of a feed: its text is parsed once, and once more as far as its title."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            titles, items = [], []
            for text in batch:  # one feed at a time is a Python object
                source = text.as_py() or ""
                titles.append(feed_title(source))
                items.append(_items(source))
            yield pa.StructArray.from_arrays([pa.array(titles, pa.string()), _lists(items)], names=["title", "items"])

    return F.arrow_udf(run, T.StructType([T.StructField("title", T.StringType()), T.StructField("items", T.ArrayType(FEED_ITEM))]))


class Feed:
    def __init__(self, column):
        self.parsed = _feed()(_column(column))

    def title(self) -> Column:
        return self.parsed["title"]

    def items(self) -> Column:
        return self.parsed["items"]

    def links(self) -> Column:
        return F.array_compact(self.items()["link"])

    def titles(self) -> Column:
        return F.array_compact(self.items()["title"])


def feed(column) -> Feed:
    return Feed(column)


def register(spark: SparkSession) -> None:
    """SQL functions css(html, selector, attribute), xpath_all(xml, expression), regex_all(text,
    pattern), json_all(json, path), xml_all(xml, expression), feed_items(xml)."""

    def arrays(kind: str, with_attribute: bool = False):
        def each(texts: pa.Array, selectors: pa.Array, attributes: pa.Array | None) -> pa.Array:
            out = []
            for i, (t, s) in enumerate(zip(texts.to_pylist(), selectors.to_pylist())):
                how, arg = projection(attributes[i].as_py() or "") if attributes is not None else ("all" if kind in ("json", "regex") else "node", "")
                out.append(Page(t or "").run(Spec(kind, s or "", how, arg)))
            return pa.array(out, pa.list_(pa.string()))

        if with_attribute:
            def run3(t: pa.Array, s: pa.Array, a: pa.Array) -> pa.Array:
                return each(t, s, a)

            return F.arrow_udf(run3, STRINGS)

        def run2(t: pa.Array, s: pa.Array) -> pa.Array:
            return each(t, s, None)

        return F.arrow_udf(run2, STRINGS)

    spark.udf.register("css", arrays("css", True))
    for name, kind in (("xpath_all", "xpath"), ("xml_all", "xml"), ("regex_all", "regex"), ("json_all", "json")):
        spark.udf.register(name, arrays(kind))

    def items(t: pa.Array) -> pa.Array:
        return _lists([_items(x.as_py() or "") for x in t])

    spark.udf.register("feed_items", F.arrow_udf(items, T.ArrayType(FEED_ITEM)))


def projection(attribute: str) -> tuple[str, str]:
    """How an attribute entry of a rule reads a node."""
    if attribute in ("text", "html"):
        return attribute, ""
    if attribute.startswith("attr:"):
        return "attr", attribute[5:]
    return "node", ""
