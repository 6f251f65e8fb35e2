"""Compiled steps as columns: one item a page, follow requests from links.

All selectors of a step that read the page text share one Arrow UDF; headers, URL and meta are plain
columns. Failures are error columns, not exceptions, so one bad page fails nothing else.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.errors import ParseError
from webloom.functions.extract import STRINGS, Spec, extract, projection
from webloom.functions.patterns import to_java
from webloom.functions.values import stringify
from webloom.operators.frontier import merge_meta
from webloom.plans.rules import Field, Link, Step
from webloom.schemas import META

#: Which selectors read which source.
MATRIX = {"html": ("css", "xpath", "regex", "ai"), "text": ("regex",), "json": ("json",), "xml": ("xml", "xpath")}


def spec_of(f: Field, selector: str) -> Spec:
    kind, how, arg = f.selector_type, "all", ""
    if kind in ("css", "xpath", "xml"):
        how, arg = projection(f.attribute)
    elif kind == "regex" and f.attribute.startswith("group:"):
        how, arg = "group", f.attribute[6:]
    return Spec(kind, selector, how, arg)


class Sources:
    """The arrays that the selectors of some fields give, each computed once."""

    def __init__(self, fields: list[Field]):
        self.specs: list[Spec] = []
        for f in fields:
            if f.source in MATRIX and f.selector:
                if f.selector_type not in MATRIX[f.source]:
                    raise ParseError(f"unsupported source/selector: {f.source}/{f.selector_type}")
                self.specs += [s for s in (spec_of(f, x) for x in f.selector) if s not in self.specs]

    def on(self, responses: DataFrame) -> DataFrame:
        return responses.withColumn("_found", extract(F.col("text"), self.specs)) if self.specs else responses

    def arrays(self, f: Field) -> list[Column]:
        if f.source in MATRIX:
            return [F.col("_found")[f"s{self.specs.index(spec_of(f, x))}"] for x in f.selector]
        empty = F.array().cast(STRINGS)
        if f.source == "headers":
            return [F.coalesce(F.try_element_at("headers", F.lit(x)), empty) for x in f.selector]
        if f.source == "final_url":
            return [F.array("url") for _ in f.selector]
        raw = F.try_element_at("meta", F.lit(f.source[5:]))
        value = F.when(raw.startswith('"'), F.array(F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"])).otherwise(empty)
        return [F.coalesce(value, empty) for _ in f.selector]

    def values(self, f: Field) -> Column:
        """All values if multiple, else those of the first selector that has one."""
        arrays = self.arrays(f)
        if not arrays:
            return F.array().cast(STRINGS)
        if f.multiple:
            return F.concat(*arrays)
        first = F.coalesce(*(F.get(a, F.lit(0)) for a in arrays))
        return F.when(first.isNotNull(), F.array(first)).otherwise(F.array().cast(STRINGS))


def items(responses: DataFrame, step: Step, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """The kept columns, the fields in the order of their names, and ``error``; no fields: no rows.
    Where a field has the name of a kept column or of ``error``, that is named ``page_...``."""
    names = {f.name.lower() for f in step.fields}
    free = lambda c: free(f"page_{c}") if c.lower() in names else c
    packed = packed_items(responses, step, keep)
    if not step.fields:
        return packed.select(*keep, "error")
    return packed.select(*(F.col(c).alias(free(c)) for c in keep), *(F.col("item").getField(n).alias(n) for n in sorted({f.name for f in step.fields})), F.col("error").alias(free("error")))


def parsed(responses: DataFrame, step: Step) -> tuple[DataFrame, Sources]:
    """The responses with all that the step's fields and links find in their texts, by one pass, for
    packed_items and requests to read."""
    fields = {f.name: f for f in step.fields}
    sources = Sources([*(fields[n] for n in sorted(fields)), *step.links])
    return sources.on(responses), sources


def packed_items(responses: DataFrame, step: Step, keep: tuple[str, ...] = ("url",), sources: Sources | None = None) -> DataFrame:
    """The kept columns, ``item``, a struct of the fields in the order of their names, and ``error``. With
    sources the responses are parsed."""
    fields = {f.name: f for f in step.fields}  # the last of a name counts
    spark = responses.sparkSession
    if not fields:
        kinds = {f.name: f for f in responses.schema.fields}
        return spark.createDataFrame([], T.StructType([*(kinds[k] for k in keep), T.StructField("item", T.StructType()), T.StructField("error", T.StringType())]))
    rows = responses
    if sources is None:
        sources = Sources([fields[n] for n in sorted(fields)])
        rows = sources.on(responses)
    out, errors = [], []
    for name in sorted(fields):
        f = fields[name]
        values = sources.values(f)
        missing = F.size(values) == 0
        if f.multiple:
            default = f.default if isinstance(f.default, list) else None if f.default is None else [f.default]
            fallback = F.array(*(F.lit(stringify(x)) for x in default)).cast(STRINGS) if default is not None else F.array().cast(STRINGS)
            value = F.when(missing, fallback).otherwise(values)
        else:
            value = F.when(missing, F.lit(stringify(f.default))).otherwise(F.get(values, F.lit(0)))
        out.append(value.alias(name))
        if f.required and f.default is None:
            errors.append(F.when(missing, F.lit(f"required field missing: {name}")))
    error = F.coalesce(*errors, F.lit(None).cast("string")) if errors else F.lit(None).cast("string")
    return rows.select(*keep, F.struct(*out).alias("item"), error.alias("error"))


def allowed_by(value: Column, allow: tuple[str, ...], deny: tuple[str, ...]) -> Column:
    def any_of(patterns) -> Column:
        out = F.lit(False)
        for p in patterns:
            java = to_java(p, nesting=True)  # on URLs, which are short
            if java is None:
                raise ParseError(f"invalid pattern: {p}")
            out = out | value.rlike(java)
        return out

    return (any_of(allow) if allow else F.lit(True)) & ~any_of(deny)


def _passing(link: Link):
    return lambda v: allowed_by(v, link.allow, link.deny)


def link_patch(link: Link) -> Column:
    patch = {k: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for k, v in link.meta_patch.items()}
    if link.next_step is not None:
        patch["next_step"] = json.dumps(link.next_step)
    pairs = [F.lit(x) for kv in sorted(patch.items()) for x in kv]
    return F.create_map(*pairs).cast(META) if pairs else F.create_map().cast(META)


def requests(responses: DataFrame, step: Step, keep: tuple[str, ...] = (), sources: Sources | None = None) -> DataFrame:
    """src_url, link_index, link_name, value_index, url, mode, meta, error and the kept columns: links in
    their order, their values in document order. A required link without a value is a row with an error."""
    links = list(step.links)
    spark = responses.sparkSession
    schema = T._parse_datatype_string("src_url string, link_index int, link_name string, value_index int, url string, mode string, meta map<string,string>, error string")
    if not links:
        kinds = {f.name: f for f in responses.schema.fields}
        return spark.createDataFrame([], T.StructType([*schema.fields, *(kinds[k] for k in keep)]))
    rows = responses
    if sources is None:
        sources = Sources(links)
        rows = sources.on(responses)
    entries = []
    for i, link in enumerate(links):
        urls = F.filter(sources.values(link), _passing(link))
        error = F.when(F.size(urls) == 0, F.lit(f"required link missing: {link.name}")) if link.required else F.lit(None).cast("string")
        entries.append(F.struct(F.lit(i).alias("link_index"), F.lit(link.name).alias("link_name"), urls.alias("urls"), link_patch(link).alias("patch"), error.alias("error")))
    mode = F.col("mode") if "mode" in responses.columns else F.lit("http")
    rows = rows.select(F.col("url").alias("src_url"), mode.alias("mode"), F.col("meta").alias("_meta"), F.explode(F.array(*entries)).alias("e"), *keep)
    each = rows.select("src_url", "e.link_index", "e.link_name", "mode", "_meta", F.col("e.patch").alias("patch"), F.col("e.error").alias("error"), F.posexplode_outer("e.urls").alias("value_index", "url"), *keep).filter("url is not null or error is not null")
    return each.select("src_url", "link_index", "link_name", "value_index", "url", "mode", merge_meta(F.col("_meta"), F.col("patch")).alias("meta"), "error", *keep)
