"""Frontier operators on request and attempt DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.tables import stored

RATE_WINDOW_MS = 60_000


def extract_host(url: Column) -> Column:
    """What is between the first and second "://", up to "/", up to ":"; null without "://"."""
    rest = F.split_part(url, F.lit("://"), F.lit(2))
    host = F.split_part(F.split_part(rest, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))
    return F.when(F.instr(url, "://") > 0, host)


def domain_allowed(url: Column, domains: list[str]) -> Column:
    """Without domains all are; a URL without a host is not."""
    if not domains:
        return F.lit(True)
    host, out = extract_host(url), F.lit(False)
    for d in domains:
        out = out | (host == d) | F.endswith(host, F.lit("." + d))
    return F.coalesce(out, F.lit(False))


def allowed_domains(df: DataFrame, domains: list[str]) -> DataFrame:
    bypass = F.coalesce(F.col("dont_filter"), F.lit(False)) if "dont_filter" in df.columns else F.lit(False)
    return df.filter(bypass | domain_allowed(F.col("url"), domains))


def merge_meta(meta: Column, patch: Column) -> Column:
    """Right wins, whatever the session's map policy."""
    empty = F.create_map().cast("map<string,string>")
    meta, patch = F.coalesce(meta, empty), F.coalesce(patch, empty)
    return F.map_concat(F.map_filter(meta, lambda k, v: ~F.array_contains(F.map_keys(patch), k)), patch)


def dedup(df: DataFrame, key: str = "url", *, partition: tuple[str, ...] = (), order: str = "seq", seen: DataFrame | None = None) -> DataFrame:
    """The first row of each key; null keys and dont_filter rows pass. seen: earlier keys."""
    bypass = F.col(key).isNull()
    if "dont_filter" in df.columns:
        bypass = bypass | F.coalesce(F.col("dont_filter"), F.lit(False))
    free, bound = df.filter(bypass), df.filter(~bypass)
    if seen is not None:
        bound = bound.join(seen.select(*partition, key), [*partition, key], "left_anti")
    w = Window.partitionBy(*partition, key).orderBy(order)
    first = bound.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return first.unionByName(free)


#: Rows of a key that one task may sort; keys with more are numbered part by part.
SORTED_ROWS = 1_000_000


def _many(df: DataFrame, partition: tuple[str, ...]) -> bool:
    return (df.groupBy(*partition).count().agg(F.max("count")).first()[0] or 0) > SORTED_ROWS


def _numbered(df: DataFrame, partition: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """df with _n, a row's place among all rows of its key; _part, a range of places; _at, the place in it. A key
    has many parts, so no task sorts all its rows."""
    df = stored(df.repartitionByRange(*partition, *order).withColumn("_part", F.spark_partition_id()), "frontier-parts")
    w = Window.partitionBy(*partition, "_part").orderBy(*order)
    df = df.withColumn("_at", (F.row_number().over(w) - 1).cast("long"))
    parts = df.groupBy(*partition, "_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*partition).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_size")
    return _met(df, parts, [*partition, "_part"]).withColumn("_n", F.col("_before") + F.col("_at")).drop("_before")


def _met(df: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Null keys meet too."""
    other = parts.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(other[f"_k{i}"]) for i, k in enumerate(keys)])
    return df.join(other, on).drop(*(f"_k{i}" for i in range(len(keys))))


def numbered(df: DataFrame, partition: tuple[str, ...], order: tuple[str, ...], name: str) -> DataFrame:
    """A row's place among the rows of its key, from 0."""
    if _many(df, partition):
        return _numbered(df, partition, order).drop("_at", "_part").withColumnRenamed("_n", name)
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1).cast("long"))


def _upto(df: DataFrame, keys: tuple[str, ...], value: Column) -> tuple[DataFrame, Column]:
    """(df, the greatest value of the key's rows up to each), by running maxima inside parts."""
    inside = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    parts = df.groupBy(*keys, "_part").agg(F.max(value).alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_earlier", F.max("_top").over(before)).drop("_top")
    return _met(df, parts, [*keys, "_part"]), F.greatest(F.col("_earlier"), F.max(value).over(inside))


def interval_gate(df: DataFrame, interval_ms: int, *, arrival: str = "arrival_ms", partition: tuple[str, ...] = ("step",), order: tuple[str, ...] = ("arrival_ms", "seq")) -> DataFrame:
    """admitted_ms: each arrival waits until interval_ms after the one admitted before."""
    if not _many(df, partition):
        df = df.withColumn("_n", (F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1).cast("long"))
        upto = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("admitted_ms", F.col("_n") * interval_ms + F.max(F.col(arrival) - F.col("_n") * interval_ms).over(upto)).drop("_n")
    rows = _numbered(df, partition, order)
    rows, top = _upto(rows, partition, F.col(arrival) - F.col("_n") * interval_ms)
    return rows.withColumn("admitted_ms", F.col("_n") * interval_ms + top).drop("_n", "_at", "_part", "_earlier")


def rate_limit(df: DataFrame, per_minute: int, *, arrival: str = "arrival_ms", partition: tuple[str, ...] = ("step",), order: tuple[str, ...] = ("arrival_ms", "seq")) -> DataFrame:
    """admitted_ms under a sliding window of per_minute. A hit exactly a window old still counts, so
    the n-th waits RATE_WINDOW_MS + 1 after the (n - per_minute)-th."""
    many, step = _many(df, partition), RATE_WINDOW_MS + 1
    rows = _numbered(df, partition, order) if many else df.withColumn("_n", (F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1).cast("long"))
    rows = rows.withColumns({"_r": F.col("_n") % per_minute, "_j": F.floor(F.col("_n") / per_minute).cast("long")})
    if not many:
        upto = Window.partitionBy(*partition, "_r").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("admitted_ms", F.col("_j") * step + F.max(F.col(arrival) - F.col("_j") * step).over(upto)).drop("_n", "_r", "_j")
    rows, top = _upto(rows, (*partition, "_r"), F.col(arrival) - F.col("_j") * step)
    return rows.withColumn("admitted_ms", F.col("_j") * step + top).drop("_n", "_r", "_j", "_at", "_part", "_earlier")


def attempt_number(attempts: DataFrame, *, key: tuple[str, ...] = ("url",), order: tuple[str, ...] = ("seq",), name: str = "retries") -> DataFrame:
    """How many attempts of the key came before each."""
    return numbered(attempts, key, order, name).withColumn(name, F.col(name).cast("int"))


def backoff(array: Column, retry: Column) -> Column:
    """The entry of that retry, else the last, else null."""
    return F.coalesce(F.get(array, retry), F.get(array, F.size(array) - 1))


def retry_by_status(attempts: DataFrame, statuses: list[int], count: int = 1, backoff_ms: list[int] | None = None, *, status: str = "status", retries: str = "retries") -> DataFrame:
    """flow (continue or retry), flow_reason and backoff_ms."""
    again = F.col(status).isin(statuses) & (F.col(retries) < count) if statuses else F.lit(False)
    wait = backoff(F.array(*map(F.lit, backoff_ms or [])).cast("array<bigint>"), F.col(retries))
    return attempts.withColumns({"flow": F.when(again, F.lit("retry")).otherwise(F.lit("continue")), "flow_reason": F.when(again, F.concat(F.lit("retry by status: "), F.col(status).cast("string"))), "backoff_ms": F.when(again, wait)})


def retry_by_error(attempts: DataFrame, count: int = 1, backoff_ms: list[int] | None = None, *, kinds: tuple[str, ...] | None = ("download",), retries: str = "retries") -> DataFrame:
    """Without kinds any error is tried again."""
    again = F.col("error").isNotNull() & (F.col("error.kind").isin(list(kinds)) if kinds is not None else F.lit(True)) & (F.col(retries) < count)
    wait = backoff(F.array(*map(F.lit, backoff_ms or [])).cast("array<bigint>"), F.col(retries))
    return attempts.withColumns({"flow": F.when(again, F.lit("retry")).otherwise(F.lit("continue")), "flow_reason": F.when(again, F.concat(F.lit("retry by error: "), F.col("error.kind"), F.lit(" error: "), F.col("error.message"))), "backoff_ms": F.when(again, wait)})


def rescheduled(df: DataFrame, now_ms: int, reason: Column, wait: Column) -> DataFrame:
    """Requests to be tried again: retry counter and reason in meta, no filtering, perhaps later."""
    n = F.coalesce(F.try_element_at("meta", F.lit("_retry_times")).cast("int"), F.lit(0)) + 1
    patch = F.map_filter(F.create_map(F.lit("_retry_times"), n.cast("string"), F.lit("_retry_reason"), F.to_json(F.struct(reason.alias("r"))).substr(F.lit(6), F.length(F.to_json(F.struct(reason.alias("r")))) - 6), F.lit("_retry_backoff_ms"), wait.cast("string")), lambda k, v: v.isNotNull())
    return df.withColumns({"meta": merge_meta(F.col("meta"), patch), "dont_filter": F.lit(True), "ready_at_ms": F.when(wait > 0, F.lit(now_ms) + wait)})


def ready(df: DataFrame, now_ms: int) -> DataFrame:
    return df.filter(F.coalesce(F.col("ready_at_ms") <= now_ms, F.lit(True)))


def acked(inflight: DataFrame, done: DataFrame) -> DataFrame:
    """In-flight rows without those whose URL is done."""
    return inflight.join(done.select("url").distinct(), "url", "left_anti")


def nacked(inflight: DataFrame, failed: DataFrame) -> DataFrame:
    """The first in-flight row of each failed URL, which goes to the front."""
    first = inflight.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("seq"))).filter("_n = 1").drop("_n")
    return first.join(failed.select("url").distinct(), "url", "left_semi").withColumn("priority", F.lit(-1))


def wave_of(df: DataFrame, per_host: int, *, at_once: int | None = None, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """wave: per_host rows of a host at a time and, with at_once, so many rows in all: of every host's
    turns the first ones, in the order of turn and row."""
    rows = df.withColumn("host", extract_host(F.col("url")))
    rows = numbered(rows, ("host",), order, "wave").withColumn("wave", F.floor(F.col("wave") / per_host).cast("long"))
    if at_once is None:
        return rows
    rows = numbered(rows.withColumn("_all", F.lit(0)), ("_all",), ("wave", *order), "_n")
    return rows.withColumn("wave", F.floor(F.col("_n") / at_once).cast("long")).drop("_n", "_all")


def leased(df: DataFrame, now_ms: int, per_host: int, at_once: int | None) -> DataFrame:
    """What goes next of a frontier: of the ready rows per_host a host at most, at_once in all."""
    rows = ready(df, now_ms).withColumn("_host", F.coalesce(extract_host(F.col("url")), F.lit("unknown")))
    w = Window.partitionBy("_host").orderBy("priority", "seq")  # a limit in each task comes before the shuffle
    rows = rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= per_host).drop("_k", "_host")
    return rows if at_once is None else rows.orderBy("priority", "seq").limit(at_once)
