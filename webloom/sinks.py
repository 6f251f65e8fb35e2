"""What becomes of items: pipelines change or drop them, outputs write them.

A pipeline is a DataFrame function with a beginning and an end. It gets page_url, step, item (JSON text) and
gives them back, fewer or changed; a row with text in a column ``error`` is no item but a dead letter.
A wave in which a pipeline itself fails loses its items to the dead letters, all other waves go on.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ItemPipeline:
    """The null pipeline: everything passes."""

    def open(self, spider: str) -> None: ...

    def process(self, items: DataFrame, spider: str) -> DataFrame:
        return items

    def close(self, spider: str) -> None: ...


class Stage(ItemPipeline):
    """Of a DataFrame function."""

    def __init__(self, function: Callable[[DataFrame], DataFrame]):
        self.function = function

    def process(self, items: DataFrame, spider: str) -> DataFrame:
        return self.function(items)


class Chain(ItemPipeline):
    """One after another; what one drops or fails, the next does not see."""

    def __init__(self, *parts: ItemPipeline | Callable[[DataFrame], DataFrame]):
        self.parts = [p if isinstance(p, ItemPipeline) else Stage(p) for p in parts]

    def open(self, spider: str) -> None:
        for p in self.parts:
            p.open(spider)

    def process(self, items: DataFrame, spider: str) -> DataFrame:
        failed = []
        for p in self.parts:
            items = p.process(items, spider)
            if "error" in items.columns:
                failed.append(items.filter("error is not null"))
                items = items.filter("error is null").drop("error")
        for f in failed:
            items = items.unionByName(f, allowMissingColumns=True)
        return items

    def close(self, spider: str) -> None:
        for p in self.parts:
            p.close(spider)


class Each(ItemPipeline):
    """Of a function of one item (a dict) and the spider's name: a dict to keep, None to drop; what it
    raises makes a dead letter of that item alone."""

    def __init__(self, function: Callable[[dict, str], dict | None]):
        self.function = function

    def process(self, items: DataFrame, spider: str) -> DataFrame:
        function, kind = self.function, pa.struct([("item", pa.string()), ("error", pa.string())])

        def one(text: str) -> dict:
            try:
                out = function(json.loads(text), spider)
                return {"item": None if out is None else json.dumps(out, ensure_ascii=False), "error": None}
            except Exception as e:  # whatever the item does to the function
                return {"item": text, "error": f"{type(e).__name__}: {e}"}

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([one(x.as_py()) for x in batch], kind)

        made = items.withColumn("_made", F.arrow_udf(run, "struct<item:string,error:string>").asNondeterministic()("item"))
        return made.withColumns({"item": F.col("_made.item"), "error": F.col("_made.error")}).drop("_made").filter("item is not null")


class ItemOutput(ABC):
    """A sink. It gets each wave's items: page_url, step, item."""

    @abstractmethod
    def write(self, items: DataFrame) -> None: ...


class Collector(ItemOutput):
    """Keeps items on the driver: for tests and small crawls."""

    def __init__(self) -> None:
        self._items: list[dict] = []

    def write(self, items: DataFrame) -> None:
        self._items += [json.loads(r.item) for r in items.select("item").toLocalIterator()]

    def items(self) -> list[dict]:
        return list(self._items)


class TableOutput(ItemOutput):
    """Appends to a folder, in any format that Spark writes."""

    def __init__(self, path: str, format: str = "parquet"):
        self.path, self.format = path, format

    def write(self, items: DataFrame) -> None:
        items.write.mode("append").format(self.format).save(self.path)


class LogPipeline(ItemPipeline):
    """Counts the items of each step as they pass."""

    def __init__(self, log: Callable[[str], None] = print):
        self.log, self.counts = log, {}

    def open(self, spider: str) -> None:
        self.counts = {}
        self.log(f"{spider}: open")

    def process(self, items: DataFrame, spider: str) -> DataFrame:
        for r in items.groupBy("step").count().collect():
            self.counts[r["step"]] = self.counts.get(r["step"], 0) + r["count"]
        return items

    def close(self, spider: str) -> None:
        self.log(f"{spider}: closed, {sum(self.counts.values())} items")
