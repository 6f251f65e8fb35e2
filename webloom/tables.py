"""Tables in the shared folder that spark.checkpoint.dir names: they outlive executors and cut lineage. And
tables as read, for steps that cost more than reading."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="webloom-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """A table as read, in two parts a core at least. A file of short rows may be one row group of a million
    rows, which no split divides: all that follows would be one task's."""
    parts = 2 * table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= parts else table.repartition(parts)
