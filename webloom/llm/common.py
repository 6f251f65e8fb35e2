"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (id) or (id, number) that may be broadcast; beyond it the same join shuffles.
MAX_BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder, with its scheme, under spark.checkpoint.dir, which all executors share.

    Only where the setting is absent and the executors are threads of this machine (tests, a laptop) a
    temporary folder is used; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="webloom-")
        spark.sparkContext.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage,
    and what executors computed outlives them."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sized(df: DataFrame, rows: int, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows allow it; else as it is (shuffle join)."""
    return F.broadcast(df) if rows <= most else df


#: Bytes of an Arrow batch on its way to a worker, unless the session says otherwise. Spark's own 64 MB
#: are held several times over, by the JVM and by the worker, for each task.
BATCH_BYTES = 4_000_000
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by BATCH_BYTES in a session that has Spark's default."""
    if spark.conf.get(_BATCH_CONF, "64m") in ("64m", "64MB", "67108864", "67108864b"):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


#: Rows of a key, at least, that make it hot; and hot keys, at most: a key is hot only beyond that share of all rows too.
HOT_ROWS, HOT_KEYS = 100_000, 10_000
_SALTS = 997


def spread(left: DataFrame, right: DataFrame, key: str, n: str, by: str) -> DataFrame:
    """left joined to right, which has one row a key and in ``n`` about how many rows of left have it.

    The hot keys' rows of right, HOT_KEYS at most, are broadcast and their rows of left are not brought
    together: the join of the rest sees them under null, spread by ``by``. right is read twice: store it."""
    size = right.agg(F.sum(n).alias("all"), F.max(n).alias("most")).first()
    hot = max(HOT_ROWS, (size["all"] or 0) // HOT_KEYS)
    if (size["most"] or 0) <= hot:
        return left.join(right, key)
    payload = [c for c in right.columns if c != key]
    few = right.filter(F.col(n) > hot).select(key, F.struct(*payload).alias("_few"))
    rest = right.filter(F.col(n) <= hot).select(F.col(key).alias("_key"), F.lit(0).alias("_salt"), F.struct(*payload).alias("_rest"))
    known = left.join(F.broadcast(few), key, "left")
    cold = F.col("_few").isNull()
    known = known.withColumns({"_key": F.when(cold, F.col(key)), "_salt": F.when(cold, 0).otherwise(F.pmod(F.xxhash64(by), F.lit(_SALTS)).cast("int") + 1)})
    met = known.join(rest, ["_key", "_salt"], "left").withColumn("_found", F.coalesce("_few", "_rest")).filter("_found is not null")
    return met.select(*(named(met, c) for c in left.columns), *(F.col("_found")[c].alias(c) for c in payload))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame, name: str) -> Column:
    """The column of that exact name, dots and all."""
    return df[f"`{name}`"]
