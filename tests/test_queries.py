"""Queries against DuckDB on the smallest tables."""

import os

import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(frame, columns):
    def one(v):
        if pd.isna(v):
            return None
        if isinstance(v, float) and v == int(v):
            return int(v)
        return v

    return sorted(str([one(v) for v in row]) for row in frame[columns].astype(object).values.tolist())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_oracles(spark):
    import duckdb

    import __spark_entry__ as entry

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    sql, wrong = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if name in sql:
            got, want = query(spark, SF).toPandas(), c.execute(sql[name]).df()
            columns = sorted(got.columns)
            if columns != sorted(want.columns) or normal(got, columns) != normal(want, columns):
                wrong.append(name)
    assert not wrong
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_part_is_spread_over_the_cores(spark):
    """Its file is one row group, which no split divides."""
    from pyspark.sql import functions as F

    from webloom.plans.queries import _part_xml
    from webloom.tables import spread

    assert _part_xml(spark, SF).select(F.spark_partition_id()).distinct().count() > 4
    read = spark.read.parquet(f"{SF}/part.parquet")
    many = read.repartition(100)
    assert spread(many) is many and sorted(spread(read).collect()) == sorted(read.collect())
