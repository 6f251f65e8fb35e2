"""Middlewares that a spider may register: counters and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.engine import Hook

_MOD = 1 << 64


def rolling_hash(secret: str, text: Column) -> Column:
    """hash * 31 + byte over the bytes of secret and text, modulo 2**64, as hexadecimal digits."""
    start = 0
    for b in secret.encode():
        start = (start * 31 + b) % _MOD
    whole = F.lit(str(start)).cast("decimal(38,0)")
    digits = F.hex(text.cast("binary"))
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substr(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("decimal(3,0)"))
    codes = F.when(F.octet_length(text) > 0, codes).otherwise(F.array().cast("array<decimal(3,0)>"))
    step = lambda a, b: ((a * F.lit(31).cast("decimal(2,0)") + b) % F.lit(str(_MOD)).cast("decimal(20,0)")).cast("decimal(38,0)")
    value = F.aggregate(codes, whole, step)
    signed = F.when(value >= F.lit(str(_MOD // 2)).cast("decimal(20,0)"), value - F.lit(str(_MOD)).cast("decimal(20,0)")).otherwise(value)
    return F.lower(F.hex(signed.cast("long")))


class SignatureHook(Hook):
    """Gives each request that has none a header X-Signature."""

    def __init__(self, options: dict):
        self.secret = str(options.get("secret", ""))

    def process_request(self, rows: DataFrame) -> DataFrame:
        value = F.concat(F.lit("sha256:"), rolling_hash(self.secret, F.col("url")))
        own = F.map_concat("headers", F.create_map(F.lit("X-Signature"), F.array(value)))
        return rows.withColumn("headers", F.when(F.map_contains_key("headers", "X-Signature"), F.col("headers")).otherwise(own))


class StatsHook(Hook):
    """Counts requests and responses: one small job each a wave."""

    def __init__(self, options: dict):
        self.label = str(options.get("label", "default"))
        self.requests = self.responses = 0

    def process_request(self, rows: DataFrame) -> DataFrame:
        self.requests += rows.count()
        return rows

    def process_response(self, rows: DataFrame) -> DataFrame:
        self.responses += rows.count()
        return rows
