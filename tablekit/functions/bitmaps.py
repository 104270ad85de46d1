"""Sets of integers as bitmaps: a row for each key and bucket of 64 numbers, so any set is spread out, and a set of few
numbers far apart takes no more rows than it has numbers. Sets are united by sums of fixed size, which need no sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """keys, bucket and bits of the numbers in ``column``; nulls are left out."""
    c = F.col(f"`{column}`").cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), c.bitwiseAND(F.lit(63)).cast("int"))
    return df.filter(c.isNotNull()).groupBy(*keys, F.shiftright(c, 6).alias("bucket")).agg(F.bit_or(bit).alias("bits"))


def _keys(a: DataFrame) -> list[str]:
    return [c for c in a.columns if c != "bits"]


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy(*_keys(a)).agg(F.bit_or("bits").alias("bits"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.unionByName(b).groupBy(*_keys(a)).agg(F.bit_and("bits").alias("bits"), F.count("*").alias("_n"))
    return both.filter("_n = 2").drop("_n")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The numbers of ``a`` that are not in ``b``."""
    keys, none = _keys(a), F.lit(None).cast("bigint")
    sides = a.withColumn("_other", none).unionByName(b.withColumnRenamed("bits", "_other").withColumn("bits", none))
    both = sides.groupBy(*keys).agg(F.bit_or("bits").alias("bits"), F.bit_or("_other").alias("_other")).filter("bits IS NOT NULL")
    return both.select(*keys, F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_other", F.lit(0).cast("bigint")))).alias("bits"))


def counts(a: DataFrame, alias: str) -> DataFrame:
    """How many numbers each key's set has; without keys, one row."""
    return a.groupBy(*[k for k in _keys(a) if k != "bucket"]).agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias(alias))
