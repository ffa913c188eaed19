"""A mergeable quantile sketch as a table (A8): counts by bucket, with a stated error.

A value (a whole number from 0 on) falls into the bucket of its 8 leading bits, named by the bucket's least value, so a
quantile read from the buckets is at most 1/128 under the exact one. Sketches are DataFrames (keys, bucket, n): they merge
by adding up counts, so hours make days without a value being read again; the groupBy combines before its shuffle, and a
key has at most 57 * 128 + 256 rows whatever it has seen. Counts of conditions (e.g. successes) travel along exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 8


def bucket(x: Column) -> Column:
    """The least value of x's bucket (null and negative values: null)."""
    drop = F.greatest(F.length(F.bin(x)) - BITS, F.lit(0))
    return F.when(x >= 0, F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop))


def bucket_sql(x: str) -> str:
    drop = f"greatest(length(bin({x})) - {BITS}, 0)::INTEGER"
    return f"CASE WHEN {x} >= 0 THEN ({x} >> {drop}) << {drop} END"


def of(df: DataFrame, keys: list, value: str, conditions: dict[str, Column] | None = None) -> DataFrame:
    """(keys, bucket, n, one count per condition)."""
    return df.groupBy(*keys, bucket(F.col(value)).alias("bucket")).agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in (conditions or {}).items()])


def merged(sketches: DataFrame, keys: list, counts: list[str] | None = None) -> DataFrame:
    """Sketches (of several tables or finer keys) added up by ``keys``."""
    return sketches.groupBy(*keys, "bucket").agg(*[F.sum(c).alias(c) for c in ["n", *(counts or [])]])


def quantiles(sketch: DataFrame, keys: list[str], wanted: dict[str, tuple[int, int]], counts: list[str] | None = None) -> DataFrame:
    """(keys, n, counts, one column per wanted quantile a/b: the least bucket at which b * (values so far) >= a * n)."""
    order = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    x = sketch.where("bucket IS NOT NULL").withColumn("__upto", F.sum("n").over(order)).withColumn("__total", F.sum("n").over(whole))
    return x.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in counts or []],
                                *[F.min(F.when(b * F.col("__upto") >= a * F.col("__total"), F.col("bucket"))).alias(name) for name, (a, b) in wanted.items()])
