"""Trace log: append, scan, truncate (S1-S3) and the analytics over it (W1, W2; W4 is in ``operators/ordered``).

Traces are JSON lines with an explicit schema (no inference).  A bad line does
not blank the whole log (the reference returns nothing then): it is kept in
``_corrupt`` and the other lines are read normally.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

STEP = Ty.StructType([Ty.StructField("layer", Ty.StringType()), Ty.StructField("name", Ty.StringType()),
                      Ty.StructField("status", Ty.StringType())])
TRACE_SCHEMA = Ty.StructType([
    Ty.StructField("query_key", Ty.StringType()),
    Ty.StructField("query", Ty.StringType()),
    Ty.StructField("answer", Ty.StringType()),
    Ty.StructField("handled_by", Ty.StringType()),
    Ty.StructField("layer", Ty.StringType()),
    Ty.StructField("layer_name", Ty.StringType()),
    Ty.StructField("cost_saved", Ty.BooleanType()),
    Ty.StructField("latency_ms", Ty.DoubleType()),
    Ty.StructField("alpha", Ty.DoubleType()),
    Ty.StructField("price_tier", Ty.StringType()),
    Ty.StructField("model", Ty.StringType()),
    Ty.StructField("selection_reason", Ty.StringType()),
    Ty.StructField("steps", Ty.ArrayType(STEP)),
    Ty.StructField("timestamp", Ty.StringType()),
    # ours: enough to recompute the statistics from the log alone
    Ty.StructField("provider", Ty.StringType()),
    Ty.StructField("tokens", Ty.LongType()),
    Ty.StructField("cost", Ty.DoubleType()),
    Ty.StructField("confidence", Ty.DoubleType()),
])
CORRUPT = "_corrupt"


def to_traces(decisions: DataFrame, key_cols: list[str], query: DataFrame | None = None, text: str = "query",
              latency_ms: float | None = None) -> DataFrame:
    """Trace rows from decisions (joined to the request text when given)."""
    d = decisions if query is None else decisions.join(query.select(*key_cols, text), key_cols, "left")
    return d.select(
        F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols]).alias("query_key"),
        (F.col(text) if text in d.columns else F.lit(None).cast("string")).alias("query"),
        (F.col("answer") if "answer" in d.columns else F.lit(None).cast("string")).alias("answer"),
        "handled_by", "layer", "layer_name", "cost_saved",
        F.lit(latency_ms).cast("double").alias("latency_ms"), F.col("alpha").cast("double").alias("alpha"),
        "price_tier", "model", "selection_reason", "steps",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "provider", F.col("tokens").cast("long").alias("tokens"), "cost", "confidence")


def write_traces(traces: DataFrame, path: str, mode: str = "append") -> None:
    """Append JSON lines (one file per task; the folder is the log)."""
    traces.write.mode(mode).json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """schema'd scan; a missing log is an empty table; bad lines land in ``_corrupt``."""
    schema = Ty.StructType([*TRACE_SCHEMA.fields, Ty.StructField(CORRUPT, Ty.StringType())])
    try:
        return (spark.read.schema(schema).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def clear_traces(spark: SparkSession, path: str) -> None:
    """S3: truncate the log (overwrite with no rows)."""
    spark.createDataFrame([], TRACE_SCHEMA).write.mode("overwrite").json(path)


# ── analytics ────────────────────────────────────────────────────────────────

def last_n(df: DataFrame, order_cols: list[str], n: int = 30) -> DataFrame:
    """The newest n rows in original order; n == 0 returns all rows (reference quirk).

    Spark plans orderBy+limit as a per-partition top-n followed by a merge, never a full sort."""
    if n == 0:
        return df
    return df.orderBy(*[F.col(c).desc() for c in order_cols]).limit(n)


def newest_per_group(df: DataFrame, group: str, order_cols: list[str], n: int = 50) -> DataFrame:
    """Newest n rows per group with their rank.  ``row_number() <= n`` is planned with a
    partial group limit before the shuffle, so a hot group ships at most n rows per map task."""
    w = Window.partitionBy(group).orderBy(*[F.col(c).desc() for c in order_cols])
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
