"""Readers for the input tables (parquet, one file or folder per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query stream: user turns of ``conversations`` (conv_id, turn, query)."""
    c = table(spark, sf_dir, "conversations")
    return c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))


USER_TURNS_SQL = "SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user'"


def assistant_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns keyed by the user turn they answer (turn - 1)."""
    c = table(spark, sf_dir, "conversations")
    return (c.filter(F.col("role") == "assistant")
            .select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")))


ASSISTANT_REPLIES_SQL = ("SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations "
                         "WHERE role = 'assistant'")
