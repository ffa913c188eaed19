"""Structured Streaming form of the cascade.

Requests arrive as a file stream; each micro-batch is routed with the batch
cascade (``foreachBatch``) against the index of the bank and of everything learned in
earlier batches (T4: layer-5 answers join the bank, label = answer text; the index is kept
by epochs, so a batch signs its own texts alone), decisions are
appended to a parquet table (T5), and a second streaming query keeps running
counts per layer in complete mode (T2).  All state and output live under the
shared checkpoint folder, so a restarted driver resumes from the last committed
batch.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import minhash as MH
from strata.plans import cascade as CA
from strata.session import scratch_path


def route_stream(spark: SparkSession, source: DataFrame, keys: list[str], text: str, bank: DataFrame,
                 completions: DataFrame | None = None, knowledge: DataFrame | None = None,
                 base: str | None = None, **route_kw) -> str:
    """Run the streaming cascade to completion (availableNow); returns the output folder.

    ``base`` is where state and output live: give the same one again to resume. How many files make a
    micro-batch is the source's ``maxFilesPerTrigger``. A batch's rows go to folders of its own epoch,
    which a replay overwrites, so nothing is written twice."""
    base = base or scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    out = os.path.join(base, "decisions")
    bank_id, bank_text, bank_label = bank.columns
    store = MH.StoredIndex(spark, os.path.join(base, "index"), bank_id, "__text")
    stored = lambda rows: rows.select(bank_id, F.col(bank_text).alias("__text"), F.col(bank_text).alias("text"), F.col(bank_label).alias("label"))
    if store.rows() is None:
        store.append(stored(bank), -1)  # the given bank is signed once, not by micro-batch

    def one_batch(df: DataFrame, epoch_id: int) -> None:
        index, known = store.index(epoch_id), store.rows(epoch_id)
        dec = CA.route(df, keys, text, bank=known.select(bank_id, "text", "label"), bank_id=bank_id, index=index,
                       completions=completions, knowledge=knowledge, **route_kw)
        dec = dec.checkpoint(eager=True)
        dec.write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch_id}"))
        ok5 = (F.col("layer") == "5") & (F.col("handled_by") != "error")
        if completions is not None:
            asked = (dec.filter(ok5).select(*keys).join(df.select(*keys, text), keys).join(completions.select(*keys, "answer"), keys)
                     .select(F.xxhash64(*[F.col(k) for k in keys]).alias(bank_id), F.col(text).alias("__text"), F.col("answer").alias("label")))
            # of a text that is asked several times, the first request by id is learned; of a text that is known, none
            first = asked.groupBy("__text").agg(F.min(F.struct(bank_id, "label")).alias("f")).select(
                f"f.{bank_id}", "__text", F.col("__text").alias("text"), "f.label")
            store.append(first.join(known.select("text"), "text", "left_anti").select(bank_id, "__text", "text", "label"), epoch_id)

    q = (source.writeStream.foreachBatch(one_batch).option("checkpointLocation", os.path.join(base, "_ckpt_route"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def running_layer_counts(spark: SparkSession, decisions_path: str, schema, name: str | None = None) -> DataFrame:
    """Streaming groupBy(layer).count() over the decision log, complete mode, to a memory table."""
    name = name or f"layer_counts_{uuid.uuid4().hex[:8]}"
    s = spark.readStream.schema(schema).parquet(decisions_path)
    q = (s.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).writeStream.outputMode("complete")
         .format("memory").queryName(name)
         .option("checkpointLocation", os.path.join(os.path.dirname(decisions_path), f"_ckpt_{name}"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)
