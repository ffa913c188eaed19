"""Contiguous balanced shards by global prefix sums of byte sizes.

The rows (without their texts) are put in one global order by range partitions, and written once to
the shared checkpoint folder, so that partitions stay what they are. Each partition reports its row
count and bytes; their prefix sums, one number pair per partition, give every row its global byte
offset without a window over all rows. The byte line is cut at equal targets, at the row edge that is
nearest; rows between two cuts are a shard, and their rank in it the slot.

Order: hash of the text, then crc32, doc_id and input place. Equal texts therefore are neighbours. A
cut inside such a group moves to the group's nearer end if the whole group is no larger than the
largest row; larger groups are cut, as a group may exceed a shard. Groups of any size are spread over
range partitions, as doc_id and the input place are part of the order.

Defined results: a null text is empty (size 1, crc32 0); null ids are kept and come first in their
group; repeated rows each get a slot; with fewer rows than shards, some shards stay empty; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import ensure_checkpoint_dir

SHARDS = 16


def in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, size, text_crc32, group; globally ordered, fixed in the checkpoint folder."""
    ensure_checkpoint_dir(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("group"),
                       F.monotonically_increasing_id().alias("place"))
    order = ["group", "text_crc32", "doc_id", "place"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("place").checkpoint()


def column(batch, name):
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def totals(rows: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Partition -> row count, bytes, largest row: one small row per partition."""
    def run(batches):
        n = size = most = 0
        for b in batches:
            v = column(b, "size")
            n, size, most = n + len(v), size + int(v.sum()), max(most, int(v.max(initial=0)))
        yield pa.RecordBatch.from_pydict({"p": pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          "n": pa.array([n], pa.int64()), "size": pa.array([size], pa.int64()),
                                          "most": pa.array([most], pa.int64())})
    return {r["p"]: (r["n"], r["size"], r["most"]) for r in rows.mapInArrow(run, "p int, n long, size long, most long").collect()}


def numbered(batches, starts):
    """Each batch with the global row number and the byte offset of its first row."""
    row, offset = starts.get(TaskContext.get().partitionId(), (0, 0))
    for b in batches:
        size = column(b, "size")
        end = offset + np.cumsum(size)
        yield b, row + np.arange(len(size)), end - size, end
        row, offset = row + len(size), int(end[-1]) if len(end) else offset


def cut_rows(rows: DataFrame, starts, total: int, largest: int, shards: int) -> list[int]:
    """The number of the first row of shards 1, 2, ..."""
    targets = np.array([total * k / shards for k in range(1, shards)])

    def at_targets(batches):
        for b, row, first, end in numbered(batches, starts):
            group = column(b, "group")
            for k in np.flatnonzero((targets >= first[0]) & (targets < end[-1])) if len(row) else []:
                i = int(np.searchsorted(end, targets[k], "right"))
                cut = int(row[i]) + int(end[i] - targets[k] < targets[k] - first[i])
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "row": pa.array([cut], pa.int64()),
                                                  "group": pa.array([group[i]], pa.int64())})

    found = {r["k"]: (r["row"], r["group"]) for r in rows.mapInArrow(at_targets, "k int, row long, group long").collect()}
    wanted = np.array(sorted({g for _, g in found.values()}), np.int64)

    def extents(batches):
        for b, row, first, end in numbered(batches, starts):
            group = column(b, "group")
            for g in np.intersect1d(group, wanted):
                own = np.flatnonzero(group == g)
                yield pa.RecordBatch.from_pydict({"group": pa.array([g], pa.int64()), **{
                    k: pa.array([int(v)], pa.int64()) for k, v in (("a", first[own[0]]), ("z", end[own[-1]]),
                                                                  ("row_a", row[own[0]]), ("row_z", row[own[-1]] + 1))}})

    spans = {r["group"]: r for r in rows.mapInArrow(extents, "group long, a long, z long, row_a long, row_z long")
             .groupBy("group").agg(*[f(c).alias(c) for f, c in ((F.min, "a"), (F.max, "z"), (F.min, "row_a"), (F.max, "row_z"))])
             .collect()}
    cuts: list[int] = []
    for k in range(shards - 1):
        row, g = found[k]
        s = spans[g]
        if s["z"] - s["a"] <= largest:
            row = s["row_a"] if targets[k] - s["a"] <= s["z"] - targets[k] else s["row_z"]
        cuts.append(max([row, *cuts[-1:]]))
    return cuts


def assign(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row for each row of ``docs``."""
    rows = in_order(docs, doc_id, text)
    by_part = totals(rows)
    starts, n, size = {}, 0, 0
    for p in sorted(by_part):
        starts[p] = (n, size)
        n, size = n + by_part[p][0], size + by_part[p][1]
    cuts = np.array(cut_rows(rows, starts, size, max(x[2] for x in by_part.values()), shards) if n else [], np.int64)
    first = np.concatenate([[0], cuts])

    def place(batches):
        for b, row, _, _ in numbered(batches, starts):
            shard = np.searchsorted(cuts, row, "right")
            keep = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "size", "text_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(shard.astype(np.int32)), pa.array(row - first[shard])],
                                             names=["doc_id", "size", "text_crc32", "shard", "slot"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(place, f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """The documents as one folder ``shard=N`` each, sorted by slot; ``doc_id`` must be a key of ``docs``."""
    (docs.join(assigned.select(F.col("doc_id").alias(doc_id), "shard", "slot"), doc_id)
     .repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
