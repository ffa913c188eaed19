"""Hard negatives by best-first search in STR-packed R-trees over integer vectors.

Packing: rows are range-partitioned by (label, their widest coordinate), so a label of any size is cut into slabs;
within a partition every ``TREE_ROWS`` rows of a label become one tree, tiled by the next widest coordinates into
leaves of ``LEAF`` rows (sort-tile-recursive), with ``FAN`` leaves a node. Every node keeps its minimum bounding box.
The trees are a checkpoint, ``PART_ROWS`` rows a part.

Search: a box bounds the inner product of a query coordinate by coordinate. A queue holds nodes by their upper
bound; a node is left out if its interval misses all score windows, or lies strictly below the k-th best of each
window it meets; rows of the leaves that remain are scored. All windows of a query share one walk. Queries are a
stated set (anchors); each visits every part, streamed past the part's trees (a task holds the trees of one part, not
the queries), and the best k of the parts are merged by query. Parts are dealt to several tasks where there are fewer
parts than cores. Nothing passes through the driver but the variance of each coordinate.

Scores are exact integers: products run in float32 or float64 while no sum can leave the exact integers, else in int64.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part; components
become floor(scale * x); a shorter vector counts as padded with zeros, an empty one as zeros; ties go by smaller id;
repeated rows are rows of their own, repeated anchors one anchor; an anchor is never its own positive (nor is another
row of its id); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.arrow import give_back
from strata.session import ensure_checkpoint_dir

SCALE = 256
LEAF, FAN, TREE_ROWS, PART_ROWS, AXES = 32, 32, 4096, 250_000, 4
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


# packing ──────────────────────────────────────────────────────────────────

def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """id, label, ints of the rows that take part."""
    x = F.col(f"`{vector}`")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return (rows.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & x.isNotNull() & ~F.exists(x, odd))
            .select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"),
                    F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("ints")))


def widest_axes(rows: DataFrame, n: int = AXES) -> list[int]:
    """The coordinates with the greatest variance."""
    spread = rows.select(F.posexplode("ints").alias("axis", "x")).groupBy("axis").agg(F.var_pop("x").alias("spread"))
    return [r["axis"] for r in spread.orderBy(F.desc("spread"), "axis").limit(n).collect()]


def matrix(ints: pa.Array) -> np.ndarray:
    """Rows of possibly unequal length, padded with zeros."""
    size = ints.value_lengths().to_numpy(zero_copy_only=False)
    flat = ints.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def tiled(vectors: np.ndarray, axes: list[int], size: int = LEAF) -> np.ndarray:
    """An order of the rows in which every ``size`` neighbours are a tile: slabs by one axis, cut by the next ones."""
    def tile(rows, left):
        leaves = math.ceil(len(rows) / size)
        if not left or leaves <= 1:
            return [rows]
        rows = rows[np.argsort(vectors[rows, left[0]], kind="stable")]
        step = math.ceil(leaves / math.ceil(leaves ** (1 / len(left)))) * size
        return [part for k in range(0, len(rows), step) for part in tile(rows[k:k + step], left[1:])]

    return np.concatenate(tile(np.arange(len(vectors)), [a for a in axes if a < vectors.shape[1]]))


def parts_of(rows: DataFrame, part_rows: int) -> int:
    return max(1, math.ceil(rows.count() / part_rows))


def packed(rows: DataFrame, part_rows: int = PART_ROWS, tree_rows: int = TREE_ROWS) -> tuple[DataFrame, int]:
    """(part, label, width, ids, vectors) per tree, with its rows in tile order, and the number of parts."""
    ensure_checkpoint_dir(rows.sparkSession)
    axes, parts = widest_axes(rows), parts_of(rows, part_rows)
    first = F.coalesce(F.get("ints", F.lit(axes[0] if axes else 0)), F.lit(0))
    placed = rows.select("label", first.alias("along"), "id", "ints").repartitionByRange(parts, "label", "along", "id")
    schema = T.StructType([rows.schema["label"], T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("vectors", T.BinaryType())])

    def tree(label, batch):
        vectors, ids = matrix(batch.column("ints")), batch.column("id").to_numpy(zero_copy_only=False)
        order = tiled(vectors, axes[1:])
        vectors = vectors[order]
        kind = np.int16 if np.abs(vectors).max(initial=0) < 2**15 else np.int64
        return label, vectors.shape[1], ids[order].tobytes(), vectors.astype(kind).tobytes()

    def run(batches):
        waiting = []

        def emit(final):
            table = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0] if waiting else None
            waiting.clear()
            out = []
            if table is not None and len(table):
                labels = table.column("label").to_pylist()
                cuts = [0, *[k for k in range(1, len(labels)) if labels[k] != labels[k - 1]], len(labels)]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    ends = range(i, j, tree_rows)
                    for k in ends:
                        if not final and j == len(labels) and k + tree_rows > j:
                            waiting.append(table.slice(k))
                            break
                        out.append(tree(labels[i], table.slice(k, min(tree_rows, j - k))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)

        types = None
        for batch in batches:
            types = [batch.schema.field("label").type, pa.int32(), pa.binary(), pa.binary()]
            waiting.append(batch)
            if sum(map(len, waiting)) >= 2 * tree_rows:
                yield from emit(False)
        if waiting:
            yield from emit(True)
        give_back()

    trees = placed.sortWithinPartitions("label", "along", "id").mapInArrow(run, schema)
    return trees.withColumn("part", F.spark_partition_id() % parts).checkpoint(), parts


# search ───────────────────────────────────────────────────────────────────

class Boxes:
    """Minimum bounding boxes of every ``size`` rows (or boxes)."""

    def __init__(self, low, high, size):
        at = np.arange(0, len(low), size)
        self.low, self.high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)

    def interval(self, above, below, part=slice(None)):
        """The least and the greatest inner product with a query, given as its positive and its negative part."""
        low, high = self.low[part], self.high[part]
        return low @ above + high @ below, high @ above + low @ below


class Tree:
    def __init__(self, label, width, ids, vectors):
        self.label, self.width, self.ids = label, width, np.frombuffer(ids, np.int64)
        kind = np.int16 if len(vectors) == 2 * len(self.ids) * width else np.int64
        self.rows = np.frombuffer(vectors, kind).reshape(len(self.ids), width).astype(np.int64)
        self.most = int(np.abs(self.rows).max(initial=0))

    def cast(self, kind):
        self.rows = self.rows.astype(kind)
        self.leaves = Boxes(self.rows, self.rows, LEAF)
        self.nodes = Boxes(self.leaves.low, self.leaves.high, FAN)


#: From the fastest on, with the least bound of sums that are not exact in it.
KINDS = [(np.float32, 2**24), (np.float64, 2**53), (np.int64, math.inf)]


class Part:
    """The trees of one part, in the number type that its queries so far allow, with all their roots' boxes."""

    def __init__(self, trees: list[Tree]):
        self.trees, self.most = trees, max((t.most for t in trees), default=0)
        self.width, self.level = max((t.width for t in trees), default=0), -1
        self.code = {x: k for k, x in enumerate(dict.fromkeys(t.label for t in trees))}
        self.codes = np.array([self.code[t.label] for t in trees], np.int64)

    def fit(self, query: np.ndarray) -> np.ndarray:
        bound = max(1, self.width) * (self.most + 1) * (int(np.abs(query).max(initial=0)) + 1)
        level = next(k for k, (_, least) in enumerate(KINDS) if bound < least)
        if level > self.level:
            self.level = level
            for t in self.trees:
                t.cast(KINDS[level][0])
            wide = lambda x: np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
            each = [(wide(t.nodes.low).min(0), wide(t.nodes.high).max(0)) for t in self.trees]
            low, high = (np.array([e[k] for e in each]).reshape(len(each), self.width) for k in (0, 1))
            self.roots = Boxes(low, high, 1)
        return query.astype(KINDS[self.level][0])

    def best(self, query, label, own, bars, same: bool, k: int, share: tuple[int, int]) -> list[tuple[int, int, int]]:
        """(bar, score, id) of the first k rows of each bar's window; without bars of one window of all scores."""
        query = self.fit(np.concatenate([query, np.zeros(max(0, self.width - len(query)), np.int64)]))
        above, below = np.maximum(query, 0), np.minimum(query, 0)
        low, high = share
        windows = [(-((-low * b) // 100), (high * b) // 100) for b in bars] if bars else [(LEAST, MOST)]
        least, most = (np.array(x, np.int64) for x in zip(*windows, strict=True))
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        top, order, queue = max(w[1] for w in windows), itertools.count(), []

        def fitting(boxes, width, places=slice(None)):
            """The boxes that meet a window, and all boxes' upper bounds."""
            reach, bound = boxes.interval(above[:width], below[:width], places)
            return np.flatnonzero(((reach[:, None] <= most) & (bound[:, None] >= least)).any(1)), bound

        if not self.trees:
            return []
        fits, bounds = fitting(self.roots, self.width)
        for t in fits[(self.codes[fits] == self.code.get(label, -1)) == same].tolist():
            heapq.heappush(queue, (-min(bounds[t], top), next(order), t, -1))
        while queue:
            bound, _, t, node = heapq.heappop(queue)
            if -bound < least.min():
                break
            tree = self.trees[t]
            if node < 0:
                fits, bounds = fitting(tree.nodes, tree.width)
                for n in fits.tolist():
                    heapq.heappush(queue, (-min(bounds[n], top), next(order), t, n))
                continue
            fits, _ = fitting(tree.leaves, tree.width, slice(node * FAN, (node + 1) * FAN))
            at = ((fits + node * FAN)[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < len(tree.ids)]
            scores = (tree.rows[at] @ query[:tree.width]).astype(np.int64)
            for w in range(len(windows)):
                hit = np.flatnonzero((scores >= least[w]) & (scores <= most[w]))
                ids = tree.ids[at[hit]]
                if same:
                    hit, ids = hit[ids != own], ids[ids != own]
                if len(hit):
                    first = np.lexsort((ids, -scores[hit]))[:k]
                    found[w] = sorted([*found[w], *zip((-scores[hit[first]]).tolist(), ids[first].tolist(), strict=True)])[:k]
                    if len(found[w]) == k:
                        least[w] = -found[w][-1][0]
        return [(bar, -s, i) for bar, rows in zip(bars or [0], found, strict=True) for s, i in rows]


def search(trees: DataFrame, parts: int, queries: DataFrame, same: bool, k: int, share: tuple[int, int] = (0, 100)) -> DataFrame:
    """The first k rows (score, id) by query (query, anchor_id) and bar, of the query's label (``same``) or of others.
    ``queries``: query, anchor_id, label, ints, bars (array of scores; empty: one window of all scores)."""
    spark = queries.sparkSession
    copies = max(1, math.ceil(2 * spark.sparkContext.defaultParallelism / parts))
    copy = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    bank = trees.withColumn("copy", copy(copies)).select((F.col("part") * copies + F.col("copy")).cast("int").alias("task"), F.lit(0).alias("kind"),
                                                         "label", "width", "ids", "vectors")
    asked = queries.withColumn("part", copy(parts)).select(
        (F.col("part") * copies + F.pmod(F.col("query"), F.lit(copies))).cast("int").alias("task"), F.lit(1).alias("kind"), "label",
        "query", "anchor_id", "ints", "bars")
    met = bank.unionByName(asked, allowMissingColumns=True).repartition(parts * copies, "task").sortWithinPartitions("task", "kind", "query")

    def run(batches):
        task, trees, part = None, [], None
        for batch in batches:
            columns = {n: batch.column(n) for n in ("task", "kind", "label", "width", "query", "anchor_id")}
            columns = {n: c.to_pylist() for n, c in columns.items()}
            out = []
            for i in range(len(batch)):
                if columns["task"][i] != task:
                    task, trees, part = columns["task"][i], [], None
                label = columns["label"][i]
                if columns["kind"][i] == 0:
                    trees.append(Tree(label, columns["width"][i], batch.column("ids")[i].as_py(), batch.column("vectors")[i].as_py()))
                    continue
                part = part or Part(trees)
                query = batch.column("ints")[i].values.to_numpy(zero_copy_only=False)
                for bar, score, row in part.best(query, label, columns["anchor_id"][i], batch.column("bars")[i].as_py(), same, k, share):
                    out.append((columns["query"][i], columns["anchor_id"][i], bar, score, row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query", "anchor_id", "bar", "score", "id"])
        give_back()

    found = met.mapInArrow(run, "query long, anchor_id long, bar long, score long, id long")
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))), 1, k)
    return (found.groupBy("query", "anchor_id", "bar").agg(first.alias("first"))
            .select("query", "anchor_id", "bar", F.posexplode("first").alias("place", "x"))
            .select("query", "anchor_id", "bar", (F.col("place") + 1).cast("int").alias("rank"), (-F.col("x.down")).alias("score"), F.col("x.id").alias("id")))


def mine(rows: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 3, share: tuple[int, int] = (50, 95),
         part_rows: int = PART_ROWS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows (id, label, ints) that the
    condition ``anchors`` names: per anchor its best positives of the same label, per positive the best negatives of other
    labels whose score is between ``share`` (in hundredths) of the positive's."""
    trees, parts = packed(rows, part_rows, tree_rows)
    asked = (rows.where(anchors).distinct()
             .select(F.xxhash64("id", "label", "ints").alias("query"), F.col("id").alias("anchor_id"), "label", "ints"))
    none = F.array().cast("array<long>")
    positives = search(trees, parts, asked.withColumn("bars", none), True, n_positives).checkpoint()
    bars = positives.groupBy("query", "anchor_id").agg(F.sort_array(F.collect_set("score")).alias("bars"))
    negatives = search(trees, parts, asked.join(bars, ["query", "anchor_id"]), False, n_negatives, share)
    wanted = positives.select("query", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("bar"))
    return wanted.join(negatives, ["query", "anchor_id", "bar"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("bar").alias("positive_score"), F.col("score").alias("negative_score"))
