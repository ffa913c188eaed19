"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``size`` consecutive words of an item (a shorter item is one window). A document contains
a window only if it contains all its shingles, so by the prefix principle one token is necessary:
``|W| - ceil(1.0 * |W|) + 1 = 1`` shingle, the rarest. The steps:

1. one pass over the documents counts how often each shingle of the items occurs in them (partial
   counts per task, summed by Spark): this orders the shingles by rarity;
2. each distinct window keeps its rarest shingle and that shingle's place in it;
3. a second pass joins document shingles with these, applies the length and positional bounds (the
   window must lie in the text), verifies the rest of the window word by word, and marks the words.

Both passes are row-local: no shuffle of documents, whatever key is hot. The items are a stated query
set, worked through in blocks of at most ``block_bytes`` of text (one pass each, so what is broadcast
has a fixed bound; an item longer than that is a block of its own).

Defined results: null or wordless texts have no words and no hits; a null item id counts as "";
items with equal texts or repeated ids count once per distinct id; empty tables give no rows or no
hits; other columns, whatever their names, are not read; words are compared by 64-bit hashes of
each word at its place.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.arrow import append, slices, text_buffers
from strata.llm.words import ALNUM, Tokenizer, grams, mix

WINDOW = 13
SHINGLE = 3
BLOCK_BYTES = 16 << 20
FILTER_BITS = 22


class Keys:
    """Membership and place of 64-bit keys in a sorted array, behind a bitmap of fixed size."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray):
        """(positions in ``hashes``, their places in ``keys``)."""
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        place = np.searchsorted(self.keys, hashes[at])
        place[place == len(self.keys)] = 0
        ok = self.keys[place] == hashes[at] if len(self.keys) else np.zeros(0, bool)
        return at[ok], place[ok]


class Windows(NamedTuple):
    """Distinct windows as places in the items' words (each word is held once), and the items that have each."""
    words: np.ndarray  # hashes of all items' words
    first: np.ndarray
    length: np.ndarray
    names: list[str]
    upto: np.ndarray  # window w is of the items of[upto[w]:upto[w + 1]], numbers of names
    of: np.ndarray


def item_windows(items: list[tuple[str, str]], size: int) -> Windows:
    """Windows are equal if two 64-bit hashes of their word hashes and their lengths are."""
    tokenizer = Tokenizer(ALNUM, lower=True)
    names = sorted({item for item, _ in items})
    number = {x: k for k, x in enumerate(names)}
    held = [tokenizer.words(data := np.frombuffer(text.encode(), np.uint8), np.array([0, len(data)]))[3] for _, text in items]
    n = np.array([len(h) for h in held], np.int64)
    words = np.concatenate([np.zeros(0, np.uint64), *held])
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    first, row = ranges(np.cumsum(n) - n, count), np.repeat(np.arange(len(n)), count)
    length, owner = np.minimum(n, size)[row], np.array([number[item] for item, _ in items], np.int64)[row]
    a, b = (length.astype(np.uint64) * np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
    for k in range(int(length.max(initial=0))):
        at = np.flatnonzero(length > k)
        w = words[first[at] + k]
        a[at] = mix(a[at] + w)
        b[at] = mix(b[at] ^ mix(w + np.uint64(k + 1)))
    order = np.lexsort((owner, b, a))
    a, b, owner = a[order], b[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    distinct = new.copy()
    distinct[1:] |= owner[1:] != owner[:-1]
    some = order[new]
    upto = np.append(np.flatnonzero(new[distinct]), int(distinct.sum()))
    return Windows(words, first[some], length[some], names, upto, owner[distinct])


def shingle_keys(windows: Windows, shingle: int) -> dict[int, np.ndarray]:
    """Sorted distinct shingle hashes by shingle length (short windows have short shingles)."""
    out = {}
    for k in np.unique(np.minimum(windows.length, shingle)).tolist():
        own = np.flatnonzero(np.minimum(windows.length, shingle) == k)
        change = np.zeros(len(windows.words) + 2, np.int32)
        np.add.at(change, windows.first[own], 1)
        np.add.at(change, windows.first[own] + windows.length[own] - k + 1, -1)
        inside = np.flatnonzero(np.cumsum(change) > 0)  # where a shingle of some window begins
        out[k] = np.unique(grams(windows.words, k)[inside])
    return out


def rarity(docs: DataFrame, keys: dict[int, np.ndarray], text: str) -> dict[int, np.ndarray]:
    """How often each shingle of the items occurs in all documents, by its length and place among the keys."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches):
        tokenizer, have = Tokenizer(ALNUM, lower=True), {k: Keys(v) for k, v in shared.value.items()}
        totals = {k: np.zeros(len(v.keys), np.int64) for k, v in have.items()}
        for batch in batches:
            for i, j in slices(batch.column(0)):
                _, _, _, h, bounds = tokenizer.words(*text_buffers(batch.column(0).slice(i, j - i)))
                row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                for k, v in have.items():
                    g = grams(h, k)
                    at, place = v.find(g)
                    at_ok = row[at] == row[at + k - 1]
                    totals[k] += np.bincount(place[at_ok], minlength=len(v.keys))
        for k, v in totals.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int64)),
                                              pa.array(v[at])], names=["k", "place", "n"])

    parts = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "k int, place long, n long")
    found = parts.groupBy("k", "place").agg(F.sum("n").alias("n")).toArrow()
    of, place, n = (found.column(c).to_numpy() for c in ("k", "place", "n"))
    out = {k: np.zeros(len(v), np.int64) for k, v in keys.items()}
    for k, counts in out.items():
        counts[place[of == k]] = n[of == k]
    return out


def anchored(windows: Windows, keys, counts, shingle: int) -> dict[int, dict]:
    """By shingle length: sorted anchor keys, and for each the windows that it anchors, with its place in them. A window's
    anchor is its shingle with the least count, of those the one with the least hash, the first of them."""
    out = {}
    short = np.minimum(windows.length, shingle)
    for k in keys:
        own = np.flatnonzero(short == k)
        g, anchor, at = grams(windows.words, k), np.zeros(len(own), np.uint64), np.zeros(len(own), np.int64)
        for size in np.unique(windows.length[own]).tolist():
            same = np.flatnonzero(windows.length[own] == size)
            for i in range(0, len(same), 1 << 16):
                some = same[i:i + (1 << 16)]
                h = g[windows.first[own[some]][:, None] + np.arange(size - k + 1)]
                n = counts[k][np.searchsorted(keys[k], h)]
                least = np.where(n == n.min(1, keepdims=True), h, np.uint64(2**64 - 1))
                at[some] = least.argmin(1)
                anchor[some] = h[np.arange(len(some)), at[some]]
        order = np.lexsort((at, own, anchor))
        unique, first = np.unique(anchor[order], return_index=True)
        out[k] = {"keys": unique, "first": np.append(first, len(own)).astype(np.int64), "window": own[order], "at": at[order]}
    return out


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] values), first[1], ..."""
    skip = np.repeat(first - (np.cumsum(count) - count), count)
    return skip + np.arange(int(count.sum()))


def occurrences(h, bounds, have, anchors, lengths, flat, offset):
    """(first word, window) of all occurrences of windows in a slice."""
    firsts, windows = [], []
    for k, keys in have.items():
        a = anchors[k]
        at, place = keys.find(grams(h, k))
        n = a["first"][place + 1] - a["first"][place]
        entry = ranges(a["first"][place], n)
        window = a["window"][entry]
        first = np.repeat(at, n) - a["at"][entry]
        row = np.searchsorted(bounds, np.repeat(at, n), "right") - 1
        ok = (first >= bounds[row]) & (first + lengths[window] <= bounds[row + 1])
        first, window = first[ok], window[ok]
        for j in range(int(lengths[window].max()) if len(window) else 0):
            longer = lengths[window] > j
            where = np.where(longer, first + j, 0)
            ok = ~longer | (h[where] == flat[np.where(longer, offset[window] + j, 0)])
            first, window = first[ok], window[ok]
        firsts.append(first)
        windows.append(window)
    return np.concatenate(firsts or [np.zeros(0, np.int64)]), np.concatenate(windows or [np.zeros(0, np.int64)])


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
          T.StructField("hit_items", T.ArrayType(T.StringType()))]


def merge_spans(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def mark_block(docs: DataFrame, windows: Windows, anchors, text: str) -> DataFrame:
    """Adds the fields for one block of items, or extends those that an earlier block gave."""
    earlier = "hit_spans" in docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((anchors, tuple(windows)))
    if earlier:
        docs = docs.withColumnsRenamed({f.name: f"earlier_{f.name}" for f in FIELDS})

    def start():
        anchors, (flat, offset, lengths, names, upto, of) = shared.value
        tokenizer, have = Tokenizer(ALNUM, lower=True), {k: Keys(v["keys"]) for k, v in anchors.items()}

        def kernel(data, offsets, batch):
            _, _, _, h, bounds = tokenizer.words(data, offsets)
            rows = len(offsets) - 1
            first, window = occurrences(h, bounds, have, anchors, lengths, flat, offset)
            spans, items = [[] for _ in range(rows)], [set() for _ in range(rows)]
            if len(first):
                change = np.zeros(len(h) + 1, np.int64)
                np.add.at(change, first, 1)
                np.add.at(change, first + lengths[window], -1)
                hit = np.cumsum(change)[:-1] > 0
                row = np.searchsorted(bounds, first, "right") - 1
                edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
                for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                    r = int(np.searchsorted(bounds, a, "right")) - 1
                    while a < b:  # hits may touch over the end of a row
                        end = min(b, int(bounds[r + 1]))
                        if end > a:
                            spans[r].append([int(a - bounds[r]), int(end - bounds[r])])
                        a, r = end, r + 1
                pairs = np.unique(row * len(lengths) + window)
                for p in pairs:
                    w = int(p) % len(lengths)
                    items[int(p) // len(lengths)].update(names[k] for k in of[upto[w]:upto[w + 1]].tolist())
            if earlier:
                for r, old in enumerate(batch.column("earlier_hit_spans").to_pylist()):
                    spans[r] = merge_spans([*spans[r], *old])
                for r, old in enumerate(batch.column("earlier_hit_items").to_pylist()):
                    items[r].update(old)
            return np.diff(bounds), spans, [sorted(x) for x in items]

        return kernel

    out = append(docs, FIELDS, start, text)
    return out.drop(*[f"earlier_{f.name}" for f in FIELDS]) if earlier else out


def mark(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE,
         block_bytes: int = BLOCK_BYTES, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, hit_spans ([first, last + 1] word numbers) and hit_items (sorted ids as strings)."""
    items = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"),
                             F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-2 * total // block_bytes) or 1
    out = docs
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        windows = item_windows([(r["item"], r["text"]) for r in block.toLocalIterator()], size)
        keys = shingle_keys(windows, shingle)
        counts = rarity(docs, keys, text) if len(windows.first) else {}
        out = mark_block(out, windows, anchored(windows, keys, counts, shingle), text)
    return out


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """The contamination rule: some hit, and at least one word in twenty."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def verdicts(marked: DataFrame) -> DataFrame:
    """``mark``'s rows with n_hit, n_items, items_sha256 and contaminated in place of its lists."""
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return (marked.withColumn("n_hit", hits).withColumn("n_items", F.size("hit_items").cast("long"))
            .withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256))
            .withColumn("contaminated", contaminated()).drop("hit_spans", "hit_items"))
