"""Cross-tokenizer alignment: where the tokens of a byte-level vocabulary (A) and of a piece vocabulary (B) end together.

A space is put before every text and both tokenizers encode it as a whole: the text is cut before single spaces
that follow a visible character, where neither tokenizer can join the two sides (A's word pattern ends there, B has
no piece with a space mark behind another character), and each distinct unit is encoded once a task. A text whose
tokens' bytes are not the text again (in A or B) has no tokens.

All tokens of a batch then lie on one byte line. Offsets where both sides end a token and go on with a space-marked
one are anchors; anchors cut a text into windows of token ids. Each distinct window, known by its two id tuples, is
aligned once (common ends give its groups and links) and remembered; equal hashes are checked id by id.

``align`` is one pass without a shuffle; ``pair_counts`` adds up how many links of the corpus hold each id pair
(summed per batch before the shuffle); ``weigh`` gives each text the counts of its links. The counts go to the tasks
as two sorted arrays while there are at most ``MOST_SHARED`` pairs (13 bytes each), else by a join on the pair.

Defined results: null and empty texts have no tokens; equal texts have equal results; an empty table gives no rows;
other columns pass through (the added ones must not be there already).
"""

from __future__ import annotations

import itertools
import json
import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.arrow import append, give_back
from strata.llm.words import MULT, Remembered, Tokenizer, mix, powers, ranges
from strata.session import scratch_path

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
#: How a byte-level vocabulary cuts words; fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
UNITS_A_CALL = 500
#: Units and windows remembered by a task, and pairs shared with the tasks.
KNOWN_UNITS, KNOWN_WINDOWS, MOST_SHARED = 200_000, 200_000, 4_000_000

#: White space beyond ASCII by UTF-8 bytes, and the space mark; fixed values.
WIDE_SPACES = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", *[b"\xe2\x80" + bytes([k]) for k in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)],
               b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xe2\x96\x81"]


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for themselves,
    characters from 256 on for the other bytes in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def token_bytes_a(vocabulary: bytes) -> list[bytes]:
    given = json.loads(vocabulary)
    ids = dict(given["model"]["vocab"]) | {t["content"]: t["id"] for t in given.get("added_tokens", [])}
    of = byte_of_char()
    out = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return out


def by_rank(vocabulary: bytes) -> bool:
    """Whether the vocabulary is plainly byte-level and its ids follow its merges."""
    given = json.loads(vocabulary)
    kind, model = given.get("pre_tokenizer") or {}, given["model"]
    if given.get("normalizer") or kind.get("type") != "ByteLevel" or not kind.get("use_regex", True) or kind.get("add_prefix_space"):
        return False
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return all(x < y for x, y in itertools.pairwise(merged))


def ranks_of(vocabulary: bytes, tokens: list[bytes]) -> dict[bytes, int]:
    added = {t["id"] for t in json.loads(vocabulary).get("added_tokens", [])}
    return {t: i for i, t in enumerate(tokens) if t and i not in added}


def token_bytes_b(model) -> list[bytes]:
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]


def units(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the units: each row's begin, and spaces behind a visible character, save a row's last byte."""
    space = data == 0x20
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = (data <= 0x20) | (data == 0x7F)
    for mark in WIDE_SPACES:
        hit = data[len(mark) - 1:] == mark[-1]
        for k, byte in enumerate(mark[:-1]):
            hit = hit & (data[k:len(data) - len(mark) + 1 + k] == byte)
        blank[len(mark) - 1:] |= hit
    space[1:] &= ~blank[:-1]
    space[edges[1:] - 1] = False
    space[edges[:-1]] = True
    starts = np.flatnonzero(space)
    return starts, np.append(starts[1:], len(data))


class Vocabularies:
    """Both tokenizers with the bytes of their tokens. The id behind a vocabulary's last marks a unit that it does not give back.

    A's merges are applied by rank, many units a call, where its ids follow its merges; vocabularies of another order go
    to the library that the file is made for."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken

        self.b, self.a, self.ranked = sentencepiece.SentencePieceProcessor(model_proto=b), None, None
        self.bytes_a, self.bytes_b = token_bytes_a(a), token_bytes_b(self.b)
        if by_rank(a):
            self.ranked = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks_of(a, self.bytes_a), special_tokens={})
        else:
            from tokenizers import Tokenizer as Library

            self.a = Library.from_str(a.decode())
            self.a.encode_special_tokens = True
        self.blank = np.arange(256) <= 0x20  # what ends a unit in white space, or may: all bytes behind a character's first
        self.blank[0x80:] = True
        self.names_a, self.names_b = (list(map(str, range(len(x) + 1))) for x in (self.bytes_a, self.bytes_b))
        sizes = lambda tokens: np.array([*map(len, tokens), 0], np.int64)
        spaced = lambda tokens: np.array([*[t.startswith(b" ") for t in tokens], False])
        self.size_a, self.size_b = sizes(self.bytes_a), sizes(self.bytes_b)
        self.space_a, self.space_b = spaced(self.bytes_a), spaced(self.bytes_b)
        self.flat_a, self.flat_b = (np.frombuffer(b"".join(x), np.uint8) for x in (self.bytes_a, self.bytes_b))
        self.begin_a, self.begin_b = (np.cumsum(x) - x for x in (self.size_a, self.size_b))

    def _checked(self, ids, size, whole, lengths, tokens, sizes, flat, begin):
        """(ids, size), with units whose tokens' bytes are not theirs (``whole``, of these lengths) marked as one bad token."""
        n = sizes[ids]
        upto = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(size)])]
        if np.array_equal(np.diff(upto), lengths) and np.array_equal(flat[ranges(begin[ids], n)], whole):
            return ids, size
        at, to = np.concatenate([[0], np.cumsum(size)]).tolist(), np.concatenate([[0], np.cumsum(lengths)]).tolist()
        raw, each = whole.tobytes(), ids.tolist()
        lists = [each[i:j] for i, j in itertools.pairwise(at)]
        return flattened([x if b"".join([tokens[t] for t in x]) == raw[i:j] else [len(tokens)] for x, (i, j) in zip(lists, itertools.pairwise(to), strict=True)])

    def encode_a(self, data, starts, ends):
        lengths, whole = ends - starts, data[ranges(starts, ends - starts)]
        if self.ranked is None:
            ids, size = flattened([e.ids for e in self.a.encode_batch_fast([r.decode() for r in cut(data, starts, ends)], add_special_tokens=False)])
        else:  # units one after another are a text that is cut as they are, up to one that ends in white space
            to = np.cumsum(lengths)
            raw, edges = whole.tobytes(), np.flatnonzero(self.blank[data[ends - 1]]) + 1
            edges = np.unique(np.concatenate([edges, np.arange(0, len(starts), UNITS_A_CALL), [len(starts)]]))
            calls = [0, *to[edges[1:] - 1].tolist()]
            ids = np.array(list(itertools.chain.from_iterable(self.ranked.encode_ordinary(raw[x:y].decode()) for x, y in itertools.pairwise(calls))), np.int32)
            size = np.diff(np.searchsorted(np.cumsum(self.size_a[ids]), to, "left") + 1, prepend=0)
        return self._checked(ids, size, whole, lengths, self.bytes_a, self.size_a, self.flat_a, self.begin_a)

    def encode_b(self, data, starts, ends):
        """The library puts a space before what it encodes, so the unit's own is left out."""
        lengths = ends - starts
        ids, size = flattened(self.b.encode([r[1:].decode() for r in cut(data, starts, ends)], num_threads=1))
        return self._checked(ids, size, data[ranges(starts, lengths)], lengths, self.bytes_b, self.size_b, self.flat_b, self.begin_b)


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(size.sum())), size


def cut(data, starts, ends) -> list[bytes]:
    return [data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def run_hashes(ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the id runs first..last - 1."""
    up, down = powers(len(ids) + 1, MULT), powers(len(ids) + 1, pow(MULT, -1, 2**64))
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * up[:len(ids)], out=total[1:])
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


class Side:
    """Id runs one after another."""

    def __init__(self):
        self.ids, self.begin = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, ids, size):
        self.ids, self.begin = np.concatenate([self.ids, ids]), np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])

    def same(self, entry, ids, first, last) -> np.ndarray:
        """Which runs first..last - 1 of ``ids`` are the runs ``entry``."""
        size = last - first
        out = self.begin[entry + 1] - self.begin[entry] == size
        at = np.flatnonzero(out & (size > 0))
        differ = self.ids[ranges(self.begin[entry[at]], size[at])] != ids[ranges(first[at], size[at])]
        out[np.repeat(at, size[at])[differ]] = False
        return out


class Windows:
    """Alignments of windows, remembered by their id tuples."""

    def __init__(self, voc: Vocabularies, limit: int = KNOWN_WINDOWS):
        self.voc, self.limit = voc, limit
        self.clear()

    def clear(self):
        self.by_hash: dict[int, int] = {}
        self.by_ids: dict[tuple, int] = {}
        self.a, self.b, self.links, self.groups = Side(), Side(), Side(), []

    def look_up(self, a, a0, a1, b, b0, b1) -> np.ndarray:
        """The entry of each window (ids a[a0:a1], b[b0:b1])."""
        h = mix(run_hashes(a, a0, a1) * np.uint64(3) + run_hashes(b, b0, b1))
        unique, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.groups) + len(unique) > self.limit:
            self.clear()
        entry = np.fromiter(map(self.by_hash.get, unique.tolist(), itertools.repeat(-1)), np.int64, len(unique))
        new = np.flatnonzero(entry < 0)
        at = first[new]
        entry[new] = self.remember(a, a0[at], a1[at], b, b0[at], b1[at])
        self.by_hash.update(zip(unique[new].tolist(), entry[new].tolist(), strict=True))
        out = entry[which]
        other = np.flatnonzero(~(self.a.same(out, a, a0, a1) & self.b.same(out, b, b0, b1)))
        for w in other:  # equal hashes of different windows
            one = slice(w, w + 1)
            key = (tuple(a[a0[w]:a1[w]].tolist()), tuple(b[b0[w]:b1[w]].tolist()))
            if key not in self.by_ids:
                self.by_ids[key] = int(self.remember(a, a0[one], a1[one], b, b0[one], b1[one])[0])
            out[w] = self.by_ids[key]
        return out

    def remember(self, a, a0, a1, b, b0, b1) -> np.ndarray:
        """Aligns windows that are not known: the ends that both sides share cut a window into groups, each with one
        link, of the tokens that end it."""
        n_a, n_b = a1 - a0, b1 - b0
        ids_a, ids_b = a[ranges(a0, n_a)], b[ranges(b0, n_b)]
        ends_a, ends_b = np.cumsum(self.voc.size_a[ids_a]), np.cumsum(self.voc.size_b[ids_b])
        _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        pairs = ids_a[at_a].astype(np.int64) * len(self.voc.bytes_b) + ids_b[at_b]
        n_links = np.diff(np.searchsorted(at_a, np.concatenate([[0], np.cumsum(n_a)])))
        a_text, b_text = ([names[k] for k in ids.tolist()] for names, ids in ((self.voc.names_a, ids_a), (self.voc.names_b, ids_b)))
        a_cut, b_cut = [0, *(at_a + 1).tolist()], [0, *(at_b + 1).tolist()]
        groups = [",".join(a_text[i:j]) + "|" + ",".join(b_text[k:m])
                  for i, j, k, m in zip(a_cut[:-1], a_cut[1:], b_cut[:-1], b_cut[1:], strict=True)]
        bounds = [0, *np.cumsum(n_links).tolist()]
        entry = np.arange(len(self.groups), len(self.groups) + len(n_a))
        self.groups += [";".join(groups[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        self.a.add(ids_a, n_a)
        self.b.add(ids_b, n_b)
        self.links.add(pairs, n_links)
        return entry


def aligned(voc: Vocabularies):
    """The kernel of ``align``: (n_a, n_b, links, groups) of the rows of a slice."""
    known_a, known_b, windows = Remembered(voc.encode_a, KNOWN_UNITS), Remembered(voc.encode_b, KNOWN_UNITS), Windows(voc)
    hashing = Tokenizer(np.ones(256, bool), lower=False)
    bad_a, bad_b = len(voc.bytes_a), len(voc.bytes_b)

    def kernel(data, offsets, _):
        n_rows = len(offsets) - 1
        size = np.diff(offsets)
        some = np.flatnonzero(size)
        line = np.insert(data, offsets[some], 0x20)
        edges = np.concatenate([[0], np.cumsum(size[some] + 1)])
        starts, ends = units(line, edges)
        hashes = hashing.hashes(line, starts, ends)
        a, n_a = known_a.look_up(line, starts, ends, hashes)
        b, n_b = known_b.look_up(line, starts, ends, hashes)
        row = np.searchsorted(edges, starts, "right") - 1
        row_a, row_b = np.repeat(row, n_a), np.repeat(row, n_b)
        fine = np.ones(len(some), bool)
        fine[row_a[a == bad_a]] = fine[row_b[b == bad_b]] = False
        a, b, row_a, row_b = a[fine[row_a]], b[fine[row_b]], row_a[fine[row_a]], row_b[fine[row_b]]
        at_a, at_b = (np.concatenate([[0], np.cumsum(s[i])])[:-1] for s, i in ((voc.size_a, a), (voc.size_b, b)))
        _, a0, b0 = np.intersect1d(at_a[voc.space_a[a]], at_b[voc.space_b[b]], assume_unique=True, return_indices=True)
        a0, b0 = np.flatnonzero(voc.space_a[a])[a0], np.flatnonzero(voc.space_b[b])[b0]
        entry = windows.look_up(a, a0, np.append(a0[1:], len(a)), b, b0, np.append(b0[1:], len(b)))
        counts = [np.bincount(some[r], minlength=n_rows) for r in (row_a, row_b)]
        bounds = np.searchsorted(some[row_a[a0]], np.arange(n_rows + 1)).tolist()
        links = windows.links
        n_links = links.begin[entry + 1] - links.begin[entry]
        flat = links.ids[ranges(links.begin[entry], n_links)]
        upto = np.concatenate([[0], np.cumsum(n_links)])[bounds]
        texts, each = windows.groups, entry.tolist()
        groups = [";".join([texts[k] for k in each[i:j]]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        return [*counts, pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(flat, pa.int64())), groups]

    return kernel


def align(docs: DataFrame, a: str = A_FILE, b: str = B_FILE, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep``) with n_a, n_b (tokens), links (a-id times B's size plus b-id, of every common
    end in order) and groups (``a1,a2|b1;a3|b2,b3``)."""
    shared = docs.sparkSession.sparkContext.broadcast((Path(a).read_bytes(), Path(b).read_bytes()))
    n_pairs = len(token_bytes_a(shared.value[0])) * vocabulary_size(shared.value[1])
    kind = T.IntegerType() if n_pairs < 2**31 else T.LongType()
    fields = [T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()),
              T.StructField("links", T.ArrayType(kind)), T.StructField("groups", T.StringType())]
    return append(docs, fields, lambda: aligned(Vocabularies(*shared.value)), text, keep=keep)


def vocabulary_size(model: bytes) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()


def pair_counts(rows: DataFrame, size_b: int, links: str = "links") -> DataFrame:
    """(pair, n, best): how many links hold each pair, and whether no pair of the same B id has more."""
    def run(batches):
        for batch in batches:
            pairs, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])
        give_back()

    counts = (rows.select(F.col(links)).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
              .withColumn("b", F.col("pair") % size_b))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def weigh(rows: DataFrame, counts: DataFrame, links: str = "links", most_shared: int = MOST_SHARED) -> DataFrame:
    """``rows`` (with a column row_key of its own) with n_best and count_sum over their links."""
    if counts.count() > most_shared:
        each = rows.select("row_key", F.explode(links).alias("pair")).groupBy("row_key", "pair").agg(F.count("*").alias("k"))
        sums = each.join(counts, "pair").groupBy("row_key").agg(
            F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
        return rows.join(sums, "row_key", "left").fillna(0, ["n_best", "count_sum"])
    table = counts.toArrow()
    order = np.argsort(table["pair"].to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy()[order] for c in ("pair", "n", "best")))
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(batches):
        pair, n, best = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(links))
            at = np.searchsorted(pair, column.flatten().to_numpy(zero_copy_only=False))
            upto = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)])[upto]) for x in (best, n)]
            old = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*old, *[pa.array(s, pa.int64()) for s in sums]], names=[*names, "n_best", "count_sum"])
        give_back()

    return rows.mapInArrow(run, schema)


def corpus_links(docs: DataFrame, a: str = A_FILE, b: str = B_FILE, text: str = "text", keep: list[str] | None = None,
                 most_shared: int = MOST_SHARED) -> DataFrame:
    """``keep`` with n_a, n_b, links, groups_sha256 ('' without tokens), n_best and count_sum; texts are encoded once,
    their links wait in a table in the shared folder."""
    spark = docs.sparkSession
    rows = align(docs, a, b, text, keep=keep)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    path = scratch_path(spark, f"align-{uuid.uuid4().hex}")
    rows.withColumn("groups_sha256", digest).drop("groups").withColumn("row_key", F.monotonically_increasing_id()).write.parquet(path)
    written = spark.read.parquet(path)
    counts = pair_counts(written, vocabulary_size(Path(b).read_bytes())).checkpoint()
    return weigh(written, counts, most_shared=most_shared).drop("row_key")
