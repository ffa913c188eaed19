"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces of a public model are put into a double array over bytes (base, check, piece), in which the
white-space marker is the byte 0x20. A text gets the marker in front; the best sequence of pieces by the
sum of log scores is found by dynamic programming over byte positions. A character that no piece covers
costs ``UNKNOWN`` more than the worst piece and becomes byte pieces (fallback); so does a literal
U+2581, which keeps decoding exact. Where no piece has a marker after another character, the texts fall
apart at markers; distinct segments are solved once, thousands at a time in numpy (segments of over
LONG bytes one by one). Models whose scores are merge ranks rather than logarithms (r for rank r) take
Zipf's law, -ln((r + 1) H). Ties go to the piece that begins first.

Defined results: null and empty texts have no ids and decode to ""; equal texts have equal ids; control ids
decode to nothing, and bytes that are no UTF-8 to U+FFFD; an empty table gives no rows; other columns
pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from strata.llm.arrow import append
from strata.llm.words import Remembered, Tokenizer, ranges

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN = 10.0
NEVER = -1e8
LONG = 200


def read_model(path: str):
    """(bytes of every id, log scores, ids that text can become, id of each byte): from a local file on the driver."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    names = [m.id_to_piece(i) for i in range(n)]
    byte_id = np.full(256, -1, np.int64)
    plain, data = np.zeros(n, bool), []
    for i, name in enumerate(names):
        if m.is_byte(i):
            byte_id[int(name[3:5], 16)] = i
            data.append(bytes([int(name[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            data.append(b"")
        else:
            plain[i] = True
            data.append(name.replace(MARKER, " ").encode())
    raw = np.array([m.get_score(i) for i in range(n)])
    plain &= raw > NEVER  # such pieces are decoded, but never chosen
    return data, log_scores(raw, plain), plain, byte_id


def log_scores(raw: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """The model's scores, or Zipf's law if they are whole numbers down from about 0: the ranks of merges."""
    own = raw[plain]
    if len(own) < 2 or own.max() > 0 or (own != np.round(own)).any():
        return raw.astype(np.float64)
    return -np.log((np.abs(raw) + 1) * np.sum(1 / (np.arange(len(own)) + 1)))


def double_array(pieces: dict[bytes, int]):
    """(base, check, piece): the state behind byte b of state s is base[s] + b if check says s; the root is 0."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for piece, number in pieces.items():
        node = 0
        for b in piece:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][b]
        ends[node] = number
    reach = 4096
    size = 2 * len(children) + 2 * reach
    base, check, piece = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    used = np.zeros(size, bool)
    used[0] = True
    place, front, todo = {0: 0}, 1, [0]
    for node in todo:
        keys = sorted(children[node])
        if not keys:
            continue
        at = max(front - keys[0], 1)
        while True:
            if at + 2 * reach > size:
                base, check, piece = (np.concatenate([x, np.full(size, f)]) for x, f in ((base, 0), (check, -1), (piece, -1)))
                used = np.concatenate([used, np.zeros(size, bool)])
                size *= 2
            taken = used[at + keys[0]:at + keys[0] + reach].copy()
            for b in keys[1:]:
                taken |= used[at + b:at + b + reach]
            if not taken.all():
                at += int(taken.argmin())
                break
            at += reach
        base[place[node]] = at
        for b in keys:
            child = children[node][b]
            used[at + b] = True
            place[child] = at + b
            check[at + b], piece[at + b] = place[node], ends[child]
            todo.append(child)
        if used[front:front + reach].mean() > 0.9:  # nearly full: not tried again
            front += reach
    return base, check, piece


def char_sizes(data: np.ndarray) -> np.ndarray:
    """Bytes of the character that begins here; 0 within one."""
    return np.select([data < 0x80, data < 0xC0, data < 0xE0, data < 0xF0], [1, 0, 2, 3], 4)


class Encoder:
    """Best pieces of byte spans."""

    def __init__(self, trie, scores: np.ndarray, byte_id: np.ndarray):
        self.base, self.check, self.piece = trie
        self.scores, self.byte_id = scores, byte_id
        self.unknown = float(scores[self.piece[self.piece >= 0]].min()) - UNKNOWN

    def encode(self, data, starts, ends):
        """(ids one after another, number of each) of many spans."""
        size = ends - starts
        edge = np.cumsum(size + 1) - (size + 1)  # each span has a place for its end
        total = int((size + 1).sum())
        back, by = np.zeros(total, np.int64), np.full(total, -1, np.int64)
        text = np.zeros(total, np.uint8)
        text[ranges(edge, size)] = data[ranges(starts, size)]
        chars = char_sizes(text)
        long = np.flatnonzero(size > LONG)
        for k in long:
            a, n = int(edge[k]), int(size[k])
            self._one(text[a:a + n], chars[a:a + n], back[a:a + n + 1], by[a:a + n + 1], a)
        self._many(text, chars, edge, size, np.flatnonzero(size <= LONG), back, by)
        return self._follow(text, edge, size, back, by)

    def _many(self, text, chars, edge, size, lanes, back, by):
        best = np.full(len(text), -np.inf)
        lanes = lanes[np.argsort(-size[lanes], kind="stable")]
        at, end = edge[lanes], (edge + size)[lanes]
        best[at] = 0
        for i in range(int(size[lanes[0]]) if len(lanes) else 0):
            running = int(np.searchsorted(-(end - at), -i))
            here = at[:running] + i
            live = np.flatnonzero(best[here] > -np.inf)
            here, stop = here[live], end[:running][live]
            so_far, whole = best[here], here + chars[here]
            covered = np.zeros(len(here), bool)
            which, state, to = np.arange(len(here)), np.zeros(len(here), np.int64), here
            while len(which):
                inside = to < stop[which]
                which, state, to = which[inside], state[inside], to[inside]
                step = self.base[state] + text[to]
                ok = (self.check[step] == state) & (self.base[state] > 0)
                which, state, to = which[ok], step[ok], to[ok] + 1
                hit = np.flatnonzero(self.piece[state] >= 0)
                w, t, p = which[hit], to[hit], self.piece[state[hit]]
                covered[w[t == whole[w]]] = True
                value = so_far[w] + self.scores[p]
                better = value > best[t]
                t = t[better]
                best[t], back[t], by[t] = value[better], here[w[better]], p[better]
            w = np.flatnonzero(~covered)
            t, value = whole[w], so_far[w] + self.unknown
            better = value > best[t]
            t = t[better]
            best[t], back[t], by[t] = value[better], here[w[better]], -1

    def _one(self, text, chars, back, by, offset):
        base, check, piece, scores = self.base, self.check, self.piece, self.scores
        n, raw, sizes = len(text), text.tolist(), chars.tolist()
        best = [-np.inf] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -np.inf:
                continue
            state, to, covered = 0, i, False
            while to < n and base[state] > 0:
                step = base[state] + raw[to]
                if check[step] != state:
                    break
                state, to = step, to + 1
                p = piece[state]
                if p >= 0:
                    covered |= to == i + sizes[i]
                    value = best[i] + scores[p]
                    if value > best[to]:
                        best[to], back[to], by[to] = value, i + offset, p
            to = i + sizes[i]
            if not covered and best[i] + self.unknown > best[to]:
                best[to], back[to], by[to] = best[i] + self.unknown, i + offset, -1

    def _follow(self, text, edge, size, back, by):
        """Reads the best paths backwards, all spans at once."""
        spot, lane = edge + size, np.arange(len(edge))
        found_lane, found_id, turn, found_turn = [], [], 0, []
        while len(lane):
            going = spot > edge[lane]
            spot, lane = spot[going], lane[going]
            came, p = back[spot], by[spot]
            known = p >= 0
            found_lane.append(lane[known])
            found_id.append(p[known])
            found_turn.append(np.full(int(known.sum()), turn))
            n = (spot - came)[~known]
            found_lane.append(np.repeat(lane[~known], n))
            at = ranges(came[~known], n)
            found_id.append(self.byte_id[text[at]])
            found_turn.append(turn + (np.repeat(spot[~known], n) - at - 1))
            spot, turn = came, turn + 4
        lanes, ids, turns = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (found_lane, found_id, found_turn))
        order = np.lexsort((-turns, lanes))
        return ids[order].astype(np.int32), np.bincount(lanes, minlength=len(edge))


def marked(data: np.ndarray, offsets: np.ndarray):
    """The rows with a marker in front of each that is not empty."""
    size = np.diff(offsets)
    edges = np.concatenate([[0], np.cumsum(size + (size > 0))])
    out = np.full(int(edges[-1]), 0x20, np.uint8)
    out[ranges(edges[:-1] + 1, size)] = data
    return out, edges


def segments(data: np.ndarray, offsets: np.ndarray, part: bool):
    """Starts and ends of the pieces of text that can be solved alone: from markers to the next markers."""
    first = np.zeros(len(data), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    if part:
        space = data == 0x20
        first |= space & ~np.concatenate([[False], space[:-1]])
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], len(data)) if len(starts) else starts


def joined(names: list[bytes]):
    """Bytes of all ids one after another, and where each begins."""
    size = np.array([len(x) for x in names], np.int64)
    return np.frombuffer(b"".join(names), np.uint8), np.cumsum(size) - size, size


def prepared(docs: DataFrame, path: str):
    names, scores, plain, byte_id = read_model(path)
    trie = double_array({names[i]: int(i) for i in np.flatnonzero(plain)})
    part = not any(b" " in names[i].lstrip(b" ") for i in np.flatnonzero(plain))
    return docs.sparkSession.sparkContext.broadcast((trie, scores, byte_id, joined(names), part))


def texts_of(ids: np.ndarray, counts: np.ndarray, pieces) -> list[str]:
    """The text of each run of ``counts`` ids, without the first marker."""
    data, begin, size = pieces
    fine = (ids >= 0) & (ids < len(size))
    known = np.where(fine, ids, 0)
    length = np.where(fine, size[known], 0)
    text = data[ranges(begin[known], length)].tobytes()
    ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [text[a + text.startswith(b" ", a, z):z].decode(errors="replace") for a, z in zip(ends[:-1], ends[1:], strict=True)]


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", name: str = "token_ids", keep: list[str] | None = None,
           decoded: str | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep``) with the ids of the text's pieces; if ``decoded`` names a column, also
    with the text that the ids decode to, in the same pass."""
    shared = prepared(docs, model)
    fields = [T.StructField(name, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])

    def start():
        trie, scores, byte_id, pieces, part = shared.value
        encoder = Encoder(trie, scores, byte_id)
        known, tokenizer = Remembered(encoder.encode), Tokenizer(np.ones(256, bool), lower=False)

        def kernel(data, offsets, batch):
            text, edges = marked(data, offsets)
            starts, ends = segments(text, edges, part)
            ids, n = known.look_up(text, starts, ends, tokenizer.hashes(text, starts, ends))
            row_ids = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, edges)]
            out = [pa.ListArray.from_arrays(pa.array(row_ids.astype(np.int32)), pa.array(ids, pa.int32()))]
            return out + ([texts_of(ids.astype(np.int64), np.diff(row_ids), pieces)] if decoded else [])

        return kernel

    return append(docs, fields, start, text, keep=keep, slice_bytes=1 << 20)


def decode(rows: DataFrame, model: str = MODEL, ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids; null ids and ids that the model lacks decode to nothing."""
    shared = rows.sparkSession.sparkContext.broadcast(joined(read_model(model)[0]))
    columns = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            out = []
            for i in range(0, len(column), 500):
                part = column.slice(i, 500)
                n = np.array(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                out += texts_of(part.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), n, shared.value)
            old = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*old, pa.array(out, pa.string())], names=[*columns, name])

    return rows.mapInArrow(run, schema)


def is_byte_piece(piece: Column, model: str = MODEL) -> Column:
    """Whether an id is a byte piece."""
    ids = sorted(int(x) for x in read_model(model)[3] if x >= 0)
    if ids == list(range(ids[0], ids[0] + len(ids))):
        return (piece >= ids[0]) & (piece <= ids[-1])
    return piece.isin(ids)
