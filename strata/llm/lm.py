"""LM scoring: a causal self-attention model over subword ids, trained in numpy, and a word-count base.

Model. Words are encoded by a public subword vocabulary. One attention layer reads the last tokens (up
to twice SPAN, SPAN at least where there are so many) with a learned bias by distance; a hidden layer then
adds to ln p(class | two tokens before) for the class of the next token. That prior and p(token | class,
token before) come from counts over all training texts. The frequent ids are classes of their own, the others share classes by rank and by
whether they begin a word. All counts, and with them classes, embedded ids, contexts and
histories, are of all training rows, summed by Spark. Embeddings, attention and output are trained together
(Adam) on windows of up to WINDOW tokens, cut from texts of any length. A window is known by a hash of its text's
id and its number, never by where its row lies. All windows of all training texts train the model: they are dealt by
hash to groups of about GROUP windows, so the groups grow with the corpus, each group trains on its windows in the
order of their hashes, and the parameters are averaged by the number of windows. Where the groups begin from is no
random point, but what the FIRST windows in the order of their hashes lead to, in one task. So scores do not depend on the partitions of the input.

Texts are encoded once: the ids (two bytes each) wait in a table in the shared folder, with what the base needs of a
text, and all later passes read these.

Scoring. A text is cut into blocks of SPAN tokens. Each block's window is the block before and itself, so
windows overlap by half and every token is scored exactly once, with all windows of a slice in one
batched, masked attention. With one layer, queries, keys and values depend on the id alone and are
looked up.

Base. Word counts over all training texts are summed by Spark. The HEAVY most frequent words are broadcast
(a fixed bound); other words of a text are joined with the counts over the cluster: they are rare, so
no key of that join is hot.

Defined results: a null or wordless text is its end alone; equal texts have equal scores; rows with a null id
are training rows; without training texts all counts are 0 and the model gives every class and id the
same share; an empty table gives no rows; other columns are not read. Words are counted by 64-bit hashes.
"""

from __future__ import annotations

import itertools
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.arrow import append, give_back, in_one_task, slices, text_buffers
from strata.llm.words import SPACED, Remembered, Tokenizer, mix, ranges
from strata.session import ensure_checkpoint_dir, scratch_path

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPAN = 16
DIM = 8
HIDDEN = 16
OWN_CLASSES, SHARED_CLASSES = 48, 8  # shared ones: so many for pieces that begin a word, and for those that do not
EMBEDDED = 4096
BEFORE = 512  # contexts of one token: the most frequent ids alone, the others by class
PAIRS = 1 << 14  # contexts of two tokens: the most frequent ones; otherwise the last token's
WINDOW, GROUP = 64 * SPAN, 2000
FIRST = 1500  # windows that lead from random parameters to where all groups begin
STEPS, BATCH, RATE = 400, 512, 0.02
LATER = 0.1  # the rate from the first model on, as a share of RATE
HEAVY = 1 << 20
HELD_WORDS = 4_000_000
SLICE_TOKENS = 1 << 19


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def word_encoder(model: bytes) -> Remembered:
    """Ids of lower-cased words, as within a text."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)

    def encode(data, starts, ends):
        raw = data.tobytes()
        ids = pieces.encode([raw[a:z].lower().decode() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)], num_threads=1)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(size.sum())), size

    return Remembered(encode, 400_000)


class Texts:
    """Words and subword ids of slices. bytes.lower() and the hashes fold A-Z alone."""

    def __init__(self, model: bytes):
        self.words, self.ids = Tokenizer(SPACED, lower=True), word_encoder(model)

    def read(self, data, offsets):
        """(word hashes, word bounds of rows, ids, id bounds of rows)."""
        _, starts, ends, h, bounds = self.words.words(data, offsets)
        ids, n = self.ids.look_up(data, starts, ends, h)
        return h, bounds, ids, np.concatenate([[0], np.cumsum(n)])[bounds]


def blocks(ids: np.ndarray, bounds: np.ndarray, begin: int, end: int):
    """Inputs (begin, then the ids) and targets (the ids, then end) of all rows, padded to blocks of SPAN:
    (inputs, targets, real, first block of a row, row of each block)."""
    n = np.diff(bounds) + 1
    count = -(-n // SPAN)
    row = np.repeat(np.arange(len(n)), count)
    total = int(count.sum()) * SPAN
    start = (np.cumsum(count) - count) * SPAN
    inputs, targets, real = np.full(total, begin, np.int64), np.full(total, end, np.int64), np.zeros(total, bool)
    real[ranges(start, n)] = True
    inputs[ranges(start + 1, n - 1)] = ids
    targets[ranges(start, n - 1)] = ids
    first = np.zeros(len(row), bool)
    first[np.cumsum(count) - count] = True
    shape = (-1, SPAN)
    return inputs.reshape(shape), targets.reshape(shape), real.reshape(shape), first, row


def windows_of(ids: np.ndarray, bounds: np.ndarray, begin: int, end: int, choose):
    """(number among all, window) of the windows of all rows (begin, the ids, end, cut after each WINDOW targets) that
    ``choose`` names, given their rows and their numbers within a row; each holds its targets and the token before them."""
    n = np.diff(bounds) + 1
    count = -(-n // WINDOW)
    row = np.repeat(np.arange(len(n)), count)
    number = ranges(np.zeros(len(n), np.int64), count)
    a = number * WINDOW
    z = np.minimum(a + WINDOW, n[row])
    for w in choose(row, number):
        r = row[w]
        own = ids[bounds[r] + max(a[w] - 1, 0):min(bounds[r] + z[w], bounds[r + 1])]
        yield w, np.concatenate([[begin] if a[w] == 0 else [], own, [end] if z[w] == n[r] else []]).astype(np.uint16)


def window_blocks(flat: np.ndarray, bounds: np.ndarray, begin: int, end: int):
    """As blocks(), of windows; what begins a window within a text has no history, so it is not real."""
    n = np.diff(bounds) - 1
    count = -(-n // SPAN)
    total = int(count.sum()) * SPAN
    start = (np.cumsum(count) - count) * SPAN
    inputs, targets, real = np.full(total, begin, np.int64), np.full(total, end, np.int64), np.zeros(total, bool)
    at = ranges(start, n)
    inputs[at], targets[at], real[at] = flat[ranges(bounds[:-1], n)], flat[ranges(bounds[:-1] + 1, n)], True
    real[start] = flat[bounds[:-1]] == begin
    first = np.zeros(total // SPAN, bool)
    first[start // SPAN] = True
    shape = (-1, SPAN)
    return inputs.reshape(shape), targets.reshape(shape), real.reshape(shape), first


DISTANCE = np.arange(SPAN)[:, None] + SPAN - np.arange(2 * SPAN)[None, :]
FORBIDDEN = np.float32(-1e9)


def attention_bias(by_distance: np.ndarray) -> np.ndarray:
    return np.where(DISTANCE >= 0, by_distance[np.maximum(DISTANCE, 0)], FORBIDDEN).astype(np.float32)


def with_before(x: np.ndarray) -> np.ndarray:
    """Each block after the one before it (the first block after itself, which is masked)."""
    return np.concatenate([np.concatenate([x[:1], x[:-1]]), x], axis=1)


def classes_of(counts: np.ndarray, begins_word: np.ndarray) -> np.ndarray:
    """Class of each id by frequency."""
    order = np.argsort(-counts, kind="stable")
    out = np.zeros(len(counts), np.int64)
    out[order[:OWN_CLASSES]] = np.arange(OWN_CLASSES)
    for kind in (0, 1):
        rest = order[OWN_CLASSES:][begins_word[order[OWN_CLASSES:]] == kind]
        mass = np.cumsum(counts[rest] + 1e-3)
        share = np.minimum((mass / max(mass[-1], 1) * SHARED_CLASSES).astype(np.int64), SHARED_CLASSES - 1) if len(rest) else mass.astype(np.int64)
        out[rest] = OWN_CLASSES + kind * SHARED_CLASSES + share
    return out


N_CLASSES = OWN_CLASSES + 2 * SHARED_CLASSES
PIECE = 64  # blocks


def softmax(x):
    """In place."""
    x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(-1, keepdims=True)
    return x


class Room:
    """Arrays that the batches of a task reuse: no batch waits for new memory."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, n: int, *shape: int, like=np.float32) -> np.ndarray:
        held = self.held.get(name)
        if held is None or len(held) < n or held.shape[1:] != shape or held.dtype != like:
            held = self.held[name] = np.empty((n, *shape), like)
        return held[:n]


def gradients(p, inputs, first, place, target, real, prior, history=None, room=None, with_loss=True):
    """(loss or None, gradients); ``prior``: by place of the blocks, or by ``history``. What is wide (the distances, the
    classes) is worked through PIECE blocks at a time, which stay in a core's cache; sums over places run over all blocks."""
    room, like, n = room or Room(), p["embed"].dtype, len(inputs)
    flat = lambda t: t.reshape(-1, t.shape[-1])
    at = place[inputs]
    x = room("x", n, SPAN, DIM, like=like)
    np.take(p["embed"], at, axis=0, out=x, mode="clip")
    around = with_before(x)
    q, z, dz, r = (room(name, n, SPAN, width, like=like) for name, width in (("q", DIM), ("z", HIDDEN), ("dz", HIDDEN), ("r", HIDDEN)))
    k, v = room("k", n, 2 * SPAN, DIM, like=like), room("v", n, 2 * SPAN, HIDDEN, like=like)
    for of, name, to in ((x, "query", q), (around, "key", k), (around, "value", v), (x, "direct", z)):
        np.matmul(of, p[name], out=to)
    d, ds = room("d", n, SPAN, N_CLASSES, like=like), room("ds", n, SPAN, 2 * SPAN, like=like)
    dq, dk, dv = room("dq", n, SPAN, DIM, like=like), room("dk", n, 2 * SPAN, DIM, like=like), room("dv", n, 2 * SPAN, HIDDEN, like=like)
    bias, root = attention_bias(p["distance"]), np.float32(np.sqrt(DIM))
    places = max(int(real.sum()), 1)
    share, padding = np.float32(1) / np.float32(places), ~real
    loss = 0.0 if with_loss else None
    for i in range(0, n, PIECE):
        j = min(i + PIECE, n)
        a, da, before = (room(name, j - i, SPAN, width, like=like) for name, width in (("a", 2 * SPAN), ("da", 2 * SPAN), ("before", N_CLASSES)))
        np.matmul(q[i:j], k[i:j].transpose(0, 2, 1), out=a)
        a /= root
        a += bias
        a[first[i:j], :, :SPAN] = FORBIDDEN
        softmax(a)
        own = z[i:j]
        np.matmul(a, v[i:j], out=dz[i:j])
        own += dz[i:j]
        own += p["inner"]
        np.maximum(own, 0, out=r[i:j])
        y = d[i:j]
        np.matmul(r[i:j], p["out"], out=y)
        y += p["outer"]
        y += prior[i:j] if history is None else np.take(prior, history[i:j], axis=0, out=before, mode="clip")
        softmax(y)
        cells = np.arange((j - i) * SPAN) * N_CLASSES + target[i:j].ravel()
        line = y.reshape(-1)
        if with_loss:
            loss -= np.log(np.maximum(line[cells], 1e-12))[real[i:j].ravel()].sum() / places
        line[cells] -= 1
        y *= share
        y[padding[i:j]] = 0
        np.matmul(y, p["out"].T, out=dz[i:j])
        dz[i:j] *= own > 0
        np.matmul(dz[i:j], v[i:j].transpose(0, 2, 1), out=da)
        np.matmul(a.transpose(0, 2, 1), dz[i:j], out=dv[i:j])
        ds_own = ds[i:j]
        np.multiply(da, a, out=ds_own)
        da -= ds_own.sum(-1, keepdims=True)
        np.multiply(a, da, out=ds_own)
    by = np.zeros(2 * SPAN, np.float32)
    np.add.at(by, np.maximum(DISTANCE, 0).ravel(), np.where(DISTANCE >= 0, ds.sum(0), 0).ravel())
    for i in range(0, n, PIECE):
        own = ds[i:i + PIECE]
        own /= root
        np.matmul(own, k[i:i + PIECE], out=dq[i:i + PIECE])
        np.matmul(own.transpose(0, 2, 1), q[i:i + PIECE], out=dk[i:i + PIECE])
    g = {"out": flat(r).T @ flat(d), "outer": flat(d).sum(0), "inner": flat(dz).sum(0), "direct": flat(x).T @ flat(dz), "distance": by,
         "query": flat(x).T @ flat(dq), "key": flat(around).T @ flat(dk), "value": flat(around).T @ flat(dv)}
    dx = dq @ p["query"].T
    dx += dz @ p["direct"].T
    d_around = dk @ p["key"].T
    d_around += dv @ p["value"].T
    dx += d_around[:, SPAN:]
    dx[:-1] += d_around[1:, :SPAN] * ~first[1:, None, None]
    cells = (at.ravel() * DIM)[:, None] + np.arange(DIM)
    g["embed"] = np.bincount(cells.ravel(), weights=dx.ravel(), minlength=p["embed"].size).reshape(p["embed"].shape).astype(like)
    return loss, g


class Adam:
    def __init__(self, p):
        self.p, self.t = p, 0
        self.m, self.s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def step(self, g, rate: float) -> None:
        self.t += 1
        for k in self.p:
            m, s, step = self.m[k], self.s[k], g[k]
            m *= 0.9
            m += 0.1 * step
            s *= 0.98
            s += 0.02 * step * step
            below = s / (1 - 0.98**self.t)
            np.sqrt(below, out=below)
            below += 1e-8
            step = m / (1 - 0.9**self.t)
            step *= rate
            step /= below
            self.p[k] -= step


def batch_gradients(p, part: slice, made, classes, place, histories, prior, begin: int, room=None):
    inputs, targets, real, first = made
    begins = first[part].copy()
    begins[0] = True
    history = two_before(inputs[part], first[part], begin, histories)
    if part.start and not first[part.start]:
        before = histories["contexts"][inputs[part.start - 1, -1]]
        history[0, 0] = histories["map"][before * BEFORE + histories["contexts"][inputs[part.start, 0]]]
    return gradients(p, inputs[part], begins, place, classes[targets[part]], real[part], prior, history, room, with_loss=False)[1]


def train(flat, bounds, classes, place, histories, prior, begin: int, end: int, seed: int = 3):
    """The parameters where all groups begin, from the first windows."""
    rng = np.random.default_rng(seed)
    shape = {"embed": (EMBEDDED + 1, DIM), "query": (DIM, DIM), "key": (DIM, DIM), "value": (DIM, HIDDEN), "direct": (DIM, HIDDEN),
             "inner": (HIDDEN,), "out": (HIDDEN, N_CLASSES), "outer": (N_CLASSES,), "distance": (2 * SPAN,)}
    p = {k: (rng.normal(0, 0.3 if len(s) > 1 else 0, s)).astype(np.float32) for k, s in shape.items()}
    if len(bounds) < 2:
        p["out"] *= 0
        return p
    p["out"] *= 0.1
    made, adam, room = window_blocks(flat, bounds, begin, end), Adam(p), Room()
    for t in range(1, STEPS + 1):
        at = int(rng.integers(0, max(1, len(made[0]) - BATCH)))
        g = batch_gradients(p, slice(at, at + BATCH), made, classes, place, histories, prior, begin, room)
        adam.step(g, RATE * min(1, 2 * (1 - t / (STEPS + 1))))
    return p


def read_windows(column):
    """(flat ids, bounds) of windows as two-byte numbers."""
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), np.uint16), np.concatenate([[0], np.cumsum([len(w) // 2 for w in held])]).astype(np.int64)


def trained_on_all(windows: DataFrame, total: int, p: dict, classes, place, histories, prior, begin: int, end: int) -> dict:
    """The mean, by windows, of the parameters that each group of the ``total`` windows (h, window) reaches from ``p``."""
    groups = max(1, -(-total // GROUP))
    dealt = windows.select(F.pmod("h", F.lit(groups)).cast("int").alias("g"), "h", "window").repartition("g").sortWithinPartitions("g", "h", "window")
    shared = windows.sparkSession.sparkContext.broadcast((p, classes, place, histories, prior))
    names = list(p)
    edges = np.concatenate([[0], np.cumsum([p[k].size for k in names])])

    def run(batches):
        first, classes, place, histories, prior = shared.value
        now, adam, room = None, None, Room()
        p, seen, reached = first, 0, np.zeros(edges[-1] + 1)  # all groups of the task, and their windows

        for batch in batches:
            group = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
            for x, y in itertools.pairwise(cuts):
                if x < y and group[x] != now:
                    reached += np.concatenate([*(p[k].ravel() for k in names), [1]]).astype(np.float64) * seen
                    now, p, seen = group[x], {k: v.copy() for k, v in first.items()}, 0
                    adam = Adam(p)
                for i in range(x, y, 1000):
                    flat, bounds = read_windows(batch.column("window").slice(i, min(1000, y - i)))
                    made = window_blocks(flat, bounds, begin, end)
                    for at in range(0, len(made[0]), BATCH):
                        adam.step(batch_gradients(p, slice(at, at + BATCH), made, classes, place, histories, prior, begin, room), RATE * LATER)
                    seen += len(bounds) - 1
        reached += np.concatenate([*(p[k].ravel() for k in names), [1]]).astype(np.float64) * seen
        if reached[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(reached))), pa.array(reached)], names=["cell", "v"])
        give_back()

    found = dealt.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    if not found.num_rows:
        return p
    total = np.zeros(edges[-1] + 1)
    total[found.column("cell").to_numpy()] = found.column("v").to_numpy()
    mean = (total[:-1] / total[-1]).astype(np.float32)
    return {k: mean[i:j].reshape(p[k].shape) for k, i, j in zip(names, edges[:-1], edges[1:], strict=True)}


def tables(p, place: np.ndarray):
    """What each id contributes: query, key, value, direct."""
    e = p["embed"][place]
    return (np.ascontiguousarray(e @ p["query"] / np.float32(np.sqrt(DIM))), np.ascontiguousarray(e @ p["key"]),
            np.ascontiguousarray(e @ p["value"]), np.ascontiguousarray(e @ p["direct"] + p["inner"]))


def class_logs(look, out, prior, bias, inputs, first, target, history) -> np.ndarray:
    """ln p(class of the target) for every place of the blocks, by batched masked attention."""
    query, key, value, direct = look
    result = np.empty(inputs.shape, np.float32)
    step, room = 512, Room()
    for i in range(0, len(inputs), step):
        j = min(i + step, len(inputs))
        z, y = room("z", j - i, SPAN, value.shape[1]), room("y", (j - i) * SPAN, out.shape[1])
        for a in range(i, j, PIECE):  # what a piece holds stays in a core's cache
            b = min(a + PIECE, j)
            ids = inputs[max(a - 1, 0):b]
            own = inputs[a:b]
            k, v = (room(name, b - a, 2 * SPAN, t.shape[1]) for name, t in (("k", key), ("v", value)))
            for around, t in ((k, key), (v, value)):
                found = np.take(t, ids, axis=0, mode="clip")
                around[:, SPAN:] = found[len(ids) - (b - a):]
                around[len(around) - len(found) + 1:, :SPAN] = found[:-1]
                if not a:
                    around[0, :SPAN] = found[0]
            s = np.matmul(np.take(query, own, axis=0, mode="clip"), k.transpose(0, 2, 1), out=room("s", b - a, SPAN, 2 * SPAN))
            s += bias
            s[first[a:b], :, :SPAN] = FORBIDDEN
            if s.max() > 60:
                np.minimum(s, 60, out=s)
            np.exp(s, out=s)
            weight = s.sum(-1, keepdims=True)
            mine = np.matmul(s, v, out=z[a - i:b - i])
            mine /= weight
            mine += np.take(direct, own, axis=0, mode="clip")
            np.maximum(mine, 0, out=mine)
        np.matmul(z.reshape(-1, z.shape[-1]), out, out=y)
        before = history[i:j].ravel()
        wanted = target[i:j].ravel()
        logs = result[i:j].reshape(-1)
        for a in range(0, len(y), PIECE * SPAN):
            rows = y[a:a + PIECE * SPAN]
            rows += np.take(prior, before[a:a + len(rows)], axis=0, out=room("before", len(rows), prior.shape[1]), mode="clip")
            picked = rows.reshape(-1)[np.arange(len(rows)) * rows.shape[1] + wanted[a:a + len(rows)]]
            if rows.max() > 60:
                np.minimum(rows, 60, out=rows)  # log probabilities and what is learned onto them: no sum overflows
            np.exp(rows, out=rows)
            logs[a:a + len(rows)] = np.minimum(picked, 60) - np.log(rows.sum(-1))
    return result


def contexts_of(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """What the counts know of the token before: itself if it is frequent, or else its class."""
    out = classes.copy()
    top = np.argsort(-counts, kind="stable")[:BEFORE - N_CLASSES]
    out[top] = N_CLASSES + np.arange(len(top))
    return out


def id_slices(batch):
    """(first row, last row + 1, ids, bounds) of slices of a batch with ids as two-byte numbers, of bounded size or one row."""
    column = batch.column(batch.schema.get_field_index("ids")).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    flat = np.frombuffer(raw, np.uint8)[:offsets[-1]].view(np.uint16) if raw is not None else np.zeros(0, np.uint16)
    offsets, i = offsets // 2, 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_TOKENS, "right")) - 1)
        yield i, j, flat[offsets[i]:offsets[j]].astype(np.int64), offsets[i:j + 1] - offsets[i]
        i = j


def histories_of(rows: DataFrame, contexts: np.ndarray, begin: int, end: int) -> dict:
    """What the counts know of the two tokens before: the frequent pairs of all given texts' ids, or the last one's
    context; pairs are summed by Spark."""
    shared = rows.sparkSession.sparkContext.broadcast(contexts)

    def run(batches):
        contexts, total = shared.value, np.zeros(BEFORE * BEFORE, np.int64)
        same = {"contexts": contexts, "map": np.arange(BEFORE * BEFORE)}
        for batch in batches:
            for _, _, ids, bounds in id_slices(batch):
                inputs, _, real, first, _ = blocks(ids, bounds, begin, end)
                total += np.bincount(two_before(inputs, first, begin, same)[real], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])
        give_back()

    found = rows.select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(BEFORE * BEFORE, np.int64)
    n[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    top = np.argsort(-n, kind="stable")[:PAIRS]
    top = top[n[top] > 0]
    to = (PAIRS + np.arange(BEFORE * BEFORE) % BEFORE).astype(np.int32)
    to[top] = np.arange(len(top))
    return {"contexts": contexts, "map": to}


def two_before(inputs, first, begin: int, histories: dict) -> np.ndarray:
    last = histories["contexts"][inputs]
    if not last.size:
        return last
    before = np.concatenate([[0], last.ravel()[:-1]]).reshape(last.shape)
    before[first, 0] = histories["contexts"][begin]
    return histories["map"][before * BEFORE + last]


def count_windows(rows: DataFrame) -> int:
    return int(rows.agg(F.sum(F.ceil((F.octet_length("ids") / 2 + 1) / WINDOW))).first()[0] or 0)


def survey(rows: DataFrame, begin: int, end: int, sample: int = 0, share: int = 1) -> DataFrame:
    """Of all given texts' ids (id, n): counts of every target id (the end once a text) by task; and (h, window): windows to
    train on with their hash, as two-byte numbers: one in ``share`` (1: all; 0: none), and those whose hash is low enough to
    be among the first ``sample``."""
    low = min(2**63 - 1, int(2**63 * 1.25 * sample / max(1, count_windows(rows))) + 1) if sample else 0

    def run(batches):
        counts = np.zeros(end + 1, np.int64)
        for batch in batches:
            seeds = batch.column("seed").to_numpy().view(np.uint64)
            for i, j, ids, bounds in id_slices(batch):
                counts += np.bincount(ids, minlength=end + 1)
                known = []

                def choose(row, number, own=seeds[i:j], known=known):
                    h = mix(own[row] + mix(number.astype(np.uint64) + np.uint64(1))) >> np.uint64(1)
                    known.append(h)
                    dealt = h % np.uint64(share) == 0 if share else np.zeros(len(h), bool)
                    return np.flatnonzero((h < np.uint64(low)) | dealt).tolist()

                held = [(int(known[0][w]), x.tobytes()) for w, x in windows_of(ids, bounds, begin, end, choose)]
                none = pa.nulls(len(held), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array([h for h, _ in held], pa.int64()), pa.array([x for _, x in held], pa.binary())],
                                                 names=["id", "n", "h", "window"])
            counts[end] += batch.num_rows
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at]), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary())],
                                         names=["id", "n", "h", "window"])
        give_back()

    return rows.select("seed", "ids").mapInArrow(run, "id long, n long, h long, window binary")


def count_ids(found: DataFrame, width: int) -> np.ndarray:
    counted = found.where("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width, np.int64)
    out[counted.column("id").to_numpy()] = counted.column("n").to_numpy()
    return out


def count_pairs(rows: DataFrame, classes, contexts, histories, place, begin: int, end: int):
    """Counts of (context, id) and of (history, class) over all given texts' ids, ids by their place (0: all that
    have none); summed by Spark."""
    shared = rows.sparkSession.sparkContext.broadcast((classes, contexts, histories, place))
    width = EMBEDDED + 1
    cells = BEFORE * width

    def run(batches):
        classes, contexts, histories, place = shared.value
        of_ids, of_classes = np.zeros(cells, np.int64), np.zeros((PAIRS + BEFORE) * N_CLASSES, np.int64)
        for batch in batches:
            for _, _, ids, bounds in id_slices(batch):
                inputs, targets, real, first, _ = blocks(ids, bounds, begin, end)
                history = two_before(inputs, first, begin, histories)[real]
                of_ids += np.bincount(contexts[inputs[real]] * width + place[targets[real]], minlength=len(of_ids))
                of_classes += np.bincount(history * N_CLASSES + classes[targets[real]], minlength=len(of_classes))
        for first, total in ((0, of_ids), (cells, of_classes)):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(first + at), pa.array(total[at])], names=["cell", "n"])

    found = rows.select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells + (PAIRS + BEFORE) * N_CLASSES, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out[:cells].reshape(BEFORE, width), out[cells:].reshape(PAIRS + BEFORE, N_CLASSES)


def by_context(counts: np.ndarray, histories: dict):
    """(the last token's context of each history, counts of (context, class)) from counts of (history, class)."""
    last = np.zeros(PAIRS + BEFORE, np.int64)
    last[PAIRS:] = np.arange(BEFORE)
    own = np.flatnonzero(histories["map"] < PAIRS)
    last[histories["map"][own]] = own % BEFORE
    by_last = np.zeros((BEFORE, N_CLASSES))
    np.add.at(by_last, last, counts)
    return last, by_last


def prior_logs(counts: np.ndarray, histories: dict) -> np.ndarray:
    """ln p(class | history), backing off to the last token's context, then to the class alone."""
    last, by_last = by_context(counts, histories)
    alone = (by_last.sum(0) + 1) / (by_last.sum() + N_CLASSES)
    second = (by_last + BACK_OFF * alone) / (by_last.sum(1, keepdims=True) + BACK_OFF)
    return np.log((counts + BACK_OFF * second[last]) / (counts.sum(1, keepdims=True) + BACK_OFF)).astype(np.float32)


BACK_OFF = 20.0


def within_class(pairs: np.ndarray, classes: np.ndarray, place: np.ndarray, counts: np.ndarray, by_class: np.ndarray | None = None):
    """For p(id | class of the id, context), backing off to p(id | class): ln p by (context, place), and for ids
    without a place ln of their share by (context, class) and ln p(id | class). All counts are of the whole corpus;
    ids without a place share by p(id | class) what ``by_class``, the counts of (context, class), has beyond the
    placed ones (without it, column 0 of ``pairs``, dealt to the classes alike)."""
    known, others = np.flatnonzero(place > 0), np.flatnonzero(place == 0)
    alone = counts + 0.1
    alone = alone / np.bincount(classes, weights=alone, minlength=N_CLASSES)[classes]
    placed = np.stack([np.bincount(classes[known], weights=r, minlength=N_CLASSES) for r in pairs[:, place[known]]])
    left = np.bincount(classes[others], weights=alone[others], minlength=N_CLASSES)
    if by_class is None:
        dealt = np.bincount(classes[others], weights=counts[others] + 0.1, minlength=N_CLASSES)
        lump = pairs[:, :1] * (dealt / max(dealt.sum(), 1e-9))
    else:
        lump = by_class - placed
    total = placed + lump + BACK_OFF
    share = (lump + BACK_OFF * left) / total / np.where(left > 0, left, 1)
    table = np.zeros(pairs.shape, np.float32)
    table[:, place[known]] = np.log((pairs[:, place[known]] + BACK_OFF * alone[known]) / total[:, classes[known]])
    return table, np.log(np.maximum(share, 1e-30)).astype(np.float32), np.log(alone).astype(np.float32)


def within_logs(within, contexts, classes, place, inputs, targets):
    table, share, alone = within
    context, at = contexts[inputs], place[targets]
    return np.where(at > 0, table[context, at], share[context, classes[targets]] + alone[targets])


def fit(docs: DataFrame, vocabulary: str = VOCABULARY, sample_docs: int = FIRST):
    """The model, from all training rows (doc_id, text), as plain arrays; ``sample_docs``: how many windows come first."""
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return fit_ids(encoded(docs, Path(vocabulary).read_bytes(), empty), vocabulary, sample_docs)


def fit_ids(rows: DataFrame, vocabulary: str = VOCABULARY, first: int = FIRST):
    """The model, from all windows of the training rows (seed, ids) of ``encoded``, as plain arrays."""
    import sentencepiece

    raw = Path(vocabulary).read_bytes()
    pieces = sentencepiece.SentencePieceProcessor(model_proto=raw)
    width = pieces.get_piece_size() + 2
    begin, end = width - 2, width - 1
    begins_word = np.array([*(pieces.id_to_piece(i).startswith("▁") for i in range(width - 2)), True, True]).astype(np.int64)
    found = survey(rows, begin, end, first, share=0).checkpoint()
    early = found.where("window IS NOT NULL").select("h", "window")
    counts = count_ids(found, width)
    classes = classes_of(counts, begins_word)
    place = np.zeros(width, np.int64)  # the rarer ids share an embedding
    order = np.argsort(-counts, kind="stable")[:EMBEDDED - 1]
    place[order] = np.arange(1, len(order) + 1)
    place[counts == 0] = 0
    place[begin] = EMBEDDED
    contexts = contexts_of(counts, classes)
    histories = histories_of(rows, contexts, begin, end)
    pairs, by_history = count_pairs(rows, classes, contexts, histories, place, begin, end)
    prior = prior_logs(by_history, histories)
    shared = rows.sparkSession.sparkContext.broadcast((classes, place, histories, prior))

    def learn(table):
        classes, place, histories, prior = shared.value
        return train(*read_windows(table.column("window")), classes, place, histories, prior, begin, end)

    p = in_one_task(early.orderBy("h", "window").limit(first), learn)
    windows = survey(rows, begin, end).where("window IS NOT NULL").select("h", "window")
    p = trained_on_all(windows, count_windows(rows), p, classes, place, histories, prior, begin, end)
    return {"vocabulary": raw, "begin": begin, "end": end, "classes": classes, "contexts": contexts, "histories": histories,
            "place": place, "look": tables(p, place), "out": p["out"], "prior": prior + p["outer"],
            "bias": attention_bias(p["distance"]), "within": within_class(pairs, classes, place, counts, by_context(by_history, histories)[1])}


def without_attention(model: dict) -> dict:
    """The model with its attention's values set to zero, to see what they give."""
    query, key, value, direct = model["look"]
    return {**model, "look": (query, key, np.zeros_like(value), direct)}


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all given texts."""
    def run(batches):
        tokenizer, held, n = Tokenizer(SPACED, lower=True), [], 0

        def counted():
            words, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(c)], names=["word", "c"])

        for batch in batches:
            for i, j in slices(batch.column(0)):
                held.append(tokenizer.words(*text_buffers(batch.column(0).slice(i, j - i)))[3])
                n += len(held[-1])
                if n > HELD_WORDS:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()

    return docs.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def heavy_words(counts: DataFrame, most: int | None = None):
    """(words in order, their counts) of the most frequent words, at most ``most`` (HEAVY): those from a power of
    2**(1/16) on. The histogram by that power has a few hundred rows; no task sorts or gathers all words."""
    most = HEAVY if most is None else most
    step = F.floor(F.log2("c") * 16)
    least, total = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        total += r["n"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = counts.where(step >= least).toArrow()
    words = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], top.column("c").to_numpy()[order]


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("heavy_known", T.LongType()), T.StructField("heavy_sum", T.DoubleType()),
          T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("ids", T.BinaryType())]
LIGHT = ["doc_id", "held_out", "row", "n_words", "heavy_known", "heavy_sum"]


def encoded(docs: DataFrame, vocabulary: bytes, heavy) -> DataFrame:
    """doc_id, held_out, row, seed (a hash of the id), the base's sums over heavy words, rare (the other words) and the
    subword ids as two-byte numbers, of (doc_id, text); written to the shared folder once."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, heavy))

    def start():
        model, (words, c) = shared.value
        texts, logs = Texts(model), np.log10(c + 1.0)

        def kernel(data, offsets, batch):
            h, bounds, ids, id_bounds = texts.read(data, offsets)
            rows = len(offsets) - 1
            row = np.repeat(np.arange(rows), np.diff(bounds))
            unique, which = np.unique(h, return_inverse=True)
            place = np.minimum(np.searchsorted(words, unique), max(len(words) - 1, 0))
            known = words[place] == unique if len(words) else np.zeros(len(unique), bool)
            value = np.where(known, logs[place], 0.0) if len(words) else np.zeros(len(unique))
            is_known = known[which]
            rare = np.flatnonzero(~is_known)
            n_rare = np.bincount(row[rare], minlength=rows)
            edges = np.concatenate([[0], np.cumsum(n_rare)]).astype(np.int32)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer((id_bounds * 2).astype(np.int64)), pa.py_buffer(ids.astype(np.uint16))])
            return (np.diff(bounds), np.bincount(row[is_known], minlength=rows), np.bincount(row, weights=value[which], minlength=rows),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(h[rare].view(np.int64))), raw)

        return kernel

    rows = docs.select("doc_id", "text", held_out().alias("held_out"), F.monotonically_increasing_id().alias("row"), F.xxhash64("doc_id").alias("seed"))
    path = scratch_path(spark, f"lm-{uuid.uuid4().hex}")
    append(rows, FIELDS, start, keep=["doc_id", "held_out", "row", "seed"], slice_bytes=2 << 20).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def scored(rows: DataFrame, model: dict) -> DataFrame:
    """The LIGHT columns of ``encoded``'s rows with the model's log10 probability of each text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    source = rows.select(*LIGHT, "ids")
    schema = T.StructType([*(source.schema[c] for c in LIGHT), T.StructField("score", T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            out = [np.zeros(0)]
            for i, j, ids, bounds in id_slices(batch):
                inputs, targets, real, first, block_row = blocks(ids, bounds, m["begin"], m["end"])
                history = two_before(inputs, first, m["begin"], m["histories"])
                ln = class_logs(m["look"], m["out"], m["prior"], m["bias"], inputs, first, m["classes"][targets], history)
                ln = ln + within_logs(m["within"], m["contexts"], m["classes"], m["place"], inputs, targets)
                out.append(np.bincount(block_row, weights=np.where(real, ln, 0).sum(1, dtype=np.float64), minlength=j - i) / np.log(10))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in LIGHT), pa.array(np.concatenate(out))],
                                             names=[*LIGHT, "score"])
        give_back()

    return source.mapInArrow(run, schema)


def score(docs: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    training = rows.where(~held_out())
    counts = word_counts(training).checkpoint()
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = training.count()
    n, v = n_words + ends, n_distinct + (ends > 0)
    part = encoded(rows, Path(vocabulary).read_bytes(), heavy_words(counts))
    model = fit_ids(part.where("NOT held_out"), vocabulary)
    rest = (part.select("row", F.explode("rare").alias("word")).join(counts, "word", "left").groupBy("row")
            .agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_sum"), F.count("c").alias("rare_known")))
    share = float(n + v + 1)
    total = F.col("heavy_sum") + F.coalesce("rare_sum", F.lit(0.0)) + F.log10(F.lit(ends + 1.0)) - F.col("n_tokens") * F.log10(F.lit(share))
    return (scored(part, model).join(rest, "row", "left").withColumn("n_tokens", F.col("n_words") + 1)
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("heavy_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
                    F.lit(n).cast("long").alias("train_tokens"), total.alias("base_score"), "score"))
