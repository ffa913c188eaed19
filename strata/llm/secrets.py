"""Secret scans with one combined deterministic automaton.

Each rule is a head, then a run of at least ``least`` bytes of a tail class. All rules together,
unanchored, are compiled from their regexes to an NFA over bytes, by subset construction to a DFA and
by partition refinement to the smallest one: one array of transitions over byte classes, and for each
state the rules that end there. Text is scanned once for all rules: the bytes of a slice are cut into
lanes that step through the array together in numpy. A lane assumes the start state; where the lane
before it turns out to end in another state, it is run again from that one, until all agree.

Where a rule ends, its own anchored automata (head, and head with the whole tail) give the exact spans:
leftmost, longest, not overlapping within a kind, over the stretch of bytes that the rule can cross.

Defined results: null and empty texts have no spans; equal texts have equal spans; spans are in code
points, end exclusive; spans of different kinds may overlap, and ties in start go by the order of
RULES; an empty table gives no rows; other columns pass through untouched.
"""

from __future__ import annotations

import re
from dataclasses import astuple, dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.arrow import append


@dataclass(frozen=True)
class Rule:
    kind: str
    head: str
    tail: str
    least: int


PEM = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
#: The base rules, then further ones; formats are fixed values.
BASE = (Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 6),
        Rule("access", r"AKIA", r"[A-Z0-9]", 16),
        Rule("hex", r"", r"[0-9a-f]", 24))
RULES = (*BASE,
         Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]", 36),
         Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]", 10),
         Rule("google", r"AIza", r"[0-9A-Za-z_-]", 35),
         Rule("stripe", r"[rs]k_(live|test)_", r"[A-Za-z0-9]", 16),
         Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY", r"-", 5),
         # the key itself: up to its END line; then, for keys cut off before it, what follows the header line
         Rule("pem_block", rf"{PEM}(?:-?[\t\r\n\x20-\x2C\x2E-\x7E])*-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?", r"-", 5),
         Rule("pem_body", PEM, r"[A-Za-z0-9+/=\r\n\\]", 16))

LANE = 512
#: A rule ends in the scan with the first byte of its tail, or with so many if it has no head; the exact
#: spans are held against all that it asks for.
SCANNED = 8


class Nfa:
    """Byte NFA of regexes: edges[state] is a list of (bytes, next), free[state] of next."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def add(self, pattern: str, at: int) -> int:
        """Appends the pattern behind state ``at``; its end state."""
        return self._items(re._parser.parse(pattern), at, False)

    def _bytes(self, at: int, chars: set[int], fold: bool) -> int:
        if not chars or max(chars) > 127:
            raise ValueError("rules are of ASCII characters")
        if fold:
            chars = chars | {ord(chr(c).swapcase()) for c in chars}
        end = self.state()
        self.edges[at].append((frozenset(chars), end))
        return end

    def _items(self, items, at: int, fold: bool) -> int:
        for op, arg in items:
            match str(op):
                case "LITERAL":
                    at = self._bytes(at, {arg}, fold)
                case "IN":
                    chars: set[int] = set()
                    for kind, x in arg:
                        if str(kind) not in ("LITERAL", "RANGE"):
                            raise ValueError(f"class with {kind}")
                        chars.update([x] if str(kind) == "LITERAL" else range(x[0], x[1] + 1))
                    at = self._bytes(at, chars, fold)
                case "SUBPATTERN":
                    at = self._items(arg[3], at, fold or bool(arg[1] & re.I))
                case "BRANCH":
                    end = self.state()
                    for branch in arg[1]:
                        begin = self.state()
                        self.free[at].append(begin)
                        self.free[self._items(branch, begin, fold)].append(end)
                    at = end
                case "MAX_REPEAT":
                    least, most, body = arg
                    for _ in range(least):
                        at = self._items(body, at, fold)
                    if most == re._parser.MAXREPEAT:
                        loop = self.state()
                        self.free[at].append(loop)
                        self.free[self._items(body, loop, fold)].append(loop)
                        at = loop
                    else:
                        end = self.state()
                        for _ in range(most - least):
                            self.free[at].append(end)
                            at = self._items(body, at, fold)
                        self.free[at].append(end)
                        at = end
                case other:
                    raise ValueError(f"no rule may have {other}")
        return at


@dataclass
class Dfa:
    """classes: of each byte; next: state x class, -1 where nothing goes on; accepts: rules (bits) of each state."""
    classes: np.ndarray
    next: np.ndarray
    accepts: np.ndarray

    @cached_property
    def moves(self) -> list[list[int]]:
        return self.next.tolist()


def build(patterns: list[str], tails: list[tuple[str, int]] | None = None) -> Dfa:
    """The smallest automaton that tells for each prefix which patterns end there.

    With ``tails``, a pattern is a head that may begin anywhere, then its tail as often as said; a
    pattern that has begun its tail is the leftmost match and keeps its own later beginnings out.
    """
    nfa = Nfa()
    start = nfa.state()
    ends, heads, rests = [], [], []
    for k, p in enumerate(patterns):
        begin = nfa.state()
        nfa.free[start].append(begin)
        end = nfa.add(p, begin)
        heads.append(frozenset(range(begin, len(nfa.edges))))
        if tails:
            tail, n = tails[k]
            ends.append(nfa.add(f"{tail}{{{n}}}", end))
            nfa.free[nfa.add(f"{tail}+", ends[-1])].append(nfa.state())
            rests.append(frozenset(range(max(heads[-1]) + 1, len(nfa.edges))))
        else:
            ends.append(end)

    def pruned(states: frozenset[int]) -> frozenset[int]:
        for head, rest in zip(heads, rests, strict=False):
            if states & rest:
                states -= head
        return states

    signature: dict[tuple, int] = {}
    sets = sorted({e[0] for edges in nfa.edges for e in edges}, key=sorted)
    classes = np.array([signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256)], np.int64)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(signature))]

    def closure(states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for x in nfa.free[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)

    step: dict[int, list[frozenset[int]]] = {
        s: [closure({x for chars, x in edges if b in chars}) for b in sample] for s, edges in enumerate(nfa.edges) if edges}
    first = pruned(closure({start}))
    known, todo, rows = {first: 0}, [first], []
    while todo:
        now = todo.pop(0)
        row = []
        for c in range(len(sample)):
            to = pruned(frozenset().union(*(step[s][c] for s in now if s in step), *((first,) if tails else ())))
            if not to:
                row.append(-1)
                continue
            if to not in known:
                known[to] = len(known)
                todo.append(to)
            row.append(known[to])
        rows.append(row)
    accepts = np.array([sum(1 << i for i, e in enumerate(ends) if e in states) for states in known], np.int64)
    return smallest(classes, np.array(rows, np.int64), accepts)


def smallest(classes, moves, accepts) -> Dfa:
    """Merges states that no text tells apart, by refining the partition by accepted rules."""
    _, part = np.unique(accepts, return_inverse=True)
    while True:
        seen = np.where(moves >= 0, part[moves], -1)
        _, first, finer = np.unique(np.column_stack([part, seen]), axis=0, return_index=True, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    swap = np.arange(len(first))  # the start state becomes number 0
    swap[[0, finer[0]]] = swap[[finer[0], 0]]
    order = np.argsort(swap)
    seen = np.where(moves >= 0, swap[finer[moves]], -1)
    return Dfa(classes, seen[first][order], accepts[first][order])


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]):
    """The scan of all rules; then for each rule the head, the head with the tail, and the bytes that it can cross."""
    scan = build([r.head for r in rules], [(r.tail, 1 if r.head else min(r.least, SCANNED)) for r in rules])
    own = []
    for r in rules:
        head, whole = build([r.head]), build([f"{r.head}{r.tail}+"])
        crosses = (whole.next >= 0).any(axis=0)[whole.classes]
        own.append((head, whole, crosses))
    return scan, own


def ends(scan: Dfa, data: np.ndarray, offsets: np.ndarray):
    """(byte positions, rules) at which rules end, in one pass over the bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = scan.next.shape[1]
    moves, symbols = scan.next.ravel() * width, scan.classes[data]
    marks = np.arange(LANE, len(data), LANE)
    gaps = np.flatnonzero((data == 0x20) | (data == 0x0A)) + 1
    after = np.append(gaps, len(data))[np.searchsorted(gaps, marks)]
    cuts = np.where(after - marks < LANE // 4, after, marks)
    begin = np.unique(np.concatenate([cuts[cuts < len(data)], offsets[:-1][np.diff(offsets) > 0]]))
    length = np.diff(np.append(begin, len(data)))
    fresh = np.isin(begin, offsets)  # a row begins here: always in the start state
    used, last = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    found: dict[int, list[tuple[int, int]]] = {}
    todo = np.arange(len(begin))
    flags = scan.accepts != 0
    while len(todo):
        todo = todo[np.argsort(-length[todo], kind="stable")]
        state, at, left = used[todo] * width, begin[todo], length[todo]
        hits: dict[int, list[tuple[int, int]]] = {}
        running = len(todo)
        for t in range(int(left[0])):
            while left[running - 1] <= t:
                running -= 1
            state[:running] = moves[state[:running] + symbols[at[:running] + t]]
            hit = flags[state[:running] // width]
            if hit.any():
                for x in np.flatnonzero(hit):
                    hits.setdefault(int(todo[x]), []).append((int(at[x]) + t, int(scan.accepts[state[x] // width])))
        for lane in todo:
            found.pop(int(lane), None)
        found.update(hits)
        last[todo] = state // width
        came = np.where(fresh, 0, np.concatenate([[0], last[:-1]]))
        todo = np.flatnonzero(came != used)
        used[todo] = came[todo]
    pairs = sorted(p for v in found.values() for p in v)
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def longest(dfa: Dfa, symbols: list[int], moves: list[list[int]], at: int, end: int) -> int:
    """Where the longest match from ``at`` ends, or -1."""
    state, best = 0, at if dfa.accepts[0] else -1
    while at < end:
        state = moves[state][symbols[at]]
        if state < 0:
            break
        at += 1
        if dfa.accepts[state]:
            best = at
    return best


def exact(rule: Rule, own, text: np.ndarray, a: int, z: int) -> list[tuple[int, int]]:
    """Spans of the rule within bytes a to z, which no match crosses: leftmost, longest, not overlapping."""
    head, whole, _ = own
    part = text[a:z]
    s_head, s_whole = head.classes[part].tolist(), whole.classes[part].tolist()
    begins = (whole.next[0] >= 0)[whole.classes[part]]  # no match begins elsewhere
    out, p = [], 0
    for begin in np.flatnonzero(begins).tolist():
        if begin < p:
            continue
        end = longest(whole, s_whole, whole.moves, begin, z - a)
        if end <= begin:
            continue
        if end - longest(head, s_head, head.moves, begin, end) >= rule.least:
            out.append((a + begin, a + end))
        p = end
    return out


def spans_of(rules, scan, own, data, offsets) -> dict[int, list[tuple[int, int, int]]]:
    """Row -> (start, end, rule number) in code points, sorted."""
    at, which = ends(scan, data, offsets)
    out: dict[int, list[tuple[int, int, int]]] = {}
    done: dict[tuple[int, int], int] = {}
    rows = np.searchsorted(offsets, at, "right") - 1
    texts: dict[int, tuple] = {}
    for p, mask, row in zip(at.tolist(), which.tolist(), rows.tolist(), strict=True):
        first = int(offsets[row])
        if row not in texts:
            texts = {row: (data[first:int(offsets[row + 1])], {})}  # hits come in order: one row at a time
        text, edges = texts[row]
        for k, rule in enumerate(rules):
            if not mask >> k & 1 or done.get((row, k), -1) >= p - first:
                continue
            if k not in edges:
                edges[k] = np.flatnonzero(~own[k][2][text])
            i = int(np.searchsorted(edges[k], p - first))
            a = int(edges[k][i - 1]) + 1 if i else 0
            z = int(edges[k][i]) if i < len(edges[k]) else len(text)
            done[row, k] = z
            out.setdefault(row, []).extend((s, e, k) for s, e in exact(rule, own[k], text, a, z))
    for row, found in out.items():
        text = data[int(offsets[row]):int(offsets[row + 1])]
        points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
        out[row] = sorted((int(points[s]), int(points[e]), k) for s, e, k in found)
        out[row].sort(key=lambda x: (x[0], x[2], x[1]))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))


def _shared(docs: DataFrame, rules):
    """Broadcast of the rules and automata as plain tuples and arrays, which workers read without this module."""
    scan, own = compiled(rules)
    return docs.sparkSession.sparkContext.broadcast(
        ([astuple(r) for r in rules], astuple(scan), [(astuple(h), astuple(w), c) for h, w, c in own]))


def _opened(shared):
    rules, scan, own = shared.value
    return [Rule(*r) for r in rules], Dfa(*scan), [(Dfa(*h), Dfa(*w), c) for h, w, c in own]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``secret_spans``: (kind, start, end) by start, then by the order of the rules."""
    shared = _shared(docs, tuple(rules))

    def start():
        rules, automaton, own = _opened(shared)

        def kernel(data, offsets, batch):
            found = spans_of(rules, automaton, own, data, offsets)
            return [[[{"kind": rules[k].kind, "start": s, "end": e} for s, e, k in found.get(row, ())]
                     for row in range(len(offsets) - 1)]]

        return kernel

    return append(docs, [T.StructField("secret_spans", SPANS)], start, text, slice_bytes=4 << 20)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by <KIND>; of overlapping spans, the first gives the name. Null stays null."""
    shared = _shared(docs, tuple(rules))

    def start():
        rules, automaton, own = _opened(shared)

        def kernel(data, offsets, batch):
            column = batch.column(batch.schema.get_field_index(text))
            found = spans_of(rules, automaton, own, data, offsets)
            if not found:
                return [column]
            values = column.to_pylist()
            for row, spans in found.items():
                parts, at = [], 0
                for s, e, k in spans:
                    if s >= at:
                        parts += [values[row][at:s], f"<{rules[k].kind.upper()}>"]
                    at = max(at, e)
                values[row] = "".join([*parts, values[row][at:]])
            return [pa.array(values, column.type)]

        return kernel

    out = append(docs, [T.StructField("redacted_text", T.StringType())], start, text, slice_bytes=4 << 20)
    return out.withColumn(text, F.col("redacted_text")).select(*docs.columns)


def digest(kinds: list[str] | None = None, spans: str = "secret_spans"):
    """kind:start:end of the spans (of these kinds), comma-joined."""
    own = F.filter(spans, lambda x: x["kind"].isin(kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count(kind: str, spans: str = "secret_spans"):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
