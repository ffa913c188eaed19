"""Fingerprints (12), alignment (11) and hard negatives (13) against SQL or plain Python, on odd rows and empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import align, hard_negatives, merkle, queries

from .conftest import ODD, PROSE
from .test_operators import SMALL, spark_rows, sql_rows


@pytest.fixture
def run(monkeypatch):
    def go(name, **tables):
        monkeypatch.setattr(queries, "table", lambda spark, sf_dir, t: tables[t])
        return queries.QUERIES[name](next(iter(tables.values())).sparkSession, "")
    return go


# 12 ───────────────────────────────────────────────────────────────────────

def test_fingerprints_equal_the_sql(spark, run, frame):
    text = "one line, of some words that go on.\nanother line here\n\na new section; with one line\n\n\n\nlast"
    docs = frame([*[(i, t) for i, t in ODD if i is not None], (40, text), (41, text.replace("another", "some other")), (42, "日本語。のテキスト" * 60)])
    assert spark_rows(run("op12_fingerprints", documents=docs)) == sql_rows(queries.op12_sql(), documents=docs)


def test_fingerprints_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = queries.QUERIES["op12_fingerprints"](spark, SMALL)
    assert spark_rows(got) == sql_rows(queries.op12_sql(), documents=docs)
    near = got.agg(F.avg("near_edited"), F.expr("percentile(near_next, 0.9)")).first()
    assert near[0] > 0.6 and near[1] < 0.1


def test_next_of_every_row_for_any_number_of_buckets(frame):
    pairs = [(k * 3 % 101, f"text {k}") for k in range(101)] + [(None, "none"), (None, None), (7, "again"), (7, "again")]
    order = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or ""))
    want = sorted(((i, t, order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)), key=repr)
    for buckets in (1, 4, 60):
        got = merkle.with_next(frame(pairs), buckets=buckets).select("doc_id", "text", "next_text").collect()
        assert sorted((tuple(r) for r in got), key=repr) == want


def test_next_of_small_tables(frame):
    rows = lambda pairs: [tuple(r) for r in merkle.with_next(frame(pairs)).select("doc_id", "next_text").collect()]
    assert rows([]) == []
    assert rows([(5, "only")]) == [(5, "only")]
    assert rows([(None, "a")]) == [(None, "a")]
    assert sorted(rows([(1, "a"), (2, None)])) == [(1, ""), (2, "a")]


def test_likeness_and_changes(spark):
    a = "first section, line one is here.\nline two of it\n\nsecond section has this line\nand a second line that stays"
    b = a.replace("line two of it", "line two was changed")
    made = spark.createDataFrame([(a, a), (a, b), (b, a), (a, ""), ("", ""), ("", None), (a, PROSE)], "a string, b string").select(
        "a", merkle.fingerprint(F.col("a")).alias("x"), merkle.fingerprint(F.col("b")).alias("y"))
    got = made.select(merkle.likeness(F.col("x"), F.col("y")).alias("near"), merkle.changes(F.col("x"), F.col("y")).alias("at")).collect()
    assert [r["near"] for r in got[:1]] == [1.0] and 0.5 < got[1]["near"] < 1.0 and got[1]["near"] == got[2]["near"]
    assert [r["near"] for r in got[3:]] == [0.0, 1.0, 1.0, 0.0]
    assert [tuple(x) for x in got[0]["at"]] == [] and [tuple(x) for x in got[1]["at"]] == [(0, 1)]
    assert len({r["x"] for r in made.collect()}) == 3


def test_pieces_lose_nothing():
    for _, text in ODD:
        for line in (text or "").split("\n"):
            assert "".join(re.findall(merkle.PIECE, line)) == line


# 11 ───────────────────────────────────────────────────────────────────────

def aligned(rows):
    """(id, n_a, n_b, links, best, sum, digest) by encoding every text as a whole with the libraries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    with open(align.A_FILE, "rb") as f:
        given = f.read()
    a_model, b_model = Tokenizer.from_str(given.decode()), SentencePieceProcessor(model_file=align.B_FILE)
    a_model.encode_special_tokens = True
    bytes_a, bytes_b = align.token_bytes_a(given), align.token_bytes_b(b_model)
    each, total = [], collections.Counter()
    for i, text in rows:
        a, b, links, groups = [], [], [], []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            whole = (" " + text).encode()
            if b"".join(bytes_a[k] for k in a) != whole or b"".join(bytes_b[k] for k in b) != whole:
                a, b = [], []
        ends_b = dict(zip(np.cumsum([len(bytes_b[k]) for k in b]).tolist(), range(len(b)), strict=True))
        last_a = last_b = 0
        for k, end in enumerate(np.cumsum([len(bytes_a[x]) for x in a]).tolist()):
            if end in ends_b:
                m = ends_b[end]
                links.append((a[k], b[m]))
                groups.append(",".join(map(str, a[last_a:k + 1])) + "|" + ",".join(map(str, b[last_b:m + 1])))
                last_a, last_b = k + 1, m + 1
        total.update(links)
        each.append((i, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = collections.Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return sorted(((i, n_a, n_b, len(x), len(x), sum(total[p] == most[p[1]] for p in x), sum(total[p] for p in x), digest)
                   for i, n_a, n_b, x, digest in each), key=repr)


PARTS = ["a", "b", "The", " ", "  ", "\n", " \n", "\t", " ", " ", "　", "é", "日本", "😀", "▁", "'s", "'ll", "1", "23", ".", "...", "<s>",
         "</s>", "<0x41>", "<|endoftext|>", "\x1c", "́", "x" * 50, "​", "\r\n", "ﬁ", "K"]


def test_alignment_of_odd_texts(frame, run):
    random.seed(11)
    rows = [(k, "".join(random.choices(PARTS, k=random.randint(1, 12)))) for k in range(1500)] + ODD
    got = run("op11_alignment", documents=frame(rows))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == aligned(rows)


def test_alignment_of_the_small_table_by_broadcast_and_by_join(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    want = aligned([tuple(r) for r in docs.collect()])
    n = F.size("links").cast("long")
    for most in (align.MOST_SHARED, 0):
        got = align.corpus_links(docs, keep=["doc_id"], most_shared=most)
        got = got.select("doc_id", "n_a", "n_b", n.alias("n_groups"), n.alias("n_links"), "n_best", "count_sum", "groups_sha256")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_alignment_of_no_rows(frame):
    assert align.corpus_links(frame([]), keep=["doc_id"]).count() == 0


def test_windows_with_equal_hashes_are_told_apart(monkeypatch):
    with open(align.A_FILE, "rb") as a, open(align.B_FILE, "rb") as b:
        voc = align.Vocabularies(a.read(), b.read())
    texts = ["the cat sat", "a cat sat on the mat", "other words, here", "the the cat"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    plain = align.aligned(voc)(data, offsets, None)
    monkeypatch.setattr(align, "run_hashes", lambda ids, first, last: np.zeros(len(first), np.uint64))
    collided = align.aligned(voc)(data, offsets, None)
    assert plain[3] == collided[3] and plain[2].to_pylist() == collided[2].to_pylist()


# 13 ───────────────────────────────────────────────────────────────────────

VECTORS = "vec_id long, embedding array<float>, label int, score double, ints string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], VECTORS)


def random_rows(n, seed, values=None):
    r = np.random.default_rng(seed)
    found = r.choice(values, (n, 8)) if values is not None else r.normal(size=(n, 8)) / 3
    return [(k, [float(np.float32(x)) for x in v], int(r.integers(0, 10))) for k, v in enumerate(found)]


@pytest.mark.parametrize("rows", [random_rows(400, 1), random_rows(300, 2, [0.0, 0.25, 0.5]),
                                  random_rows(200, 3) + [(k, [0.3] * 8, 1) for k in range(200, 400)], []])
def test_hard_negatives_equal_the_sql(spark, run, rows):
    given = vectors(spark, rows)
    assert spark_rows(run("op13_hard_negatives", embeddings=given)) == sql_rows(queries.op13_sql(), embeddings=given)


def test_rows_that_take_no_part(spark, run):
    rows = random_rows(150, 4)
    odd = [(None, [0.1] * 8, 1), (1000, None, 1), (1050, [0.1] * 8, None), (1100, [0.1] * 7 + [None], 2), (1150, [float("nan")] * 8, 2),
           (1200, [float("inf")] + [0.1] * 7, 3), (50, rows[50][1], rows[50][2]), (51, rows[51][1], rows[51][2])]
    given = vectors(spark, rows + odd)
    assert spark_rows(run("op13_hard_negatives", embeddings=given)) == sql_rows(queries.op13_sql(), embeddings=given)


def test_small_trees_and_many_parts_give_the_same_rows(spark):
    rows = hard_negatives.quantised(vectors(spark, random_rows(500, 5)))
    many = hard_negatives.mine(rows, F.col("id") % 50 == 0, part_rows=60, tree_rows=48)
    assert spark_rows(many) == spark_rows(hard_negatives.mine(rows, F.col("id") % 50 == 0)) != []


def test_large_components_and_unequal_lengths(spark):
    r = random.Random(6)
    rows = [(k, [r.uniform(-1, 1) * 10 ** r.randint(0, 6) for _ in range(r.randint(0, 9))], k % 3) for k in range(200)]
    given = vectors(spark, rows)
    quantised = hard_negatives.quantised(given)
    held = [(x["id"], x["label"], x["ints"]) for x in quantised.collect()]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    want = []
    for i, label, v in held:
        if i % 50:
            continue
        scored = sorted((-dot(v, w), j, other) for j, other, w in held)
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:5]:
            inside = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            want += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(inside)]
    got = hard_negatives.mine(quantised, F.col("id") % 50 == 0)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) != []


def test_tiles_and_boxes():
    rows = np.random.default_rng(7).integers(-50, 50, (1000, 5))
    order = hard_negatives.tiled(rows, [0, 1, 2])
    assert sorted(order.tolist()) == list(range(1000))
    spread = lambda x: sum(np.ptp(x[k:k + 32, :3], axis=0).sum() for k in range(0, 1000, 32))
    assert spread(rows[order]) < 0.7 * spread(rows)
    boxes, query = hard_negatives.Boxes(rows, rows, 32), np.array([3, -2, 0, 7, -1])
    low, high = boxes.interval(np.maximum(query, 0), np.minimum(query, 0))
    inner = np.split(rows @ query, range(32, 1000, 32))
    assert all(low[k] <= x.min() and x.max() <= high[k] for k, x in enumerate(inner))
