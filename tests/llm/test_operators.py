"""Every operator against a brute-force version, on odd rows, small tables and empty tables."""

import collections
import hashlib
import random
import re
import string
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check_oracle import rows_of as comparable
from strata.llm import (chat, decontaminate, licenses, lm, ngram_join, pieces, quality, queries, secrets, sharding, toxicity)
from strata.llm.components import components
from strata.llm.words import ALNUM, Tokenizer

from .conftest import ODD, PROSE

SMALL = "/root/testdata/sf0.001"
ASCII = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def lower(t):
    return (t or "").translate(ASCII)


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"{name}_arrow", df.toArrow())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_arrow")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return comparable(names, cur.fetchall())


def spark_rows(df):
    return comparable(df.columns, [tuple(r) for r in df.collect()])


@pytest.fixture
def run(monkeypatch):
    """A registered query over given tables."""
    def go(name, **tables):
        monkeypatch.setattr(queries, "table", lambda spark, sf_dir, t: tables[t])
        return queries.QUERIES[name](next(iter(tables.values())).sparkSession, "")
    return go


# 1 ────────────────────────────────────────────────────────────────────────

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return found + [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]


def test_secret_automaton_is_exact_on_random_texts():
    rnd, parts = random.Random(5), ["token", "Secret", "api_key", "PASSWORD", "passwd", "=", ":", "==", "\"", "'", " ", "abc123", "AKIA", "AKIA" + "Z9" * 8,
                                    "deadbeef" * 3, "0a1b2c", "é", "日本", "\n", ",", "word ", "f" * 40, "ghp_" + "a1" * 18, "tok", "en="]
    scan, own = secrets.compiled(secrets.RULES)
    for _ in range(150):
        texts = ["".join(rnd.choice(parts) for _ in range(rnd.choice([0, 1, 5, 30, 400]))) for _ in range(5)]
        data = [t.encode() for t in texts]
        offsets = np.cumsum([0] + [len(d) for d in data])
        got = secrets.spans_of(secrets.RULES, scan, own, np.frombuffer(b"".join(data), np.uint8), offsets)
        for i, t in enumerate(texts):
            assert sorted((a, z, secrets.RULES[k].kind) for a, z, k in got.get(i, []) if k < 3) == sorted(base_spans(t))


def test_secrets_query_and_redaction(odd, run):
    assert spark_rows(run("op1_secrets", documents=odd)) == sql_rows(queries.op1_sql(), documents=odd)
    clean = {r["doc_id"]: r for r in secrets.redact(odd.select("doc_id", "text", "source")).collect()}
    assert clean[11]["text"].startswith("<ASSIGN>, <ASSIGN>' <ACCESS> <HEX>")
    assert clean[1]["text"] is None and clean[9]["text"] == dict(ODD)[9]
    assert run("op1_secrets", documents=odd.limit(0)).count() == 0


def test_redaction_takes_the_whole_private_key(frame, run):
    rnd = random.Random(3)
    body = ["".join(rnd.choice(string.ascii_letters + string.digits + "+/") for _ in range(64)) for _ in range(12)] + ["Qx9+/w=="]
    key = lambda name="RSA ", mark="", end="\n", head=(): end.join(mark + x for x in (
        f"-----BEGIN {name}PRIVATE KEY-----", *head, *body, f"-----END {name}PRIVATE KEY-----"))
    whole = [key(), key("", "# "), key("EC ", "    ", "\r\n"), key("", end="\\n"), key(head=("Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B", ""))]
    rows = [(k, f"before it\n{t}\nafter - it, {'x ' * 400}é") for k, t in enumerate(whole)]
    rows += [(10, f"{key()}\nbetween them\n{key('EC ')}\nend"), (11, "\n".join(["cut off", *key().split("\n")[:9]])), (12, "-----BEGIN PRIVATE KEY----- is a header line"),
             (13, "-----BEGIN PUBLIC KEY-----\n" + "word " * 300)]
    docs = frame(rows)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs.select("doc_id", "text")).collect()}
    assert not [i for i, t in clean.items() for line in body if line in t]
    for k in range(len(whole)):
        assert clean[k].strip("# ").replace("# <", "<").replace("    <", "<") == f"before it\n<PEM>\nafter - it, {'x ' * 400}é"
    assert clean[10] == "<PEM>\nbetween them\n<PEM>\nend" and clean[11] == "cut off\n<PEM>"
    assert clean[12] == "<PEM> is a header line" and clean[13] == dict(rows)[13]
    assert spark_rows(run("op1_secrets", documents=docs)) == sql_rows(queries.op1_sql(), documents=docs)


def test_smallest_automaton_merges_states():
    assert len(secrets.build(["abc|abd|xbc|xbd"]).next) == 4


# 2 ────────────────────────────────────────────────────────────────────────

def test_licenses(frame, run):
    mit = dict(reversed(licenses.TEMPLATES))["MIT"]
    docs = frame([*ODD, (30, f"{PROSE}\nLicensed under the Apache License, Version 2.0.\n{PROSE}"), (31, "released  under the *MIT* license"),
                  (32, "Permission\n" + max((t for i, t in licenses.TEMPLATES if i == "MIT"), key=len) + " extra words"), (33, mit + mit)])
    got = {r["doc_id"]: r for r in run("op2_licenses", documents=docs).collect()}
    assert got[30]["licenses"] == "Apache-2.0" and got[30]["best_dice"] == 1.0
    assert got[31]["licenses"] == "MIT" and got[32]["licenses"] == "MIT" and got[4]["licenses"] == "" and got[1]["best_license"] is None
    assert spark_rows(run("op2_licenses", documents=docs)) == sql_rows(queries.op2_sql(), documents=docs)
    assert run("op2_licenses", documents=docs.limit(0)).count() == 0


def test_licenses_within_a_text(frame, run):
    texts = {i: max((t for k, t in licenses.TEMPLATES if k == i), key=len) for i in ("MIT", "GPL-3.0")}
    mit = f"MIT License Copyright (c) 2020 Some One {texts['MIT']} THE SOFTWARE IS PROVIDED AS IS {PROSE} {PROSE} {PROSE}".split()
    header = f"{PROSE} {texts['GPL-3.0']} This program is distributed in the hope that it will be useful {PROSE} {PROSE}".split()
    block = lambda mark, w: "\n".join(mark + " ".join(w[k:k + 9]) for k in range(0, len(w), 9))
    rows = [*ODD, (30, block(" * ", mit)), (31, block("# ", header)), (32, f"{PROSE}. Licensed under the Apache License, Version 2.0. {PROSE}"),
            (33, " ".join(texts["MIT"].split()[:30]) + f" {PROSE}"), (34, f"{PROSE} Released under the MIT License")]
    docs = frame(rows)
    got = {r["doc_id"]: r for r in run("op2_license_windows", documents=docs).collect()}
    assert [got[k]["licenses"] for k in (30, 31, 32, 33, 34)] == ["MIT", "GPL-3.0", "Apache-2.0", "", "MIT"]
    assert got[30]["best_dice"] > 0.95 and got[32]["best_dice"] == 1.0 and got[1]["best_license"] is None and got[2]["licenses"] == "" and len(got) == len({i for i, _ in rows})
    parts = {r["doc_id"]: r["licenses"] for r in run("op2_licenses", documents=docs).collect()}
    assert all(set(filter(None, x.split(","))) <= set(got[k]["licenses"].split(",")) for k, x in parts.items())


# 3 ────────────────────────────────────────────────────────────────────────

CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b <|turn|> [INST]"), (1, 1, "assistant", "a\\b <|turn|> [INST]"), (2, None, None, None),
         (2, 5, "assistant", ""), (None, 0, "assistant", "x" * 1000), (3, 1, "user", "</s>"), (3, 0, "sys\ntem", "é😀\n" * 200), (4, 0, "assistant", None)]


def test_chat(spark, run):
    chats = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("message", F.lit(1)).withColumn("seq", F.lit("x"))
    got = run("op3_chat", conversations=chats)
    assert spark_rows(got) == sql_rows(queries.op3_sql(), conversations=chats)
    trap = next(r for r in got.collect() if r["conv_id"] == -1)
    assert trap["n_turns"] == 2 and trap["loss_sha256"] == hashlib.sha256(queries.TRAP.encode()).hexdigest()
    assert run("op3_chat", conversations=chats.limit(0)).count() == 1


def test_events_fold(spark):
    log = [(1, 1, 0, "open", "user", None), (1, 1, 2, "delta", None, "b"), (1, 1, 1, "delta", None, "a"), (1, 1, 3, "edit", None, "new"), (1, 1, 4, "delta", None, "!"),
           (1, 2, 0, "open", "assistant", None), (1, 2, 1, "delta", None, "bad"), (1, 2, 2, "regenerate", None, None), (1, 2, 3, "delta", None, "good"),
           (1, 3, 0, "open", "user", None), (1, 3, 1, "delta", None, "gone"), (1, 3, 2, "delete", None, None)]
    events = spark.createDataFrame([(c, m, m, s, k, r, b) for c, m, s, k, r, b in log], "conv_id long, message long, turn long, seq long, kind string, role string, body string")
    shown = chat.render(chat.fold(events))
    r = shown.select("formatted", chat.read_back().alias("turns"), chat.loss_texts().alias("loss")).first()
    assert [tuple(t) for t in r["turns"]] == [("user", "new!"), ("assistant", "good")] and r["loss"] == ["good"]
    assert r["formatted"] == "<|turn|>user<|text|>new!<|end|>\n<|turn|>assistant<|text|>good<|end|>\n"


# 4 ────────────────────────────────────────────────────────────────────────

def shingles(t, size=5):
    w = spaced(lower(t))
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    rows = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = [(i, s) for i, s in rows if i is not None and s]
    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    named = {s: find(i) for i, s in own}
    return sorted(((i, len(s), find(i) if i is not None else named.get(s)) for i, s in rows), key=repr)


def near_copies(seed=1, groups=12, of=14):
    rnd, out = random.Random(seed), []
    for g in range(groups):
        words = [f"g{rnd.randint(0, 60)}" for _ in range(rnd.randint(5, 90))]
        for _ in range(of):
            w = list(words)
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
            out.append((len(out), " ".join(w)))
    return out


@pytest.mark.parametrize("weight", [None, 1500])
def test_ngram_join_is_exact(frame, monkeypatch, weight):
    if weight:
        monkeypatch.setattr(ngram_join, "PART_WEIGHT", weight)  # families of several blocks
    rows = near_copies()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(frame(rows)).collect()), key=repr)
    assert got == brute_components(rows)


def test_ngram_join_odd_rows(odd, run):
    got = sorted((tuple(r) for r in run("op4_ngram_join", documents=odd).collect()), key=repr)
    assert got == brute_components(ODD)
    assert run("op4_ngram_join", documents=odd.limit(0)).count() == 0


def brute_links(rows):
    rows = [(i, shingles(t)) for i, t in rows]
    own = [(i, s) for i, s in rows if i is not None and s]
    out = []
    for i, s in rows:
        equal = [k for k, x in own if x == s]
        n = sum(100 * len(s & x) >= 75 * len(s | x) for _, x in own)
        out.append((i, len(s), min(equal), len(equal), n - (i is not None)) if equal else (i, len(s), i, *((1, 0) if i is not None and not s else (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("weight", [None, 1500])
def test_ngram_links_are_counted_exactly(frame, monkeypatch, run, weight):
    if weight:
        monkeypatch.setattr(ngram_join, "PART_WEIGHT", weight)
    near = near_copies(groups=6)
    rows = [*near, *((500 + i, t) for i, t in near[:20]), (3, near[40][1]), (None, near[5][1]), *(r for r in ODD if r[0] != 9)]
    got = sorted((tuple(r) for r in run("op4_ngram_links", documents=frame(rows)).collect()), key=repr)
    assert got == brute_links(rows) and max(r[4] or 0 for r in got) > 10


def test_signature_tree_finds_all_pairs():
    rnd = random.Random(3)
    sets = [np.array(sorted(rnd.sample(range(60), rnd.randint(1, 30))), np.int64) for _ in range(120)] + [np.arange(40, dtype=np.int64) + k for k in range(30)]
    bits, size = ngram_join.bitmaps(sets)
    tree = ngram_join.Tree(bits, size, np.arange(len(sets)))
    got = set(zip(*(x.tolist() for x in ngram_join.dual_walk(tree, tree, True)), strict=True))
    want = {(i, j) for j in range(len(sets)) for i in range(j)
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert got == want and len(want) > 20


def test_components_of_a_chain(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).unionAll(spark.createDataFrame([(1000, 1001), (None, 5)], "a long, b long"))
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 300)}, 1001: 1000}


# 5 ────────────────────────────────────────────────────────────────────────

def test_toxicity(frame, spark, odd, run):
    rnd = random.Random(2)
    syllables = ["ka", "lo", "mi", "ren", "tas", "vo", "du", "pel"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    rows, labels = [], []
    for i in range(400):
        w, bad = [word() for _ in range(rnd.randint(20, 300))], i % 8 == 0
        if bad:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(["zxgrub", "zxgrubber", "qwarfle", "Qwarfled"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    labels = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    docs = frame([*rows, (900, None), (901, "")])
    got = {r["doc_id"]: r for r in run("op5_toxicity", documents=docs, labels=labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in held) for i in range(400))
    assert np.mean([got[i]["predicted"] == (i % 8 == 0) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["score"] == got[901]["score"] and not got[900]["predicted"]
    model = toxicity.fitted(docs, labels)
    clean = next(t for i, t in rows if i in held and i % 8)
    unseen = [r["toxicity"] for r in toxicity.score(frame([(1, f"{clean} zxgrubb"), (2, clean)]).drop("toxicity"), model).orderBy("doc_id").collect()]
    assert unseen[0] > 5 * unseen[1]
    none = run("op5_toxicity", documents=odd, labels=labels.limit(0)).collect()
    assert len(none) == len(ODD) and all(r["score"] < 1e-6 for r in none)
    assert run("op5_toxicity", documents=odd.limit(0), labels=labels).count() == 0


# 6 ────────────────────────────────────────────────────────────────────────

def test_decontamination(spark, frame, run, odd):
    rnd = random.Random(4)
    items = [(k, " ".join(rnd.choice(["Aa", "bb", "cc-", "dd", "é"]) for _ in range(n))) for k, n in enumerate([1, 3, 12, 13, 14, 40, 40])]
    items += [(7, PROSE), (8, PROSE), (8, "one"), (9, None), (None, "lazy dog"), (10, "...")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(1))
    rows = [*ODD, (20, f"x {items[5][1]} y"), (21, items[4][1]), (22, " ".join(t or "" for _, t in items)), (23, f"{PROSE} {PROSE}")]
    docs = frame(rows)
    want = sql_rows(queries.op6_sql("(SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL)"), documents=docs, benchmark=benchmark)
    got = run("op6_decontaminate", documents=docs, benchmark=benchmark).where("doc_id IS NOT NULL").distinct()
    assert spark_rows(got) == want
    blocks = decontaminate.verdicts(decontaminate.mark(docs.select("doc_id", "text"), benchmark, block_bytes=200)).drop("text").where("doc_id IS NOT NULL").distinct()
    assert spark_rows(blocks) == want
    assert run("op6_decontaminate", documents=odd.limit(0), benchmark=benchmark).count() == 0
    assert run("op6_decontaminate", documents=odd, benchmark=benchmark.limit(0)).where("contaminated").count() == 0


def test_word_spans_match_a_regex():
    for t in [x for _, x in ODD if x]:
        data = np.frombuffer(t.encode(), np.uint8)
        s, e = Tokenizer(ALNUM, lower=True).spans(data, np.array([0, len(data)]))
        assert [lower(t).encode()[a:z].decode() for a, z in zip(s, e, strict=True)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


# 7 ────────────────────────────────────────────────────────────────────────

@pytest.fixture(scope="module")
def unigram():
    names, scores, plain, byte_id = pieces.read_model(pieces.MODEL)
    known = {names[i]: int(i) for i in np.flatnonzero(plain)}
    return names, scores, known, byte_id, pieces.double_array(known)


def best_score(t, names, scores, known, byte_id, unknown):
    data = (" " + t).encode() if t else b""
    sizes = pieces.char_sizes(np.frombuffer(data, np.uint8)).tolist()
    best = [0.0] + [-np.inf] * len(data)
    for i in range(len(data)):
        covered = False
        for j in range(i + 1, min(len(data), i + 48) + 1) if best[i] > -np.inf else ():
            if data[i:j] in known:
                covered |= j == i + sizes[i]
                best[j] = max(best[j], best[i] + scores[known[data[i:j]]])
        if best[i] > -np.inf and not covered:
            best[i + sizes[i]] = max(best[i + sizes[i]], best[i] + unknown)
    return best[-1]


def test_sentencepiece(odd, run, unigram, frame):
    names, scores, known, byte_id, trie = unigram
    unknown = pieces.Encoder(trie, scores, byte_id).unknown
    rnd = random.Random(3)
    bits = ["the ", "  ", "word", "日本", "é", "▁", "\n", "😀", "token", "x" * 300, " ", "<s>", "1234", "\t", "ß", "́"]
    rows = [(100 + k, "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 3, 20])))) for k in range(60)]
    docs = frame([*ODD, *rows])
    got = run("op7_sentencepiece", documents=docs).collect()
    assert all(r["exact"] for r in got) and len(got) == len(ODD) + 60
    texts, fallback = dict(rows), set(byte_id.tolist())
    for r in got:
        if r["doc_id"] in texts:
            ids, t = r["token_ids"], texts[r["doc_id"]]
            bytes_of = b"".join(names[i] for i in ids if i in fallback)
            total = sum(scores[i] for i in ids if i not in fallback) + unknown * len(bytes_of.decode())
            assert total == pytest.approx(best_score(t, names, scores, known, byte_id, unknown))
            assert r["n_byte_tokens"] == len(bytes_of)
    assert run("op7_sentencepiece", documents=odd.limit(0)).count() == 0


def test_decode_odd_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [None, -5, 10**6, 1, 2]), (4, [3 + 0xFF])], "k long, token_ids array<int>")
    assert [r["decoded"] for r in pieces.decode(rows).orderBy("k").collect()] == ["", "", "", "�"]


def test_double_array_holds_exactly_the_pieces(unigram):
    base, check, piece = unigram[4]
    for data, number in list(unigram[2].items())[::50]:
        state = 0
        for b in data:
            step = base[state] + b
            assert check[step] == state
            state = step
        assert piece[state] == number
    assert (piece >= 0).sum() == len(unigram[2])


# 8 ────────────────────────────────────────────────────────────────────────

def brute_quality(t):
    w = spaced(t)
    seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if spaced(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(odd, run, frame):
    got = run("op8_quality", documents=odd).collect()
    key = lambda r: (str(r["doc_id"]), *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))
    assert sorted(map(key, got)) == sorted((str(i), *brute_quality(t)) for i, t in ODD)
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in got)
    assert not any(r["kept"] for r in got if r["base_failed"])
    rnd = random.Random(1)
    good = [(i, " ".join(rnd.choice(["house", "river", "garden", "people", "often", "water", "light", "green", "walk", "stone"]) + rnd.choice(["", "s"]) for _ in range(200))) for i in range(60)]
    junk = [(100 + i, " ".join("".join(rnd.choice("xzqjkv") for _ in range(8)) for _ in range(200))) for i in range(5)]
    kept = {r["doc_id"]: r["kept"] for r in run("op8_quality", documents=frame(good + junk)).collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in junk)
    assert run("op8_quality", documents=odd.limit(0)).count() == 0


def test_vocabulary_matches_the_library(odd):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=quality.VOCABULARY)
    for r in quality.measure(odd.select("doc_id", "text").where("doc_id IN (4, 7, 10, 11)")).collect():
        ids = [i for w in spaced(r["text"]) for i in sp.encode(w)]
        assert r["n_tokens"] == len(ids) and r["n_byte_tokens"] == sum(sp.is_byte(i) for i in ids)


# 9 ────────────────────────────────────────────────────────────────────────

@pytest.mark.parametrize("shards", [16, 3])
def test_sharding(frame, shards):
    rows = [(i, "abc " * (i % 37)) for i in range(500)] + [(1000 + i, "hot text") for i in range(300)] + ODD
    got = sharding.assign(frame(rows), shards).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in got)


def test_sharding_query(odd, run, tmp_path, spark):
    got = run("op9_sharding", documents=odd)
    assert got.count() == len(ODD) and {r["law"] for r in got.collect()} == {"bytes"} and got.where("grown_shard IS NOT NULL").count() == 0
    assert run("op9_sharding", documents=odd.limit(0)).count() == 0
    docs = odd.where("doc_id > 4").select("doc_id", "text")
    sharding.write_shards(docs, sharding.assign(docs, 2), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()


# 10 ───────────────────────────────────────────────────────────────────────

def test_lm_base_and_model(frame, run, monkeypatch, odd):
    monkeypatch.setattr(lm, "STEPS", 40)
    monkeypatch.setattr(lm, "HEAVY", 20)  # so that most words take the join
    rnd = random.Random(6)
    rows = [*ODD, *((100 + i, " ".join(rnd.choice(PROSE.split()) for _ in range(rnd.randint(0, 60)))) for i in range(150))]
    got = run("op10_lm_score", documents=frame(rows)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = [(i, [*spaced(lower(t)), None]) for i, t in rows]
    count = collections.Counter(w for i, ws in words if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    key = lambda i, h, a, b, c, s: (str(i), h, a, b, c, round(s, 6))
    want = sorted(key(i, held(i), len(ws), sum(count[w] > 0 for w in ws), n, sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words)
    assert sorted(key(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert run("op10_lm_score", documents=odd.limit(0)).count() == 0


def lm_parts(seed=0):
    rng = np.random.default_rng(seed)
    ids, bounds = rng.integers(0, 50, 400), np.array([0, 0, 7, 7 + lm.SPAN * 3, 400])
    classes = np.concatenate([np.arange(50) % lm.N_CLASSES, [0, 1]])
    place = np.arange(52)
    p = {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in {
        "embed": (lm.EMBEDDED + 1, lm.DIM), "query": (lm.DIM, lm.DIM), "key": (lm.DIM, lm.DIM), "value": (lm.DIM, lm.HIDDEN), "direct": (lm.DIM, lm.HIDDEN),
        "inner": (lm.HIDDEN,), "out": (lm.HIDDEN, lm.N_CLASSES), "outer": (lm.N_CLASSES,), "distance": (2 * lm.SPAN,)}.items()}
    return ids, bounds, classes, place, p


def test_lm_windows_equal_attention_token_by_token():
    ids, bounds, classes, place, p = lm_parts()
    inputs, targets, real, first, row = lm.blocks(ids, bounds, 50, 51)
    assert real.sum() == len(ids) + len(bounds) - 1  # every token and every end once
    prior = np.zeros((1, lm.N_CLASSES), np.float32)
    got = lm.class_logs(lm.tables(p, place), p["out"], prior + p["outer"], lm.attention_bias(p["distance"]), inputs, first, classes[targets], np.zeros_like(inputs))
    for r in range(len(bounds) - 1):
        x = np.concatenate([[50], ids[bounds[r]:bounds[r + 1]]])
        y = np.concatenate([ids[bounds[r]:bounds[r + 1]], [51]])
        mine = got[row == r].ravel()[:len(y)]
        e = p["embed"][place[x]].astype(np.float64)
        for t in range(len(y)):
            a = max(0, (t // lm.SPAN - 1) * lm.SPAN)
            s = np.array([e[t] @ p["query"] @ (e[j] @ p["key"]) / np.sqrt(lm.DIM) + p["distance"][t - j] for j in range(a, t + 1)])
            w = np.exp(s - s.max())
            z = np.maximum((w / w.sum()) @ (e[a:t + 1] @ p["value"]) + e[t] @ p["direct"] + p["inner"], 0) @ p["out"] + p["outer"]
            assert mine[t] == pytest.approx(z[classes[y[t]]] - np.log(np.exp(z).sum()), abs=1e-4)


def test_lm_gradients():
    ids, bounds, classes, place, p = lm_parts(1)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    inputs, targets, real, first, _ = lm.blocks(ids, bounds, 50, 51)
    prior = np.zeros((*inputs.shape, lm.N_CLASSES))
    loss = lambda: lm.gradients(p, inputs, first, place, classes[targets], real, prior)
    _, g = loss()
    for k in p:
        at = (3,) * p[k].ndim
        p[k][at] += 1e-5
        up = loss()[0]
        p[k][at] -= 2e-5
        down = loss()[0]
        p[k][at] += 1e-5
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=2e-5), k


def test_lm_shares_sum_to_one():
    rng = np.random.default_rng(1)
    width = 60
    counts = rng.integers(0, 30, width).astype(np.int64)
    classes = lm.classes_of(counts, (np.arange(width) % 2))
    place = np.where(counts > 3, np.arange(width) + 1, 0)
    pairs = rng.integers(0, 4, (lm.BEFORE, lm.EMBEDDED + 1))
    contexts = np.arange(width) % lm.BEFORE
    within = lm.within_class(pairs, classes, place, counts)
    for context in (0, 17):
        p = np.exp(lm.within_logs(within, contexts, classes, place, np.full(width, context), np.arange(width)))
        assert np.allclose(np.bincount(classes, weights=p, minlength=lm.N_CLASSES)[np.unique(classes)], 1, atol=1e-4)


def wide_corpus():
    """(texts, ids of each): far more distinct pieces than EMBEDDED, in texts that a sample of three does not show."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=lm.VOCABULARY)
    words = [w for w in (sp.id_to_piece(i)[1:] for i in range(sp.get_piece_size()) if sp.id_to_piece(i).startswith("▁")) if re.fullmatch("[a-z]{2,}", w)][:lm.EMBEDDED + 1500]
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(words) for _ in range(300)) for _ in range(100)] + [" ".join(words[k::60] * 2) for k in range(60)]
    return texts, [[i for w in t.split() for i in sp.encode(w)] for t in texts]


def test_lm_counts_every_id_of_the_corpus(spark, frame):
    texts, ids = wide_corpus()
    m = lm.fit(frame(list(enumerate(texts))).select("doc_id", "text"), sample_docs=3)
    count = np.full(m["end"] + 1, 0.1)
    for row in ids:
        np.add.at(count, [*row, m["end"]], 1)
    alone = np.log(count / np.bincount(m["classes"], weights=count)[m["classes"]])
    assert len({i for row in ids for i in row}) > lm.EMBEDDED and np.allclose(m["within"][2], alone, atol=1e-4)
    # what the ids without a place get after one context is what the corpus counts there
    c, got = m["contexts"][m["begin"]], np.arange(m["end"] + 1)
    p = np.exp(lm.within_logs(m["within"], m["contexts"], m["classes"], m["place"], np.full(len(got), m["begin"]), got).astype(float))
    assert np.allclose(np.bincount(m["classes"], weights=p)[np.unique(m["classes"])], 1, atol=1e-3)
    pairs = [(x, y) for row in ids for x, y in zip([m["begin"], *row], [*row, m["end"]], strict=True) if m["contexts"][x] == c]
    rest = m["place"] == 0
    for k in np.unique(m["classes"][rest]):
        n, lost = (sum(m["classes"][y] == k and ok(y) for _, y in pairs) for ok in (lambda y: True, lambda y: rest[y]))
        back = np.exp(alone)[rest & (m["classes"] == k)].sum() * lm.BACK_OFF
        assert p[rest & (m["classes"] == k)].sum() == pytest.approx((lost + back) / (n + lm.BACK_OFF), rel=1e-2)


def test_lm_model_takes_long_texts_and_the_whole_corpus(spark, frame):
    rnd = random.Random(4)
    long = [(i, " ".join(rnd.choice(PROSE.split()) for _ in range(9_000))) for i in range(3)]  # each over 32 KB
    m = lm.fit(frame(long).select("doc_id", "text"))
    texts = lm.Texts(m["vocabulary"])
    data = [t.encode() for _, t in long]
    ids = texts.read(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))[2]
    count = np.bincount(ids, minlength=m["end"] + 1)
    count[m["end"]] = len(long)
    order = np.argsort(-count, kind="stable")
    assert (m["classes"][order[:5]] == np.arange(5)).all() and (m["place"][count > 0] > 0).all() and np.abs(m["out"]).sum() > 0
    assert (m["histories"]["map"] < lm.PAIRS).sum() > 50


def test_lm_windows_grow_with_the_corpus(frame):
    def chosen(n, parts):
        docs = frame([(i, f"{PROSE} " * 400) for i in range(n)]).select("doc_id", "text").repartition(parts)
        with open(lm.VOCABULARY, "rb") as f:
            rows = lm.encoded(docs, f.read(), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        return sorted((r["h"], bytes(r["window"])) for r in lm.survey(rows, 32000, 32001, sample=1, share=4).where("window IS NOT NULL").collect())

    few, many = chosen(20, 1), chosen(80, 2)
    assert len(few) > 20 and 3 * len(few) < len(many) < 5 * len(few)
    assert many == chosen(80, 7)  # wherever the rows lie


def test_lm_scores_do_not_depend_on_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 30)
    monkeypatch.setattr(lm, "GROUP", 10)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    told = lambda n: {r["doc_id"]: r["score"] for r in lm.score(docs.repartition(n)).collect()}
    a, b = told(2), told(6)
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-3


def test_lm_windows_hold_every_target_once():
    ids, bounds = np.arange(5000) % 40, np.array([0, 0, 7, 3 * lm.WINDOW - 1, 5000])
    held = [w for _, w in lm.windows_of(ids, bounds, 50, 51, lambda row, number: range(len(row)))]
    want = [np.concatenate([ids[i:j], [51]]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    assert np.array_equal(np.concatenate([w[1:] for w in held]), np.concatenate(want)) and max(map(len, held)) == lm.WINDOW + 1
    flat, edges = lm.read_windows(lm.pa.array([w.tobytes() for w in held], lm.pa.binary()))
    inputs, targets, real, first = lm.window_blocks(flat, edges, 50, 51)
    assert first.sum() == len(held) and real.sum() == len(ids) + 4 - sum(w[0] != 50 for w in held)
    whole = [x.reshape(-1) for x in lm.blocks(ids, bounds, 50, 51)[:3]]
    assert np.array_equal(targets.ravel()[real.ravel()][:7], whole[1][whole[2]][:7])


# registered queries with SQL ────────────────────────────────────────────────

@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    cur = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names) and spark_rows(df) == comparable(names, cur.fetchall())
