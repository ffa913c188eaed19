"""Findings of round 3; every test builds its own rows."""

import os

import pytest

import __spark_entry__ as E


def test_cross_validation_makes_folds_once_and_fits_a_fold_once(spark, tmp_path, monkeypatch):
    """F1: three models share the folds and each fold's training rows; all models of all folds are scored."""
    from strata.operators import vote as VO
    from strata.plans import evaluate as EV

    rows = [(i, i % 2, [float(i % 2), (i % 5) / 10]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(os.path.join(tmp_path, "embeddings.parquet"))
    made, fitted = [], []
    folds, fit = EV.stratified_folds, VO.Ensemble.fit.__func__
    monkeypatch.setattr(EV, "stratified_folds", lambda *a, **k: made.append(1) or folds(*a, **k))
    monkeypatch.setattr(VO.Ensemble, "fit", classmethod(lambda cls, *a, **k: fitted.append(1) or fit(cls, *a, **k)))
    got = {r["model"]: (r["mean_accuracy"], r["std_accuracy"]) for r in E.queries()["q_cv_accuracy"](spark, str(tmp_path)).collect()}
    assert len(made) == 1 and len(fitted) == 3
    assert got == {m: (pytest.approx(1.0), pytest.approx(0.0)) for m in ("logistic", "perceptron", "boosted trees")}


def test_lm_trains_on_every_window_of_the_corpus(spark, monkeypatch):
    """the groups together see each window once, none is left out."""
    from strata.llm import lm

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(30 + i % 9))) for i in range(120)], "doc_id long, text string")
    seen = []
    trained = lm.trained_on_all
    monkeypatch.setattr(lm, "GROUP", 25)
    monkeypatch.setattr(lm, "STEPS", 5)
    monkeypatch.setattr(lm, "trained_on_all", lambda windows, *rest: seen.append(windows.collect()) or trained(windows, *rest))
    model = lm.fit(docs)
    assert len(seen[0]) == 120 == len({r["h"] for r in seen[0]}) and abs(model["out"]).sum() > 0


def test_nearest_holds_a_block_once(monkeypatch):
    """what a task holds of Python memory is bounded: small blocks, each as one matrix, read batch by batch."""
    import numpy as np
    import pyarrow as pa
    import tracemalloc

    from strata.operators import vectors as V

    n, dim = 20_000, 64
    vectors = np.random.default_rng(1).normal(size=(n, dim))

    def batches():
        for kind, count in ((0, n), (1, 100)):
            for i in range(0, count, 1000):
                x = vectors[i:min(i + 1000, count)]
                yield pa.RecordBatch.from_pydict({
                    "task": np.zeros(len(x), np.int32), "kind": np.full(len(x), kind, np.int32), "bank_id": np.arange(i, i + len(x)),
                    "payload": pa.array([{"x": 0}] * len(x)), "vector": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float64()))})

    tracemalloc.start()
    before, peak_arrow = pa.total_allocated_bytes(), 0
    for part, table, sims in V._tiles(batches(), 1):
        assert sims.size <= 1_000_000 and (sims.argmax(1) == np.asarray(part.column("bank_id"))).all()
        peak_arrow = max(peak_arrow, pa.total_allocated_bytes() - before)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert V.BLOCK_BYTES <= 32 << 20 and peak < 3.5 * n * dim * 8 + (20 << 20) and peak_arrow < n * dim * 8 / 2


def test_only_the_residue_is_classified(spark, monkeypatch):
    """the keyword classifier meets no request that an earlier layer answered."""
    from strata.operators import keyword
    from strata.plans import cascade as CA

    met, classify = [], keyword.classify
    monkeypatch.setattr(keyword, "classify", lambda df, *a, **k: met.append(sorted(r["id"] for r in df.select("id").collect())) or classify(df, *a, **k))
    asked = spark.createDataFrame([(1, "what is 2 + 3"), (2, "hello"), (3, "the weather in my small town"), (4, None), (5, "2 + #")], "id long, query string")
    got = {r["id"]: (r["layer"], r["answer"]) for r in CA.route(asked, ["id"]).collect()}
    assert met == [[i for i in (3, 5) if i in got]] and got[1] == ("0A", "= 5") and got[2][0] == "0A" and got[3][0] in ("1", "5")


def test_arithmetic_with_a_mark_of_the_texts_own(spark):
    """rows of one template are computed whatever others stand beside them in a batch."""
    from strata.operators import arith

    rows = spark.createDataFrame([(1, "1 + 2"), (2, "# + 2"), (3, None), (4, "4 / 0"), (5, "2 ^ 3"), (6, "7 + 8")], "id long, e string").coalesce(1)
    assert {r["id"]: r["value"] for r in arith.evaluate(rows, "e").collect()} == {1: 3.0, 2: None, 3: None, 4: None, 5: 8.0, 6: 15.0}


def test_text_ensemble_cuts_texts_once(spark, tmp_path, monkeypatch):
    """F8: models are fitted on stored vectors, not on texts that every pass would read and cut again."""
    from strata.operators import vote as VO

    class Seen(Exception):
        pass

    def fit(train, features, label):
        raise Seen(train.count(), train.inputFiles(), train.columns)

    rows = [(i, "some words here and there", "en" if i % 2 else "de") for i in range(20)] + [(21, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(os.path.join(tmp_path, "documents.parquet"))
    monkeypatch.setattr(VO.Ensemble, "fit", staticmethod(fit))
    with pytest.raises(Seen) as told:
        E.queries()["q_text_ensemble"](spark, str(tmp_path))
    assert told.value.args[0] == 17 and not told.value.args[1] and "features" in told.value.args[2]


def test_dedup_moves_texts_not_shingles(spark):
    """k-grams are hashed side by side, and pairs are compared by their texts; no plan carries arrays of shingles."""
    import hashlib

    import numpy as np

    from strata.operators import minhash as MH

    odd = ["the quick brown fox", "", "short", "日本語 のテキスト é ▁ 힣 😀 abc", "x" * 40, "naïve café 123456"]
    raw = [x.encode() for x in odd]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    for k in (3, 8, 20):  # 20: some are longer than a block of md5
        starts, ends, row = MH.grams_of(data, offsets, k)
        want = [(i, int(hashlib.md5(x[j:j + k].encode()).hexdigest()[:7], 16)) for i, x in enumerate(odd) for j in range(len(x) - k + 1)]
        assert list(zip(row.tolist(), MH.gram_hashes(data, starts, ends).tolist(), strict=True)) == want

    base = " ".join(f"word{i * 7 % 101} and more" for i in range(120))
    texts = [(1, base), (2, base), (3, base + " one more end"), (4, base + " né çà"), (5, None), (6, "tiny"), (7, "é" + base), (8, None), (9, "tiny")]
    pairs = MH.dedup_representatives(spark.createDataFrame(texts, "id long, text string"), "id", "text")
    assert "array_intersect" not in pairs._jdf.queryExecution().toString()
    grams = {i: {x[j:j + 8] for j in range(len(x or "") - 7)} for i, x in texts}
    got = {r["id"]: (r["rep_id"], r["jaccard"]) for r in pairs.collect()}
    assert got == {i: (1, pytest.approx(len(grams[i] & grams[1]) / len(grams[i] | grams[1]))) for i in (2, 3, 4, 7)}
    assert MH.gram_jaccard(MH.gram_set("ab", 8), MH.gram_set("", 8), 8) is None


def test_lm_works_through_batches_in_arrays_that_it_keeps():
    """op10_lm_score, CPU seconds: a batch after the first waits for little new memory, in training as in scoring, and its
    gradients are those of the plain formulas over the whole batch."""
    import numpy as np
    import tracemalloc

    from strata.llm import lm

    rng = np.random.default_rng(5)
    n, classes_of = lm.BATCH, rng.integers(0, lm.N_CLASSES, 52)
    p = {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in {
        "embed": (lm.EMBEDDED + 1, lm.DIM), "query": (lm.DIM, lm.DIM), "key": (lm.DIM, lm.DIM), "value": (lm.DIM, lm.HIDDEN), "direct": (lm.DIM, lm.HIDDEN),
        "inner": (lm.HIDDEN,), "out": (lm.HIDDEN, lm.N_CLASSES), "outer": (lm.N_CLASSES,), "distance": (2 * lm.SPAN,)}.items()}
    place, inputs = np.arange(52), rng.integers(0, 52, (n, lm.SPAN))
    first, real, target = np.arange(n) % 9 == 0, rng.random((n, lm.SPAN)) < 0.9, classes_of[rng.integers(0, 52, (n, lm.SPAN))]
    prior, history = np.log(rng.dirichlet(np.ones(lm.N_CLASSES), 40)).astype(np.float32), rng.integers(0, 40, (n, lm.SPAN))

    def peak(f):
        f()
        tracemalloc.start()
        try:
            f()
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    wide = n * lm.SPAN * lm.N_CLASSES * 4
    args = (lm.attention_bias(p["distance"]), inputs, first, target, history)
    assert peak(lambda: lm.class_logs(lm.tables(p, place), p["out"], prior, *args)) < 2.5 * wide
    room = lm.Room()
    assert peak(lambda: lm.gradients(p, inputs, first, place, target, real, prior, history, room, with_loss=False)) < 2.5 * wide
    loss, got = lm.gradients(p, inputs, first, place, target, real, prior, history, room)

    w = {k: v.astype(np.float64) for k, v in p.items()}
    x = w["embed"][place[inputs]]
    around = np.concatenate([np.concatenate([x[:1], x[:-1]]), x], axis=1)
    s = (x @ w["query"]) @ (around @ w["key"]).transpose(0, 2, 1) / np.sqrt(lm.DIM) + lm.attention_bias(p["distance"])
    s[first, :, :lm.SPAN] = -1e9
    a = np.exp(s - s.max(-1, keepdims=True))
    a /= a.sum(-1, keepdims=True)
    z = x @ w["direct"] + a @ (around @ w["value"]) + w["inner"]
    y = np.exp(np.maximum(z, 0) @ w["out"] + w["outer"] + prior[history])
    y /= y.sum(-1, keepdims=True)
    assert loss == pytest.approx(-np.log(np.take_along_axis(y, target[..., None], 2)[..., 0])[real].mean(), rel=1e-4)
    d = (y - np.eye(lm.N_CLASSES)[target]) * real[..., None] / real.sum()
    dz = (d @ w["out"].T) * (z > 0)
    dv, da = a.transpose(0, 2, 1) @ dz, dz @ (around @ w["value"]).transpose(0, 2, 1)
    ds = a * (da - (da * a).sum(-1, keepdims=True)) / np.sqrt(lm.DIM)
    flat = lambda t: t.reshape(-1, t.shape[-1])
    dq, dk = ds @ (around @ w["key"]), ds.transpose(0, 2, 1) @ (x @ w["query"])
    d_around = dk @ w["key"].T + dv @ w["value"].T
    dx = dq @ w["query"].T + dz @ w["direct"].T + d_around[:, lm.SPAN:]
    dx[:-1] += d_around[1:, :lm.SPAN] * ~first[1:, None, None]
    embed = np.zeros_like(w["embed"])
    np.add.at(embed, place[inputs], dx)
    want = {"out": flat(np.maximum(z, 0)).T @ flat(d), "outer": flat(d).sum(0), "inner": flat(dz).sum(0), "direct": flat(x).T @ flat(dz), "embed": embed,
            "query": flat(x).T @ flat(dq), "key": flat(around).T @ flat(dk), "value": flat(around).T @ flat(dv)}
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-6), k
