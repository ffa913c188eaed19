"""Faults found in review, each with the case that showed it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import arith, lookup, ordered, vectors
from strata.sources import traces


@pytest.mark.parametrize("text, value", [
    ("(12 * 8) + (144 / 12) - 5^2", 83.0), ("5--3", 8.0), ("7//2", 3.0), ("7%3", 1.0), ("2**3", 8.0), ("8/(2+2)", 2.0), ("-4 + 1", -3.0),
    ("5*", None), ("(2)(3)", None), ("1/0", None), ("1.0E7", None), ("", None), (None, None), ("__import__(1)", None), ("(" * 500 + "1" + ")" * 500, None)])
def test_arithmetic(spark, text, value):
    got = arith.evaluate(spark.createDataFrame([(text,)], "e string"), "e").first()["value"]
    assert got == pytest.approx(value) if value is not None else got is None


def test_every_template_is_evaluated(spark):
    rows = [(n, "+".join(["1"] * n)) for n in range(1, 40)]
    got = arith.evaluate(spark.createDataFrame(rows, "n int, e string"), "e").collect()
    assert all(r["value"] == r["n"] for r in got)


def test_trace_log_in_one_session(spark, tmp_path):
    path = str(tmp_path / "log")
    assert traces.read_traces(spark, path).count() == 0
    one = traces.read_traces(spark, path).drop(traces.CORRUPT)
    row = one.unionByName(spark.range(1).select(F.lit("k").alias("query_key")), allowMissingColumns=True)
    traces.write_traces(row, path)
    (tmp_path / "log" / "part-bad.json").write_text("{not json\n")
    got = traces.read_traces(spark, path).collect()
    assert sorted((r["query_key"] or "", bool(r[traces.CORRUPT])) for r in got) == [("", True), ("k", False)]
    traces.clear_traces(spark, path)
    assert traces.read_traces(spark, path).count() == 0
    traces.write_traces(row, path)
    assert traces.read_traces(spark, path).count() == 1


@pytest.mark.parametrize("kind", ["contains", "prefix", "word_prefix", "equals"])
def test_rules_match_alike_compiled_and_joined(spark, kind):
    rules = spark.createDataFrame([(0, "hi"), (1, "history"), (2, "h"), (3, "is long"), (4, "ab cd")], "ord int, phrase string")
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["history is long", "hi there", "this", "hi", "ab cd", "ab", "x", "", "ab cd ef"])], "k int, t string")
    run = lambda most: {r["k"]: r["rule"] and r["rule"]["ord"] for r in lookup.first_match(texts, ["k"], F.col("t"), rules, kind, max_compiled=most).collect()}
    assert run(256) == run(0)


def test_as_of_skips_null_prices(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    feed = spark.createDataFrame([(1, at(1), 5.0), (2, at(2), None)], "event_id long, ts timestamp, price double")
    probe = spark.createDataFrame([(3, at(3)), (4, at(0)), (2, at(2))], "event_id long, ts timestamp")
    got = ordered.asof(probe.withColumn("key", F.col("event_id")), feed, ["key"])
    assert {r["key"]: r["asof_price"] for r in got.collect()} == {3: 5.0, 4: None, 2: 5.0}


@pytest.mark.parametrize("exclude", [None, "k"])
def test_nearest_is_alike_in_blocks(spark, exclude):
    import random
    rnd = random.Random(1)
    bank = spark.createDataFrame([(i, [rnd.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(60)], "b long, v array<double>")
    probes = bank.select(F.col("b").alias("k"), F.col("v").alias("q"))
    run = lambda size: sorted((r["k"], r["rank"], r["b"], round(r["similarity"], 9))
                              for r in vectors.nearest(probes, ["k"], "q", bank, "b", "v", k=3, exclude_self=exclude, blocks=size).collect())
    assert run(1) == run(8) == run(64) and len(run(64)) == 180


def test_nearest_of_null_and_short_vectors(spark):
    bank = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [0.0, 0.0, 5.0])], "b long, v array<double>")
    probes = spark.createDataFrame([(1, [2.0]), (2, None), (3, [-1.0, 0.0, 0.0, 0.0])], "k long, q array<double>")
    got = {r["k"]: (r["b"], r["similarity"]) for r in vectors.nearest(probes, ["k"], "q", bank, "b", "v").collect()}
    assert got == {1: (2, 1.0), 2: (1, 0.0), 3: (1, 0.0)}
    assert vectors.nearest(probes, ["k"], "q", bank.limit(0), "b", "v").count() == 0


def test_containment_of_many_short_texts(spark):
    a = spark.createDataFrame([(1, "x1y2z3 and 299 more")], "k long, t string")
    b = spark.createDataFrame([(i, str(i)) for i in range(300)], "b long, s string")
    got = lookup.containment_pairs(a, "k", "t", b, "b", "s").collect()
    assert sorted(r["b"] for r in got) == [1, 2, 3, 9, 29, 99, 299]


def test_disambiguation_tests_raw_lines(spark):
    s = "Mercury may refer to:\n mercury, a planet\nmercury the element\nThe god\n"
    df = spark.createDataFrame([(s,)], "s string")
    got = df.select(T.disambiguation(F.col("s"), F.lit("mercury"), F.lit("Mercury")).alias("x")).first()["x"]
    assert got == "**Mercury**\n\nmercury, a planet\nThe god"


def test_upsert_keeps_stored_rows(spark):
    store = spark.createDataFrame([(1, "old")], "k long, v string")
    new = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "k long, v string")
    assert sorted((r["k"], r["v"]) for r in vectors.upsert(store, new, "k").collect()) == [(1, "old"), (2, "a")]


def test_one_checkpoint_folder_a_session(spark):
    from strata.session import ensure_checkpoint_dir
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_learning_stream_resumes_without_duplicates(spark, tmp_path):
    """Three batches: what the first sends to the paid layer is learned, and asked again later is answered from it."""
    from strata.streaming import route_stream as RS
    src, base = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    ask = "thinhand orstent blering thend wherst ansh thionder ingle thatre oned thinge plorat senter wandel"
    bank = spark.createDataFrame([(1, "quite another stored question about gardens", "g")], "bank_id long, text string, label string")
    done = spark.createDataFrame([(i, 0, "the answer") for i in range(4)], "conv_id long, turn long, answer string")

    def go():
        source = spark.readStream.schema("conv_id long, turn long, query string").option("maxFilesPerTrigger", 1).json(str(src))
        return RS.route_stream(spark, source, ["conv_id", "turn"], "query", bank, completions=done, base=base)

    for i in range(2):
        (src / f"{i}.json").write_text(f'{{"conv_id": {i}, "turn": 0, "query": "{ask}"}}\n')
    out = spark.read.parquet(go())
    assert sorted((r["epoch"], r["layer"]) for r in out.collect()) == [(0, "5"), (1, "2")]
    (src / "2.json").write_text(f'{{"conv_id": 2, "turn": 0, "query": "{ask}"}}\n')
    out = spark.read.parquet(go())
    assert sorted((r["epoch"], r["layer"]) for r in out.collect()) == [(0, "5"), (1, "2"), (2, "2")]
