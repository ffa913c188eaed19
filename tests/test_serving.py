"""The cascade's seven layers, order operators, keyed stream state, stores, sketches and folds."""

import collections
import datetime as dt
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from check_oracle import rows_of
from strata.functions import text as T
from strata.operators import handler, minhash as MH, ordered, sketch, store, vote
from strata.plans import cascade as CA
from strata.plans import evaluate as EV
from strata.sources.tables import TABLES
from strata.streaming import hold_stream as HS

SF = "/root/testdata/sf0.001"
QUICK = ["q_response", "q_stats_report", "q_trace_view", "q_price_explained", "q_identities", "q_candidate_order", "q_fallback", "q_embed_upsert",
         "q_latency_quantiles", "q_bursts", "q_price_hold", "q_price_hold_stream", "q_event_windows_stream", "q_cv_centroid", "q_unit_convert", "q_math_gate",
         "q_keyword_score", "q_attempt_order", "q_summary", "q_topic_join", "q_layer_scorecard"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def both(spark, con, name):
    df = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    rows = df.collect()
    assert rows_of(df.columns, rows) == rows_of(names, cur.fetchall())
    return df.columns, rows


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_its_sql_and_no_column_is_constant(spark, con, name):
    columns, rows = both(spark, con, name)
    if len(rows) > 10:
        told = {c for c in columns if len({str(r[c]) for r in rows if r[c] is not None}) < 2}
        assert told <= {"kw_excluded", "n_votes", "turn", "source_rank"}, told


def test_all_seven_layers_are_hit(spark, con):
    _, rows = both(spark, con, "q_cascade_layers")
    hits = collections.Counter(r["layer"] for r in rows)
    assert set(hits) == {"0A", "0B", "1", "2", "3", "4", "5"}, hits
    assert {r["handled_by"] for r in rows} >= {"math", "conversion", "greeting", "pages", "documents", "tinyml", "cache", "embedder", "ensemble", "error"}


@pytest.mark.parametrize("query, answer", [
    ("convert 17 cm to meter", "17.0 cm = 0.17 meter (1 meter = 100 cm)"), ("what is 5 + 3", "= 8"), ("calculate sinx/cosx", "= tan(x)"),
    ("simplify sin(x)^2 + cos(x)^2", "= 1"), ("what is (12 * 8) + (144 / 12) - 5^2", "= 83"), ("how many cm in meter", "1 meter = 100 cm")])
def test_answers_are_worded_as_the_service_does(spark, query, answer):
    got = CA.route(spark.createDataFrame([(1, query)], "k int, query string"), ["k"]).first()
    assert (got["layer"], got["answer"]) == ("0A", answer)
    assert [(s["layer"], s["name"], s["status"]) for s in got["steps"]] == [("0A", "Query Handler", "HIT")]


def test_default_answers_and_the_catalog(spark):
    ask = spark.createDataFrame([(1, "zzz qqq vvv www xxx kkk"), (2, "zzz qqq vvv www xxx kkk"), (3, "zzz qqq vvv www xxx kkk")], "k int, query string")
    votes = spark.createDataFrame([(k, p, "b" if k == 3 else "a", c) for k, c in ((1, 0.9), (2, 0.61), (3, 0.9)) for p in (1, 2)], "k int, pos int, label string, confidence double")
    plain = {r["k"]: (r["layer"], r["answer"]) for r in CA.route(ask, ["k"], votes=votes).collect()}
    assert plain == {1: ("4", "Classified by Ensemble ML (a)"), 2: ("5", None), 3: ("4", "Classified by Ensemble ML (b)")}
    known = spark.createDataFrame([("a", "an answer")], "label string, answer string")
    assert {r["k"]: (r["layer"], r["answer"]) for r in CA.route(ask, ["k"], votes=votes, catalog=known).collect()} == {
        1: ("4", "an answer"), 2: ("5", None), 3: ("5", None)}


@pytest.mark.parametrize("x", [0.0, 1.0, 17.0, 0.17, 0.0001, 0.00001234, 1e15, 123456789.25, 1e16, 3e22, 0.0062900000000000005, 18000.0, 1 / 3])
def test_floats_are_shown_as_python_does(spark, x):
    assert spark.createDataFrame([(x,)], "x double").select(T.shown_float("x")).first()[0] == repr(x)


# order operators ──────────────────────────────────────────────────────────

def events(spark, n, seconds, feeds=2, seed=1):
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"f{r.randrange(feeds)}", k, start + dt.timedelta(seconds=r.randrange(seconds)), None if r.random() < 0.1 else r.random()) for k in range(n)]
    return spark.createDataFrame(rows, "feed string, event_id long, ts timestamp, price double"), rows


@pytest.mark.parametrize("seconds, hold", [(3600, 5), (40, 60), (10**6, 60)])
def test_hold_equals_a_walk_for_any_number_of_partitions(spark, seconds, hold):
    df, rows = events(spark, 600, seconds)
    want, last = [], {}
    for feed, k, ts, price in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        new = feed not in last or (ts - last[feed][0]).total_seconds() >= hold
        if new:
            last[feed] = (ts, price)
        want.append((feed, k, new, last[feed][1]))
    for parts in (1, 7):
        got = ordered.sample_and_hold(df, value="price", hold_seconds=hold, parts=parts).collect()
        assert sorted(tuple(r) for r in got) == sorted(want, key=lambda x: x[:2])


def test_as_of_by_group_with_all_events_in_one_hour(spark):
    df, rows = events(spark, 500, 3600)
    want = {}
    for feed, k, ts, _ in rows:
        seen = [(t, i, p) for g, i, t, p in rows if g == feed and p is not None and (t, i) <= (ts, k)]
        want[k] = max(seen)[2] if seen else None
    for parts in (1, 9):
        got = ordered.asof(df, df, ["event_id"], by=["feed"], parts=parts).collect()
        assert {r["event_id"]: r["asof_price"] for r in got} == want


def test_running_totals_over_partitions(spark):
    df, rows = events(spark, 300, 1000)
    got = ordered.running_totals(df, ["ts", "event_id"], {"n": F.lit(1), "total": F.col("price")}, parts=6).collect()
    n, total = 0, 0.0
    for r in sorted(got, key=lambda r: (r["ts"], r["event_id"])):
        n, total = n + 1, total + (r["price"] or 0.0)
        assert r["n"] == n and r["total"] == pytest.approx(total)
    assert ordered.running_totals(df.limit(0), ["ts"], {"n": F.lit(1)}).count() == 0


# keyed state and event time ───────────────────────────────────────────────

def test_hold_stream_resumes_with_its_state(spark, tmp_path):
    df, _ = events(spark, 200, 4000)
    given, out = str(tmp_path / "in"), str(tmp_path / "out")
    low, cut = df.agg(F.min("ts")).first()[0], dt.datetime(2024, 1, 1, 0, 33)
    source = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(given)
    df.where(F.col("ts") < F.lit(cut)).coalesce(1).write.parquet(given)
    HS.hold_stream(source(), out, hold_seconds=300)
    first = spark.read.parquet(out + "/rows").count()
    df.where(F.col("ts") >= F.lit(cut)).coalesce(1).write.mode("append").parquet(given)
    rows = spark.read.parquet(HS.hold_stream(source(), out, hold_seconds=300))
    want = ordered.sample_and_hold(df, value="price", hold_seconds=300)
    assert low is not None and 0 < first < 200
    assert sorted((tuple(r) for r in rows.collect()), key=repr) == sorted((tuple(r) for r in want.collect()), key=repr)


def test_late_rows_are_not_counted(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "event_type string, ts timestamp, value double"
    given = str(tmp_path / "in")
    for rows in ([("a", day(1), 1.0), ("a", day(1, 5), 2.0), ("a", day(3), 1.0)], [("a", day(3, 1), 1.0)], [("a", day(1, 6), 9.0), ("a", day(5), 1.0)],
                 [("b", day(8), 1.0)]):  # a row is late once the batch before has passed its window
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(given)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(given)
    got = spark.read.parquet(HS.event_counts(source, str(tmp_path / "out"), "event_type")).collect()
    counted = {(r["start"].day, r["event_type"]): (r["n"], r["total"]) for r in got}
    assert counted == {(1, "a"): (2, 3.0), (3, "a"): (2, 2.0), (5, "a"): (1, 1.0)}  # day 1's late row is left out, day 8 is still open


# stores, classes, sketches, folds ─────────────────────────────────────────

def test_store_keeps_first_rows_over_replays_and_compaction(spark, tmp_path):
    s = store.KeyedStore(spark, str(tmp_path / "s"), "k")
    assert s.read() is None
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    s.append(rows((1, "a"), (2, "c"), (2, "b")), 0)
    s.append(rows((1, "z"), (3, "d")), 1)
    s.append(rows((1, "z"), (3, "d")), 1)  # the epoch again
    told = lambda: sorted((r["k"], r["v"], r["epoch"]) for r in s.read().collect())
    assert told() == [(1, "a", 0), (2, "b", 0), (3, "d", 1)]
    s.compact()
    s.append(rows((3, "y"), (4, "e")), 2)
    assert told() == [(1, "a", 0), (2, "b", 0), (3, "d", 1), (4, "e", 2)]
    assert [r["k"] for r in s.missing(rows((4, "x"), (5, "x"))).collect()] == [5]
    assert sorted(r["k"] for r in s.read(2).collect()) == [1, 2, 3]


TEXTS = ["the quick brown fox jumps over the lazy dog near the river bank", "the quick brown fox jumps over the lazy cat near the river bank",
         "completely different words about gardens and flowers in the spring", "short", ""]


def test_stored_index_signs_an_epoch_once_and_answers_as_a_whole_one(spark, tmp_path, monkeypatch):
    bank = spark.createDataFrame([(k, TEXTS[k % 5]) for k in range(12)], "id int, text string")
    stored = MH.StoredIndex(spark, str(tmp_path / "i"), "id", "text")
    signed = []
    real = MH.signature_rows
    monkeypatch.setattr(MH, "signature_rows", lambda df, *a, **b: signed.append(df.count()) or real(df, *a, **b))
    stored.append(bank.where("id < 5"), 0)
    stored.append(bank.where("id >= 5"), 1)
    assert signed == [5, 7]
    asked = spark.createDataFrame(list(enumerate(TEXTS)), "k int, q string")
    want = sorted(tuple(r) for r in MH.best_match(asked, ["k"], "q", MH.Index(bank, "id", "text")).collect())
    assert sorted(tuple(r) for r in MH.best_match(asked, ["k"], "q", stored.index()).collect()) == want
    stored.compact()
    assert sorted(tuple(r) for r in MH.best_match(asked, ["k"], "q", stored.index()).collect()) == want and {r[1] for r in want} == {0, 1, 2, 3}


def test_equal_texts_are_one_class_pair(spark):
    rows = spark.createDataFrame([(k, TEXTS[0]) for k in range(400)], "id int, text string")
    index = MH.Index(rows, "id", "text")
    probes = MH.probe_signatures(rows.withColumnRenamed("id", "k"), ["k"], "text", index)
    assert MH.class_pairs(probes, index).count() == 1
    assert {r["match_id"] for r in MH.best_match(rows.withColumnRenamed("id", "k"), ["k"], "text", index).collect()} == {0}
    assert MH.candidates(probes, ["k"], index).count() == 160_000


def test_long_signatures_equal_the_exploded_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).unionAll(spark.createDataFrame([(-1, None), (-2, ""), (-3, "ab")], "doc_id long, text string"))
    a = {r["doc_id"]: list(r["sig"]) for r in MH.long_signatures(docs, "doc_id", "text", 8).collect()}
    b = {r["doc_id"]: list(r["sig"]) for r in MH.signature_rows(docs, ["doc_id"], "text", 8, "oph").collect()}
    assert a == b


def test_quantiles_are_within_their_bound_and_merge(spark):
    r = random.Random(3)
    values = [int(r.lognormvariate(8, 2)) for _ in range(5000)] + [0, 1, 255, 256, 10**15]
    df = spark.createDataFrame([(k % 7, v) for k, v in enumerate(values)], "part int, us long")
    whole = sketch.quantiles(sketch.of(df, [F.lit(1).alias("g")], "us"), ["g"], {"p50": (1, 2), "p99": (99, 100)}).first()
    merged = sketch.quantiles(sketch.merged(sketch.of(df, ["part"], "us"), [F.lit(1).alias("g")]), ["g"], {"p50": (1, 2), "p99": (99, 100)}).first()
    assert whole == merged and whole["n"] == len(values)
    for name, q in (("p50", 0.5), ("p99", 0.99)):
        exact = sorted(values)[math.ceil(q * len(values)) - 1]
        assert exact * (1 - 1 / 128) <= whole[name] <= exact


def test_folds_differ_by_at_most_one_row_a_label(spark):
    rows = spark.createDataFrame([(k, "x" if k % 10 else "rare") for k in range(200)] + [(500, None)], "k int, label string")
    got = collections.Counter((r["label"], r["fold"]) for r in EV.stratified_folds(rows, "k", "label", 3).collect())
    for label in ("x", "rare"):
        n = [got[label, f] for f in range(3)]
        assert max(n) - min(n) <= 1 and sum(n) == (180 if label == "x" else 20)
    assert got[None, 0] == 1


def test_ensemble_of_texts_on_held_out_rows_after_saving(spark):
    rows = E.queries()["q_text_ensemble"](spark, SF).where("held_out").collect()
    right = [r["label"] == r["lang"] for r in rows if r["label"] is not None]
    assert len(rows) >= 30 and sum(right) >= 0.9 * len(rows)
    assert len({r["confidence"] for r in rows}) > 5


def test_identity_ignores_spaces_and_nulls(spark):
    got = spark.createDataFrame([("calculate sin(x)^2+cos(x)^2",), ("what is sinx / cosx?",), ("sinx",), (None,)], "t string").select(handler.identity(F.col("t"))).collect()
    assert [r[0] for r in got] == ["1", "tan(x)", None, None]


def test_votes_without_a_majority_stay_in_the_residue(spark):
    left = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.9)], "k int, alpha double")
    votes = spark.createDataFrame([(1, 1, "a", 0.7), (1, 2, "b", None), (1, 3, "b", None), (2, 1, "a", 0.7), (2, 2, "b", None), (3, 1, "a", 0.7), (3, 2, "a", None), (9, 1, "z", 1.0)],
                                  "k int, pos int, label string, confidence double")
    got = {r["k"]: (r["__vote"], r["__vote_confidence"]) for r in vote.decide(left, ["k"], votes, "alpha").collect()}
    assert got == {1: ("b", 0.7), 2: (None, 0.7), 3: (None, 0.7)}
