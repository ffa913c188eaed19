"""Registered queries against their DuckDB oracle on the smallest test tables, plus invariants."""

import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import rows_of
from strata.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["q_normalize", "q_topic_extract", "q_word_count", "q_gk_gate", "q_math_gate", "q_keyword_route",
        "q_provider_select", "q_llm_cost", "q_neardup_best", "q_doc_dedup", "q_cosine_top1", "q_vote_majority",
        "q_price_asof", "q_running", "q_scorecard", "q_arith_templates", "q_containment", "q_cascade"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, df.collect()) == rows_of(dcols, cur.fetchall())


def test_every_query_has_an_entry():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40


def test_cascade_invariants(spark):
    from strata.plans import registry as Rg
    d = Rg.decisions(spark, SF)
    u = Rg.user_turns(spark, SF)
    assert d.count() == u.count() == d.select("conv_id", "turn").distinct().count()
    s = Rg.CA.stats(d).first()
    assert s["local"] + s["llm"] == s["total"]


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 7 and sum(r["n"] for r in rows) > 0
