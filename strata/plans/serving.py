"""Registered queries of the whole cascade and what is shown of it: all seven layers, responses, reports, evaluation,
the keyed stream twin, incremental stores, latency sketches. Registered beside those of ``registry``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata import rules as R
from strata.functions import predicates as P
from strata.functions import text as T
from strata.functions.regex import sql_str
from strata.operators import handler, keyword, knowledge as KN, minhash as MH, ordered as OR, pricing as PR, providers, sketch, store
from strata.plans import cascade as CA
from strata.plans import evaluate as EV
from strata.plans import registry as G
from strata.plans import requests as RQ
from strata.session import scratch_path
from strata.sources.tables import ASSISTANT_REPLIES_SQL, assistant_replies, table, user_turns
from strata.streaming import hold_stream as HS

register = G.register


# ── all seven layers ─────────────────────────────────────────────────────────

KEYS = ["src", "id"]
_PROVIDERS = ["auto", " Gemini", "groq", "smart"]
_DIMS = [64, 40, 16]  # of a vector request's vector, the first so many components are those of its embedding, the others 0


#: The fixed keyword rules and those tuned to one of the corpus's languages, so that layers behind them have texts left.
_KEYWORDS = R.keyword_rules() + [(c, o + 100, p, k, w, d) for c, o, p, k, w, d in G.tuned_keyword_rows() if c == "german"]


def _wanted(x: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _PROVIDERS)), F.pmod(x, F.lit(len(_PROVIDERS))).cast("int") + 1)


def requests(spark, sf):
    """(src, id, query, provider): all user turns, every benchmark text with a word before it, every page's title asked for,
    the requests of all parts, the first line of every document, and one request for every embedding."""
    u = user_turns(spark, sf).select(F.lit("turn").alias("src"), (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("id"), "query")
    b = table(spark, sf, "benchmark").select(F.lit("item").alias("src"), F.col("item_id").cast("long").alias("id"), F.concat(F.lit("please: "), "text").alias("query"))
    d = table(spark, sf, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("query"))
    e = table(spark, sf, "embeddings").select(F.lit("vec").alias("src"), F.col("vec_id").alias("id"),
                                              F.concat(F.lit("vector request number "), F.col("vec_id").cast("string")).alias("query"))
    named = [x.select(F.lit(n).alias("src"), F.col("id").cast("long").alias("id"), "query") for n, x in (("page", RQ.page_asks(spark, sf)), ("part", RQ.asks(spark, sf)))]
    out = u
    for x in (b, d, e, *named):
        out = out.unionAll(x)
    return out.withColumn("provider", _wanted(F.col("id")))


_REQUESTS_SQL = f"""
SELECT src, id, query, ([{', '.join(map(sql_str, _PROVIDERS))}])[CAST(id % {len(_PROVIDERS)} AS INTEGER) + 1] AS provider FROM (
  SELECT 'turn' AS src, CAST(conv_id * 1000 + turn AS BIGINT) AS id, query FROM {G.U}
  UNION ALL SELECT 'item', CAST(item_id AS BIGINT), 'please: ' || text FROM benchmark
  UNION ALL SELECT 'doc', doc_id, split_part(text, chr(10), 1) FROM documents
  UNION ALL SELECT 'vec', vec_id, 'vector request number ' || CAST(vec_id AS VARCHAR) FROM embeddings
  UNION ALL SELECT 'page', CAST(id AS BIGINT), query FROM ({RQ.PAGE_ASKS_SQL})
  UNION ALL SELECT 'part', CAST(id AS BIGINT), query FROM ({RQ.ASKS_SQL}))"""


def layered(spark, sf):
    """The decisions of all requests, with every layer's table given and the price as of the event of the request's number."""
    asked = requests(spark, sf)
    emb = table(spark, sf, "embeddings")
    kept = F.coalesce(*[F.when(F.pmod("vec_id", F.lit(len(_DIMS))) == k, n) for k, n in enumerate(_DIMS)])
    vectors = emb.select(F.lit("vec").alias("src"), F.col("vec_id").alias("id"),
                         F.transform("embedding", lambda x, i: F.when(i < kept, x.cast("double")).otherwise(0.0)).alias("vector"))
    bank = emb.select(F.col("vec_id").alias("vid"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("label"))

    def votes(left):
        voted, sure = G._voters(spark, sf, left.where("src = 'vec'").select(F.col("id").alias("vec_id")))
        return voted.join(sure, "vec_id").select(F.lit("vec").alias("src"), F.col("vec_id").alias("id"), "pos", F.col("label").cast("string").alias("label"), "confidence")

    events = table(spark, sf, "events")
    feed = events.where(F.col("event_type") == G._PRICE_FEED).select("ts", "event_id", (F.col("value") / 1000).alias("price"))
    at = OR.asof(events.select("event_id", "ts"), feed, ["event_id"])
    prices = asked.select(*KEYS).join(at, F.col("id") == F.col("event_id")).select(*KEYS, F.col("asof_price").alias("price"))
    answers = assistant_replies(spark, sf).select(F.lit("turn").alias("src"), (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("id"), "answer")
    catalog = table(spark, sf, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").cast("string").alias("label"), F.col("n_name").alias("answer"))
    rules = spark.createDataFrame(_KEYWORDS, keyword.RULE_SCHEMA)
    return CA.route(asked, KEYS, "query", bank=G._bank(spark, sf), knowledge=G._knowledge(spark, sf), completions=answers, vectors=vectors,
                    vector_bank=bank, votes=votes, keyword_rules=rules, prices=prices, catalog=catalog, provider_col="provider")


def _layered_sql() -> str:
    h = handler.handle_sql("query", R.greeting_rules(), R.fact_rules())
    math = arith_sql("query")
    tier, alpha = PR.tier_sql("price")
    probe = "SELECT src || ':' || id AS pid, query FROM rq"
    req = f"lower({T.py_strip_sql('provider')})"
    auto = f"{req} IN ({', '.join(map(sql_str, R.AUTO_PROVIDER_NAMES))})"
    sel = providers.select_provider_sql("query")
    chosen = f"(CASE WHEN {auto} THEN {sel[0]} WHEN {req} = 'gemini' THEN 'gemini' ELSE 'groq' END)"
    model = f"(CASE WHEN {auto} THEN {sel[1]} WHEN {chosen} = 'gemini' THEN {sql_str(R.GEMINI_MODELS[0])} ELSE {sql_str(R.GROQ_MODELS[0])} END)"
    pt, ct = T.word_count_sql("query"), T.word_count_sql("coalesce(reply, '')")
    own = "CASE " + " ".join(f"WHEN vec_id % {len(_DIMS)} = {k} THEN {n}" for k, n in enumerate(_DIMS)) + " END"
    floor = f"greatest(alpha, {R.ENSEMBLE_FLOOR})"
    labelled = "layer IN ('1', '2', '3', '4')"
    default = "CASE layer WHEN '1' THEN 'Handled by TinyML (' || label || ')' WHEN '4' THEN 'Classified by Ensemble ML (' || label || ')' ELSE label END"
    return f"""
WITH rq0 AS ({_REQUESTS_SQL}),
pr AS (SELECT event_id, last_value(price IGNORE NULLS) OVER (ORDER BY ts, kind, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price, kind
       FROM (SELECT ts, 0 AS kind, event_id, value / 1000 AS price FROM events WHERE event_type = '{G._PRICE_FEED}'
             UNION ALL SELECT ts, 1, event_id, NULL FROM events)),
rq AS (SELECT rq0.*, CASE WHEN price IS NULL THEN {R.DEFAULT_ALPHA} ELSE {alpha} END AS alpha, CASE WHEN price IS NULL THEN '{R.DEFAULT_TIER}' ELSE {tier} END AS price_tier
       FROM rq0 LEFT JOIN (SELECT event_id, price FROM pr WHERE kind = 1) p ON p.event_id = rq0.id WHERE {T.canon_sql('query')} <> ''),
{G._MH_BANK},
{MH.shingles_cte_sql("psh", probe, "pid", "query", 3)},
{MH.signature_cte_sql("ps", "psh")},
{MH.bands_cte_sql("pb", "ps")},
{G._CAND},
sim AS (SELECT c.pid, c.bid, count(*) / CAST({MH.NUM_PERM} AS DOUBLE) AS sim
        FROM cand c JOIN ps p ON p.id = c.pid JOIN bs b ON b.id = c.bid AND b.slot = p.slot AND b.m = p.m GROUP BY c.pid, c.bid),
mh AS (SELECT pid, bid, round_even(sim, 3) AS similarity FROM (
        SELECT pid, bid, sim, row_number() OVER (PARTITION BY pid ORDER BY sim DESC, bid) AS rn FROM sim) WHERE rn = 1),
{G._NN},
{G._CENT},
mv AS (SELECT vec_id, list_transform(v, lambda x, i: CASE WHEN i <= {own} THEN x ELSE 0.0 END) AS v FROM e),
ns AS (SELECT a.vec_id, b.label, list_cosine_similarity(a.v, b.v) AS sim, row_number() OVER (
         PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id) AS rn FROM mv a JOIN e b ON TRUE),
kw AS ({keyword.classify_sql("SELECT src, id, query FROM rq", KEYS, "query", _KEYWORDS)}),
kb AS {KN.best_sql()},
x AS (SELECT rq.*, {h['h0a_kind']} AS kind0, {h['h0a_rule']} AS rule0, {h['h0a_answer']} AS answer0, {math['answer']} AS math, {math['rule']} AS math_rule,
             {P.gk_gate_sql('query')} AS gk, {T.topic_sql('query')} AS topic FROM rq),
y AS (SELECT x.*, kw.kw_hit, kw.kw_label, kw.kw_confidence, kb.summary, kb.source_rank, mh.bid, mh.similarity, a.answer AS reply,
             round_even(ns.sim, 3) AS vec_sim, ns.label AS vec_label, maj.label AS vote, (1 + v1s.sim) / 2 AS vote_sim, nation.n_name AS vote_answer
      FROM x JOIN kw ON kw.src = x.src AND kw.id = x.id
      LEFT JOIN kb ON x.gk AND x.topic <> '' AND kb.topic = x.topic
      LEFT JOIN mh ON mh.pid = x.src || ':' || x.id
      LEFT JOIN ns ON x.src = 'vec' AND ns.vec_id = x.id AND ns.rn = 1
      LEFT JOIN maj ON x.src = 'vec' AND maj.vec_id = x.id
      LEFT JOIN v1s ON x.src = 'vec' AND v1s.vec_id = x.id AND v1s.rn = 1
      LEFT JOIN nation ON nation.n_nationkey = maj.label AND n_regionkey <> 0
      LEFT JOIN ({ASSISTANT_REPLIES_SQL}) a ON x.src = 'turn' AND a.conv_id * 1000 + a.turn = x.id),
z AS (SELECT *, CASE WHEN kind0 IS NOT NULL OR math IS NOT NULL THEN '0A' WHEN summary IS NOT NULL THEN '0B' WHEN kw_hit THEN '1' WHEN bid IS NOT NULL THEN '2'
                     WHEN vec_sim >= {R.EMBED_THRESHOLD} THEN '3' WHEN vote IS NOT NULL AND vote_sim >= {floor} AND vote_answer IS NOT NULL THEN '4' ELSE '5' END AS layer,
             {chosen} AS sel_provider, {model} AS sel_model FROM y),
l AS (SELECT *, CASE layer WHEN '0A' THEN coalesce(rule0, math_rule) WHEN '1' THEN kw_label WHEN '2' THEN 'item-' || bid
                     WHEN '3' THEN CAST(vec_label AS VARCHAR) WHEN '4' THEN CAST(vote AS VARCHAR) END AS label FROM z)
SELECT l.src, l.id, layer,
  CASE layer WHEN '0A' THEN coalesce(kind0, 'math') WHEN '0B' THEN CASE WHEN source_rank = 1 THEN 'pages' ELSE 'documents' END WHEN '1' THEN 'tinyml'
       WHEN '2' THEN 'cache' WHEN '3' THEN 'embedder' WHEN '4' THEN 'ensemble' ELSE CASE WHEN reply IS NULL THEN 'error' ELSE sel_provider END END AS handled_by,
  label, layer <> '5' AS cost_saved,
  CASE layer WHEN '0A' THEN 1.0 WHEN '0B' THEN 1.0 WHEN '1' THEN kw_confidence WHEN '2' THEN similarity WHEN '3' THEN vec_sim
       WHEN '4' THEN round_even(vote_sim, 3) ELSE CASE WHEN reply IS NULL THEN 0.0 ELSE 1.0 END END AS confidence,
  alpha, price_tier,
  CASE WHEN layer = '5' AND reply IS NOT NULL THEN sel_provider END AS provider,
  CASE WHEN layer = '5' AND reply IS NOT NULL THEN sel_model END AS model,
  CASE WHEN layer = '5' AND reply IS NOT NULL THEN {pt} + {ct} END AS tokens,
  CASE WHEN layer = '5' AND reply IS NOT NULL THEN CASE WHEN sel_provider = 'gemini' THEN {providers.flat_cost_sql(pt + ' + ' + ct)}
       ELSE {providers.split_cost_sql(pt, ct)} END END AS cost,
  {G._STEPS_SQL} AS steps,
  CASE layer WHEN '0A' THEN coalesce(answer0, math) WHEN '0B' THEN summary WHEN '5' THEN reply ELSE coalesce(k.n_name, {default}) END AS answer
FROM l LEFT JOIN (SELECT CAST(n_nationkey AS VARCHAR) AS known, n_name FROM nation WHERE n_regionkey <> 0) k ON {labelled} AND k.known = l.label"""


def arith_sql(e: str) -> dict[str, str]:
    """The math answers that the made requests can have: identities, and ``a * (b - c)`` of non-negative numbers."""
    form = r"^([0-9]+) \* \(([0-9]+\.?[0-9]*) - ([0-9]+)\)$"
    t = T.math_normalize_sql(e)
    part = lambda k: f"CAST(regexp_extract({t}, {sql_str(form)}, {k}) AS DOUBLE)"
    value = f"({part(1)} * ({part(2)} - {part(3)}))"
    shown = f"CASE WHEN {value} = floor({value}) THEN CAST(CAST({value} AS BIGINT) AS VARCHAR) ELSE CAST({value} AS VARCHAR) END"
    gate, same = P.math_gate_sql(e), handler.identity_sql(e)
    return {"answer": f"CASE WHEN {gate} THEN CASE WHEN {same} IS NOT NULL THEN '= ' || {same} WHEN regexp_matches({t}, {sql_str(form)}) THEN '= ' || {shown} END END",
            "rule": f"CASE WHEN {same} IS NOT NULL THEN 'identity' ELSE '#*(#-#)' END"}


@register("q_cascade_layers", _layered_sql())
def q_cascade_layers(spark, sf):
    return layered(spark, sf).withColumn("steps", CA.steps_text()).select(
        *KEYS, "layer", "handled_by", "label", "cost_saved", "confidence", "alpha", "price_tier", "provider", "model", "tokens", "cost", "steps", "answer")


# ── what is shown of a decision (S7, P12, P13, P14, F8, J14, J15, U3) ────────

_LOST = "event_type = 'error'"


@register("q_response", f"""
SELECT event_id, CASE WHEN {_LOST} THEN 'No answer found' ELSE props END AS answer, CASE WHEN {_LOST} THEN 'unknown' ELSE event_type END AS handled_by,
       CASE WHEN {_LOST} THEN '?' ELSE CAST(user_id % 5 AS VARCHAR) END AS layer, CASE WHEN {_LOST} THEN 'Unknown Layer' ELSE 'Layer ' || CAST(user_id % 5 AS VARCHAR) END AS layer_name,
       CASE WHEN value > 100 THEN {R.DEFAULT_ALPHA} ELSE value / 100 END AS alpha, CASE WHEN value > 100 THEN '{R.DEFAULT_TIER}' ELSE 'cheap' END AS price_tier,
       CASE WHEN {_LOST} THEN FALSE ELSE event_type <> 'purchase' END AS cost_saved, CASE WHEN value > 100 THEN 1.0 ELSE value / 200 END AS confidence,
       CASE WHEN {_LOST} THEN 0 ELSE 1 END AS n_steps
FROM events""")
def q_response(spark, sf):
    """Events read as decisions of which errors and high values lack fields, as a caller is shown them."""
    e = table(spark, sf, "events")
    lost, high = F.expr(_LOST), F.col("value") > 100
    unless = lambda c, v: F.when(~c, v)
    name = (F.col("user_id") % 5).cast("string")
    none = F.lit(None).cast("string")
    made = e.select("event_id", unless(lost, F.col("props")).alias("answer"), unless(lost, F.col("event_type")).alias("handled_by"), unless(lost, name).alias("layer"),
                    unless(lost, F.concat(F.lit("Layer "), name)).alias("layer_name"), unless(high, F.col("value") / 100).alias("alpha"),
                    unless(high, F.lit("cheap")).alias("price_tier"), unless(lost, F.col("event_type") != "purchase").alias("cost_saved"),
                    unless(high, F.col("value") / 200).alias("confidence"), none.alias("model"), none.alias("provider"), none.alias("selection_reason"),
                    F.lit(None).cast("long").alias("tokens"), unless(lost, F.array(F.struct(name.alias("layer"), name.alias("name"), F.lit("HIT").alias("status")))).alias("steps"))
    return CA.respond(made, ["event_id"]).select("event_id", "answer", "handled_by", "layer", "layer_name", "alpha", "price_tier", "cost_saved", "confidence",
                                                F.size("steps").alias("n_steps"))


@register("q_stats_report", f"""
SELECT day, total, CAST(round(local / total * 100, 1) AS VARCHAR) || '%' AS local_rate, '$' || CAST(round(local * {R.BASELINE_COST_PER_QUERY}::DOUBLE, 4) AS VARCHAR) AS estimated_saved,
       '$' || CAST(round(spent, 5) AS VARCHAR) AS estimated_spent
FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (event_type <> '{G._PRICE_FEED}') AS local,
             coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = '{G._PRICE_FEED}'), 0) / 100000.0::DOUBLE AS spent FROM events GROUP BY 1)""")
def q_stats_report(spark, sf):
    """A day's statistics as they are shown; costs are summed in whole units of 1e-5."""
    paid = F.col("event_type") == G._PRICE_FEED
    g = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("total"), F.count_if(~paid).alias("local"), (F.coalesce(F.sum(F.when(paid, F.round(F.col("value") * 100).cast("long"))), F.lit(0)) / 100000.0).alias("spent"))
    return CA.report(g).select("day", "total", "local_rate", "estimated_saved", "estimated_spent")


_SHOWN = ["cache", "groq", "tinyml", "math", "nobody", "embedder"]


@register("q_trace_view", f"""
WITH h(handled_by, label, layer, cost) AS (VALUES {', '.join('(' + ', '.join(map(sql_str, x)) + ')' for x in R.HANDLERS)}),
t AS (SELECT event_id, ([{', '.join(map(sql_str, _SHOWN))}])[CAST(event_id % {len(_SHOWN)} AS INTEGER) + 1] AS handled_by,
             CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN 0.0 ELSE value / 500 END AS confidence FROM events)
SELECT event_id, t.handled_by, coalesce(h.label, u.label) AS label, coalesce(h.layer, u.layer) AS layer, coalesce(h.cost, u.cost) AS cost,
       CASE WHEN confidence IS NULL OR confidence = 0 THEN 100 ELSE CAST(floor(confidence * 100 + 0.5) AS BIGINT) END AS confidence_pct
FROM t LEFT JOIN h ON h.handled_by = t.handled_by JOIN h u ON u.handled_by = 'unknown'""")
def q_trace_view(spark, sf):
    """How a decision's handler and confidence are shown."""
    e = table(spark, sf, "events")
    handled = F.element_at(F.array(*map(F.lit, _SHOWN)), F.pmod("event_id", F.lit(len(_SHOWN))).cast("int") + 1)
    conf = F.when(F.col("event_type") == "view", None).when(F.col("event_type") == "click", 0.0).otherwise(F.col("value") / 500)
    shown = CA.shown(e.select("event_id", handled.alias("handled_by"), conf.alias("confidence")))
    return shown.select("event_id", "handled_by", "label", "layer", "cost", "confidence_pct")


_PRICE = "value / 1000"
_TIER_SQL = PR.tier_sql(_PRICE)


@register("q_price_explained", f"""
SELECT event_id, CASE {_TIER_SQL[0]} """ + " ".join(
    f"WHEN {sql_str(n)} THEN {' || '.join([sql_str(x) if x else chr(39) * 2 for x in t.split('%s')[:1]])} || CAST({_PRICE} AS VARCHAR) || "
    f"{sql_str(t.split('%s')[1])} || CAST({_TIER_SQL[1]} AS VARCHAR) || {sql_str(t.split('%s')[2])}" for n, t in R.TIER_EXPLANATIONS.items()) + f""" END AS reasoning,
  (event_id % 100) / 100.0::DOUBLE >= {_TIER_SQL[1]} AS surrogate
FROM events""")
def q_price_explained(spark, sf):
    """What a price's tier is explained as; F8: whether a surrogate of some confidence would be used under it."""
    e = table(spark, sf, "events").withColumn("price", F.col("value") / 1000).withColumn("t", PR.tier("price"))
    return e.select("event_id", PR.explanation("price", F.col("t")).alias("reasoning"),
                    P.should_use_surrogate((F.col("event_id") % 100) / 100.0, F.col("t.alpha").cast("double")).alias("surrogate"))


@register("q_identities", f"""
SELECT conv_id, turn, {handler.identity_sql('text')} AS answer FROM ({RQ.TURNS_AND_ASKS_SQL}) WHERE {P.math_gate_sql('text')}""")
def q_identities(spark, sf):
    """J15 over the requests that pass the math gate."""
    x = RQ.turns_and_asks(spark, sf).where(P.math_gate(F.col("text")))
    return x.select("conv_id", "turn", handler.identity(F.col("text")).alias("answer"))


_LINK = r'href="([^"]*)"'


@register("q_candidate_order", f"""
WITH l AS (SELECT page_id, list_transform([url] || regexp_extract_all(html, '{_LINK}', 1), lambda x: regexp_replace(x, '/$', '')) AS links FROM pages)
SELECT page_id, len(links) AS n_given, array_to_string(list_filter(links, lambda x, i: list_position(links, x) = i), ' ') AS candidates FROM l""")
def q_candidate_order(spark, sf):
    """A page's own address and its links, each once and in the order of preference."""
    links = F.concat(F.array("url"), F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))
    x = table(spark, sf, "pages").select("page_id", F.transform(links, lambda u: F.regexp_replace(u, "/$", "")).alias("links"))
    return x.select("page_id", F.size("links").cast("long").alias("n_given"), F.array_join(F.array_distinct("links"), " ").alias("candidates"))


# ── layer 5: fallback chain (R3) ─────────────────────────────────────────────

@register("q_fallback", """
WITH a AS (SELECT l_orderkey AS query_id, l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS ord, CASE WHEN l_suppkey % 2 = 0 THEN 'groq' ELSE 'gemini' END AS provider,
                  'model-' || CAST(l_partkey % 4 AS VARCHAR) AS model, l_returnflag = 'N' AS ok, 'error ' || CAST(l_partkey AS VARCHAR) AS error FROM lineitem),
g AS (SELECT query_id, arg_min({'p': provider, 'm': model}, ord) FILTER (ok) AS win, arg_max(error, ord) FILTER (NOT ok) AS last_error, count(*) AS n_attempts FROM a GROUP BY 1)
SELECT query_id, win.p AS provider, win.m AS model, last_error, n_attempts, win IS NULL AS failed FROM g""")
def q_fallback(spark, sf):
    """An order's lines read as the attempts of a request: the first that succeeded, the last error."""
    li = table(spark, sf, "lineitem")
    return providers.resolve_attempts(li.select(
        F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber").cast("long") * 10_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("ord"), F.when(F.col("l_suppkey") % 2 == 0, "groq").otherwise("gemini").alias("provider"),
        F.concat(F.lit("model-"), (F.col("l_partkey") % 4).cast("string")).alias("model"), (F.col("l_returnflag") == "N").alias("ok"),
        F.concat(F.lit("error "), F.col("l_partkey").cast("string")).alias("error")))


# ── evaluation by layer and validator (A5, F10) ──────────────────────────────

_CASE = """conv_id % 5 AS category, 1 + turn % 3 AS weight, CASE conv_id % 3 WHEN 0 THEN ['2', '5'] WHEN 1 THEN ['5'] ELSE ['0A', '2'] END AS expected,
  CASE WHEN conv_id % 2 = 0 THEN [lower(query[1:2]), 'ITEM'] ELSE [] END AS any_of, CASE WHEN turn % 4 = 0 THEN ['e'] ELSE [] END AS all_of, (conv_id % 4) * 8 AS min_len"""


@register("q_layer_scorecard", f"""
WITH d AS ({G._CASCADE_SQL}),
c AS (SELECT conv_id, turn, {_CASE} FROM {G.U} WHERE {T.canon_sql('query')} <> ''),
p AS (SELECT category, weight, list_contains(expected, layer) AND (len(any_of) = 0 OR len(list_filter(any_of, lambda s: contains(lower(coalesce(answer, '')), lower(s)))) > 0)
             AND len(list_filter(all_of, lambda s: NOT contains(lower(coalesce(answer, '')), lower(s)))) = 0 AND length(coalesce(answer, '')) > min_len AS passed
      FROM c JOIN d USING (conv_id, turn))
SELECT category, count(*) AS total, count(*) FILTER (passed) AS passed, CAST(sum(weight) AS BIGINT) AS weight, CAST(sum(CASE WHEN passed THEN weight ELSE 0 END) AS BIGINT) AS earned,
       ((CAST(sum(CASE WHEN passed THEN weight ELSE 0 END) AS BIGINT) * 2000 + CAST(sum(weight) AS BIGINT)) // (CAST(sum(weight) AS BIGINT) * 2)) / 10.0 AS pct
FROM p GROUP BY category""")
def q_layer_scorecard(spark, sf):
    """Every user turn is a case: its layer must be one of those expected and its answer must pass the validator."""
    u = user_turns(spark, sf).where(T.canon("query") != "")
    none = F.array().cast("array<string>")
    cases = u.select("conv_id", "turn", (F.col("conv_id") % 5).alias("category"), (1 + F.col("turn") % 3).alias("weight"),
                     F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("2"), F.lit("5"))).when(F.col("conv_id") % 3 == 1, F.array(F.lit("5")))
                     .otherwise(F.array(F.lit("0A"), F.lit("2"))).alias("expected"),
                     F.when(F.col("conv_id") % 2 == 0, F.array(F.lower(F.substring("query", 1, 2)), F.lit("ITEM"))).otherwise(none).alias("any_of"),
                     F.when(F.col("turn") % 4 == 0, F.array(F.lit("e"))).otherwise(none).alias("all_of"), (F.col("conv_id") % 4 * 8).alias("min_len"))
    return EV.scorecard(EV.judged(cases, G.decisions(spark, sf), ["conv_id", "turn"]))


# ── price feed as a keyed stream (T3), event-time windows (T2) ───────────────

@register("q_price_hold_stream", G.ORACLE["q_price_hold"])
def q_price_hold_stream(spark, sf):
    """The stream twin of q_price_hold: the events in three micro-batches by time, with state per feed."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("feed"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 1000).alias("price"))
    given = HS.in_time_slices(e, 3)
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(given)
    rows = HS.hold_stream(source, scratch_path(spark, f"hold-{uuid.uuid4().hex}"), hold_seconds=G._HOLD_S)
    return spark.read.parquet(rows).select("feed", "event_id", "kept", F.col("held").alias("held_price"))


@register("q_event_windows_stream", """
WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL)
SELECT CAST(start AS DATE) AS day, event_type, n, total FROM w
WHERE epoch_us(start) + 86400000000 <= (SELECT max(epoch_us(ts) // 1000) * 1000 - 3600000000 FROM events)""")
def q_event_windows_stream(spark, sf):
    """Daily counts by event time, appended once the watermark (an hour behind the latest event) has passed the day."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(HS.in_time_slices(e, 3))
    rows = HS.event_counts(source, scratch_path(spark, f"windows-{uuid.uuid4().hex}"), "event_type")
    return spark.read.parquet(rows).select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


# ── incremental stores (S4, J9, S6) ──────────────────────────────────────────

@register("q_embed_upsert", """
SELECT vec_id, label, CASE WHEN label < 5 THEN embedding[1]::DOUBLE ELSE -embedding[1]::DOUBLE END AS first, CASE WHEN label < 5 THEN 0 ELSE 1 END AS epoch FROM embeddings""")
def q_embed_upsert(spark, sf):
    """A vector store in two epochs: first the labels below 5, then all rows with the sign turned, of which only the keys that
    the store lacks are appended; read back after compaction."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    kept = store.KeyedStore(spark, os.path.join(scratch_path(spark, f"vectors-{uuid.uuid4().hex}"), "store"), "vec_id")
    kept.append(e.where("label < 5"), 0)
    kept.append(e.withColumn("vector", F.transform("vector", lambda x: -x)), 1)
    kept.compact()
    return kept.read().select("vec_id", "label", F.get("vector", F.lit(0)).alias("first"), F.col("epoch").cast("int").alias("epoch"))


# ── latency (A8) ─────────────────────────────────────────────────────────────

_US = "CAST(round(value * 1000) AS BIGINT)"


@register("q_latency_quantiles", f"""
WITH b AS (SELECT event_type AS layer, CAST(ts AS DATE) AS day, {sketch.bucket_sql(_US)} AS bucket, count(*) AS n, count(*) FILTER ({_US} < 100000) AS fast FROM events GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY layer, day ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY layer, day) AS total FROM b)
SELECT layer, day, CAST(max(total) AS BIGINT) AS n, CAST(sum(fast) AS BIGINT) AS n_fast,
       min(CASE WHEN 2 * upto >= total THEN bucket END) AS p50_us, min(CASE WHEN 100 * upto >= 95 * total THEN bucket END) AS p95_us,
       min(CASE WHEN 100 * upto >= 99 * total THEN bucket END) AS p99_us
FROM c GROUP BY layer, day""")
def q_latency_quantiles(spark, sf):
    """Exact counts (all, and under 100 ms) and quantiles from a mergeable sketch, by layer and day; the days' sketches come
    from the hours' ones."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("layer"), F.date_trunc("hour", "ts").alias("hour"), F.round(F.col("value") * 1000).cast("long").alias("us"))
    hours = sketch.of(e, ["layer", "hour"], "us", {"fast": F.col("us") < 100_000})
    days = sketch.merged(hours, ["layer", F.to_date("hour").alias("day")], ["fast"])
    q = sketch.quantiles(days, ["layer", "day"], {"p50_us": (1, 2), "p95_us": (95, 100), "p99_us": (99, 100)}, ["fast"])
    return q.select("layer", "day", "n", F.col("fast").alias("n_fast"), "p50_us", "p95_us", "p99_us")


_BURSTS_SQL = """
WITH o AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_ok, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us,
       CASE WHEN count(*) = count(*) FILTER (event_type <> 'error') THEN CASE WHEN (epoch_us(max(ts)) - epoch_us(min(ts))) / count(*) < 1000 * 150 THEN 10 ELSE 8 END ELSE 0 END AS points
FROM s GROUP BY user_id, k"""


@register("q_bursts", _BURSTS_SQL)
def q_bursts(spark, sf):
    """Bursts: a user's events with gaps under an hour, their successes, throughput and points."""
    return EV.bursts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", F.col("event_type") != "error", "1 hour")


@register("q_final_score", f"""
WITH {G._EVAL_SQL},
b AS (SELECT points FROM ({_BURSTS_SQL}) ORDER BY n DESC, n_ok DESC, user_id, start_us LIMIT 1)
SELECT CAST(sum(weight) AS BIGINT) AS total_weight, CAST(sum(CASE WHEN passed THEN weight ELSE 0 END) AS BIGINT) AS earned,
       CAST((SELECT points FROM b) AS INTEGER) AS burst_points,
       round(CAST(sum(CASE WHEN passed THEN weight ELSE 0 END) AS DOUBLE) / sum(weight) * {R.EVAL_FUNCTIONAL_POINTS} + (SELECT points FROM b), 1) AS score
FROM ev""")
def q_final_score(spark, sf):
    """The earned share of all cases, and the points of the largest burst of all events."""
    top = q_bursts(spark, sf).orderBy(F.desc("n"), F.desc("n_ok"), "user_id", "start_us").limit(1).first()
    ok, mean = (top["n"] == top["n_ok"], top["span_us"] / top["n"] / 1000) if top else (False, 0.0)
    return EV.final_score(G._eval_results(spark, sf), F.lit(ok), F.lit(mean))
