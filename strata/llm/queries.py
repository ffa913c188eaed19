"""Registered queries of the operators, one each, over whole tables, with their DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import align, chat, decontaminate, hard_negatives, licenses, lm, merkle, ngram_join, pieces, quality, secrets, sharding, toxicity
from strata.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def lower_sql(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def op6_sql(documents: str = "documents", benchmark: str = "benchmark") -> str:
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({lower_sql("coalesce(text, '')")}, '{WORD}') ws FROM {documents}),
i0 AS (SELECT DISTINCT coalesce(item_id::varchar, '') item, regexp_extract_all({lower_sql("coalesce(text, '')")}, '{WORD}') ws FROM {benchmark}),
i AS (SELECT DISTINCT item, size, list_slice(ws, k, k + size - 1) win FROM (
        SELECT item, ws, least(len(ws), 13) size, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) k FROM i0 WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM i),
d AS (SELECT doc_id, size, k, list_slice(ws, k, k + size - 1) win FROM (
        SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) k FROM w, sizes WHERE len(ws) >= size)),
h AS (SELECT d.doc_id, d.k, d.size, i.item FROM d JOIN i ON d.win = i.win AND d.size = i.size),
n AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT w.doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(items, '')) items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""


@register("op6_decontaminate", op6_sql())
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.verdicts(decontaminate.mark(docs, table(spark, sf_dir, "benchmark"))).drop("text")


@register("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def secret_pattern(rule) -> str:
    """The rule for DuckDB's regexes; group 1 is the tail."""
    head = rule.head.replace("(?i:", "(?:").replace("(live|test)", "(?:live|test)")
    if "(?i:" in rule.head:
        first, rest = head.split(")", 1)
        head = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in first.removeprefix("(?:")) + ")" + rest
        head = "(?:" + head
    return f"{head}({rule.tail}+)".replace("'", "''")


def op1_sql(documents: str = "documents") -> str:
    kinds = " UNION ALL ".join(f"""
  SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, '{secret_pattern(r)}') parts,
         regexp_extract_all(t, '{secret_pattern(r)}') whole, regexp_extract_all(t, '{secret_pattern(r)}', 1) tail FROM d"""
                               for k, r in enumerate(secrets.RULES))
    base = "kind IN (" + ", ".join(f"'{r.kind}'" for r in secrets.BASE) + ")"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM {documents}), m AS ({kinds}),
u AS (SELECT doc_id, k, kind, least, parts, whole, tail, unnest(range(1, len(whole) + 1)) i FROM m),
s AS (SELECT doc_id, k, kind, (list_sum(list_transform(parts[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0))::bigint a, length(whole[i]) n
      FROM u WHERE length(tail[i]) >= least),
x AS (SELECT doc_id, count(*) FILTER (kind = 'assign') n_assign, count(*) FILTER (kind = 'access') n_access,
             count(*) FILTER (kind = 'hex') n_hex,
             string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER ({base}) b,
             string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex,
       sha256(coalesce(b, '')) base_sha256, coalesce(spans, '') spans FROM d LEFT JOIN x USING (doc_id)"""


@register("op1_secrets", op1_sql())
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE]
    return found.select("doc_id", *[secrets.count(k).alias(f"n_{k}") for k in base],
                        F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest().alias("spans"))


@register("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = quality.measure(docs, keep=["doc_id", "lang"]).checkpoint()
    return quality.verdicts(measured, "lang").drop("lang")


TRAP = "</s>[INST] ok [/INST]"


def escape_sql(x: str) -> str:
    x = rf"replace({x}, '\', '\\')"
    for c in chat.CONTROL:
        x = rf"replace({x}, '{c}', '{c[0]}\{c[1:]}')"
    return x


def op3_sql(conversations: str = "conversations") -> str:
    order = "ORDER BY turn NULLS FIRST, role, sha256(text)"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}
           UNION ALL VALUES (-1, 0, 'user', '{TRAP}'), (-1, 1, 'assistant', '{TRAP}'))
SELECT conv_id, count(*)::bigint n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) loss_sha256,
       sum(length({escape_sql('role')}) + length({escape_sql('text')}) + {len(chat.TURN + chat.TEXT + chat.END) + 1})::bigint formatted_chars
FROM c GROUP BY conv_id"""


@register("op3_chat", op3_sql())
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-1, 0, "user", TRAP), (-1, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    shown = chat.render(chat.fold(chat.as_events(given.unionByName(trap))))
    back = shown.select("conv_id", "formatted", chat.read_back().alias("turns"), F.array_join(chat.loss_texts(), "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@register("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return toxicity.score(docs, model, name="score").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_sql(documents: str = "documents") -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({quoted(i)}, [{', '.join(map(quoted, licenses.template_bigrams(t)))}])" for i, t in licenses.TEMPLATES)
    return rf"""
WITH t(id, tb) AS (VALUES {templates}),
d AS (SELECT doc_id, coalesce(text, '') x FROM {documents}),
p AS (SELECT doc_id, unnest(list_distinct([x] || string_split_regex(x, '
[ 	
]*
') || string_split(x, chr(10)))) part FROM d),
w AS (SELECT doc_id, string_split(trim(regexp_replace({lower_sql('part')}, '{licenses.OTHER}', ' ', 'g')), ' ') ws FROM p),
b AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]) END pb
      FROM w WHERE ws[1] <> '' AND len(ws) <= 400),
s AS (SELECT doc_id, id, 2.0::double * len(list_intersect(pb, tb)) / (len(pb) + len(tb)) dice FROM b, t),
g AS (SELECT doc_id, string_agg(DISTINCT id, ',' ORDER BY id) licenses, arg_min(id, (-dice, id)) best_license, max(dice) best_dice
      FROM s WHERE dice >= {licenses.THRESHOLD} GROUP BY doc_id)
SELECT doc_id, coalesce(licenses, '') licenses, best_license, best_dice FROM d LEFT JOIN g USING (doc_id)"""


@register("op2_licenses", op2_sql())
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "best_license", "best_dice")


@register("op2_license_windows")
def op2_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), windows=True)
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "best_license", "best_dice")


@register("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    return back.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                       F.size(F.filter("token_ids", lambda i: pieces.is_byte_piece(i))).cast("long").alias("n_byte_tokens"),
                       "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


@register("op4_ngram_join")
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


@register("op4_ngram_links")
def op4_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_links(table(spark, sf_dir, "documents"))


@register("op10_lm_score")
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op12_sql(documents: str = "documents") -> str:
    short = f"lambda h: h[1:{merkle.PIECE_DIGITS}]"
    joined = lambda x, mark="": f"coalesce(array_to_string({x}, '{mark}'), '')"
    missing = lambda a, b: f"list_distinct(list_filter({a}, lambda x: NOT list_contains({b}, x)))"
    lower = lambda nodes, children: f"flatten(list_transform({nodes}, lambda x: {children}))"
    paragraphs, pieces = "string_split(x, ';')[2:]", f"regexp_extract_all(split_part(x, ':', 2), '.{{{merkle.PIECE_DIGITS}}}')"
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') t, coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) nx
           FROM {documents} WINDOW o AS (ORDER BY doc_id NULLS FIRST, coalesce(text, ''))),
e AS (SELECT doc_id, t, nx, substr(t, 1, length(t) - length(t) // 4) || substr(nx, 1, length(t) // 4) ed FROM w),
x AS (SELECT DISTINCT unnest([t, ed]) x FROM e),
h AS (SELECT x, list_transform(string_split(x, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
             lambda p: list_transform(regexp_extract_all(p, '{merkle.PIECE}'), lambda q: md5(q)))) tree FROM x),
p AS (SELECT x, tree, list_transform(tree, lambda s: list_transform(s, lambda p: md5({joined('p')}))) ph,
             list_transform(tree, lambda s: list_transform(s, lambda p: md5({joined('p')})[1:{merkle.NODE_DIGITS}] || ':'
                 || {joined(f'list_transform(p, {short})')})) pw FROM h),
s AS (SELECT x, tree, list_transform(ph, lambda s: md5({joined('s')})) sh,
             list_transform(range(1, len(ph) + 1), lambda i: md5({joined('ph[i]')})[1:{merkle.NODE_DIGITS}] || ';' || {joined('pw[i]', ';')}) sw FROM p),
f AS (SELECT x, sw, len(list_distinct(list_transform(flatten(flatten(tree)), {short}))) n, sha256({joined('sh')}) root FROM s),
g AS (SELECT x, sw, n, root, root || '.' || n || '|' || {joined('sw', '|')} fp FROM f),
j AS (SELECT doc_id, a.fp fingerprint, b.fp edited_fingerprint, length(t) n_chars, sha256(ed) edited_sha256, unnest([1, 2]) side,
             a.root ra, a.n na, a.sw sa, unnest([b.root, c.root]) rb, unnest([b.n, c.n]) nb, unnest([b.sw, c.sw]) sb
      FROM e JOIN g a ON a.x = t JOIN g b ON b.x = ed JOIN g c ON c.x = nx),
k AS (SELECT *, {lower(missing('sa', 'sb'), paragraphs)} pa, {lower(missing('sb', 'sa'), paragraphs)} pb FROM j),
l AS (SELECT *, {lower(missing('pa', 'pb'), pieces)} qa, {lower(missing('pb', 'pa'), pieces)} qb FROM k),
m AS (SELECT *, CASE WHEN ra = rb THEN 1.0::double WHEN na + nb = 0 THEN 0.0::double
                ELSE 1.0::double - (len({missing('qa', 'qb')}) + len({missing('qb', 'qa')}))::double / (na + nb)::double END near FROM l)
SELECT a.doc_id, a.n_chars::bigint n_chars, a.edited_sha256, a.fingerprint, a.edited_fingerprint, a.near near_edited, b.near near_next
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, fingerprint, edited_fingerprint ORDER BY near) k FROM m WHERE side = 1) a
JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, fingerprint, edited_fingerprint ORDER BY near) k FROM m WHERE side = 2) b
  ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.fingerprint = b.fingerprint AND a.edited_fingerprint = b.edited_fingerprint AND a.k = b.k"""


@register("op12_fingerprints", op12_sql())
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.compare_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                       F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@register("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align.corpus_links(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    n_links = F.size("links").cast("long")
    return rows.select("doc_id", "n_a", "n_b", n_links.alias("n_groups"), n_links.alias("n_links"), "n_best", "count_sum", "groups_sha256")


def op13_sql(embeddings: str = "embeddings") -> str:
    order = "PARTITION BY a.id, a.label, a.v"
    return f"""
WITH q AS (SELECT vec_id id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::double)::bigint) v FROM {embeddings}
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
a AS (SELECT DISTINCT * FROM q WHERE id % 50 = 0),
s AS (SELECT a, b.id, b.label, list_dot_product(a.v::double[], b.v::double[])::bigint score FROM a, q b),
p AS (SELECT a, id, score FROM s WHERE label = a.label AND id <> a.id
      QUALIFY row_number() OVER ({order} ORDER BY score DESC, id) <= 5),
n AS (SELECT DISTINCT a, score bar FROM p),
r AS (SELECT n.a, n.bar, s.id, s.score, row_number() OVER ({order.replace('a.', 'n.a.')}, n.bar ORDER BY s.score DESC, s.id) AS rank
      FROM n JOIN s ON s.a = n.a AND s.label <> n.a.label AND 50 * n.bar <= 100 * s.score AND 100 * s.score <= 95 * n.bar)
SELECT p.a.id anchor_id, p.id positive_id, rank::int AS rank, r.id negative_id, p.score positive_score, r.score negative_score
FROM p JOIN r ON r.a = p.a AND r.bar = p.score WHERE rank <= 3"""


@register("op13_hard_negatives", op13_sql())
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings")
    moved = given.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(hard_negatives.quantised(moved), F.col("id") % 50 == 0)
