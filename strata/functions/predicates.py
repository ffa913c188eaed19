"""Gate predicates of the cascade (F1-F10) as Spark columns and DuckDB SQL twins.

``mode="compat"`` keeps the reference's substring semantics (so "orm" blocks
"information"); ``mode="strict"`` matches whole words instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata import rules
from strata.functions import text as T
from strata.functions.regex import WS, alt, esc, sql_str, word_bounded


def _any(cols) -> Column:
    cols = list(cols)
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def any_contains(t: Column, phrases, mode: str = "compat") -> Column:
    if mode == "strict":
        return t.rlike(word_bounded(phrases)) if phrases else F.lit(False)
    return _any(t.contains(p) for p in phrases)


def any_contains_sql(t: str, phrases, mode: str = "compat") -> str:
    if not phrases:
        return "FALSE"
    if mode == "strict":
        return f"regexp_matches({t}, {sql_str(word_bounded(phrases))})"
    return "(" + " OR ".join(f"contains({t}, {sql_str(p)})" for p in phrases) + ")"


# F1 greeting gate: equals a greeting, or starts with greeting + " ".
def _canon(col, canonical):
    return canonical if canonical is not None else T.canon(col)


def greeting_text(col, canonical: Column | None = None) -> Column:
    return T.rstrip_chars(_canon(col, canonical), "?!.")


def greeting_text_sql(e: str) -> str:
    return T.rstrip_chars_sql(T.canon_sql(e), "?!.")


# F2 fact text: lower(strip(text)).rstrip('?'); facts are substrings of it.
def fact_text(col, canonical: Column | None = None) -> Column:
    return T.rstrip_chars(_canon(col, canonical), "?")


def fact_text_sql(e: str) -> str:
    return T.rstrip_chars_sql(T.canon_sql(e), "?")


# F3 conversion gate: a cue AND any unit name as substrings of lower(strip(text)).
def conversion_gate(col, canonical: Column | None = None) -> Column:
    # lower(strip(x)) equals strip(lower(x)), the canonical text
    t = _canon(col, canonical)
    return any_contains(t, rules.CONVERSION_CUES) & any_contains(t, rules.conversion_units())


def conversion_gate_sql(e: str) -> str:
    t = f"lower({T.py_strip_sql(e)})"
    return f"({any_contains_sql(t, rules.CONVERSION_CUES)} AND {any_contains_sql(t, rules.conversion_units())})"


# F4 math gate.
_FUNC_RE = word_bounded(rules.MATH_FUNCS)
_DIGIT_RE = r"\p{Nd}"
_OP_RE = r"[+\-*/^%()=]"
_WORD_OP_RE = f"(?:^|{WS}){alt(rules.MATH_WORD_OPS)}(?:{WS}|\\z)"


def math_gate(col, canonical: Column | None = None) -> Column:
    t = T.math_strip(col, canonical)
    has_func = t.rlike(_FUNC_RE) | _any(t.contains(s) for s in rules.MATH_SHORTHAND)
    has_digit = t.rlike(_DIGIT_RE)
    has_op = t.rlike(_OP_RE)
    has_word_op = t.rlike(_WORD_OP_RE)
    has_xyz = t.rlike("[xyz]")
    return has_func | (has_digit & (has_op | has_word_op)) | (has_word_op & (has_digit | has_xyz))


def math_gate_sql(e: str) -> str:
    t = T.math_strip_sql(e)
    has_func = f"(regexp_matches({t}, {sql_str(_FUNC_RE)}) OR {any_contains_sql(t, rules.MATH_SHORTHAND)})"
    has_digit = f"regexp_matches({t}, {sql_str(_DIGIT_RE)})"
    has_op = f"regexp_matches({t}, {sql_str(_OP_RE)})"
    has_word_op = f"regexp_matches({t}, {sql_str(_WORD_OP_RE)})"
    has_xyz = f"regexp_matches({t}, '[xyz]')"
    return f"({has_func} OR ({has_digit} AND ({has_op} OR {has_word_op})) OR ({has_word_op} AND ({has_digit} OR {has_xyz})))"


# F5 general-knowledge gate.
_GK_OPS_RE = "[" + esc(rules.GK_OPERATOR_CHARS).replace("-", "\\-").replace("0123456789", "\\p{Nd}") + "]"


def gk_parts(col, mode: str = "compat", stripped: Column | None = None):
    """(deny, trigger, short_entity) columns; gate = !deny AND (trigger OR short_entity).

    ``stripped``: precomputed rstrip(canon(text), '?.!')."""
    t = stripped if stripped is not None else T.rstrip_chars(T.canon(col), "?.!")
    deny = any_contains(t, rules.DOMAIN_KEYWORDS, mode)
    trig = any_contains(t, rules.GK_TRIGGERS, mode)
    n = T.word_count(t)
    short = (n >= 1) & (n <= 5) & ~t.rlike(_GK_OPS_RE)
    return deny, trig, short


def gk_gate(col, mode: str = "compat", stripped: Column | None = None) -> Column:
    deny, trig, short = gk_parts(col, mode, stripped)
    return ~deny & (trig | short)


def gk_gate_sql(e: str, mode: str = "compat") -> str:
    t = T.rstrip_chars_sql(T.canon_sql(e), "?.!")
    n = T.word_count_sql(t)
    deny = any_contains_sql(t, rules.DOMAIN_KEYWORDS, mode)
    trig = any_contains_sql(t, rules.GK_TRIGGERS, mode)
    short = f"({n} BETWEEN 1 AND 5 AND NOT regexp_matches({t}, {sql_str(_GK_OPS_RE)}))"
    return f"(NOT {deny} AND ({trig} OR {short}))"


def gk_reason(col, mode: str = "compat") -> Column:
    deny, trig, short = gk_parts(col, mode)
    return F.when(deny, "deny").when(trig, "trigger").when(short, "entity").otherwise("none")


def gk_reason_sql(e: str, mode: str = "compat") -> str:
    t = T.rstrip_chars_sql(T.canon_sql(e), "?.!")
    n = T.word_count_sql(t)
    deny = any_contains_sql(t, rules.DOMAIN_KEYWORDS, mode)
    trig = any_contains_sql(t, rules.GK_TRIGGERS, mode)
    short = f"({n} BETWEEN 1 AND 5 AND NOT regexp_matches({t}, {sql_str(_GK_OPS_RE)}))"
    return f"CASE WHEN {deny} THEN 'deny' WHEN {trig} THEN 'trigger' WHEN {short} THEN 'entity' ELSE 'none' END"


# F6 technical exclusion of the keyword classifier.
_EXCL_RE = word_bounded(rules.KEYWORD_EXCLUSIONS)
EXCLUSION_RE = _EXCL_RE


def technical_exclusion(col, canonical: Column | None = None) -> Column:
    return _canon(col, canonical).rlike(_EXCL_RE)


def technical_exclusion_sql(e: str) -> str:
    return f"regexp_matches({T.canon_sql(e)}, {sql_str(_EXCL_RE)})"


# F9 deep-model trigger.
def deep_trigger(col, canonical: Column | None = None) -> Column:
    p = _canon(col, canonical)
    return any_contains(p, rules.DEEP_TRIGGERS) | (T.word_count(p) > rules.DEEP_WORD_LIMIT)


def deep_trigger_sql(e: str) -> str:
    p = T.canon_sql(e)
    return f"({any_contains_sql(p, rules.DEEP_TRIGGERS)} OR {T.word_count_sql(p)} > {rules.DEEP_WORD_LIMIT})"


# F8 surrogate predicate (defined by the reference, unused by its router).
def should_use_surrogate(confidence, alpha) -> Column:
    return F.col(confidence) >= F.col(alpha) if isinstance(confidence, str) else confidence >= alpha
