"""Scalar text normalisation (column expressions, JVM-side).

Every function returns a Spark ``Column``; the ``*_sql`` twin returns the same
computation as a DuckDB SQL fragment so that the oracle in ``__spark_entry__``
is built from one specification.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata import rules
from strata.functions.regex import NON_WS, WORD, WORD_CHARS, WS, WS_CHARS, alt, esc, sql_str

_STRIP = f"^{WS}+|{WS}+\\z"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# P1 canonical key: lower().strip()
# Python's whitespace set as literal characters, for btrim/rtrim (no regex pass).
PY_WS_SET = ("\t\n\x0b\x0c\r" + "".join(chr(c) for c in range(0x1C, 0x20)) + " \x85\xa0\u1680"
             + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def canon(col) -> Column:
    return F.btrim(F.lower(_c(col)), F.lit(PY_WS_SET))


def canon_sql(e: str) -> str:
    return f"regexp_replace(lower({e}), {sql_str(_STRIP)}, '', 'g')"


def py_strip(col) -> Column:
    return F.btrim(_c(col), F.lit(PY_WS_SET))


def py_strip_sql(e: str) -> str:
    return f"regexp_replace({e}, {sql_str(_STRIP)}, '', 'g')"


# P2 trailing punctuation strip: rstrip(chars)
def rstrip_chars(col, chars: str) -> Column:
    return F.rtrim(_c(col), F.lit(chars))


def rstrip_chars_sql(e: str, chars: str) -> str:
    return f"regexp_replace({e}, {sql_str('[' + esc(chars) + ']+' + '\\z')}, '')"


# P3 topic extraction: remove the first strip phrase (list order) that prefixes the text.
_TOPIC_RE = "^" + alt(rules.STRIP_PHRASES)


def topic(col, canonical: Column | None = None) -> Column:
    t = rstrip_chars(canonical if canonical is not None else canon(col), "?.!")
    return F.when(t.rlike(_TOPIC_RE), py_strip(F.regexp_replace(t, _TOPIC_RE, ""))).otherwise(t)


def topic_sql(e: str) -> str:
    t = rstrip_chars_sql(canon_sql(e), "?.!")
    inner = f"regexp_replace({t}, {sql_str(_TOPIC_RE)}, '')"
    return f"CASE WHEN regexp_matches({t}, {sql_str(_TOPIC_RE)}) THEN {py_strip_sql(inner)} ELSE {t} END"


# P9 word count: len(text.split())
_TOKEN = f"{NON_WS}+"


def word_count(col) -> Column:
    return F.regexp_count(_c(col), F.lit(_TOKEN)).cast("long")


def word_count_sql(e: str) -> str:
    return f"CAST(len(regexp_extract_all({e}, {sql_str(_TOKEN)})) AS BIGINT)"


# P4 code-token normalisation used before shingling.
_CPP = f"(^|[^{WORD_CHARS}])c\\+\\+({WORD})"
_CSHARP = f"(^|[^{WORD_CHARS}])c#({WORD})"
_PUNCT = f"[^{WORD_CHARS}{WS_CHARS}]"


def code_normalize(col) -> Column:
    t = canon(col)
    for sign, pattern, to in (("c++", _CPP, "$1cpp$2"), ("c#", _CSHARP, "$1csharp$2")):  # only texts with the sign are searched
        t = F.when(t.contains(sign), F.regexp_replace(t, pattern, to)).otherwise(t)
    t = F.replace(F.replace(t, F.lit("++"), F.lit("pp")), F.lit("#"), F.lit("sharp"))
    return F.regexp_replace(t, _PUNCT, "")


def code_normalize_sql(e: str) -> str:
    t = canon_sql(e)
    t = f"regexp_replace({t}, {sql_str(_CPP)}, '\\1cpp\\2', 'g')"
    t = f"regexp_replace({t}, {sql_str(_CSHARP)}, '\\1csharp\\2', 'g')"
    t = f"replace(replace({t}, '++', 'pp'), '#', 'sharp')"
    return f"regexp_replace({t}, {sql_str(_PUNCT)}, '', 'g')"


# P6 character shingles: distinct code-point k-grams; shorter than k -> empty.
def shingles(col, k: int = rules.SHINGLE_K) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(col), F.lit(f"(?s)(?=(.{{{k}}})).") , F.lit(1)))


def shingles_sql(e: str, k: int = rules.SHINGLE_K) -> str:
    """List of distinct k-grams (order differs from Spark; compare as sets)."""
    return f"list_distinct(list_transform(range(1, length({e}) - {k} + 2), lambda i: substr({e}, CAST(i AS INTEGER), {k})))"


# P10 first number of a text as double.
_NUMBER = r"([0-9]+\.?[0-9]*)"


def first_number(col) -> Column:
    s = F.regexp_extract(_c(col), _NUMBER, 1)
    return F.when(s != "", s.cast("double"))


def first_number_sql(e: str) -> str:
    return f"CASE WHEN regexp_extract({e}, {sql_str(_NUMBER)}, 1) <> '' THEN CAST(regexp_extract({e}, {sql_str(_NUMBER)}, 1) AS DOUBLE) END"


# A double as Python prints it: the shortest digits, plain from 1e-4 to 1e16, at least one digit behind the point.
def shown_float(col) -> Column:
    v = _c(col)
    size = F.abs(v)
    plain = F.regexp_replace(F.regexp_replace(v.cast("decimal(38,22)").cast("string"), "0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.substring_index(v.cast("string"), "E", 1), r"\.0$", "")
    power = F.substring_index(v.cast("string"), "E", -1).cast("int")
    scientific = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when((size >= 1e-4) & (size < 1e16), plain).when(size == 0, "0.0").otherwise(scientific)


# P7 summary trim: first two pieces of split('. '), ensure a final '.'.
def summary_trim(col) -> Column:
    parts = F.split(_c(col), r"\. ", 3)
    s = py_strip(F.array_join(F.slice(parts, 1, 2), ". "))
    return F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit(".")))


def summary_trim_sql(e: str) -> str:
    s = py_strip_sql(f"array_to_string(string_split({e}, '. ')[1:2], '. ')")
    return f"CASE WHEN ends_with({s}, '.') THEN {s} ELSE {s} || '.' END"


# P8 disambiguation extract.
def disambiguation(summary, topic_col, title) -> Column:
    """If 'may refer to:' is in the first 80 chars: title + first 3 usable lines, else null."""
    s = _c(summary)
    t = _c(topic_col)
    keep = F.filter(F.split(s, "\n"), lambda l: (py_strip(l) != "") & ~F.startswith(F.lower(l), t) & ~F.lower(l).contains("refer to:"))
    body = F.array_join(F.transform(F.slice(keep, 1, 3), lambda l: py_strip(l)), "\n")
    is_dis = F.lower(F.substring(s, 1, 80)).contains("may refer to:")
    return F.when(is_dis & (F.size(keep) > 0), F.concat(F.lit("**"), _c(title), F.lit("**\n\n"), body))


def disambiguation_sql(s: str, t: str, title: str) -> str:
    keep = (f"list_filter(string_split({s}, chr(10)), "
            f"lambda l: {py_strip_sql('l')} <> '' AND NOT starts_with(lower(l), {t}) AND NOT contains(lower(l), 'refer to:'))")
    return (f"CASE WHEN contains(lower(substr({s}, 1, 80)), 'may refer to:') AND len({keep}) > 0 "
            f"THEN '**' || {title} || '**' || chr(10) || chr(10) || array_to_string(list_transform({keep}[1:3], lambda l: {py_strip_sql('l')}), chr(10)) END")


# P5 math word normalisation (operator words, shorthand functions).
def _math_trigger_re():
    follow = "[" + esc(rules.MATH_TRIGGER_FOLLOW).replace("-", "\\-") + "]"
    return "^" + alt(rules.MATH_TRIGGERS) + f"({follow})"


MATH_TRIGGER_RE = _math_trigger_re()
_SHORTHAND_RE = f"(^|[^{WORD_CHARS}])" + alt(rules.MATH_SHORTHAND_FUNCS).replace("(?:", "(", 1) + f"{WS}*([a-zA-Z0-9]+)([^{WORD_CHARS}]|\\z)"
_LN_RE = f"(^|[^{WORD_CHARS}])ln\\("


BACKREF1 = "'\\1'"


def math_strip(col, canonical: Column | None = None) -> Column:
    """lower/strip/rstrip('?'), then drop the first math trigger, then strip."""
    t = rstrip_chars(canonical if canonical is not None else canon(col), "?")
    return F.when(t.rlike(MATH_TRIGGER_RE), py_strip(F.regexp_replace(t, MATH_TRIGGER_RE, "$1"))).otherwise(t)


def math_strip_sql(e: str) -> str:
    t = rstrip_chars_sql(canon_sql(e), "?")
    return (f"CASE WHEN regexp_matches({t}, {sql_str(MATH_TRIGGER_RE)}) "
            f"THEN {py_strip_sql(f'regexp_replace({t}, {sql_str(MATH_TRIGGER_RE)}, {BACKREF1})')} ELSE {t} END")


def math_normalize(col) -> Column:
    t = py_strip(rstrip_chars(math_strip(col), "?"))
    for a, b in rules.MATH_WORD_REPLACEMENTS:
        t = F.replace(t, F.lit(a), F.lit(b))
    # The boundary characters are consumed, so adjacent hits need a second pass.
    for _ in range(2):
        t = F.regexp_replace(t, _SHORTHAND_RE, "$1$2($3)$4")
    for _ in range(2):
        t = F.regexp_replace(t, _LN_RE, "$1log(")
    return t


def math_normalize_sql(e: str) -> str:
    t = py_strip_sql(rstrip_chars_sql(math_strip_sql(e), "?"))
    for a, b in rules.MATH_WORD_REPLACEMENTS:
        t = f"replace({t}, {sql_str(a)}, {sql_str(b)})"
    for _ in range(2):
        t = f"regexp_replace({t}, {sql_str(_SHORTHAND_RE)}, '\\1\\2(\\3)\\4', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, {sql_str(_LN_RE)}, '\\1log(', 'g')"
    return t
