"""Regex fragments that behave the same in Java (Spark) and RE2 (DuckDB).

Python's ``\\w``, ``\\s`` and ``\\b`` are Unicode-aware while Java's and RE2's are
ASCII, so the classes are spelled out.  ``\\z`` is used for end of text because
Java's ``$`` also matches before a final line break.
"""

from __future__ import annotations

# Python's str.split()/strip() whitespace set.
WS_CHARS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{WS_CHARS}]"
NON_WS = f"[^{WS_CHARS}]"
WORD_CHARS = r"\p{L}\p{N}_"
WORD = f"[{WORD_CHARS}]"
NON_WORD = f"[^{WORD_CHARS}]"

_META = set("\\.^$*+?()[]{}|")


def esc(s: str) -> str:
    """Escape regex metacharacters (valid in both Java and RE2)."""
    return "".join("\\" + c if c in _META else c for c in s)


def alt(words) -> str:
    """Ordered alternation; Java and RE2 both prefer the leftmost alternative."""
    return "(?:" + "|".join(esc(w) for w in words) + ")"


def word_bounded(words) -> str:
    """Pattern matching any of ``words`` with Unicode word boundaries on both sides.

    Used only for existence tests (rlike), so consuming the boundary chars is fine.
    """
    return f"(?:^|{NON_WORD}){alt(words)}(?:{NON_WORD}|\\z)"


def sql_str(s: str) -> str:
    """DuckDB string literal (no backslash processing, quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_str(v) for v in values) + "]"
