"""Column functions on code text: regex dialect, lines, comments, strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions.issue_texts import ISSUE_TEXTS

# The characters that count as white space, and the line breaks.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
              "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
LINE_BREAKS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def rx(pattern: str, flags: str = "") -> str:
    """Python pattern to Java dialect: Unicode classes, ``\\n`` the only line end."""
    return f"(?dU{flags})" + pattern.replace(r"\s", r"[\s\x1c-\x1f]")


def has(col: Column, pattern: str, flags: str = "", words: tuple = ()) -> Column:
    """Does the pattern occur? ``words``: plain text, one of which each match holds.

    The search for plain text is far cheaper and settles most lines.
    """
    found = col.rlike(rx(pattern, flags))
    return contains_any(col, words) & found if words else found


def hits(col: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(col, F.lit(rx(pattern, flags)))


def group(col: Column, pattern: str, idx: int) -> Column:
    return F.regexp_extract(col, rx(pattern), idx)


def groups(col: Column, pattern: str, idx: int, flags: str = "") -> Column:
    return F.regexp_extract_all(col, F.lit(rx(pattern, flags)), F.lit(idx))


def by_language(language: Column, values: dict, fn, default: Column) -> Column:
    """``fn(values[language])`` picked by language, ``default`` for the others."""
    out = None
    for lang, value in values.items():
        cond = language == lang
        out = F.when(cond, fn(value)) if out is None else out.when(cond, fn(value))
    return out.otherwise(default)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def occurrences(col: Column, needle: str) -> Column:
    """How often a one-character string occurs."""
    return F.length(col) - F.length(F.replace(col, F.lit(needle), F.lit("")))


def _one_break_kind(col: Column) -> Column:
    return F.regexp_replace(col, LINE_BREAKS, "\n")


def split_lines(col: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    text = F.regexp_replace(_one_break_kind(col), r"\n\z", "")
    return F.when(col == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def line_count(col: Column) -> Column:
    text = _one_break_kind(col)
    breaks = occurrences(text, "\n")
    return F.when(col == "", 0).otherwise(breaks + F.when(text.endswith("\n"), 0).otherwise(1))


def strip_c_comments(col: Column) -> Column:
    """Drop ``/* */`` with the line ends inside, then ``//`` to the line end (also in strings)."""
    # An opening mark after the last closing one stays, so the pattern need not look for its end in vain.
    closed = F.when(F.contains(col, F.lit("*/")), F.length(col) - F.instr(F.reverse(col), "/*") + 1).otherwise(0)
    blocks = F.regexp_replace(F.substr(col, F.lit(1), closed), r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(F.concat(blocks, F.substr(col, closed + 1)), r"//[^\n]*", "")


def blank_strings(col: Column) -> Column:
    """Empty quoted text, keeping the quotes; an open string keeps its first quote only."""
    return F.regexp_replace(col, r"""(["'])(?:(?!\1)[^\\]|\\[\s\S]?)*+(\1?)""", "$1$2")


def lookup(col: Column, table: dict) -> Column:
    """Literal map lookup, null when absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col)


def contains_any(col: Column, words) -> Column:
    out = None
    for word in words:
        out = col.contains(word) if out is None else out | col.contains(word)
    return out


def issue_name(rule: str) -> Column:
    return F.lit(ISSUE_TEXTS[rule][0])


def issue_fix(rule: str, *args) -> Column:
    """Fix text with ``{0}``, ``{1}`` ... filled from columns."""
    text = ISSUE_TEXTS[rule][1]
    if not args:
        return F.lit(text)
    parts = re.split(r"\{(\d)\}", text)
    return F.concat(*[
        (args[int(p)].cast("string") if i % 2 else F.lit(p)) for i, p in enumerate(parts) if p
    ])
