"""Several values packed in one field: a quote-aware finite-state tokenizer.

States: *outside* (between delimiters), *quoted* (inside a quoted value) and a nesting depth for brackets. Plain text between
special characters is skipped by one compiled pattern, so the cost follows the special characters, not the length.

Rules
-----
- Delimiters outside quotes: ``, ; |``, the bullet, tab and line breaks; a slash only with blanks (or an end) on both sides.
- A quote opens only at the start of a value and closes only before a delimiter, a closing bracket or the end. Any other
  quote is an ordinary character (apostrophes). A quote that never closes is an ordinary character too.
- Inside quotes a doubled quote stands for one, and a backslash escapes the next character (``\\n \\t \\r \\uXXXX`` as in JSON).
- Outside quotes a backslash makes the next character ordinary.
- ``[`` at the start of a value opens a list, whose elements are values of the field; ``]`` before a delimiter or the end closes
  it. Parentheses within a value nest: a delimiter inside them belongs to the value. Unbalanced brackets are ordinary.
- Values are trimmed; empty ones are dropped and not counted.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = ",;|•\t\n\r"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

_SPECIAL = re.compile("[" + re.escape(DELIMITERS + "".join(QUOTES) + "\\/[]()") + "]")
_ENDS = re.compile(r"\s*(?:[" + re.escape(DELIMITERS + "]") + r"]|/(?=\s|$)|$)")
_HEX = re.compile(r"[0-9A-Fa-f]{4}")


_STOPS = {close: re.compile("[" + re.escape("\\" + close) + "]") for close in QUOTES.values()}


def _quoted(text: str, at: int, close: str, dead: set[int]) -> tuple[str, int] | None:
    """The quoted value whose opening quote stands before ``at`` and the place after its closing quote; None if unclosed.

    ``dead``: places of ``close`` and backslashes from which an earlier search in this text found no end. A search that comes to one ends
    there, so all searches together pass a text once.
    """
    parts: list[str] = []
    passed: list[int] = []
    n, i = len(text), at
    while m := _STOPS[close].search(text, i):
        parts.append(text[i : m.start()])
        i, c = m.start(), m.group()
        if i in dead:
            break
        passed.append(i)
        if c == "\\" and i + 1 < n:
            follow = text[i + 1]
            if follow == "u" and (m := _HEX.match(text, i + 2)):
                parts.append(chr(int(m.group(), 16)))
                i += 6
                continue
            parts.append(ESCAPES.get(follow, follow))
            i += 2
        elif c == close:
            if text.startswith(close, i + 1) and close in "\"'":
                parts.append(close)
                i += 2
            elif _ENDS.match(text, i + 1):
                return "".join(parts), i + 1
            else:
                parts.append(c)
                i += 1
        else:
            parts.append(c)
            i += 1
    dead.update(passed)
    return None


def split_field(text: str | None) -> list[str]:
    """The values packed in ``text``, in order; an empty list for null or when there is none."""
    if text is None:
        return []
    values: list[str] = []
    buffer: list[str] = []
    n, i, lists, parens = len(text), 0, 0, 0
    last_list, last_paren = text.rfind("]"), text.rfind(")")
    dead: dict[str, set[int]] = {}

    def fresh() -> bool:
        return not any(map(str.strip, buffer))

    def flush() -> None:
        value = "".join(buffer).strip()
        buffer.clear()
        if value:
            values.append(value)

    while i < n:
        m = _SPECIAL.search(text, i)
        if m is None:
            buffer.append(text[i:])
            break
        if m.start() > i:
            buffer.append(text[i : m.start()])
        c, i = m.group(), m.end()
        if c == "\\":
            buffer.append(text[i : i + 1] or c)
            i += 1
        elif c in QUOTES and fresh() and (found := _quoted(text, i, QUOTES[c], dead.setdefault(QUOTES[c], set()))) is not None:
            buffer.clear()
            buffer.append(found[0])
            i = found[1]
        elif c == "[" and fresh() and last_list >= i:
            buffer.clear()
            lists += 1
        elif c == "]" and lists and _ENDS.match(text, i):
            flush()
            lists -= 1
        elif c == "(" and last_paren >= i:
            parens += 1
            buffer.append(c)
        elif c == ")" and parens:
            parens -= 1
            buffer.append(c)
        elif c == "/" and not parens:
            before = not buffer or buffer[-1][-1:].isspace() or buffer[-1] == ""
            if before and (i >= n or text[i].isspace()):
                flush()
            else:
                buffer.append(c)
        elif c in DELIMITERS and not parens:
            flush()
        else:
            buffer.append(c)
    flush()
    return values


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_field_udf(fields: pd.Series) -> pd.Series:
    """``split_field`` over Arrow batches; equal fields of a batch are split once."""
    known: dict[str, list[str]] = {}

    def split(text: str | None) -> list[str]:
        if text is None:
            return []
        if text not in known:
            known[text] = split_field(text)
        return known[text]

    return fields.map(split, na_action=None)


def split_packed(df: DataFrame, field: str, keep: list[str], pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per value of ``field``: the ``keep`` columns, its place (INT, from 1) and the value.

    Narrow: no exchange. Rows whose field is null or holds no value yield no row; repeats stay. Only ``keep`` and ``field`` are
    read, so other columns may have any name; a ``keep`` column named like an output raises.
    """
    if {pos, value} & set(keep):
        raise ValueError(f"keep clashes with the output columns {pos!r}, {value!r}")
    parts = df.select(*keep, split_field_udf(F.col(field)).alias("__values"))
    out = parts.select(*keep, F.posexplode("__values").alias("__pos", "__value"))
    return out.select(*keep, (F.col("__pos") + 1).cast("int").alias(pos), F.col("__value").alias(value))
