"""Text expressions. ``strip`` and ``split`` keep the semantics of the reference workload: all white space, empty tokens kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters removed from a text before it is cut at blanks.
PUNCTUATION = "([,.!?:;])"


def year_of(date: Column) -> Column:
    """The first four characters of a date string."""
    return F.substring(date, 1, 4)


def now_text(pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """The time at which the query began, formatted; the end of a window serves better where results must be the same again."""
    return F.date_format(F.current_timestamp(), pattern)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def clean_lower(text: Column) -> Column:
    """Lower case, without the ten punctuation characters."""
    return F.translate(F.lower(text), PUNCTUATION, "")


def blank_tokens(text: Column) -> Column:
    """Cut at single blanks; empty tokens stay, line breaks stay inside tokens."""
    return F.split(text, " ")


def list_values(text: Column) -> Column:
    """Cut at commas, each value stripped."""
    return F.transform(F.split(text, ","), lambda v: strip(v))


def hashtag_texts(entities: Column) -> Column:
    """The ``text`` of each element of ``entities.hashtags``."""
    return F.transform(entities["hashtags"], lambda h: h["text"])
