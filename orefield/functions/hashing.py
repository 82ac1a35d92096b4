"""Exact big-integer hashing with 64-bit arithmetic, and bit helpers.

A string stands for the big-endian integer X of its UTF-8 bytes. Since ``(a*X + b) % m = (a * (X % m) + b) % m``, and X % m is a fold over
groups of four bytes, no big integer is needed; for m below 2**31 nothing overflows.
"""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

_M31 = 1 << 31


def bytes_mod(text: Column, m: int) -> Column:
    """The integer of the UTF-8 bytes of ``text``, modulo ``m``; 0 for the empty string, null for null."""
    if not 1 < m < _M31:
        raise ValueError("m must be in 2..2**31 - 1")
    groups = F.ceil(F.octet_length(text) / 4).cast("int")
    hexed = F.lpad(F.hex(F.encode(text, "UTF-8")), groups * 8, F.lit("0"))  # zeros in front leave the integer as it is
    places = F.when(groups > 0, F.sequence(F.lit(1), groups)).otherwise(F.array().cast("array<int>"))
    step = lambda acc, i: F.pmod(acc * (1 << 32) + F.conv(F.substring(hexed, i * 8 - 7, F.lit(8)), 16, 10).cast("long"), F.lit(m))
    return F.when(text.isNotNull(), F.aggregate(places, F.lit(0).cast("long"), step))


def linear_hash(x: Column, a: int, b: int, m: int) -> Column:
    """``(a * x + b) % m``."""
    return F.pmod(F.lit(a).cast("long") * x + F.lit(b).cast("long"), F.lit(m).cast("long"))


def coefficients(n: int, m: int, seed: int) -> tuple[list[int], list[int]]:
    """``n`` pairs of coefficients below ``m`` from a seed; a is never 0."""
    rng = random.Random(seed)
    return [rng.randint(1, m - 1) for _ in range(n)], [rng.randint(0, m - 1) for _ in range(n)]


def trailing_zeros(v: Column) -> Column:
    """Zeros at the end of the binary text of ``v``; the text of 0 is a single 0."""
    v = v.cast("long")
    return F.when(v == 0, F.lit(1)).otherwise(F.bit_count(v.bitwiseAND(-v) - 1)).cast("int")


def seeded_number(seed: int, *parts: Column) -> Column:
    """A number in 0 .. 2**32 - 1 from the first eight hex digits of an md5 of seed and parts, the same in any SQL engine."""
    text = F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
