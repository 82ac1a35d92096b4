"""Bloom filter and Flajolet-Martin estimates with exact, seedable hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions.hashing import bytes_mod, linear_hash, trailing_zeros


def positions(key: Column, a: list[int], b: list[int], m: int) -> Column:
    """Bit positions of a key, one per coefficient pair; none for the empty string."""
    x = bytes_mod(key, m)
    hashed = F.array(*[linear_hash(x, i, j, m) for i, j in zip(a, b)])
    return F.when(F.octet_length(key) > 0, hashed).when(key.isNotNull(), F.array().cast("array<bigint>"))


def bloom_build(keys: DataFrame, key: str, a: list[int], b: list[int], m: int) -> DataFrame:
    """The set bits: distinct positions, at most ``m`` rows. Nulls are no keys."""
    distinct = keys.select(F.col(key).cast("string").alias("k")).where("k IS NOT NULL").distinct()
    return distinct.select(F.explode(positions(F.col("k"), a, b, m)).alias("position")).distinct()


def bloom_probe(probes: DataFrame, key: str, bits: DataFrame, a: list[int], b: list[int], m: int, empty_is_member: bool = True) -> DataFrame:
    """All columns of ``probes`` and ``predicted``: 1 if every position of the key is set, else 0; null keys give 0.

    The filter goes to every task as one array of at most ``m`` positions (m bounds it, not the data), and rows are tested in place: no
    exchange, duplicates and order kept. The empty string has no positions, so it passes unless ``empty_is_member`` is False.
    """
    filter_row = bits.agg(F.collect_set("position").alias("__bits"))
    at = positions(F.col(key).cast("string"), a, b, m)
    inside = F.size(F.array_except(at, F.col("__bits"))) == 0
    if not empty_is_member:
        inside = inside & (F.octet_length(key) > 0)
    return probes.crossJoin(F.broadcast(filter_row)).withColumn("predicted", F.coalesce(inside.cast("int"), F.lit(0))).drop("__bits")


def fm_maxima(x: Column, a: list[int], b: list[int], m: int) -> list[Column]:
    """One aggregate per hash function: the most trailing zeros for keys already reduced modulo ``m`` (``bytes_mod``).

    The maxima merge, so they also serve as streaming state.
    """
    return [F.max(trailing_zeros(linear_hash(x, i, j, m))).alias(f"z{k}") for k, (i, j) in enumerate(zip(a, b))]


def fm_estimate(n_hashes: int, groups: int) -> Column:
    """Median over groups of the mean of ``2 ** z`` inside a group, rounded half to even."""
    size = n_hashes // groups
    means = [sum((F.pow(F.lit(2.0), F.col(f"z{g * size + i}")) for i in range(size)), F.lit(0.0)) / size for g in range(groups)]
    ordered = F.array_sort(F.array(*means))
    middle = groups // 2
    median = F.get(ordered, F.lit(middle)) if groups % 2 else (F.get(ordered, F.lit(middle - 1)) + F.get(ordered, F.lit(middle))) / 2
    return F.bround(median, 0).cast("long")


def fm_windows(events: DataFrame, ts: str, key: str, window: str, slide: str, a: list[int], b: list[int], m: int, groups: int) -> DataFrame:
    """Per sliding window: Flajolet-Martin estimate and exact number of distinct keys: (window_end, estimate, truth)."""
    keyed = events.where(F.col(key).isNotNull()).select(ts, F.col(key).alias("__k"), bytes_mod(F.col(key), m).alias("__x"))
    # a key counts once per window for either figure, so copies go before the 40 maxima are taken
    once = keyed.select(F.window(ts, window, slide).alias("__w"), "__k", "__x").distinct()
    per = once.groupBy("__w").agg(*fm_maxima(F.col("__x"), a, b, m), F.count(F.lit(1)).alias("truth"))
    return per.select(F.col("__w.end").alias("window_end"), fm_estimate(len(a), groups).alias("estimate"), "truth")
