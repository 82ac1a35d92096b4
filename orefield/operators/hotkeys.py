"""Per-key results without imbalance, though a few keys hold most rows.

Counts, sums and extremes are mergeable and combined before the exchange on the key. Distinct counts go through (key, value)
first. Quantiles are exact and come from *distributed selection*: values are counted in histogram bins per key, the bin that holds
the wanted rank is refined, and so on until every rank resolves to one value. Only counters travel, never a key's values.
Frequent keys come from the same selection: in sorted order a key with n rows stands at one of the ranks n, 2n, 3n and so on.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.session import cut_lineage

#: A key with at least one row in ``HOT_PARTS`` is hot. There are at most that many, so a table of hot keys may be broadcast.
HOT_PARTS = 1024


def key_histogram(df: DataFrame, key: str, value: str, bins: int = 256) -> DataFrame:
    """Round 0: rows (key, bin, n, lo, hi) of one grid over the range of all values; bin -1 holds the null and NaN values.

    The grid is the range of ``value``, one row broadcast. A (key, bin) counter is combined before the exchange on both, so a hot
    key spreads over its bins. Null keys are left out; an empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("key"), F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias("v")).where(F.col("key").isNotNull())
    grid = rows.agg(F.min("v").alias("g0"), F.max("v").alias("g1"))
    binned = rows.crossJoin(F.broadcast(grid)).select("key", "v", _bin("v", "g0", "g1", bins).alias("bin"))
    return binned.groupBy("key", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def _bin(v: str, lo: str, hi: str, bins: int) -> Column:
    share = (F.col(v) / 2 - F.col(lo) / 2) / (F.col(hi) / 2 - F.col(lo) / 2)
    inside = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(share * bins).cast("int")))
    return F.when(F.col(v).isNull(), -1).when(F.col(hi) <= F.col(lo), 0).otherwise(inside)


def _image(v: str) -> Column:
    """A 64-bit integer that orders doubles, infinities included, as the doubles themselves; both zeros are one."""
    bits = F.expr(f"CAST(java_method('java.lang.Double', 'doubleToLongBits', {v} + 0.0D) AS BIGINT)")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def _image_bin(bins: int, image: Callable[[str], Column]) -> Column:
    """Bin of the image of ``v`` between the images ``lo_image`` and ``hi_image``, in whole numbers."""
    wide = lambda c: c.cast("decimal(20,0)")
    lo, hi = wide(F.col("lo_image")), wide(F.col("hi_image"))
    up = (wide(image("v")) - lo).cast("decimal(21,0)") * F.lit(bins).cast("decimal(10,0)")
    return F.call_function("div", up, (hi - lo).cast("decimal(21,0)") + F.lit(1).cast("decimal(1,0)")).cast("int")


def _ranked(histogram: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """The bin in which each wanted rank falls. The window is over the bins of one key, a bounded number."""
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = histogram.withColumn("upto", F.sum("n").over(w))
    joined = cum.join(wanted, by, "inner") if wanted is not None else cum
    return joined.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))


def _resolved(rows: DataFrame, state: DataFrame, bins: int, max_rounds: int, image: Callable[[str], Column]) -> DataFrame:
    """Refines the bins of ``state`` (key, q, lo, hi, rank, hot) over ``rows`` (key, v) until each rank is one value: (key, q, value).

    Each round reads the rows once; only the bins that are still open take part. Open bins of hot keys are broadcast, the others meet
    their rows in a join on the key. ``image`` maps a value to a 64-bit integer of the same order; a round divides the width of a bin
    there by ``bins``, so 8 rounds of 256 bins resolve any rank. A rank still open after ``max_rounds`` raises.
    """
    done = [state.where("lo = hi")]
    for _ in range(max_rounds):
        state = state.where("lo < hi")
        if state.isEmpty():
            break
        open_bins = state.select("key", "lo", "hi", "hot").distinct().withColumn("lo_image", image("lo")).withColumn("hi_image", image("hi"))
        inside = F.col("v").between(F.col("lo"), F.col("hi"))
        hot = rows.join(F.broadcast(open_bins.where("hot")), "key").where(inside)
        cold = rows.join(open_bins.where("NOT hot"), "key").where(inside)
        counted = (
            hot.unionByName(cold)
            .select("key", "lo", "hi", "v", _image_bin(bins, image).alias("bin"))
            .groupBy("key", "lo", "hi", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        )
        found = _ranked(counted, state.select("key", "lo", "hi", "q", "rank", "hot"), ["key", "lo", "hi"])
        state = cut_lineage(found.select("key", "q", F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "hot"))
        done.append(state.where("lo = hi"))
    else:
        if not state.where("lo < hi").isEmpty():
            raise RuntimeError(f"ranks are open after {max_rounds} rounds of {bins} bins")
    return reduce(DataFrame.unionByName, done).select("key", "q", F.col("lo").alias("value"))


def keyed_quantiles(df: DataFrame, key: str, value: str, qs: list[float], bins: int = 256, max_rounds: int = 24, histogram: DataFrame | None = None) -> DataFrame:
    """Exact per-key quantiles: rows (key, q, value), value the element of rank ``ceil(q * n)`` (at least 1) of the key's non-null values.

    ``histogram``: that of round 0, if the caller needs it as well. Open bins of hot keys are at most ``HOT_PARTS * len(qs)``; no other key
    has more than one in ``HOT_PARTS`` of the rows. Ties, repeated rows and infinities are ordinary values; NaN counts as null. Keys
    without a value are left out.
    """
    hist = cut_lineage((histogram if histogram is not None else key_histogram(df, key, value, bins)).where("bin >= 0"))
    totals = hist.groupBy("key").agg(F.sum("n").alias("total"))
    wanted = totals.select("key", "total", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    wanted = wanted.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("total") - 1e-9)).cast("long"))
    every = hist.agg(F.sum("n")).first()[0] or 0
    state = cut_lineage(_ranked(hist, wanted, ["key"]).select("key", "q", "lo", "hi", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), (F.col("total") * HOT_PARTS >= every).alias("hot")))
    rows = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    return _resolved(rows, state, bins, max_rounds, _image)


def keyed_profile(df: DataFrame, key: str, value: str, member: str, latest: str, qs: list[float] = (0.1, 0.5, 0.9), bins: int = 256) -> DataFrame:
    """Per key: rows, distinct non-null members, mean of ``value``, greatest ``latest`` and the exact quantiles of ``value``.

    Columns key, n_rows, n_members, mean_value, latest, then ``q<percent>`` per quantile. Row counts come from the histogram of the
    quantile selection. A key whose values are all null has a null mean and null quantiles; one without members has 0.
    """
    base = df.select(F.col(key).alias("key"), F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias("v"), F.col(member).alias("m"), F.col(latest).alias("d")).where(F.col("key").isNotNull())
    base = cut_lineage(base)  # read by every round of the selection
    histogram = cut_lineage(key_histogram(base, "key", "v", bins))
    counts = histogram.groupBy("key").agg(F.sum("n").alias("n_rows"))
    # one exchange on (key, member): a hot key is spread over its members
    by_member = base.groupBy("key", "m").agg(F.sum("v").alias("s"), F.count("v").alias("c"), F.max("d").alias("d"))
    merged = by_member.groupBy("key").agg(F.count("m").alias("n_members"), (F.sum("s") / F.sum("c")).alias("mean_value"), F.max("d").alias("latest"))
    quantiles = keyed_quantiles(base, "key", "v", list(qs), bins, histogram=histogram)
    wide = quantiles.groupBy("key").agg(*[F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(f"q{round(q * 100)}") for q in qs])
    return counts.join(merged, "key", "left").join(wide, "key", "left")


#: Bits of a key's hash that make the cells of the first histogram of ``heavy_keys``.
CELL_BITS = 12


def heavy_keys(df: DataFrame, key: str, share: float, bins: int = 256, max_rounds: int = 24) -> DataFrame:
    """Keys with at least ``share`` of all rows that have a key: (key, n_rows), by selection of ranks.

    Sorted by the 64-bit hashes of their keys, the rows of a key stand together. With t the least number of rows wanted, a key with t
    rows stands at one of the ranks t, 2t, 3t ... These ranks, at most ``1 / share``, are resolved by refined histograms: first counters
    per cell of the hash, then of the bins that hold a wanted rank, until each is one hash. The keys with such a hash are counted
    exactly. Only counters of at most ``bins / share`` bins travel, never one per key, and a hot key is one counter a task. Null keys
    are left out; the empty table gives no rows. Ties at the threshold are all kept.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    named = cut_lineage(df.select(F.col(key).alias("name")).where("name IS NOT NULL").withColumn("v", F.xxhash64("name")))
    rows = named.select(F.shiftright("v", 64 - CELL_BITS).cast("int").alias("key"), "v")
    cells = cut_lineage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))  # at most 1 << CELL_BITS rows
    total = cells.agg(F.sum("n")).first()[0] or 0
    least = max(1, math.ceil(total * share - 1e-9))
    upto = F.sum("n").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = cells.withColumn("before", upto - F.col("n"))
    first, last = F.floor(F.col("before") / least) + 1, F.floor((F.col("before") + F.col("n")) / least)
    steps = F.when(last >= first, F.sequence(first, last))
    state = before.select("key", F.explode(steps).alias("q"), "lo", "hi", "before").select("key", "q", "lo", "hi", (F.col("q") * least - F.col("before")).alias("rank"), F.lit(True).alias("hot"))
    hashes = _resolved(rows, cut_lineage(state), bins, max_rounds, F.col).select(F.col("value").alias("v")).distinct()
    counted = named.join(F.broadcast(hashes), "v", "left_semi").groupBy(F.col("name").alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where(F.col("n_rows") >= least)


def hot_split_join(left: DataFrame, right: DataFrame, key: str, parts: int = HOT_PARTS) -> DataFrame:
    """Inner equi-join of ``left`` with ``right``, which is unique by ``key``, when a few keys hold most rows of ``left``.

    Keys with at least one in ``parts`` of the rows of ``left`` (at most ``parts`` keys, so at most ``parts`` rows of ``right``) are
    joined by broadcast; the other rows are shuffled on the key, none of which exceeds one in ``parts``. Null keys match nothing.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).count()
    total = counts.agg(F.sum("count").alias("__total"))
    hot_keys = counts.crossJoin(F.broadcast(total)).where(F.col("count") * parts >= F.col("__total")).select(key)
    hot_keys = cut_lineage(hot_keys)
    hot_right = F.broadcast(right.join(F.broadcast(hot_keys), key, "left_semi"))
    cold_left = left.join(F.broadcast(hot_keys), key, "left_anti")
    cold_right = right.join(F.broadcast(hot_keys), key, "left_anti")
    return left.join(hot_right, key).unionByName(cold_left.join(cold_right, key))


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows (counted, not guessed), else unchanged for a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
