"""Frequent itemsets: level-wise joins, two-pass partitioned mining (SON), and FP-growth, with the same exact result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions.hashing import seeded_number
from orefield.operators.hotkeys import bounded_broadcast, hot_split_join
from orefield.session import cut_lineage

#: Least local threshold of the two-pass algorithm with several parts; below it nearly every subset of a basket is a candidate.
LEAST_LOCAL = 4
#: Rows of one part, and items of one basket, that a task may hold.
PART_ROWS, BASKET_ITEMS = 2_000_000, 100_000
#: Candidates of one size that are broadcast.
MAX_BROADCAST = 200_000


def baskets(pairs: DataFrame, basket: str, item: str, min_size: int = 0) -> DataFrame:
    """Distinct (basket, item) rows without nulls; only baskets with at least ``min_size`` items if that is above 1."""
    rows = pairs.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket IS NOT NULL AND item IS NOT NULL").distinct()
    if min_size > 1:
        keep = rows.groupBy("basket").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_size).select("basket")
        rows = rows.join(keep, "basket", "left_semi")
    return rows


def basket_arrays(rows: DataFrame) -> DataFrame:
    """(basket, items) with sorted items."""
    return rows.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"))


def levelwise(rows: DataFrame, support: int, max_size: int | None = None) -> DataFrame:
    """Itemsets that at least ``support`` baskets hold: (items, n). A-Priori as joins.

    Occurrences (basket, itemset) of the frequent k-itemsets are extended by a greater frequent item of the same basket; the prefix
    and the last two items of a candidate must be frequent, then it is counted. Each level is written, so lineage stays short.
    """
    rows = cut_lineage(rows)
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    level = cut_lineage(counts.select(F.array("item").alias("items"), "n"))
    found = level
    frequent = rows.join(counts.select("item"), "item", "left_semi")
    frequent = cut_lineage(frequent)
    held = frequent.select("basket", F.array("item").alias("items"), F.col("item").alias("last"))
    size = 1
    while (max_size is None or size < max_size) and not level.isEmpty():
        longer = held.join(frequent, "basket").where(F.col("item") > F.col("last"))
        longer = longer.select("basket", F.concat("items", F.array("item")).alias("items"), F.col("item").alias("last"))
        if size > 1:
            tail = F.array_sort(F.concat(F.slice("items", 1, size - 1), F.slice("items", size + 1, 1)))
            longer = longer.withColumn("__tail", tail).join(level.select(F.col("items").alias("__tail")), "__tail", "left_semi").drop("__tail")
        level = cut_lineage(longer.groupBy("items").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support))
        held = cut_lineage(longer.join(level.select("items"), "items", "left_semi"))
        found = found.unionByName(level)
        size += 1
    return found.select("items", "n")


def mine_local(baskets_: np.ndarray, items: np.ndarray, threshold: int) -> Iterator[tuple[int, ...]]:
    """All itemsets of at least ``threshold`` baskets among (basket, item) codes, in memory and depth first.

    The rows are sorted and distinct. A prefix is extended by the greater items of the baskets that hold it: their suffixes are gathered
    as ranges, counted at once, and the infrequent items dropped before the next step.
    """

    def grow(owner: np.ndarray, flat: np.ndarray, prefix: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not len(flat):
            return
        keep = np.bincount(flat)[flat] >= threshold
        owner, flat = owner[keep], flat[keep]
        if not len(flat):
            return
        last = np.r_[owner[1:] != owner[:-1], True]
        ends = np.flatnonzero(last)[np.cumsum(np.r_[0, last[:-1]])] + 1  # where the basket of each row ends
        order = np.argsort(flat, kind="stable")
        begins = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
        for at in np.split(order, begins[1:]):
            found = (*prefix, int(flat[at[0]]))
            yield found
            length = ends[at] - at - 1
            if (length > 0).sum() >= threshold:
                inside = np.repeat(at + 1 - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
                yield from grow(owner[inside], flat[inside], found)

    yield from grow(baskets_, items, ())


def part_of(basket: Column, parts: int) -> Column:
    """The part of a basket, by a hash that any engine has."""
    return F.pmod(seeded_number(0, basket), F.lit(parts)).cast("int")


def son_parts(n_rows: int, support: int, partitions: int) -> int | None:
    """Number of parts: as asked, but with a local threshold of at least ``LEAST_LOCAL`` where that leaves more than one part, and with at
    most ``PART_ROWS`` rows a part; None if both cannot be had."""
    most = max(1, support // LEAST_LOCAL)
    parts = max(min(partitions, most), -(-n_rows // PART_ROWS), 1)
    return parts if parts <= most else None


def son_candidates(rows: DataFrame, support: int, partitions: int) -> DataFrame:
    """Pass 1: itemsets frequent in at least one part at the scaled-down threshold ``ceil(support / parts)``: (items), distinct.

    Items that are not frequent in all are dropped first; every globally frequent itemset is among the candidates, since one part must
    hold its share. The number of parts is that of ``son_parts``. Where parts of bounded size would need a threshold near 1, at which
    every subset of a basket is a candidate, or where a basket keeps more than ``BASKET_ITEMS`` items, the candidates are the frequent
    itemsets themselves, found level by level over tables.
    """
    counts = cut_lineage(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("item"))
    kept = cut_lineage(hot_split_join(rows, counts, "item").select("basket", "item"))
    shape = kept.groupBy("basket").agg(F.count(F.lit(1)).alias("k")).agg(F.sum("k"), F.max("k")).first()
    parts = son_parts(shape[0] or 0, support, partitions)
    if parts is None or (shape[1] or 0) > BASKET_ITEMS:
        return levelwise(kept, support).select("items")
    threshold = -(-support // parts)

    def mine(part: pd.DataFrame) -> pd.DataFrame:
        owner = pd.factorize(part["basket"], sort=False)[0]
        item, names = pd.factorize(part["item"], sort=True)
        order = np.lexsort((item, owner))
        return pd.DataFrame({"items": [[names[i] for i in c] for c in mine_local(owner[order], item[order], threshold)]})

    spread = kept.withColumn("__part", part_of(F.col("basket"), parts))
    return spread.groupBy("__part").applyInPandas(mine, "items array<string>").distinct()


def count_candidates(rows: DataFrame, candidates: DataFrame, support: int) -> DataFrame:
    """Pass 2: exact counts of the candidates, at least ``support``: (items, n).

    The subsets of a candidate are candidates, so baskets are matched along prefixes: a basket that holds the prefix of a candidate is
    looked up, by (basket, item), for its last item. Only occurrences travel, never candidates times baskets, and prefixes that turn out
    infrequent are not followed. Up to ``MAX_BROADCAST`` candidates of a size (counted) are broadcast.
    """
    listed = cut_lineage(candidates.select("items", F.size("items").alias("size")))
    largest = listed.agg(F.max("size")).first()[0] or 0
    singles = listed.where("size = 1").select(F.col("items")[0].alias("item"))
    held = cut_lineage(hot_split_join(rows, singles, "item").select("basket", F.array("item").alias("items")))
    found = level = cut_lineage(held.groupBy("items").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support))
    for size in range(2, largest + 1):
        longer = listed.where(F.col("size") == size).select(F.slice("items", 1, size - 1).alias("prefix"), F.col("items").alias("longer"), F.element_at("items", -1).alias("item"))
        longer = longer.join(bounded_broadcast(level.select(F.col("items").alias("prefix")), MAX_BROADCAST), "prefix", "left_semi")
        tried = held.withColumnRenamed("items", "prefix").join(bounded_broadcast(longer, MAX_BROADCAST), "prefix")
        held = cut_lineage(tried.join(rows, ["basket", "item"]).select("basket", F.col("longer").alias("items")))
        level = cut_lineage(held.groupBy("items").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def son(rows: DataFrame, support: int, partitions: int = 8) -> DataFrame:
    """Both passes of SON."""
    rows = cut_lineage(rows)
    return count_candidates(rows, cut_lineage(son_candidates(rows, support, partitions)), support)


def fp_growth(rows: DataFrame, support: int) -> DataFrame:
    """FP-growth of the ML library with an absolute threshold: (items, n)."""
    from pyspark.ml.fpm import FPGrowth

    arrays = cut_lineage(basket_arrays(rows))
    total = arrays.count()
    if not total:
        return arrays.select("items", F.lit(0).cast("long").alias("n"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (support - 0.5) / total))).fit(arrays)
    return model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))
