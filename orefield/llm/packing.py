"""Filling containers of fixed capacity: bulk-synchronous best fit.

Items go by classes of size, from the largest: a class holds the sizes above half of its upper bound ``hi``. For a class, rounds are made
until its items are placed:

1. *Range sort.* The items that are left and the gaps of the containers are sorted together by size and gap, into ranges. A gap of at
   least ``hi`` stands for several *slots* at ``hi``, each of which any item of the class fits; slots of smaller gaps come first.
2. *Successor sweep.* Each range is swept upwards in a task of its own; a gap takes the largest item still free below it, so an item gets
   the least gap that no larger item of the sweep has taken.
3. *Conflicts* between ranges are settled by rank: of each range only the numbers of free items and gaps are needed to know which ranks
   of free items meet which ranks of gaps above. That is one small row per range, swept in one task.
4. *Update.* Containers have smaller gaps now, and the next round begins. When no item finds a gap, new containers are opened. At first
   there are as many as the total needs at least.

The driver sees two numbers a round, those of the items placed and their sizes. The matching is the same for any number of ranges; up to ``LOCAL_ITEMS``
items (counted) the rounds therefore run in one task, with one range, which spares their jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orefield.session import cut_lineage

#: Up to so many items the rounds run in one task.
LOCAL_ITEMS = 50_000
#: Items and slots of one range.
RANGE_ROWS = 20_000
#: Ranges of one sweep at most; beyond, ranges are larger.
MOST_RANGES = 10_000


def size_classes(capacity: int) -> Iterator[tuple[int, int]]:
    """(lo, hi) from the largest class: sizes above lo and up to hi."""
    hi = capacity
    while hi >= 1:
        yield hi // 2, hi
        hi //= 2


def sweep(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matches a sorted sequence of items and gaps: each gap takes the last free item before it.

    Returns the places of matched items and their gaps, of free items (the last first) and of free gaps (the first first). Item and gap of
    a match stand on the same level of nesting, next to each other among the rows of that level.
    """
    level = np.cumsum(np.where(is_gap, -1, 1)) + is_gap
    order = np.lexsort((np.arange(len(is_gap)), level))
    follows = np.r_[(level[order][1:] == level[order][:-1]) & ~is_gap[order][:-1] & is_gap[order][1:], False] if len(order) else np.zeros(0, dtype=bool)
    items, gaps = order[follows], order[np.r_[False, follows[:-1]]] if len(order) else order
    free = np.ones(len(is_gap), dtype=bool)
    free[items] = free[gaps] = False
    return items, gaps, np.flatnonzero(free & ~is_gap)[::-1], np.flatnonzero(free & is_gap)


def pack_local(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, by the rounds of ``pack`` in memory."""
    place = np.full(len(sizes), -1, dtype=np.int64)
    gaps = np.full(-(-int(sizes.sum()) // capacity), capacity, dtype=np.int64)
    for lo, hi in size_classes(capacity):
        left = np.flatnonzero((sizes > lo) & (sizes <= hi))
        while len(left):
            able = np.flatnonzero(gaps > lo)
            slots = np.maximum(1, gaps[able] // hi)
            container = np.repeat(able, slots)
            slot = np.arange(len(container)) - np.repeat(np.cumsum(slots) - slots, slots)
            value = np.r_[sizes[left], np.minimum(gaps[container], hi)]
            is_gap = np.r_[np.zeros(len(left), dtype=bool), np.ones(len(container), dtype=bool)]
            gap = np.r_[np.zeros(len(left), dtype=np.int64), gaps[container]]
            who = np.r_[left, container]
            order = np.lexsort((np.r_[np.zeros(len(left), dtype=np.int64), slot], who, gap, is_gap, value))
            items, taken, _, _ = sweep(is_gap[order])
            if not len(items):
                gaps = np.r_[gaps, np.full(-(-len(left) // (capacity // hi)), capacity, dtype=np.int64)]
                continue
            item, where = who[order[items]], who[order[taken]]
            place[item] = where
            np.subtract.at(gaps, where, sizes[item])
            left = left[place[left] < 0]
    return place


_SWEPT = pa.schema([("part", pa.int32()), ("what", pa.int32()), ("item", pa.int64()), ("size", pa.int64()), ("container", pa.int64()), ("rank", pa.int64())])
_MATCHED, _FREE_ITEM, _FREE_GAP = 0, 1, 2


def _sweep_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps one sorted range of (value, kind, gap, who, slot)."""
    part = TaskContext.get().partitionId()
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    value, kind, who = (np.asarray(rows.column(c).combine_chunks()) for c in ("value", "kind", "who"))
    items, gaps, free_items, free_gaps = sweep(kind == 1)
    for what, at, container in ((_MATCHED, items, who[gaps]), (_FREE_ITEM, free_items, None), (_FREE_GAP, free_gaps, who[free_gaps])):
        n = len(at)
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.full(n, what, dtype=np.int32)), none if what == _FREE_GAP else pa.array(who[at]), none if what == _FREE_GAP else pa.array(value[at]), none if container is None else pa.array(container), pa.array(np.arange(n))],
            schema=_SWEPT,
        )


def _across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which ranks of the free items of a range meet which ranks of the free gaps of a higher range, from their numbers (part, items, gaps)."""
    rows = pd.concat([pd.DataFrame({"part": [], "items": [], "gaps": []}, dtype=np.int64), *frames])
    stack: list[list[int]] = []  # range, first free rank, number
    out = []
    for part, items, gaps in rows.sort_values("part")[["part", "items", "gaps"]].itertuples(index=False):
        done = 0
        while done < gaps and stack:
            top = stack[-1]
            n = min(gaps - done, top[2])
            out.append((top[0], top[1], part, done, n))
            top[1], top[2], done = top[1] + n, top[2] - n, done + n
            if not top[2]:
                stack.pop()
        if items:
            stack.append([part, 0, items])
    yield pd.DataFrame(out, columns=["item_part", "item_from", "gap_part", "gap_from", "n"], dtype=np.int64)


def _round(left: DataFrame, containers: DataFrame, lo: int, hi: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """One round: the written matches (item, container, size), and the items that are left (item, size)."""
    zero = F.lit(0).cast("long")
    items = left.select(F.col("size").alias("value"), F.lit(0).alias("kind"), zero.alias("gap"), F.col("item").alias("who"), zero.alias("slot"))
    slots = F.explode(F.sequence(zero, F.greatest(F.lit(1).cast("long"), F.floor(F.col("gap") / hi)) - 1))
    able = containers.where(F.col("gap") > lo).select(F.least("gap", F.lit(hi).cast("long")).alias("value"), F.lit(1).alias("kind"), "gap", F.col("container").alias("who"), slots.alias("slot"))
    order = ["value", "kind", "gap", "who", "slot"]
    both = items.unionByName(able)
    ranged = (both.repartitionByRange(parts, *order) if parts > 1 else both.coalesce(1)).sortWithinPartitions(*order)
    swept = cut_lineage(ranged.mapInArrow(_sweep_range, "part int, what int, item long, size long, container long, rank long"))
    if parts == 1:
        return swept.where(F.col("what") == _MATCHED).select("item", "container", "size"), swept.where(F.col("what") == _FREE_ITEM).select("item", "size")
    numbers = swept.where(F.col("what") != _MATCHED).groupBy("part").agg(F.count_if(F.col("what") == _FREE_ITEM).alias("items"), F.count_if(F.col("what") == _FREE_GAP).alias("gaps"))
    meets = numbers.coalesce(1).mapInPandas(_across, "item_part int, item_from long, gap_part int, gap_from long, n long")  # at most two rows per range
    free = swept.where(F.col("what") == _FREE_ITEM).select("part", "rank", "item", "size")
    at = (F.col("part") == F.col("item_part")) & (F.col("rank") >= F.col("item_from")) & (F.col("rank") < F.col("item_from") + F.col("n"))
    bound = free.join(F.broadcast(meets), at).select("item", "size", F.col("gap_part").alias("part"), (F.col("gap_from") + F.col("rank") - F.col("item_from")).alias("rank"))
    gaps = swept.where(F.col("what") == _FREE_GAP).select("part", "rank", "container")
    inside = swept.where(F.col("what") == _MATCHED).select("item", "container", "size")
    matched = cut_lineage(inside.unionByName(bound.join(gaps, ["part", "rank"]).select("item", "container", "size")))
    return matched, free.join(matched.select("item"), "item", "left_anti").select("item", "size")


def place_items(items: DataFrame, capacity: int, local_items: int = LOCAL_ITEMS, ranges: int | None = None) -> DataFrame:
    """(item, container) for the written table ``items`` (item LONG, unique; size LONG in 1 .. ``capacity``)."""
    if items.limit(local_items + 1).count() <= local_items:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = pd.concat([pd.DataFrame({"item": [], "size": []}, dtype=np.int64), *frames]).sort_values("item")
            yield pd.DataFrame({"item": rows["item"], "container": pack_local(rows["size"].to_numpy(np.int64), capacity)})

        return cut_lineage(items.coalesce(1).mapInPandas(run, "item long, container long"))
    spark = items.sparkSession
    total = items.agg(F.sum("size")).first()[0]
    opened = -(-total // capacity)
    fresh = lambda first, last: spark.range(first, last).select(F.col("id").alias("container"), F.lit(capacity).cast("long").alias("gap"))
    containers = fresh(0, opened)
    found, room = [], opened * capacity
    for lo, hi in size_classes(capacity):
        left = items.where((F.col("size") > lo) & (F.col("size") <= hi)).select("item", "size")
        n = left.count()
        while n:
            parts = ranges or min(-(-(n + opened + room // hi) // RANGE_ROWS), MOST_RANGES)  # room // hi: so many slots at most
            matched, rest = _round(left, containers, lo, hi, parts)
            placed, volume = matched.agg(F.count(F.lit(1)), F.sum("size")).first()
            if not placed:
                more = -(-n // (capacity // hi))
                containers = cut_lineage(containers.unionByName(fresh(opened, opened + more)))
                opened, room = opened + more, room + more * capacity
                continue
            found.append(matched)
            used = matched.groupBy("container").agg(F.sum("size").alias("used"))
            containers = containers.join(used, "container", "left").select("container", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
            containers = cut_lineage(containers.where("gap > 0"))
            left, n, room = rest, n - placed, room - volume
    return reduce(DataFrame.unionByName, found).select("item", "container")


def pack(items: DataFrame, item_id: str, size: str, capacity: int, local_items: int = LOCAL_ITEMS, ranges: int | None = None) -> DataFrame:
    """Containers of the items: (container_id, item_id, part, start, n_tokens, at).

    An item longer than ``capacity`` is cut into parts: full containers first, then the rest, which is packed like an item. Other items
    stay whole. ``start`` is where the part begins in the item, ``at`` where it lies in its container. Items of size 0 or null come out
    with a null container and part 0; rows with a null id are items of their own and keep it. ``item_id`` need not be unique: each row
    is an item. The empty table gives no rows. Numbers of containers need not follow each other. ``ranges``: ranges of a sweep, by
    default one for ``RANGE_ROWS`` items and slots.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    rows = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    piece = F.transform(
        F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / capacity).cast("long") - 1),
        lambda k: F.struct(k.cast("int").alias("part"), (k * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("size") - k * capacity).alias("n_tokens")),
    )
    pieces = rows.where("size > 0").select("item_id", F.explode(piece).alias("p")).select("item_id", "p.*")
    pieces = cut_lineage(pieces.withColumn("item", F.monotonically_increasing_id()))
    placed = place_items(pieces.select("item", F.col("n_tokens").alias("size")), capacity, local_items, ranges).withColumnRenamed("container", "container_id")
    inside = Window.partitionBy("container_id").orderBy(F.col("n_tokens").desc(), "item").rowsBetween(Window.unboundedPreceding, -1)  # at most ``capacity`` rows
    placed = pieces.join(placed, "item").withColumn("at", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    empty = rows.where("size <= 0").select(F.lit(None).cast("long").alias("container_id"), "item_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("at"))
    return placed.select("container_id", "item_id", "part", "start", "n_tokens", "at").unionByName(empty)
