"""Mixing sources to target weights: hierarchical budgeting.

The sources form a tree (for instance domain, source, language). Weights are propagated from the root. A child that cannot use its
share, even with every repetition allowed, leaves the shortage to its siblings in proportion to their weights; only what they cannot take
goes up to the siblings of the parent. Each leaf then gives the prefix of its budget in tokens out of seeded epochs: whole passes
over its items, then the first items of the next pass in the order of a seeded hash, the last of them cut to fit.

Budgets are computed in tables, level by level: the children of a node, ordered by capacity for their weight, are filled like vessels up
to one common level, which two running sums give. Nothing of the tree comes to the driver, however many leaves it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.operators.hotkeys import hot_split_join
from orefield.session import cut_lineage

#: Order buckets of a leaf: the running sum is over buckets first, then inside the single bucket in which the budget ends.
BUCKETS = 4096
#: Leaves whose budgets are broadcast.
MAX_BROADCAST = 100_000


def _key(levels: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in levels]), {"ignoreNullFields": "false"}) if levels else F.lit("{}")


def _nodes(leaves: DataFrame, levels: list[str], level: str, weights: dict[str, dict[str, float]]) -> list[DataFrame]:
    """Per depth: (parent, node, weight, capacity). Weights of the level with the targets are the target shares, those above it their
    sums, those below it the given weights (0 where a value has none) or the sizes."""
    goal = levels.index(level)
    share = F.col("target_share") * F.col("size") / F.sum("size").over(Window.partitionBy(F.col(level).cast("string")))  # a source under several parents
    shared = leaves.withColumn("share", F.coalesce(share, F.lit(0.0)))
    out = []
    for depth in range(len(levels)):
        given = weights.get(levels[depth])
        if depth <= goal:
            weight = F.sum("share")
        elif given is None:
            weight = F.sum("size").cast("double")
        else:
            table = F.create_map(*[F.lit(x) for pair in given.items() for x in pair]) if given else F.create_map().cast("map<string,double>")
            weight = F.max(F.coalesce(F.get(F.map_values(F.map_filter(table, lambda k, v: k.eqNullSafe(F.col(levels[depth]).cast("string")))), F.lit(0)), F.lit(0.0)).cast("double"))
        node = shared.groupBy(_key(levels[:depth]).alias("parent"), _key(levels[: depth + 1]).alias("node"))
        out.append(node.agg(weight.alias("weight"), F.sum("capacity").cast("double").alias("capacity")).where("weight > 0 AND capacity > 0"))
    return out


def filled(children: DataFrame) -> DataFrame:
    """(node, budget) for children (parent, node, weight, capacity, budget), ``budget`` that of the parent.

    A child gets its capacity or its weight times the level, whichever is less. In the order of capacity for weight, the level at a child
    is what the children before it leave of the budget, over the weights from it on; the level of the parent is the greatest at a child
    that it does not fill.
    """
    ordered = Window.partitionBy("parent").orderBy(F.col("capacity") / F.col("weight"), "node")
    whole = Window.partitionBy("parent")
    used = F.coalesce(F.sum("capacity").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.least("budget", F.sum("capacity").over(whole)) - used) / rest
    at = children.withColumn("level", level).withColumn("full", F.col("capacity") <= F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    return at.select("node", F.when(F.col("full"), F.col("capacity")).otherwise(F.greatest(F.lit(0.0), F.col("weight") * level)).alias("budget"))


def budgets(leaves: DataFrame, levels: list[str], level: str, weights: dict[str, dict[str, float]], total: float | None) -> DataFrame:
    """(leaf, budget) in tokens for leaves (levels, size, target_share, max_repeats)."""
    sized = leaves.withColumn("capacity", F.col("size") * F.coalesce("max_repeats", F.lit(0)))
    nodes = _nodes(sized, levels, level, weights)
    if total is None:  # the largest at which every node with a target and with items reaches its share
        goal = nodes[levels.index(level)]
        weights_of_all = goal.agg(F.sum("weight").alias("all"))
        largest = goal.crossJoin(F.broadcast(weights_of_all)).agg(F.min(F.col("capacity") * F.col("all") / F.col("weight")).alias("budget"))
    else:
        largest = leaves.sparkSession.range(1).select(F.lit(float(total)).alias("budget"))
    given = largest.select(F.lit("{}").alias("node"), "budget")
    for children in nodes:
        given = filled(children.join(given.withColumnRenamed("node", "parent"), "parent"))
    return given.select(F.col("node").alias("__leaf"), "budget")


def mix(items: DataFrame, item_id: str, size: str, levels: list[str], targets: DataFrame, total: int | None = None, seed: int = 0, level: str | None = None, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The selected items: item_id, the columns ``levels``, epoch (from 1), n_tokens and used_tokens.

    ``targets``: (``level``, target_share, max_repeats), a row per value of ``level``, by default the first of ``levels``. Levels above
    it weigh the sum of their targets, levels below it what ``weights`` says (level: {value: weight}, no value: 0), or their size. ``total``
    in tokens; None takes the largest total at which no source is short. An item is used in at most ``max_repeats`` epochs; the cut item
    at the end of a leaf's budget counts as a use. Sources without target are not used, targets without items leave their share to the
    others. Null levels are one child. Items of size 0 or null are never selected. The empty table gives no rows.
    """
    level = level or levels[0]
    base = items.select(F.col(item_id).alias("item_id"), *levels, F.col(size).cast("long").alias("n_tokens"), _key(levels).alias("__leaf")).where("n_tokens > 0 AND item_id IS NOT NULL")
    wanted = targets.select(F.col(level).cast("string").alias("__value"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats")).where("__value IS NOT NULL")
    leaves = base.groupBy("__leaf", *levels).agg(F.sum("n_tokens").alias("size"))
    leaves = cut_lineage(leaves.join(wanted, F.col(level).cast("string") == F.col("__value"), "left").drop("__value"))
    plan = leaves.join(budgets(leaves, levels, level, weights or {}, total), "__leaf").withColumn("budget", F.round("budget").cast("long")).where("budget > 0")
    whole = F.floor(F.col("budget") / F.col("size"))
    plan = plan.select("__leaf", F.least(whole, "max_repeats").cast("int").alias("whole"), F.when(whole < F.col("max_repeats"), F.col("budget") - whole * F.col("size")).otherwise(0).alias("rest"))
    plan = cut_lineage(plan)
    rows = base.join(F.broadcast(plan), "__leaf") if plan.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else hot_split_join(base, plan, "__leaf")
    full = rows.where("whole > 0").select("item_id", *levels, F.explode(F.sequence(F.lit(1), F.col("whole"))).alias("epoch"), "n_tokens", F.col("n_tokens").alias("used_tokens"))

    partial = rows.where("rest > 0").withColumn("epoch", F.col("whole") + 1).withColumn("__order", F.xxhash64(F.lit(seed), "epoch", F.col("item_id").cast("string")))
    partial = partial.withColumn("__bucket", F.shiftrightunsigned("__order", 64 - (BUCKETS.bit_length() - 1)).cast("int"))
    sums = partial.groupBy("__leaf", "__bucket").agg(F.sum("n_tokens").alias("__sum"))  # at most BUCKETS rows per leaf
    upto = Window.partitionBy("__leaf").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(upto), F.lit(0)))
    placed = partial.join(sums, ["__leaf", "__bucket"]).where(F.col("__start") < F.col("rest"))
    inside = placed.where(F.col("__start") + F.col("__sum") <= F.col("rest")).withColumn("used_tokens", F.col("n_tokens"))
    running = Window.partitionBy("__leaf", "__bucket").orderBy("__order", "item_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where(F.col("__start") + F.col("__sum") > F.col("rest"))
    edge = edge.withColumn("__before", F.col("__start") + F.coalesce(F.sum("n_tokens").over(running), F.lit(0))).where(F.col("__before") < F.col("rest"))
    edge = edge.withColumn("used_tokens", F.least("n_tokens", F.col("rest") - F.col("__before")))
    columns = ["item_id", *levels, "epoch", "n_tokens", "used_tokens"]
    return full.select(columns).unionByName(inside.select(columns)).unionByName(edge.select(columns))


def reached_shares(selected: DataFrame, level: str, targets: DataFrame) -> DataFrame:
    """Per target: its share, the tokens and share reached, uses of items and the most uses of one item. Targets without items have 0."""
    # one row per (source, item) first, so that no source is counted in one task
    per_item = selected.groupBy(level, "item_id").agg(F.sum("used_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    sums = per_item.groupBy(level).agg(F.sum("t").alias("tokens"), F.sum("k").alias("uses"), F.max("k").alias("most_uses"))
    total = sums.agg(F.sum("tokens").alias("__all"))
    out = targets.join(sums, level, "left").crossJoin(F.broadcast(total))
    return out.select(
        level,
        "target_share",
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        (F.coalesce("tokens", F.lit(0)) / F.col("__all")).alias("reached_share"),
        F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        "max_repeats",
    )
