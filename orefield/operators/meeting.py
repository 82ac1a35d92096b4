"""Pairs of records that share a token, without hot tasks: rarest parts, salted self-joins, sliced verification.

A record is a set of tokens, one row (record, n, token) per token, n the size of the set. No window, list or task ever holds a large set
or all holders of a frequent token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.operators.hotkeys import hot_split_join
from orefield.session import cut_lineage

#: Rows of one side of a self-join that meet in one place; a key with more is split over several.
BUCKET = 4096
#: Split keys that are broadcast; more are met by a join that splits hot keys itself.
SPLIT_KEYS = 100_000
#: Tokens of one set that a single verification task joins at most.
SLICE = 50_000


def rare_part(tokens: DataFrame, need: Column) -> DataFrame:
    """The rows (record, n, token, df) of the rarest part of each set that every partner sharing at least ``need`` tokens must touch.

    ``tokens`` has (record, n, token, df), df the number of sets with the token, without the tokens of one set only, though n counts
    those. A partner shares one of the ``n - need + 1`` rarest tokens, so the others find nobody new. The part comes from a histogram
    of df per set: a level of df belongs to it if the levels before do not fill it.
    """
    near = tokens.withColumn("level", F.floor(F.log2("df") * 4).cast("int"))
    levels = near.groupBy("record", "n", "level").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("record").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a few levels per record
    levels = levels.withColumn("upto", F.sum("c").over(upto)).withColumn("single", F.col("n") - F.sum("c").over(Window.partitionBy("record")))
    wanted = levels.where(F.col("single") + F.col("upto") - F.col("c") < F.col("n") - need + 1)
    cut = wanted.groupBy("record").agg(F.max("level").alias("cut"))
    return hot_split_join(near, cut, "record").where("level <= cut").select("record", "n", "token", "df")


def meet(rows: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """All ordered pairs of rows that agree on ``keys``: (keys, a, b), structs of the other columns.

    A key with more than ``bucket`` rows is split: on one side its rows are spread over parts by hash, on the other they are repeated
    for every part, so no task pairs more than ``bucket`` rows with the rows of a key. Nothing is dropped.
    """
    rows = cut_lineage(rows)
    rest = [c for c in rows.columns if c not in keys]
    hot = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > bucket).select(*keys, F.ceil(F.col("__n") / bucket).cast("int").alias("__parts")))
    n_hot = hot.limit(SPLIT_KEYS + 1).count()
    side = lambda df, name, *more: df.select(*keys, *more, *[F.col(c).alias(f"__{name}_{c}") for c in rest])
    if not n_hot:
        met = side(rows, "a").join(side(rows, "b"), keys)
    else:
        if n_hot <= SPLIT_KEYS:
            split = rows.join(F.broadcast(hot), keys, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
        else:
            keyed = lambda df: df.withColumn("__key", F.struct(*keys))
            split = hot_split_join(keyed(rows), keyed(hot).select("__key", "__parts"), "__key").drop("__key")
            split = split.unionByName(rows.join(hot, keys, "left_anti").withColumn("__parts", F.lit(1)))
        left = side(split, "a", F.pmod(F.xxhash64(*rest), F.col("__parts")).cast("int").alias("__part"))
        right = side(split, "b", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"))
        met = left.join(right, [*keys, "__part"])
    return met.select(*keys, *[F.struct(*[F.col(f"__{name}_{c}").alias(c) for c in rest]).alias(name) for name in "ab"])


def shared_counts(pairs: DataFrame, tokens: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """``pairs`` (a, b, n_a, n_b), distinct, with ``shared``, the number of common tokens, where there is any.

    The tokens of a, sliced by hash, are looked up as (b, token): a large set is spread over its slices.
    """
    found = pairs.withColumn("slices", F.ceil(F.col("n_a") / slice_rows).cast("int"))
    found = found.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    left = tokens.select(F.col("record").alias("a"), F.pmod(F.xxhash64("token"), F.ceil(F.col("n") / slice_rows)).cast("int").alias("slice"), "token")
    right = tokens.select(F.col("record").alias("b"), "token")
    return found.join(left, ["a", "slice"]).join(right, ["b", "token"]).groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"))


def sized_tokens(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(record, n, token, df) of the records in ``sizes`` (record, n); tokens of a single record pair nothing and are left out."""
    tokens = cut_lineage(hot_split_join(rows, sizes, "record"))
    spread = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return hot_split_join(tokens, spread, "token").select("record", "n", "token", "df")
