"""Most frequent items of a huge column in bounded memory: iceberg counting with several hashes.

Pass 1 counts coarse buckets under ``hashes`` hash functions, exactly: ``hashes * buckets`` counters, whatever the number of distinct
items. An item can only be frequent if its bucket is heavy under every hash. Pass 2 keeps those items and counts them exactly.
Nothing frequent is missed and nothing infrequent stays; only the memory of pass 2 depends on the data, and with at most
``1 / support`` heavy buckets of each hash an infrequent item passes with a chance of ``(1 / (support * buckets)) ** hashes``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.session import cut_lineage


def _buckets(hashes: int, buckets: int) -> list:
    return [F.pmod(F.xxhash64(F.lit(h), F.col("item")), F.lit(buckets)).cast("int") for h in range(hashes)]


def iceberg(items: DataFrame, item: str, support: float, hashes: int = 3, buckets: int = 1 << 16) -> DataFrame:
    """Items that make up at least ``support`` of all non-null items: (item, n, bound).

    ``n`` is exact; ``bound`` is the count of the item's least bucket, the estimate that pass 1 alone gives (never below ``n``).
    Nulls are not items; the empty string is one. The empty table gives no rows. Ties at the threshold are all kept.
    """
    if buckets * support < 4:
        raise ValueError("too few buckets for this support: buckets * support must be at least 4")
    column = cut_lineage(items.select(F.col(item).cast("string").alias("item")).where(F.col("item").isNotNull()))  # both passes read it
    keys = F.array(*[F.struct(F.lit(h).alias("h"), b.alias("b")) for h, b in enumerate(_buckets(hashes, buckets))])
    coarse = column.select(F.explode(keys).alias("k")).groupBy("k.h", "k.b").agg(F.count(F.lit(1)).alias("c"))
    coarse = cut_lineage(coarse)  # hashes * buckets rows at most
    total = coarse.where("h = 0").agg(F.sum("c").alias("__all"))
    # at most 1 / support heavy buckets per hash
    heavy = coarse.crossJoin(F.broadcast(total)).where(F.col("c") >= F.col("__all") * F.lit(support))
    hashed = column.select("item", *[b.alias(f"b{h}") for h, b in enumerate(_buckets(hashes, buckets))])
    for h in range(hashes):
        of_hash = heavy.where(F.col("h") == h).select(F.col("b").alias(f"b{h}"), F.col("c").alias(f"c{h}"))
        hashed = hashed.join(F.broadcast(of_hash), f"b{h}")
    bound = reduce(lambda x, y: F.least(x, y), [F.col(f"c{h}") for h in range(hashes)])
    survivors = hashed.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.first(bound).alias("bound"))
    return survivors.crossJoin(F.broadcast(total)).where(F.col("n") >= F.col("__all") * F.lit(support)).select("item", "n", "bound")
