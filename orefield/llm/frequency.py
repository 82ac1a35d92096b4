"""Frequency of every distinct term or n-gram: suffix-sorted counting.

1. *Suffixes.* Every position of a record yields the suffix that starts there, cut to ``max_len`` terms. Equal suffixes of ``BLOCK``
   terms are merged at once. A suffix carries its occurrences and, for each depth d up to its length, the number of records for
   which it is the first occurrence of its d-term prefix. These counters stand for the record sets: a record counts once for a prefix
   because only one of its occurrences is the first. They add up exactly and merge before the exchange, unlike lists of ids.
2. *Routing* by first term. Suffixes of a first term with more than its share are split over several routes by their hash.
3. *Reverse-lexicographic sort* inside each route, so a term list comes after all its extensions.
4. *Stack.* One pass with a stack of the current prefixes. Inside an Arrow batch the prefixes of each depth are runs of rows and are
   summed as arrays; the stack carries the prefixes that are open at its end into the next batch, which adds to them or pops them.
   Totals of split first terms are added up at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.session import cut_lineage, default_parallelism


#: Terms that are merged before they are passed on; bounds what a task holds.
BLOCK = 500_000


def _suffix_batches(max_len: int):
    schema = pa.schema([("terms", pa.list_(pa.string())), ("occurrences", pa.int64()), *[(f"first_{d}", pa.int64()) for d in range(max_len + 1)]])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
        held: list[pa.Array] = []
        size = 0
        for batch in batches:
            held.append(batch.column(0))
            size += len(held[-1].flatten())
            if size >= BLOCK:
                yield pa.concat_arrays(held)
                held, size = [], 0
        if held:
            yield pa.concat_arrays(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column in blocks(batches):
            lens = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
            flat = column.flatten()
            keep = np.asarray(flat.is_valid())
            record = np.repeat(np.arange(len(lens), dtype=np.int64), lens)
            if not keep.all():
                flat, record = flat.filter(pa.array(keep)), record[keep]
            coded = flat.dictionary_encode()
            code = np.asarray(coded.indices, dtype=np.int64)
            words = coded.dictionary
            n = len(code)
            arrays: list[list] = [[[]], [n], [len(lens)], *[[0] for _ in range(max_len)]]
            yield _rows(schema, pa.array(arrays[0], pa.list_(pa.string())), *arrays[1:])
            if not n:
                continue
            left = np.empty(n, dtype=np.int64)  # terms from here to the end of the record
            ends = np.flatnonzero(np.r_[record[1:] != record[:-1], True])
            left[:] = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(n) + 1
            gram = code.copy()
            firsts = []
            for depth in range(1, max_len + 1):
                at = np.flatnonzero(left >= depth)
                if depth > 1:
                    pair = gram[at] * (len(words) + 1) + code[at + depth - 1]
                    gram = np.full(n, -1, dtype=np.int64)
                    gram[at] = np.unique(pair, return_inverse=True)[1]
                flag = np.zeros(n, dtype=np.int64)
                if len(at):
                    flag[at[np.unique(gram[at] * len(lens) + record[at], return_index=True)[1]]] = 1
                firsts.append(flag)
                last = depth == max_len
                here = at if last else at[left[at] == depth]  # suffixes of just this length
                if not len(here):
                    continue
                _, start, group, count = np.unique(gram[here], return_index=True, return_inverse=True, return_counts=True)
                source = here[start]
                index = (source[:, None] + np.arange(depth)[None, :]).ravel()
                terms = pa.ListArray.from_arrays(pa.array(np.arange(0, len(index) + 1, depth), pa.int32()), words.take(pa.array(code[index])))
                sums = [np.bincount(group, weights=f[here], minlength=len(start)).astype(np.int64) for f in firsts]
                none = np.zeros(len(start), dtype=np.int64)
                yield _rows(schema, terms, count, none, *sums, *[none] * (max_len - depth))

    return run


def _rows(schema: pa.Schema, terms: pa.Array, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([terms, *[pa.array(c, pa.int64()) for c in columns]], schema=schema)


def _stack_batches(max_len: int):
    schema = pa.schema([("terms", pa.list_(pa.string())), ("occurrences", pa.int64()), ("records", pa.int64())])

    def emitted(terms: pa.Array, n, r) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([terms, pa.array(n, pa.int64()), pa.array(r, pa.int64())], schema=schema)

    def popped(found: tuple[list[str], int, int]) -> pa.RecordBatch:
        return emitted(pa.array([found[0]], schema.field(0).type), [found[1]], [found[2]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[list[str], int, int] | None] = [None] * (max_len + 1)  # the open prefix of each depth and its totals
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0)
            lens = np.asarray(lists.value_lengths(), dtype=np.int64)
            offsets = np.cumsum(lens) - lens
            flat = lists.flatten()
            code = np.asarray(flat.dictionary_encode().indices, dtype=np.int64)
            n = np.asarray(batch.column(1), dtype=np.int64)
            root = stack[0] or ([], 0, 0)
            stack[0] = ([], root[1] + int(n[lens > 0].sum()), root[2] + int(np.asarray(batch.column(2), dtype=np.int64).sum()))
            new = np.zeros(len(lens), dtype=bool)  # where a prefix of the depth before begins
            for depth in range(1, max_len + 1):
                has = lens >= depth
                here = np.full(len(lens), -1, dtype=np.int64)
                here[has] = code[offsets[has] + depth - 1]
                new = has & (new | np.r_[True, here[1:] != here[:-1]])
                starts = np.flatnonzero(new)
                if not len(starts):
                    if stack[depth]:
                        yield popped(stack[depth])
                        stack[depth] = None
                    continue
                first = np.asarray(batch.column(2 + depth), dtype=np.int64)
                sums, records = np.add.reduceat(np.where(has, n, 0), starts), np.add.reduceat(np.where(has, first, 0), starts)
                index = (offsets[starts][:, None] + np.arange(depth)[None, :]).ravel()
                terms = pa.ListArray.from_arrays(pa.array(np.arange(0, len(index) + 1, depth), pa.int32()), flat.take(pa.array(index)))
                if stack[depth]:
                    if has[0] and terms[0].as_py() == stack[depth][0]:
                        sums[0] += stack[depth][1]
                        records[0] += stack[depth][2]
                    else:
                        yield popped(stack[depth])
                    stack[depth] = None
                closed = len(starts)
                if has[-1]:  # the last prefix may go on in the next batch
                    closed -= 1
                    stack[depth] = (terms[closed].as_py(), int(sums[closed]), int(records[closed]))
                if closed:
                    yield emitted(terms.slice(0, closed), sums[:closed], records[:closed])
        for found in stack:
            if found:
                yield popped(found)

    return run


def term_frequencies(records: DataFrame, terms: str, max_len: int = 1) -> DataFrame:
    """Occurrences and records of every n-gram of up to ``max_len`` terms: (terms ARRAY, occurrences, records).

    ``records`` has one row per record; ``terms`` is its array of terms. The row with the empty array has the number of all terms and of
    all records. A null array is a record without terms; null elements are skipped. The empty table gives no rows. Other columns are
    not read. Only counters travel: for ``max_len`` 1 at most one row per distinct term and ``BLOCK`` terms, so that no term is hot.
    """
    spark = records.sparkSession
    fields = "terms array<string>, occurrences long, " + ", ".join(f"first_{d} long" for d in range(max_len + 1))
    suffixes = records.select(F.col(terms).alias("terms")).mapInArrow(_suffix_batches(max_len), fields)
    parts = default_parallelism(spark)
    route: Column = F.xxhash64(F.coalesce(F.get("terms", F.lit(0)), F.lit("")))
    if max_len > 1:
        # first terms with more than half a partition's share of the suffixes: at most 2 * parts of them
        first = records.select(F.explode(terms).alias("first")).where("first IS NOT NULL").groupBy("first").count()
        total = first.agg(F.sum("count").alias("__total"))
        hot = cut_lineage(first.crossJoin(F.broadcast(total)).where(F.col("count") * 2 * parts >= F.col("__total")).select("first", F.ceil(F.col("count") * 2 * parts / F.col("__total")).alias("splits")))
        suffixes = suffixes.withColumn("first", F.get("terms", F.lit(0))).join(F.broadcast(hot), "first", "left")
        route = F.xxhash64(F.coalesce("first", F.lit("")), F.pmod(F.xxhash64("terms"), F.coalesce("splits", F.lit(1))))
    routed = suffixes.withColumn("__route", route).repartition(parts, "__route").sortWithinPartitions(F.col("terms").desc())
    ordered = routed.select("terms", "occurrences", *[f"first_{d}" for d in range(max_len + 1)])
    counted = ordered.mapInArrow(_stack_batches(max_len), "terms array<string>, occurrences long, records long")
    # the root, and prefixes of split first terms, come from several routes
    return counted.groupBy("terms").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_frequencies(records: DataFrame, terms: str, rare: int, common: float, max_len: int = 1) -> DataFrame:
    """``term_frequencies`` with ``mark``: ``rare`` in at most ``rare`` records, ``common`` in more than the share ``common`` of them, else null.

    Where both hold (tiny collections), ``rare`` wins. The empty n-gram is left out.
    """
    counts = cut_lineage(term_frequencies(records, terms, max_len))
    root = counts.where(F.size("terms") == 0).select(F.col("records").alias("__all"))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.col("__all") * F.lit(common), "common")
    return counts.where(F.size("terms") > 0).crossJoin(F.broadcast(root)).select("terms", "occurrences", "records", mark.alias("mark"))


#: Characters removed from a text before it is cut into words.
REMOVED = "([,.!?:;])"


def words_of(text: str | Column) -> Column:
    """Words of a text: lower case, without the ten removed characters, cut at blanks, tabs and line breaks; null gives null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.translate(F.lower(column), REMOVED, ""), "[ \\t\\n\\r\\x0b\\f]+"), lambda w: w != "")
