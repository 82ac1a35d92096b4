"""Sets and graphs whose rows are counted small, as arrays of numbers that every task holds: self-joins and walks without an exchange.

Joins over tables write each pair that meets, or each (root, node, neighbour), before most of them are dropped. Here a task makes them
for its own share of the records or roots, a bounded number at a time, and only results leave it. The arrays come to the tasks by
broadcast, so callers count rows first and keep their way over tables for more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from orefield.session import default_parallelism, ship_package

#: Pairs or arcs that a task expands at a time.
AT_ONCE = 1_000_000


def in_shares(spark: SparkSession, work: Callable[[int, int], Iterator[pa.RecordBatch]], schema: str, shares: int | None = None) -> DataFrame:
    """The batches of ``work(share, shares)``, one task per share; as many as shuffle partitions unless ``shares`` is given."""
    ship_package(spark)
    shares = shares or default_parallelism(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for share in batch.column(0).to_pylist():
                yield from work(share, shares)

    return spark.range(0, shares, 1, shares).mapInArrow(run, schema)


def coded(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct values of the columns in their order (bytes for strings), and each column as places in it."""
    values = pc.unique(pa.chunked_array([chunk for column in columns for chunk in column.chunks], type=columns[0].type))
    values = values.take(pc.sort_indices(values))
    return values, [pc.index_in(column, values).to_numpy().astype(np.int32) for column in columns]


def starts(codes: np.ndarray, n: int) -> np.ndarray:
    """Where the rows of each of ``n`` codes begin among rows sorted by code; one more entry for the end."""
    return np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=n))]).astype(np.int64)


def spans(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``first[i] .. first[i] + counts[i] - 1`` of all i, one after the other."""
    return np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)


class Sets:
    """Sets of tokens, both as places in sorted order: by record, and by token."""

    def __init__(self, rows: DataFrame):
        """``rows``: (record, token), distinct and without nulls."""
        table = rows.toArrow()
        self.names, (record,) = coded(table.column("record"))
        _, (token,) = coded(table.column("token"))
        del table  # the largest of what the driver holds
        n, m = len(self.names), int(token.max()) + 1 if len(token) else 0
        by_record = np.lexsort((token, record))
        record, token = record[by_record], token[by_record]
        self.begin, self.tokens = starts(record, n), token
        by_token = np.argsort(token, kind="stable")  # records rise within a token
        self.holders = record[by_token]
        place = np.empty(len(token), np.int64)
        place[by_token] = np.arange(len(token))
        self.later = place + 1  # per row: the holders of its token after its own record
        self.left = (starts(token, m)[1:][token] - self.later) if m else np.empty(0, np.int64)

    def shared(self, share: int, shares: int, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, number of shared tokens) of the pairs a < b that share any, for a in ``share``, some records at a time."""
        n = len(self.names)
        mine = np.arange(share, n, shares)
        if not len(mine):
            return
        size = self.begin[mine + 1] - self.begin[mine]
        costs = np.concatenate([[0], np.cumsum(self.left)])
        cost = np.cumsum(costs[self.begin[mine + 1]] - costs[self.begin[mine]])
        for part in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(cost // at_once)) + 1):
            rows = spans(self.begin[mine[part]], size[part])
            at = np.repeat(np.arange(len(part)), size[part])  # records of this part, numbered
            counts = self.left[rows]
            keys = np.repeat(at.astype(np.int64) * n, counts) + self.holders[spans(self.later[rows], counts)]
            if len(part) * n <= 4 * len(keys):
                counted = np.bincount(keys, minlength=len(part) * n)
                keys = np.flatnonzero(counted)
                shared = counted[keys]
            else:
                keys, shared = np.unique(keys, return_counts=True)
            yield mine[part][keys // n], keys % n, shared

    def similar(self, share: int, shares: int, threshold: float, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, Jaccard index) of the pairs a < b with an index of at least ``threshold`` (above 0), as ``shared``."""
        size = np.diff(self.begin)
        for a, b, shared in self.shared(share, shares, at_once):
            sim = shared / (size[a] + size[b] - shared)
            kept = np.flatnonzero(sim >= threshold)
            for at in range(0, len(kept), at_once):
                some = kept[at : at + at_once]
                yield a[some], b[some], sim[some]

    def signatures(self, a: list[int], b: list[int], m: int) -> np.ndarray:
        """Per record and coefficient pair the least ``(a*i + b) % m`` over the places i of its tokens."""
        found = np.empty((len(self.names), len(a)), np.min_scalar_type(m))
        for k, (x, y) in enumerate(zip(a, b)) if len(found) else ():
            found[:, k] = np.minimum.reduceat((self.tokens.astype(np.int64) * x + y) % m, self.begin[:-1])
        return found


def agree(signatures: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int, at_once: int = AT_ONCE // 4) -> np.ndarray:
    """Whether the signatures of a and b are equal in a band of ``rows``; what is left over at the end is not used."""
    used = signatures.shape[1] // rows * rows
    found = np.zeros(len(a), bool)
    for i in range(0, len(a), at_once):
        same = signatures[a[i : i + at_once], :used] == signatures[b[i : i + at_once], :used]
        found[i : i + at_once] = same.reshape(len(same), used // rows, rows).all(axis=2).any(axis=1)
    return found


class Graph:
    """Arcs between nodes as places in sorted order."""

    def __init__(self, edges: DataFrame | pa.Table):
        table = edges if isinstance(edges, pa.Table) else edges.select("src", "dst").toArrow()
        self.names, (src, dst) = coded(table.column("src"), table.column("dst"))
        del table
        n = len(self.names)
        src, dst = (x.astype(np.int32) for x in np.divmod(np.unique(src.astype(np.int64) * n + dst), max(n, 1)))  # repeated arcs count once
        self.begin, self.target = starts(src, n), dst
        ends = np.minimum(src, dst).astype(np.int64) * n + np.maximum(src, dst)
        found, self.edge = np.unique(ends, return_inverse=True)  # per arc: its edge
        self.edge, self.u, self.v = (x.astype(np.int32) for x in (self.edge, *np.divmod(found, max(n, 1))))  # the broadcast is a file on every machine

    def batches(self, share: int, shares: int, at_once: int = AT_ONCE) -> Iterator[np.ndarray]:
        """The roots of ``share``, as many at a time as have ``at_once`` arcs and (root, node) places together."""
        mine = np.flatnonzero(np.diff(self.begin))[share::shares]
        step = max(1, at_once // max(1, len(self.target), len(self.names)))
        for i in range(0, len(mine), step):
            yield mine[i : i + step]

    def walk(self, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Breadth first from all ``roots`` at once: distances (-1: not reached) and numbers of shortest paths at place
        ``i * nodes + node`` for the root i, and per level the arcs on such paths (from, to, arc)."""
        n = len(self.names)
        degree = np.diff(self.begin)
        dist, sigma = np.full(len(roots) * n, -1, np.int32), np.zeros(len(roots) * n)
        mark = np.empty(len(roots) * n, np.int64)
        front = np.arange(len(roots), dtype=np.int64) * n + roots
        dist[front], sigma[front] = 0, 1.0
        levels, depth = [], 0
        while len(front):
            depth += 1
            node = front % n
            counts = degree[node]
            arc = spans(self.begin[node], counts)
            to = np.repeat(front - node, counts) + self.target[arc]
            new = np.flatnonzero(dist[to] < 0)
            to, arc, at = to[new], arc[new], np.repeat(front, counts)[new]
            dist[to] = depth
            np.add.at(sigma, to, sigma[at])
            places = np.arange(len(to))
            mark[to] = places
            front = to[mark[to] == places]
            if len(to):
                levels.append((at, to, arc))
        return dist, sigma, levels

    def sweep(self, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances and numbers of paths as in ``walk``, and what the shortest paths from ``roots`` send over each edge."""
        total = np.zeros(len(self.u))
        dist, sigma, levels = self.walk(roots)
        credit = np.ones(len(sigma))
        for at, to, arc in reversed(levels):
            flow = credit[to] * sigma[at] / sigma[to]
            np.add.at(credit, at, flow)
            np.add.at(total, self.edge[arc], flow)
        return dist, sigma, total

    def flows(self, share: int, shares: int, at_once: int = AT_ONCE) -> np.ndarray:
        """What the shortest paths from the roots of ``share`` send over each edge."""
        total = np.zeros(len(self.u))
        for roots in self.batches(share, shares, at_once):
            total += self.sweep(roots)[2]
        return total
