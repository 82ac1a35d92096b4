"""Distinct counts of huge identifier sets: mergeable set sketches with registers of logarithmic base.

A sketch has ``m`` registers. Register i holds K_i = floor(1 - log_b(h_i)), where h_i is the least of the set's exponential(a) hash values
for i; a larger set has larger registers, and the union of two sets has their maximum. The base b close to 1 makes a register almost as
informative as the hash value itself, so two sketches also tell how much their sets overlap.

An identifier draws its ``m`` hash values in ascending order, as sums of exponential spacings, and meets the registers in the order of a
permutation of its own. Once a value is above every register's, so are all that follow, and the identifier is done: in a large set
nearly all stop at their first value.

Every estimate comes from registers, for small sets as for large ones. Only the stored form differs: up to ``sparse`` identifiers are
kept as the 64-bit hashes from which the registers follow, which takes no more room than the registers.

Stated errors (relative standard deviation): of a count sqrt(((b + 1) / (b - 1) * ln b - 1) / m), of a Jaccard estimate from the Fisher
information of the three register comparisons (greater, equal, less).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.session import default_parallelism

_CHUNK = 1 << 15
#: Up to so many identifiers all hash values are drawn at once, in tables of so many values.
_FEW, _TABLE = 64, 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class SketchSpec:
    """Parameters of a sketch: registers, base, rate, largest sparse set. Only sketches of equal parameters can be merged."""

    m: int = 1024
    b: float = 1.001
    a: float = 20.0
    sparse: int = 256

    def __post_init__(self) -> None:
        if self.m < 2 or self.m & (self.m - 1) or not 1 < self.b <= 2 or self.a <= 0 or self.sparse < 0:
            raise ValueError("m a power of 2, 1 < b <= 2, a > 0 and sparse >= 0 are required")

    @property
    def count_error(self) -> float:
        b = self.b
        return math.sqrt(((b + 1) / (b - 1) * math.log(b) - 1) / self.m)

    def registers(self, least: np.ndarray) -> np.ndarray:
        """Register values for the least hash values."""
        k = np.floor(1 - np.log(np.maximum(least, 1e-300)) / math.log(self.b))
        return np.clip(k, 0, 65535).astype("<u2")

    def _spacing(self, hashes: np.ndarray, step: np.ndarray | int) -> np.ndarray:
        """The ``step``-th spacing (from 0) of identifiers: exponential with rate a times the number of values left."""
        u = (_mix(hashes + np.asarray(step, dtype=np.uint64) * _GOLDEN) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        return -np.log1p(-u) / (self.a * (self.m - np.asarray(step, dtype=np.float64)))

    def _order(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First register and (odd) stride of the permutation of each identifier."""
        drawn = _mix(hashes ^ np.uint64(0xD6E8FEB86659FD93))
        return (drawn & np.uint64(self.m - 1)).astype(np.int64), ((drawn >> np.uint64(32)) & np.uint64(self.m - 1)).astype(np.int64) | 1

    def _all_values(self, hashes: np.ndarray) -> np.ndarray:
        """The hash values of each identifier by register."""
        steps = np.arange(self.m)
        values = np.cumsum(self._spacing(hashes[:, None], steps[None, :]), axis=1)
        first, stride = self._order(hashes)
        out = np.empty_like(values)
        np.put_along_axis(out, (first[:, None] + stride[:, None] * steps[None, :]) & (self.m - 1), values, axis=1)
        return out

    def _least_values(self, hashes: np.ndarray) -> np.ndarray:
        """The least hash value by register of one large set."""
        least = np.full(self.m, np.inf)
        for at in range(0, len(hashes), _CHUNK):
            part = hashes[at : at + _CHUNK]
            place, stride = self._order(part)
            value = np.zeros(len(part))
            for step in range(self.m):
                value += self._spacing(part, step)
                keep = value <= least.max()
                if not keep.all():
                    part, place, stride, value = part[keep], place[keep], stride[keep], value[keep]
                if not len(part):
                    break
                np.minimum.at(least, place, value)
                place = (place + stride) & (self.m - 1)
        return least

    def dense(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Registers of consecutive groups of hashes; ``starts`` are the places where groups begin."""
        hashes = hashes.astype(np.uint64, copy=False)
        ends = np.r_[starts[1:], len(hashes)]
        out = np.empty((len(starts), self.m), dtype="<u2")
        few = np.flatnonzero(ends - starts <= _FEW)
        size, held = 0, []
        for k in [*few.tolist(), -1]:
            if held and (k < 0 or (size + ends[k] - starts[k]) * self.m > _TABLE):
                values = self._all_values(np.concatenate([hashes[starts[g] : ends[g]] for g in held]))
                out[held] = self.registers(np.minimum.reduceat(values, np.cumsum([0, *[ends[g] - starts[g] for g in held[:-1]]]), axis=0))
                size, held = 0, []
            if k >= 0:
                held.append(k)
                size += ends[k] - starts[k]
        for k in np.flatnonzero(ends - starts > _FEW):
            out[k] = self.registers(self._least_values(hashes[starts[k] : ends[k]]))
        return out

    def cardinality(self, k: np.ndarray) -> float:
        """Estimate from registers."""
        b = self.b
        return float(self.m * (1 - 1 / b) / (self.a * math.log(b) * np.power(b, -k.astype(np.float64)).sum()))


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer of the splitmix generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduce(spec: SketchSpec, cell: np.ndarray, hashes: np.ndarray, dense: dict[int, np.ndarray]) -> tuple[dict[int, bytes], dict[int, bytes]]:
    """Sparse and dense payloads by cell code, from (cell, hash) rows and the registers that some cells have already."""
    order = np.lexsort((hashes, cell))
    cell, hashes = cell[order], hashes[order]
    if len(cell):
        new = np.r_[True, (cell[1:] != cell[:-1]) | (hashes[1:] != hashes[:-1])]
        cell, hashes = cell[new], hashes[new]
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, dtype=np.int64)
    ends = np.r_[starts[1:], len(cell)].astype(np.int64)
    sparse: dict[int, bytes] = {}
    full = {c: k.tobytes() for c, k in dense.items()}
    heavy = []
    for s, e in zip(starts.tolist(), ends.tolist()):
        c = int(cell[s])
        if c not in dense and e - s <= spec.sparse:
            sparse[c] = hashes[s:e].tobytes()
        else:
            heavy.append((c, s, e))
    run: list[tuple[int, int, int]] = []
    room = 0
    for x in [*heavy, None]:
        if run and (x is None or room + x[2] - x[1] > _CHUNK):
            part = np.concatenate([hashes[s:e] for _, s, e in run])
            at = np.cumsum([0, *[e - s for _, s, e in run[:-1]]])
            for (c, _, _), k in zip(run, spec.dense(part, at)):
                full[c] = np.maximum(k, dense[c]).tobytes() if c in dense else k.tobytes()
            run, room = [], 0
        if x is not None:
            run.append(x)
            room += x[2] - x[1]
    return sparse, full


_OUT = pa.schema([("cell", pa.string()), ("is_sparse", pa.bool_()), ("payload", pa.binary())])


def _emit(names: list[str], sparse: dict[int, bytes], full: dict[int, bytes]) -> pa.RecordBatch:
    cells = [*[names[c] for c in sparse], *[names[c] for c in full]]
    return pa.RecordBatch.from_arrays(
        [pa.array(cells, pa.string()), pa.array([True] * len(sparse) + [False] * len(full), pa.bool_()), pa.array([*sparse.values(), *full.values()], pa.binary())], schema=_OUT
    )


def _partial(spec: SketchSpec, rows: int):
    """Map side: sketches of up to ``rows`` rows at a time, so memory is bounded."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        coded = t.column(0).combine_chunks().dictionary_encode()
        sparse, full = _reduce(spec, np.asarray(coded.indices, dtype=np.int64), np.asarray(t.column(1).combine_chunks(), dtype=np.int64), {})
        return _emit(coded.dictionary.to_pylist(), sparse, full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= rows:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return run


def _merge(spec: SketchSpec):
    """Reduce side: merges the sketches of each cell; input is sorted by cell, and a cell may span batches."""

    def merged(names: list[str], codes: np.ndarray, kinds: np.ndarray, payloads: list[bytes]) -> tuple[dict[int, bytes], dict[int, bytes]]:
        dense: dict[int, np.ndarray] = {}
        sizes = np.array([len(p) // 8 if k else 0 for p, k in zip(payloads, kinds)], dtype=np.int64)
        hashes = np.frombuffer(b"".join(p for p, k in zip(payloads, kinds) if k), dtype=np.int64)
        for c, k, p in zip(codes.tolist(), kinds.tolist(), payloads):
            if not k:
                regs = np.frombuffer(p, dtype="<u2")
                dense[c] = np.maximum(dense[c], regs) if c in dense else regs
        return _reduce(spec, np.repeat(codes, sizes), hashes, dense)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, bool, bytes] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, kinds, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            if held:
                names, kinds, payloads = [held[0], *names], [held[1], *kinds], [held[2], *payloads]
            known: dict[str, int] = {}
            codes = np.array([known.setdefault(x, len(known)) for x in names], dtype=np.int64)
            listed = list(known)
            sparse, full = merged(listed, codes, np.array(kinds, dtype=bool), payloads)
            last = len(listed) - 1
            held = (listed[last], last in sparse, sparse.pop(last) if last in sparse else full.pop(last))
            if sparse or full:
                yield _emit(listed, sparse, full)
        if held:
            yield _emit([held[0]], {0: held[2]} if held[1] else {}, {} if held[1] else {0: held[2]})

    return run


def sketch_sets(df: DataFrame, cells: list[str], member: str, spec: SketchSpec = SketchSpec(), rows: int = 250_000) -> DataFrame:
    """One sketch per combination of the string columns ``cells``: those columns, is_sparse, payload.

    Null members are skipped; a cell without members has no sketch. Null cell values form cells of their own. Repeated rows change
    nothing. Only partial sketches are shuffled: per task and cell at most ``max(8 * sparse, 2 * m)`` bytes for each ``rows`` rows.
    """
    cell = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in cells]), {"ignoreNullFields": "false"})
    pairs = df.where(F.col(member).isNotNull()).select(cell.alias("cell"), F.xxhash64(F.col(member).cast("string")).alias("hash"))
    return _combined(pairs.mapInArrow(_partial(spec, rows), _ddl()), cells, spec)


def _ddl() -> str:
    return "cell string, is_sparse boolean, payload binary"


def _combined(partials: DataFrame, cells: list[str], spec: SketchSpec) -> DataFrame:
    parts = default_parallelism(partials.sparkSession)
    merged = partials.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_merge(spec), _ddl())
    fields = F.from_json("cell", ", ".join(f"`{c}` string" for c in cells))
    return merged.select(fields.alias("__c"), "is_sparse", "payload").select(*[F.col("__c").getField(c).alias(c) for c in cells], "is_sparse", "payload")


def merge_sketches(sketches: DataFrame, cells: list[str], spec: SketchSpec = SketchSpec()) -> DataFrame:
    """Roll sketches up to the coarser combination ``cells``: the union of the sets, without the original rows."""
    cell = F.to_json(F.struct(*[F.col(c).alias(c) for c in cells]), {"ignoreNullFields": "false"})
    return _combined(sketches.select(cell.alias("cell"), "is_sparse", "payload"), cells, spec)


def _registers_of(spec: SketchSpec, sparse: list[bool], payloads: list[bytes], size: int = 1024) -> Iterator[np.ndarray]:
    """The registers of each sketch, whatever form it is stored in, ``size`` sketches at a time."""
    for at in range(0, len(payloads), size):
        part = payloads[at : at + size]
        kinds = sparse[at : at + size]
        hashes = [np.frombuffer(p, dtype=np.int64) for p, k in zip(part, kinds) if k]
        made = iter(spec.dense(np.concatenate(hashes), np.cumsum([0, *map(len, hashes[:-1])]))) if hashes else iter(())
        for p, k in zip(part, kinds):
            yield next(made) if k else np.frombuffer(p, dtype="<u2")


def with_estimates(sketches: DataFrame, spec: SketchSpec = SketchSpec()) -> DataFrame:
    """Adds n_distinct (DOUBLE), estimated from registers, and rel_error, the stated relative standard error."""

    @F.pandas_udf("double")
    def estimate(is_sparse: pd.Series, payload: pd.Series) -> pd.Series:
        return pd.Series([spec.cardinality(k) for k in _registers_of(spec, is_sparse.tolist(), payload.tolist())], dtype="float64")

    return sketches.withColumn("n_distinct", estimate("is_sparse", "payload")).withColumn("rel_error", F.lit(spec.count_error))


def joint_estimate(spec: SketchSpec, ku: np.ndarray, kv: np.ndarray) -> tuple[float, float, float]:
    """Maximum-likelihood Jaccard index of two register sets, the size of their union, and the standard error of the index."""
    nu, nv = spec.cardinality(ku), spec.cardinality(kv)
    u, v = nu / (nu + nv), nv / (nu + nv)
    ku, kv = ku.astype(np.int64), kv.astype(np.int64)
    more, less = int((ku > kv).sum()), int((ku < kv).sum())
    same = spec.m - more - less
    top = min(u / v, v / u)
    log_b = math.log(spec.b)

    def p(x: float) -> float:
        return -math.log1p(-max(x, 0.0) * (spec.b - 1) / spec.b) / log_b

    def slope(x: float) -> float:
        return (spec.b - 1) / spec.b / (1 - max(x, 0.0) * (spec.b - 1) / spec.b) / log_b

    def loss(j: float) -> float:
        pm, pl = p(u - v * j), p(v - u * j)
        total = 0.0
        for n, q in ((more, pm), (less, pl), (same, 1 - pm - pl)):
            if n:
                total -= n * math.log(max(q, 1e-300))
        return total

    low, high, golden = 0.0, top, (math.sqrt(5) - 1) / 2
    c, d = high - golden * (high - low), low + golden * (high - low)
    fc, fd = loss(c), loss(d)
    for _ in range(60):
        if fc <= fd:
            high, d, fd = d, c, fc
            c = high - golden * (high - low)
            fc = loss(c)
        else:
            low, c, fc = c, d, fd
            d = low + golden * (high - low)
            fd = loss(d)
    j = min(((low + high) / 2, 0.0, top), key=loss)
    pm, pl = p(u - v * j), p(v - u * j)
    dm, dl = -v * slope(u - v * j), -u * slope(v - u * j)
    information = spec.m * sum(s * s / max(q, 1e-12) for s, q in ((dm, pm), (dl, pl), (dm + dl, 1 - pm - pl)))
    error = 1 / math.sqrt(information)
    if top - j < 1e-6:  # one set seems to lie in the other: no comparison informs on one side, and the index varies as a share of m registers
        error = max(error, math.sqrt(j * (1 - j) / spec.m))
    return j, (nu + nv) / (1 + j), error


def joint_estimates(pairs: DataFrame, spec: SketchSpec = SketchSpec()) -> DataFrame:
    """For rows with two sketches (is_sparse_a, payload_a, is_sparse_b, payload_b): adds n_union, n_both, jaccard, jaccard_error."""

    @F.pandas_udf("struct<n_union: double, n_both: double, jaccard: double, jaccard_error: double>")
    def estimate(sa: pd.Series, pa_: pd.Series, sb: pd.Series, pb: pd.Series) -> pd.DataFrame:
        out = []
        for kx, ky in zip(_registers_of(spec, sa.tolist(), pa_.tolist()), _registers_of(spec, sb.tolist(), pb.tolist())):
            j, union, error = joint_estimate(spec, kx, ky)
            out.append((union, union * j, j, error))
        return pd.DataFrame(out, columns=["n_union", "n_both", "jaccard", "jaccard_error"])

    names = ["is_sparse_a", "payload_a", "is_sparse_b", "payload_b"]
    joined = pairs.withColumn("__joint", estimate(*names))
    return joined.select(*[c for c in pairs.columns if c not in names], "__joint.*")
