"""K-Means and multi-round clustering by summaries (BFR)."""

from __future__ import annotations

import hashlib
import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions.hashing import seeded_number
from orefield.session import cut_lineage

#: Up to so many coordinates (rows times dimensions, counted) the iterations of K-Means run in one task instead of one job each.
LOCAL_VALUES = 2_000_000


def _matrix(features: pd.Series, dim: int) -> np.ndarray:
    return np.array(features.tolist(), dtype=np.float64).reshape(len(features), dim)


def _nearest(centroids: list[tuple[int, list[float]]], point: Column) -> Column:
    """Id of the nearest centroid, the last one on ties; the table of centroids, as many as the caller asks for, goes to every task.

    One Arrow batch against one centroid at a time: a vector operation, where a higher-order function would be interpreted per element.
    """
    ids = np.array([i for i, _ in centroids], dtype=np.int32)
    table = np.array([c for _, c in centroids], dtype=np.float64)

    @F.pandas_udf("int")
    def nearest(features: pd.Series) -> pd.Series:
        points = _matrix(features, table.shape[1])
        best, at = np.full(len(points), np.inf), np.zeros(len(points), dtype=np.int64)
        for k, c in enumerate(table):
            d = np.sqrt(((points - c) ** 2).sum(axis=1))
            nearer = d <= best
            best[nearer], at[nearer] = d[nearer], k
        return pd.Series(ids[at])

    return nearest(point)


def assign(points: DataFrame, centroids: list[tuple[int, list[float]]]) -> DataFrame:
    """(point_id, features, cluster)."""
    return points.select("point_id", "features", _nearest(centroids, F.col("features")).alias("cluster"))


#: Clusters whose sums a task holds before it passes them on.
HELD_CLUSTERS = 20_000


def summaries(assigned: DataFrame) -> DataFrame:
    """(cluster, n, sum, sumsq) with arrays over the dimensions.

    Each task adds its points up in whole batches and passes one row per cluster on; those rows are combined per (cluster, dimension), so
    neither a large cluster nor a wide vector is a hot spot. Null clusters are left out.
    """

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def passed() -> pd.DataFrame:
            rows = [(c, n, s.tolist(), q.tolist()) for c, (n, s, q) in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["cluster", "n", "s", "q"])

        for frame in frames:
            if not len(frame):
                continue
            points = np.array(frame["features"].tolist(), dtype=np.float64).reshape(len(frame), -1)
            codes, names = pd.factorize(frame["cluster"])
            for k, name in enumerate(names):
                own = points[codes == k]
                had = held.get(int(name), (0, 0.0, 0.0))
                held[int(name)] = (had[0] + len(own), had[1] + own.sum(axis=0), had[2] + (own * own).sum(axis=0))
            if len(held) > HELD_CLUSTERS:
                yield passed()
        if held:
            yield passed()

    parts = assigned.where("cluster IS NOT NULL").select(F.col("cluster").cast("int").alias("cluster"), "features").mapInPandas(partial, "cluster int, n long, s array<double>, q array<double>")
    dims = parts.select("cluster", "n", F.posexplode(F.arrays_zip("s", "q")).alias("dim", "z")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("z.s").alias("s"), F.sum("z.q").alias("q"))
    rows = dims.groupBy("cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "s", "q"))).alias("d"))
    return rows.select("cluster", "n", F.col("d.s").alias("sum"), F.col("d.q").alias("sumsq"))


def centroids_of(summary: DataFrame) -> DataFrame:
    """(cluster, n, centroid, deviation): means and population deviations, variances below 0 taken as 0."""
    centroid = F.transform("sum", lambda s: s / F.col("n"))
    variance = F.zip_with("sumsq", centroid, lambda q, c: F.greatest(F.lit(0.0), q / F.col("n") - c * c))
    return summary.select("cluster", "n", centroid.alias("centroid"), F.transform(variance, lambda v: F.sqrt(v)).alias("deviation"))


def _seeded(seed: int, *parts) -> int:
    """``seeded_number`` of values."""
    return int(hashlib.md5("-".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16)


def _lloyd(ids: np.ndarray, points: np.ndarray, start: np.ndarray, max_rounds: int, tol: float, seed: int) -> tuple[np.ndarray, bool]:
    """The iterations of ``kmeans`` in memory: the last centroids, and whether they came to rest."""
    now = start
    for turn in range(max_rounds):
        best, at = np.full(len(points), np.inf), np.zeros(len(points), dtype=np.int64)
        for k, c in enumerate(now):
            d = np.sqrt(((points - c) ** 2).sum(axis=1))
            nearer = d <= best
            best[nearer], at[nearer] = d[nearer], k
        new = now.copy()
        for k in range(len(now)):
            own = points[at == k]
            new[k] = own.mean(axis=0) if len(own) else points[min(range(len(ids)), key=lambda p: (_seeded(seed, turn, k, ids[p]), ids[p]))]
        moved = np.sqrt(((new - now) ** 2).sum(axis=1)).max(initial=0.0)
        now = new
        if moved <= tol:
            return now, True
    return now, False


def kmeans(points: DataFrame, start: list[list[float]], max_rounds: int = 100, tol: float = 1e-4, seed: int = 0, local_values: int = LOCAL_VALUES) -> tuple[DataFrame, list[tuple[int, list[float]]]]:
    """Lloyd's algorithm from the centroids ``start``: ((point_id, features, cluster), centroids).

    Stops when no centroid moves farther than ``tol``; ending after ``max_rounds`` without that is warned of, unless ``tol`` is negative,
    which asks for a fixed number of rounds. A cluster that loses all points starts again from the point with the least seeded
    hash for that round and cluster. Only centroids reach the driver. The assignment returned is that of the final centroids.
    Up to ``local_values`` coordinates the iterations run in one task, with the same result; ``points`` is best a written table.
    """
    points = points.select("point_id", "features")
    dim = max(1, len(start[0]) if start else 1)
    rest = False
    if points.limit(local_values // dim + 1).count() <= local_values // dim:

        def loop(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [frame for frame in frames if len(frame)]
            if held:
                frame = pd.concat(held).sort_values("point_id")
                found, ended = _lloyd(frame["point_id"].to_numpy(), np.array(frame["features"].tolist(), dtype=np.float64), np.array(start, dtype=np.float64), max_rounds, tol, seed)
                yield pd.DataFrame({"k": range(len(found)), "centroid": found.tolist(), "ended": ended})

        rows = points.coalesce(1).mapInPandas(loop, "k int, centroid array<double>, ended boolean").collect()
        now = sorted((r["k"], list(r["centroid"])) for r in rows) or list(enumerate(start))
        rest = all(r["ended"] for r in rows)
    else:
        points = cut_lineage(points)
        now = list(enumerate(start))
        for turn in range(max_rounds):
            found = {r["cluster"]: list(r["centroid"]) for r in centroids_of(summaries(assign(points, now))).collect()}
            new = []
            for i, old in now:
                if i not in found:
                    again = points.orderBy(seeded_number(seed, F.lit(turn), F.lit(i), F.col("point_id")), "point_id").first()
                    new.append((i, list(again["features"]) if again else old))
                else:
                    new.append((i, found[i]))
            moved = max((math.dist(a, b) for (_, a), (_, b) in zip(now, new)), default=0.0)
            now = new
            if moved <= tol:
                rest = True
                break
    if not rest and tol >= 0:
        warnings.warn(f"K-Means has not converged after {max_rounds} rounds", RuntimeWarning, stacklevel=2)
    return assign(points, now), now


def first_within(points: DataFrame, clusters: list[tuple[int, list[float], list[float]]], limit: float) -> Column:
    """Id of the *first* cluster (id, centroid, deviation) nearer than ``limit`` in normalised distance, null if none."""
    if not clusters:
        return F.lit(None).cast("int")
    table = [(i, np.array(c, dtype=np.float64), np.where(np.array(s, dtype=np.float64) == 0, 1.0, s)) for i, c, s in clusters]

    @F.pandas_udf("int")
    def first(features: pd.Series) -> pd.Series:
        rows = _matrix(features, len(table[0][1]))
        out = np.full(len(rows), -1, dtype=np.int64)
        open_rows = np.ones(len(rows), dtype=bool)
        for i, c, s in table:
            near = open_rows & (np.sqrt((((rows - c) / s) ** 2).sum(axis=1)) < limit)
            out[near] = i
            open_rows &= ~near
        return pd.Series(out, dtype="Int64").mask(open_rows)

    return first(F.col("features"))


@dataclass
class Summary:
    """Mergeable statistics of a cluster; members live in a table, not here."""

    n: int
    total: list[float]
    squares: list[float]

    def merged(self, other: Summary) -> Summary:
        return Summary(self.n + other.n, [a + b for a, b in zip(self.total, other.total)], [a + b for a, b in zip(self.squares, other.squares)])

    @property
    def centroid(self) -> list[float]:
        return [s / self.n for s in self.total]

    @property
    def deviation(self) -> list[float]:
        return [math.sqrt(max(0.0, q / self.n - (s / self.n) ** 2)) for s, q in zip(self.total, self.squares)]


@dataclass
class BfrState:
    """State between rounds: summaries on the driver (a few per cluster), assignments and leftovers in tables, one more each round."""

    ds: dict[int, Summary] = field(default_factory=dict)
    cs: dict[int, Summary] = field(default_factory=dict)
    ds_stats: list[tuple[int, list[float], list[float]]] = field(default_factory=list)
    cs_stats: list[tuple[int, list[float], list[float]]] = field(default_factory=list)
    assigned: list[DataFrame] = field(default_factory=list)  # (point_id, kind, cluster)
    retained: list[DataFrame] = field(default_factory=list)  # (point_id, features)
    n_retained: int = 0
    rounds: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)


def _collect_summaries(assigned: DataFrame) -> dict[int, Summary]:
    """One summary per cluster; a few per cluster asked for, not per point."""
    return {r["cluster"]: Summary(r["n"], list(r["sum"]), list(r["sumsq"])) for r in summaries(assigned).collect()}


def _stats(clusters: dict[int, Summary]) -> list[tuple[int, list[float], list[float]]]:
    return [(i, clusters[i].centroid, clusters[i].deviation) for i in sorted(clusters)]


def _start_points(points: DataFrame, k: int, seed: int) -> list[list[float]]:
    """The ``k`` points of least seeded hash."""
    return [list(r["features"]) for r in points.orderBy(seeded_number(seed, F.lit("start"), F.col("point_id")), "point_id").limit(k).collect()]


def _start_means(points: DataFrame, k: int, seed: int, size: int = 6) -> list[list[float]]:
    """``k`` means of ``size`` points each: those of least seeded hash, taken together in the order of their ids; ``k`` single points where
    there are not enough."""
    drawn = points.orderBy(seeded_number(seed, F.lit("start"), F.col("point_id")), "point_id").limit(k * size).select("point_id", "features").collect()
    if len(drawn) < k * size:
        return [list(r["features"]) for r in drawn[:k]]
    drawn.sort(key=lambda r: r["point_id"])
    return [np.mean([r["features"] for r in drawn[i * size : (i + 1) * size]], axis=0).tolist() for i in range(k)]


def _split_leftover(points: DataFrame, k: int, tol: float, max_rounds: int, seed: int) -> tuple[DataFrame, DataFrame, dict[int, Summary], int]:
    """Clusters of more than one point and the single points as tables, the summaries of the clusters, the number of single points."""
    start = _start_points(points, k, seed)
    if not start:
        nothing = points.select("point_id", "features", F.lit(0).alias("cluster")).limit(0)
        return nothing, nothing.drop("cluster"), {}, 0
    clustered = cut_lineage(kmeans(points, start, max_rounds, tol, seed)[0])
    found = _collect_summaries(clustered)
    single = F.col("cluster").isin([i for i, s in found.items() if s.n == 1])
    return clustered.where(~single), clustered.where(single).select("point_id", "features"), {i: s for i, s in found.items() if s.n > 1}, sum(s.n == 1 for s in found.values())


def _labelled(df: DataFrame, kind: str) -> DataFrame:
    return df.select("point_id", F.lit(kind).alias("kind"), F.col("cluster").cast("int").alias("cluster"))


def bfr(points: DataFrame, k: int, alpha: float = 2.0, tol: float = 1e-4, max_rounds: int = 100, fraction: float = 0.2, seed: int = 7, refresh_ds: bool = False) -> BfrState:
    """Clusters points that come in rounds (point_id, features, round) by summaries; see ``BfrState``.

    Round 1: K-Means on a hash sample of ``fraction``, started from means of six points, gives the discard sets (DS); the other points of
    the round are clustered with ``2 k`` centroids into compression sets (CS) and single, retained points (RS). Later rounds: a point goes
    to the first DS nearer than ``alpha * sqrt(dim)``, else to the first such CS, else to RS; when RS has more than ``4 k`` points it is
    clustered again, and each new CS is merged into the first old one within reach (``_apart``) or kept under an id from
    ``len(cs) + 100``. DS statistics are those of round 1 unless ``refresh_ds``; CS statistics are renewed when RS is clustered. Round
    statistics: (round, DS clusters, DS points, CS clusters, CS points, RS points); every point seen is in one of the three.
    """
    order = [r["round"] for r in points.select("round").distinct().orderBy("round").collect()]
    state = BfrState()
    if not order:
        return state
    first = cut_lineage(points.where(F.col("round") == order[0]).select("point_id", "features"))
    limit = alpha * math.sqrt(len(first.first()["features"]))
    in_sample = seeded_number(seed, F.col("point_id")) < int(fraction * (1 << 32))
    if first.where(in_sample).isEmpty():
        in_sample = F.lit(True)
    chosen = first.where(in_sample)
    ds_points, _ = kmeans(chosen, _start_means(chosen, k, seed), max_rounds, tol, seed)
    ds_points = cut_lineage(ds_points)
    state.ds = _collect_summaries(ds_points)
    state.ds_stats = _stats(state.ds)
    cs_points, rs, state.cs, state.n_retained = _split_leftover(first.where(~in_sample), 2 * k, tol, max_rounds, seed)
    state.cs_stats = _stats(state.cs)
    state.assigned = [_labelled(ds_points, "DS"), _labelled(cs_points, "CS")]
    state.retained = [rs]
    _note(state, order[0])
    for turn in order[1:]:
        batch = points.where(F.col("round") == turn).select("point_id", "features")
        ds, cs = first_within(batch, state.ds_stats, limit), first_within(batch, state.cs_stats, limit)
        # one number for both kinds: even for DS, odd for CS, null for RS
        probed = cut_lineage(batch.withColumn("cluster", F.coalesce(ds * 2, cs * 2 + 1)))
        seen = 0
        for code, s in _collect_summaries(probed).items():
            target = state.cs if code % 2 else state.ds
            target[code // 2] = target[code // 2].merged(s)
            seen += s.n
        if refresh_ds:
            state.ds_stats = _stats(state.ds)
        kind = F.when(F.col("cluster") % 2 == 0, "DS").otherwise("CS")
        state.assigned.append(probed.where("cluster IS NOT NULL").select("point_id", kind.alias("kind"), F.floor(F.col("cluster") / 2).cast("int").alias("cluster")))
        state.retained.append(probed.where("cluster IS NULL").select("point_id", "features"))
        state.n_retained += probed.count() - seen
        if state.n_retained > 4 * k:
            new_points, singles, new, state.n_retained = _split_leftover(reduce(DataFrame.unionByName, state.retained), 2 * k, tol, max_rounds, seed + turn)
            target_of = {}
            next_id = len(state.cs) + 100
            for i, centroid, deviation in _stats(new):
                hit = next((j for j, c, d in state.cs_stats if _apart(centroid, deviation, c, d) < limit), None)
                if hit is None:
                    while next_id in state.cs:
                        next_id += 1
                    hit = next_id
                    state.cs[hit] = new[i]
                else:
                    state.cs[hit] = state.cs[hit].merged(new[i])
                target_of[i] = hit
            state.cs_stats = _stats(state.cs)
            if target_of:
                renamed = F.create_map(*[F.lit(x) for pair in target_of.items() for x in pair])[F.col("cluster")]
                state.assigned.append(_labelled(new_points.withColumn("cluster", renamed), "CS"))
            state.retained = [singles]
        _note(state, turn)
    return state


def _apart(a: list[float], a_deviation: list[float], b: list[float], b_deviation: list[float]) -> float:
    """Distance of two clusters: the smaller of the two that are scaled by the deviations of one of them; a deviation of 0 divides by 1."""
    return min(math.sqrt(sum(((x - y) / (s or 1.0)) ** 2 for x, y, s in zip(a, b, scale))) for scale in (a_deviation, b_deviation))


def _note(state: BfrState, turn: int) -> None:
    state.rounds.append((turn, len(state.ds), sum(s.n for s in state.ds.values()), len(state.cs), sum(s.n for s in state.cs.values()), state.n_retained))


def bfr_final(state: BfrState) -> dict[int, int]:
    """The DS nearest to each CS by the centroids last renewed; ties go to the later one."""
    return {i: min(((math.dist(own, c), -k, j) for k, (j, c, _) in enumerate(state.ds_stats)), default=(0.0, 0, -1))[2] for i, own, _ in state.cs_stats}


def bfr_labels(state: BfrState) -> DataFrame:
    """(point_id, cluster): DS members, CS members under their nearest DS, retained points as -1."""
    nearest = bfr_final(state)
    pairs = [F.lit(x) for pair in nearest.items() for x in pair]
    merged = F.create_map(*pairs)[F.col("cluster")] if pairs else F.lit(-1)
    kept = reduce(DataFrame.unionByName, state.assigned).select("point_id", F.when(F.col("kind") == "DS", F.col("cluster")).otherwise(merged).cast("int").alias("cluster"))
    return kept.unionByName(reduce(DataFrame.unionByName, state.retained).select("point_id", F.lit(-1).alias("cluster")))


def round_report(state: BfrState, spark) -> DataFrame:
    """The round statistics as a table of six columns."""
    return spark.createDataFrame(state.rounds, "round int, ds_clusters int, ds_points long, cs_clusters int, cs_points long, rs_points long")
