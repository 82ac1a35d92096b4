"""Co-occurrence graphs: label propagation, components, betweenness, modularity, divisive communities.

Edges are (src, dst) rows in both directions. Loops run on the driver over written tables; what comes back to it are single numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.operators import division
from orefield.operators.compact import Graph, Sets, in_shares
from orefield.operators.hotkeys import bounded_broadcast
from orefield.operators.meeting import meet, rare_part, shared_counts, sized_tokens
from orefield.session import cut_lineage, default_parallelism, ship_package

#: Up to so many (node, item) rows (counted) go to every task, which pairs its share of the nodes.
LOCAL_ROWS = 2_000_000
#: Nodes with enough items that are broadcast.
MAX_BROADCAST = 500_000


def cooccurrence_edges(pairs: DataFrame, node: str, item: str, at_least: int, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Both directions of each edge between nodes that share ``at_least`` items: (src, dst).

    Nodes with fewer items take no part; where those with enough rows are few (counted), the others' rows are dropped before any exchange of rows. Up to ``local_rows`` rows are paired in tasks that hold them all, so that pairs with too few
    shared items are never written. Beyond, nodes meet on shared items only. Of n items of a node, only its ``n - at_least + 1`` rarest are used to find partners, since one
    of those must be shared; frequent items, which would pair everybody with everybody, mostly drop out, and those left are split.
    Then shared items are counted.
    """
    rows = pairs.select(F.col(node).alias("record"), F.col(item).alias("token")).where("record IS NOT NULL AND token IS NOT NULL")
    if at_least > 1:  # repeated rows are still counted, so no node with enough items is lost
        enough = cut_lineage(rows.groupBy("record").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least).select("record"))
        few = bounded_broadcast(enough, MAX_BROADCAST)
        rows = rows if few is enough else rows.join(few, "record", "left_semi")
    rows = cut_lineage(rows.distinct())
    sizes = cut_lineage(rows.groupBy("record").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least))
    if local_rows and (sizes.agg(F.sum("n")).first()[0] or 0) <= local_rows:
        kind = rows.schema["record"].dataType.simpleString()
        held = rows.sparkSession.sparkContext.broadcast(Sets(rows.join(bounded_broadcast(sizes.select("record"), MAX_BROADCAST), "record", "left_semi")))

        def pair(share: int, shares: int) -> Iterator[pa.RecordBatch]:
            sets = held.value
            for a, b, shared in sets.shared(share, shares):
                a, b = a[shared >= at_least], b[shared >= at_least]
                yield pa.RecordBatch.from_arrays([sets.names.take(pa.array(a)), sets.names.take(pa.array(b))], ["u", "v"])

        found = cut_lineage(in_shares(rows.sparkSession, pair, f"u {kind}, v {kind}"))
        held.destroy()
        return _both(found)  # each pair comes once
    tokens = cut_lineage(sized_tokens(rows, sizes))
    met = meet(rare_part(tokens, F.lit(max(1, at_least))).drop("df"), ["token"])
    pairs_ = met.select(F.col("a.record").alias("a"), F.col("b.record").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b")).where("a < b").distinct()
    return both_ways(shared_counts(pairs_, tokens).where(F.col("shared") >= at_least).select(F.col("a").alias("u"), F.col("b").alias("v")))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst")))


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions from (u, v)."""
    return _both(edges).distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).distinct()


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label) after synchronous rounds; ties go to the smallest label, the first label is the node itself."""
    edges = cut_lineage(edges)
    labels = vertices(edges).withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy("dst", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("dst").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best"))
        labels = cut_lineage(best.select(F.col("dst").alias("node"), F.col("best.label").alias("label")))
    return labels


def communities(labels: DataFrame) -> DataFrame:
    """(members): sorted members of each label, for reports."""
    return labels.groupBy("label").agg(F.sort_array(F.collect_list("node")).alias("members")).select("members")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node that can be reached. Labels also jump along labels, so long chains take few rounds.

    Runs until no label changes; each round lowers a label, so it ends.
    """
    edges = cut_lineage(edges)
    start = (nodes or vertices(edges)).select("node").distinct()
    labels = cut_lineage(start.withColumn("component", F.col("node")))
    moved = True
    while moved:
        heard = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, "node", "left").select("node", F.least("component", "heard").alias("component"))
        target = nearer.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        new = cut_lineage(nearer.join(target, "component", "left").select("node", F.least("component", "jump").alias("component")))
        moved = not new.join(labels, ["node", "component"], "left_anti").isEmpty()
        labels = new
    return labels


#: Written levels that a plan unites at most; beyond, they are written as one.
LEVELS = 16


def _united(parts: list[DataFrame]) -> list[DataFrame]:
    """The parts, as one written table if there are many."""
    return [cut_lineage(reduce(DataFrame.unionByName, parts))] if len(parts) > LEVELS else parts


#: Up to so many edges (counted) the graph goes to every task, which walks from its share of the roots.
WALK_EDGES = 1_000_000


def _held(edges: DataFrame, local_edges: int):
    """The graph as a broadcast of arrays if it has at most ``local_edges`` edges (counted), else None."""
    if not local_edges or edges.limit(2 * local_edges + 1).count() > 2 * local_edges:
        return None
    return edges.sparkSession.sparkContext.broadcast(Graph(edges))


def shortest_paths(edges: DataFrame, roots: DataFrame | None = None, local_edges: int = WALK_EDGES) -> DataFrame:
    """(root, node, dist, sigma): distances and numbers of shortest paths from every node, or from ``roots`` (node), level by level until
    nothing new is reached.

    From every node of a graph of up to ``local_edges`` edges the paths are walked in tasks and written by nobody but the caller.
    """
    edges = cut_lineage(edges)
    graph = _held(edges, local_edges) if roots is None else None
    if graph:
        kind = edges.schema["src"].dataType.simpleString()

        def walk(share: int, shares: int) -> Iterator[pa.RecordBatch]:
            held = graph.value
            for starts in held.batches(share, shares):
                dist, sigma, _ = held.walk(starts)
                at = np.flatnonzero(dist >= 0)
                root, node = np.divmod(at, len(held.names))
                yield pa.RecordBatch.from_arrays([held.names.take(pa.array(starts[root])), held.names.take(pa.array(node)), pa.array(dist[at]), pa.array(sigma[at])], ["root", "node", "dist", "sigma"])

        return in_shares(edges.sparkSession, walk, f"root {kind}, node {kind}, dist int, sigma double")
    starts = vertices(edges) if roots is None else roots.select("node")
    frontier = cut_lineage(starts.select(F.col("node").alias("root"), "node", F.lit(0).alias("dist"), F.lit(1.0).alias("sigma")))
    seen, depth = [frontier], 0
    while not frontier.isEmpty():
        depth += 1
        known = reduce(DataFrame.unionByName, seen)
        reached = frontier.join(edges, frontier["node"] == edges["src"]).groupBy("root", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        frontier = cut_lineage(reached.join(known, ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("dist"), "sigma"))
        seen = _united([*seen, frontier])
    return reduce(DataFrame.unionByName, seen)


#: Up to so many edges (counted) the divisive loop runs in one task, however many nodes they link; a cut there takes less than the jobs of a cut over tables.
LOCAL_EDGES = 10_000
#: Roots whose paths are held in tables at a time.
ROOTS = 5_000


def _flows(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v, flow): what the shortest paths from ``roots`` send over each edge, over tables.

    Credit flows back level by level, for all roots at once: a node passes its credit on to its predecessors in proportion to their
    numbers of paths.
    """
    paths = cut_lineage(shortest_paths(edges, roots))
    deepest = paths.agg(F.max("dist")).first()[0] or 0
    up = paths.select("root", F.col("node").alias("src"), F.col("dist").alias("up_dist"), F.col("sigma").alias("up_sigma"))
    down = paths.select("root", F.col("node").alias("dst"), "dist", "sigma")
    arcs = cut_lineage(up.join(edges, "src").join(down, ["root", "dst"]).where("dist = up_dist + 1").select("root", "src", "dst", "dist", (F.col("up_sigma") / F.col("sigma")).alias("part")))
    credit = None  # (root, node, credit) of what has come from below
    flows: list[DataFrame] = []
    for depth in range(deepest, 0, -1):
        level = arcs.where(F.col("dist") == depth)
        if credit is not None:
            level = level.join(credit, (level["root"] == credit["croot"]) & (level["dst"] == credit["node"]), "left").drop("croot", "node")
        else:
            level = level.withColumn("credit", F.lit(0.0))
        flow = cut_lineage(level.select("root", "src", "dst", (F.col("part") * (1 + F.coalesce("credit", F.lit(0.0)))).alias("flow")))
        flows = _united([*flows, flow])
        credit = flow.groupBy(F.col("root").alias("croot"), F.col("src").alias("node")).agg(F.sum("flow").alias("credit"))
    if not flows:
        return edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(0.0).alias("flow")).limit(0)
    return cut_lineage(reduce(DataFrame.unionByName, flows).groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum("flow").alias("flow")))


def edge_betweenness(edges: DataFrame, local_edges: int = WALK_EDGES, roots: int = ROOTS) -> DataFrame:
    """(u, v, betweenness), u < v: credit of shortest paths over each edge, every unordered pair of nodes counted once.

    Up to ``local_edges`` edges every task walks from its share of the nodes, some at a time, and gives one number per edge; beyond, the
    paths are held in tables, of ``roots`` nodes at a time, so that no table has a row for every two nodes of the graph.
    """
    edges = cut_lineage(edges)
    spark = edges.sparkSession
    graph = _held(edges, local_edges)
    if graph:
        kind = edges.schema["src"].dataType.simpleString()

        def walk(share: int, shares: int) -> Iterator[pa.RecordBatch]:
            flow = graph.value.flows(share, shares)
            edge = np.flatnonzero(flow)
            yield pa.RecordBatch.from_arrays([pa.array(edge), pa.array(flow[edge])], ["edge", "flow"])

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = graph.value
            for batch in batches:
                edge = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([held.names.take(pa.array(held.u[edge])), held.names.take(pa.array(held.v[edge])), batch.column(1)], ["u", "v", "flow"])

        shares = min(default_parallelism(spark), spark.sparkContext.defaultParallelism)  # each sends a number for every edge, so no more than run at once
        summed = in_shares(spark, walk, "edge long, flow double", shares).groupBy("edge").agg(F.sum("flow").alias("flow"))
        return summed.mapInArrow(named, f"u {kind}, v {kind}, flow double").select("u", "v", F.round(F.col("flow") / 2, 9).alias("betweenness"))
    nodes = cut_lineage(vertices(edges))
    batches = max(1, -(-nodes.count() // roots))
    every = reduce(DataFrame.unionByName, [_flows(edges, nodes.where(F.pmod(F.xxhash64("node"), F.lit(batches)) == k)) for k in range(batches)])
    return every.groupBy("u", "v").agg(F.round(F.sum("flow") / 2, 9).alias("betweenness"))


def top_edge(edges: DataFrame, local_edges: int = WALK_EDGES) -> DataFrame:
    """The edge (u, v, betweenness) of highest betweenness, the smaller one on ties; no row without edges."""
    return edge_betweenness(edges, local_edges).orderBy(F.desc("betweenness"), "u", "v").limit(1)


def without_edge(edges: DataFrame, u, v) -> DataFrame:
    """``edges`` without both directions of one edge."""
    return edges.where(~(((F.col("src") == u) & (F.col("dst") == v)) | ((F.col("src") == v) & (F.col("dst") == u))))


def modularity(edges: DataFrame, membership: DataFrame) -> float:
    """Modularity of a partition (node, component) of the graph ``edges`` (both directions); 0 without edges."""
    a = membership.select(F.col("node").alias("src"), F.col("component").alias("ca"))
    b = membership.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    tagged = edges.join(a, "src").join(b, "dst")
    per = tagged.groupBy(F.col("ca").alias("c")).agg(F.sum((F.col("ca") == F.col("cb")).cast("long")).alias("inside"), F.count(F.lit(1)).alias("degree"))
    total = per.agg(F.sum("degree").alias("all"))
    q = per.crossJoin(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("all") - F.pow(F.col("degree") / F.col("all"), 2))).first()[0]
    return round(q, 4) if q is not None else 0.0


def girvan_newman(edges: DataFrame, max_cuts: int | None = None, slack: float = 0.1, local_edges: int = LOCAL_EDGES) -> tuple[DataFrame, float]:
    """Communities of greatest modularity found by cutting the edge of highest betweenness again and again: ((node, component), modularity).

    Scores use the original graph. Scoring starts after the first cut, a later partition wins ties, and the loop stops when the score
    falls ``slack`` below the best or when every node stands alone; ``max_cuts`` stops it earlier, by default nothing does. Ties for
    the top edge go to the smaller edge. A graph of at most ``local_edges`` edges, or of nodes whose pairs can be held (both counted), is divided
    in one task that keeps betweenness up from cut to cut, a larger one over tables (with ``local_edges`` 0 any but an empty one).
    """
    original = cut_lineage(edges)
    small = original.limit(2 * local_edges + 1).count() <= 2 * local_edges
    if small or local_edges and vertices(original).count() <= division.DENSE:
        ship_package(original.sparkSession)
        kind = original.schema["src"].dataType.simpleString()

        def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if held := list(batches):
                rows = pa.Table.from_batches(held)
                nodes, parts, score = division.divide(rows.column("src"), rows.column("dst"), max_cuts, slack)
                yield pa.RecordBatch.from_arrays([nodes, parts, pa.array([score] * len(nodes))], ["node", "component", "score"])

        found = cut_lineage(original.repartition(1).mapInArrow(divide, f"node {kind}, component {kind}, score double"))
        row = found.select("score").first()
        return found.select("node", "component"), row["score"] if row else -1.0
    current, nodes = original, cut_lineage(vertices(original))
    n_nodes = nodes.count()
    best, best_score = components(original, nodes), -1.0
    cuts = 0
    while max_cuts is None or cuts < max_cuts:
        if current.isEmpty():
            break
        cuts += 1
        top = top_edge(current, local_edges).first()
        current = cut_lineage(without_edge(current, top["u"], top["v"]))
        parts = components(current, nodes)
        score = modularity(original, parts)
        if score >= best_score:
            best, best_score = parts, score
        elif score < best_score - slack:
            break
        if parts.select("component").distinct().count() == n_nodes:
            break
    return best, best_score
