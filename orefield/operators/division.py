"""The divisive loop in memory: betweenness is kept up from cut to cut instead of being found anew.

A cut changes only what pairs of nodes send whose shortest paths used the edge. For each component distances and numbers of shortest
paths between all nodes are held; a cut takes away what those pairs sent, mends their entries and adds what they send now.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from orefield.operators.compact import Graph, coded, spans, starts

#: Components of more nodes hold no table of all pairs; they are walked again after each cut until they are smaller.
DENSE = 3_000
#: Distance of nodes that do not reach each other.
FAR = 1 << 14
#: Numbers of paths below this are exact as doubles.
EXACT = 2.0**53


class Component:
    """Betweenness of the edges of a component (u, v: codes of their ends, sorted, u < v) while edges are cut."""

    def __init__(self, u: np.ndarray, v: np.ndarray, dense: int = DENSE):
        graph = Graph(pa.table({"src": np.concatenate([u, v]), "dst": np.concatenate([v, u])}))
        self.nodes, self.u, self.v = graph.names.to_numpy(), graph.u.astype(np.int64), graph.v.astype(np.int64)
        self.n = n = len(self.nodes)
        self.begin, self.degree, self.target, self.edge = graph.begin[:-1], np.diff(graph.begin), graph.target.astype(np.int64), graph.edge
        self.dense = n <= dense
        if self.dense:
            self.dist, self.sigma = np.empty(n * n, np.int16), np.empty(n * n)
        total = np.zeros(len(self.u))
        for roots in graph.batches(0, 1):
            dist, sigma, flow = graph.sweep(roots)
            total += flow
            if self.dense:
                self.dist.reshape(n, n)[roots], self.sigma.reshape(n, n)[roots] = dist.reshape(-1, n), sigma.reshape(-1, n)
        self.total, self.low = total / 2, np.zeros(len(total))  # low: what rounding took from total
        if self.dense:
            self.dense = self.sigma.max(initial=0) < EXACT
            self.mark, self.between = np.empty(n * n, np.int32), np.empty(n * n, np.int32)  # between: the edge of two nodes
            self.between[self.u * n + self.v] = self.between[self.v * n + self.u] = np.arange(len(self.u))

    def credits(self) -> np.ndarray:
        """Betweenness, rounded as in ``edge_betweenness``."""
        return np.round(self.total + self.low, 9)

    def reached(self, start: int) -> np.ndarray:
        """Which nodes ``start`` reaches."""
        if self.dense:
            return self.dist[start * self.n : (start + 1) * self.n] < FAR
        return _reached(self.begin, self.degree, self.target, start)

    def cut(self, e: int) -> None:
        """Take edge ``e`` away; where the component is not dense (any more), its betweenness is to be found anew."""
        u, v = int(self.u[e]), int(self.v[e])
        if not self.dense:
            self._unlink(u, v)
            return
        n, dist, sigma = self.n, self.dist, self.sigma
        du, dv = dist[u * n : (u + 1) * n], dist[v * n : (v + 1) * n]
        side, other = np.flatnonzero(du + 1 == dv), np.flatnonzero(dv + 1 == du)
        if len(side) > len(other):  # the fewer ones are the roots
            u, v, du, dv, side, other = v, u, dv, du, other, side
        i, j = np.nonzero(dist[(side * n)[:, None] + other] == du[side][:, None] + 1 + dv[other])
        a, b = side[i], other[j]
        change = -self._sent(a, b)
        self._unlink(u, v)
        left = sigma[a * n + b] - sigma[a * n + u] * sigma[v * n + b]
        sigma[a * n + b] = sigma[b * n + a] = left
        gone = left == 0
        self._mend(a[gone], b[gone])
        linked = dist[a * n + b] < FAR
        change += self._sent(a[linked], b[linked])
        total = self.total + change
        self.low += np.where(np.abs(self.total) >= np.abs(change), (self.total - total) + change, (change - total) + self.total)
        self.total = total

    def _unlink(self, u: int, v: int) -> None:
        for x, y in ((u, v), (v, u)):
            begin, last = self.begin[x], self.begin[x] + self.degree[x] - 1
            at = begin + np.flatnonzero(self.target[begin : last + 1] == y)[0]
            self.target[at], self.edge[at] = self.target[last], self.edge[last]
            self.degree[x] -= 1

    def _mend(self, a: np.ndarray, b: np.ndarray) -> None:
        """Distances and numbers of paths of the pairs (a, b), which have lost all their shortest paths; the nearest come first."""
        n, dist, sigma = self.n, self.dist, self.sigma
        dist[a * n + b] = dist[b * n + a] = FAR
        while len(a):
            counts = self.degree[b]
            to = self.target[spans(self.begin[b], counts)]
            pair = np.repeat(np.arange(len(b)), counts)
            before = dist[(a * n)[pair] + to]
            found = np.full(len(b), FAR, np.int16)
            np.minimum.at(found, pair, before + 1)
            least = found.min()
            if least >= FAR:
                return
            used = np.flatnonzero((before == least - 1) & (found == least)[pair])
            paths = np.bincount(pair[used], sigma[(a * n)[pair[used]] + to[used]], minlength=len(b))
            done = found == least
            x, y = a[done], b[done]
            dist[x * n + y] = dist[y * n + x] = least
            sigma[x * n + y] = sigma[y * n + x] = paths[done]
            if paths.max() >= EXACT:
                self.dense = False
            a, b = a[~done], b[~done]

    def _sent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the shortest paths of the pairs (a, b) send over each edge: credit flows from b back to a, level by level."""
        n, m, dist, sigma = self.n, len(self.u), self.dist, self.sigma
        total = np.zeros(m)
        if not len(a):
            return total
        own = a * n + b
        order = np.argsort(dist[own], kind="stable")
        own = own[order]
        levels = np.searchsorted(dist[own], np.arange(int(dist[own[-1]]) + 2))  # pairs of distance d: levels[d] to levels[d + 1]
        keys, credit = np.empty(0, np.int64), np.empty(0)
        for depth in range(len(levels) - 2, 0, -1):
            here = own[levels[depth] : levels[depth + 1]]
            keys, credit = np.concatenate([keys, here]), np.concatenate([credit, np.ones(len(here))])
            places = np.arange(len(keys))
            self.mark[keys] = places
            at = self.mark[keys]
            one = at == places
            credit, keys = np.bincount(at, credit, minlength=len(keys))[one], keys[one]
            if depth == 1:
                return total + np.bincount(self.between[keys], credit, minlength=m)
            root, node = keys // n, keys % n
            share = credit / sigma[keys]
            if depth == 2:  # the nodes in between are neighbours of both: those of the end that has fewer are looked at
                end = np.where(self.degree[root] < self.degree[node], root, node)
                counts = self.degree[end]
                x, of = self.target[spans(self.begin[end], counts)], np.repeat(np.arange(len(keys)), counts)
                used = np.flatnonzero(dist[((root + node - end) * n)[of] + x] == 1)
            else:
                counts = self.degree[node]
                x, of = self.target[spans(self.begin[node], counts)], np.repeat(np.arange(len(keys)), counts)
                used = np.flatnonzero(dist[(root * n)[of] + x] == depth - 1)
            x, of = x[used], of[used]
            keys = (root * n)[of] + x
            credit = share[of] * sigma[keys]
            total += np.bincount(self.between[x * n + node[of]], credit, minlength=m)
        return total


def _reached(begin: np.ndarray, degree: np.ndarray, target: np.ndarray, start: int) -> np.ndarray:
    seen, front = np.zeros(len(begin), bool), np.array([start])
    while len(front):
        seen[front] = True
        near = np.unique(target[spans(begin[front], degree[front])])
        front = near[~seen[near]]
    return seen


def _parts(u: np.ndarray, v: np.ndarray, n: int) -> list[np.ndarray]:
    """The nodes of each component of the graph of the edges (u, v)."""
    order = np.argsort(np.concatenate([u, v]), kind="stable")
    begin, degree = starts(np.concatenate([u, v]), n)[:-1], np.bincount(np.concatenate([u, v]), minlength=n)
    target, known, found = np.concatenate([v, u])[order], np.zeros(n, bool), []
    for x in range(n):
        if not known[x]:
            found.append(np.flatnonzero(_reached(begin, degree, target, x)))
            known[found[-1]] = True
    return found


def _rounded(part: int, whole: int) -> float:
    """``part / whole`` to four places, halves away from zero as in SQL."""
    places = (abs(part) * 20_000 + whole) // (2 * whole)
    return (places if part >= 0 else -places) / 10_000


def divide(src: pa.ChunkedArray, dst: pa.ChunkedArray, max_cuts: int | None, slack: float, dense: int = DENSE) -> tuple[pa.Array, pa.Array, float]:
    """The loop of ``girvan_newman`` over arcs in both directions: (nodes, component of each, modularity).

    A cut changes the betweenness of its own component only, and the score only if the component falls apart.
    """
    names, (src, dst) = coded(src, dst)
    n = len(names)
    ends = np.unique(np.minimum(src, dst).astype(np.int64) * n + np.maximum(src, dst))
    u, v = np.divmod(ends, max(n, 1))  # in the order that decides ties
    m = len(u)
    degree = np.bincount(np.concatenate([u, v]), minlength=n)
    where, inside = np.arange(n), {}
    credits, group, place = np.full(m, -1.0), np.empty(m, object), np.zeros(m, np.int64)

    def settle(parts: list[np.ndarray]) -> None:
        for part in parts:
            where[part] = part[0]
        for part in parts:
            within = np.count_nonzero((where[u] == part[0]) & (where[v] == part[0]))
            inside[int(part[0])] = 4 * m * within - int(degree[part].sum()) ** 2

    def hold(edges: np.ndarray) -> None:
        if len(edges):
            found = Component(u[edges], v[edges], dense)
            found.ids = edges
            group[edges], place[edges], credits[edges] = found, np.arange(len(edges)), found.credits()

    settle(_parts(u, v, n))
    label = where[u]
    order = np.argsort(label, kind="stable")
    for edges in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        hold(edges)
    best, best_score, cuts, left = where.copy(), -1.0, 0, m
    while (max_cuts is None or cuts < max_cuts) and left:
        e = int(np.argmax(credits))
        of = group[e]
        of.cut(int(place[e]))
        cuts, left = cuts + 1, left - 1
        credits[e] = -1.0
        alive = of.ids[credits[of.ids] >= 0]
        near_u = of.reached(int(of.u[place[e]]))
        split = not near_u[of.v[place[e]]]
        parts = [of.nodes[near_u]] + ([of.nodes[of.reached(int(of.v[place[e]]))]] if split else [])
        if split:
            settle(parts)
        if of.dense:
            credits[alive] = of.credits()[place[alive]]
        else:
            for part in parts:
                hold(alive[where[u[alive]] == where[part[0]]])
        if not split and cuts > 1:
            continue  # the same partition and score as before
        now = _rounded(sum(inside.values()), 4 * m * m)
        if now >= best_score:
            best, best_score = where.copy(), now
        elif now < best_score - slack:
            break
        if len(inside) == n:
            break
    return names, names.take(pa.array(best)), best_score
