"""The levels and rounds of ``graph.communities`` within one task, for a graph that fits one.

The rule is that of the rounds over tables, hashes included, so both give the same communities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Constants of XXH64, which Spark's ``xxhash64`` is.
_P1, _P2, _P3, _P5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
#: Rows of a result batch, and arcs that are worked on at once.
_BATCH, _BLOCK = 10_000, 1_000_000


def hash_int(value: int, seed: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64`` makes of an int after columns whose hash is ``seed``."""
    h = (seed + _P5 + np.uint64(4)) ^ (np.full(1, value, np.uint64) * _P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


class _Graph(NamedTuple):
    """The arcs of node i are those from ``start[i]`` to ``start[i + 1]``, to ``near`` by ``weight``; ``loop`` is its weight with itself."""

    start: np.ndarray
    near: np.ndarray
    weight: np.ndarray
    loop: np.ndarray


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _graph(x: np.ndarray, y: np.ndarray, w: np.ndarray, loop: np.ndarray) -> _Graph:
    """The graph of distinct arcs with ``x`` unlike ``y``, each given in one direction."""
    n = len(loop)
    start = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(x, minlength=n) + np.bincount(y, minlength=n), out=start[1:])
    near, weight, free = np.empty(start[-1], np.int32), np.empty(start[-1]), start[:-1].copy()
    for i in range(0, len(x), _BLOCK):
        for source, to in ((x, y), (y, x)):
            order = np.argsort(source[i : i + _BLOCK], kind="stable")
            u = source[i : i + _BLOCK][order]
            first = _firsts(u)
            size = np.diff(np.r_[first, len(u)])
            at = free[u] + np.arange(len(u)) - np.repeat(first, size)
            near[at], weight[at] = to[i : i + _BLOCK][order], w[i : i + _BLOCK][order]
            free[u[first]] += size
    graph = _Graph(start, near, weight, loop)
    for part, rows, u in _arcs(graph, np.arange(n)):
        order = np.argsort(u * np.int64(n) + near[rows], kind="stable")  # the order of the rows has no influence
        near[rows], weight[rows] = near[rows][order], weight[rows][order]
    return graph


def _arcs(graph: _Graph, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the nodes with about ``_BLOCK`` arcs: the nodes, their arcs, and the place of each arc's node in the part."""
    size = graph.start[nodes + 1] - graph.start[nodes]
    block = np.cumsum(size + 1) // _BLOCK
    first = _firsts(block)
    for i, j in zip(first, np.r_[first, len(nodes)][1:], strict=True):
        part, sizes = nodes[i:j], size[i:j]
        u = np.repeat(np.arange(len(part)), sizes)
        yield part, np.arange(len(u)) + np.repeat(graph.start[part] - np.r_[0, np.cumsum(sizes)[:-1]], sizes), u


class _Level:
    """The labels of one level, and who wants to move."""

    def __init__(self, graph: _Graph, names: np.ndarray):
        self.graph, self.names, n = graph, names, len(names)
        self.strength, self.label = graph.loop.copy(), np.arange(n, dtype=np.int32)
        for part, rows, u in _arcs(graph, np.arange(n)):
            self.strength[part] += np.bincount(u, graph.weight[rows], len(part))
        self.total, self.mass = self.strength.sum(), self.strength
        # A node that wanted to stay needs no other look while none of its neighbours has moved and the communities'
        # strengths, which have changed by no more than the drift since, can't have used up the margin it had.
        self.stale, self.margin, self.drift, self.seen = np.ones(n, bool), np.zeros(n), 0.0, np.zeros(n)

    def asked(self) -> np.ndarray:
        """The nodes that may want to move."""
        return np.flatnonzero(self.stale | (self.drift > self.seen) & (self.margin <= 2 * self.strength * (self.drift - self.seen) / self.total + 1e-8))

    def wishes(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the nodes that want to move, and where to."""
        movers, targets, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], len(self.names)
        for part, rows, u in _arcs(self.graph, nodes):
            # A node is next to its own community with no weight, since it may stay.
            key = np.r_[u * np.int64(n) + self.label[self.graph.near[rows]], np.arange(len(part)) * np.int64(n) + self.label[part]]
            order = np.argsort(key, kind="stable")
            key, w = key[order], np.r_[self.graph.weight[rows], np.zeros(len(part))][order]
            starts = _firsts(key)
            to, key = np.add.reduceat(w, starts), key[starts]
            u = key // n
            c, k = key - u * n, self.strength[part[u]]
            own = c == self.label[part[u]]
            gain = np.round(to - k * (self.mass[c] - np.where(own, k, 0.0)) / self.total, 9)
            first, stays = _firsts(u), gain[own]
            best = np.maximum.reduceat(np.where(own, -np.inf, gain), first)
            # Of equal gains the own community holds, else the one with the smallest hash.
            wants = best > stays
            self.stale[part], self.margin[part], self.seen[part] = wants, stays - best, self.drift
            some = np.flatnonzero(wants[u] & (gain == best[u]) & ~own)
            some = some[np.lexsort((self.names[c[some]], u[some]))]
            some = some[_firsts(u[some])]
            movers.append(part[u[some]])
            targets.append(c[some])
        return np.concatenate(movers), np.concatenate(targets)

    def move(self, nodes: np.ndarray, into: np.ndarray) -> None:
        self.label[nodes] = into
        mass = np.bincount(self.label, self.strength, len(self.names))
        self.drift += np.abs(mass - self.mass).max()
        self.mass = mass
        self.stale[nodes] = True
        for _, rows, _ in _arcs(self.graph, nodes):
            self.stale[self.graph.near[rows]] = True


def _settle(graph: _Graph, names: np.ndarray, level: int, rounds: int) -> tuple[np.ndarray, bool]:
    """The label of each node after the rounds of one level, and whether no node wants to move."""
    found, seed = _Level(graph, names), hash_int(level, names.view(np.uint64))
    for turn in range(rounds):
        asked = found.asked()
        goes = hash_int(turn, seed[asked]) & np.uint64(1) == 0
        nodes, into = found.wishes(asked[goes])
        if len(nodes):
            found.move(nodes, into)
        elif not len(found.wishes(asked[~goes])[0]):
            return found.label, True
    return found.label, False


def _summed(keys: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys with the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, w = keys[order], w[order]
    first = _firsts(keys)
    return keys[first], np.add.reduceat(w, first) if len(w) else w


def _joined(graph: _Graph, label: np.ndarray) -> _Graph:
    """The graph of the labels."""
    n = len(label)
    loop, keys, weights = np.bincount(label, graph.loop, n), [], []
    for part, rows, u in _arcs(graph, np.arange(n)):
        c, d, w = label[part][u], label[graph.near[rows]], graph.weight[rows]
        loop += np.bincount(c[c == d], w[c == d], n)
        less = c < d
        key, w = _summed(c[less] * np.int64(n) + d[less], w[less])
        keys.append(key)
        weights.append(w)
    key, w = _summed(np.concatenate(keys), np.concatenate(weights))
    del keys, weights
    x = key // n
    return _graph(x.astype(np.int32), (key - x * n).astype(np.int32), w, loop)


def settled(graph: _Graph, names: np.ndarray, level: int, rounds: int, levels: int) -> tuple[np.ndarray, list[str]]:
    """The label of each node from ``level`` on, and what hasn't settled. ``names``: the nodes' hashes."""
    said, node = [], np.arange(len(names), dtype=np.int32)
    for turn in range(level, levels):
        label, still = _settle(graph, names, turn, rounds)
        if not still:
            said.append(unsettled(turn, rounds))
        if (label == np.arange(len(names))).all():
            return node, said
        node, graph = label[node], _joined(graph, label)
    return node, [*said, joining(levels)]


def unsettled(level: int, rounds: int) -> str:
    return f"communities: level {level} hasn't settled after {rounds} rounds"


def joining(levels: int) -> str:
    return f"communities: they still join after {levels} levels"


def _task(level: int, rounds: int, levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [[b.column(i).to_numpy(zero_copy_only=False).copy() for i in range(3)] for b in batches if b.num_rows]
        if not kept:
            return
        names = np.unique(np.concatenate([np.unique(np.concatenate([v for k in kept[i : i + 100] for v in k[:2]])) for i in range(0, len(kept), 100)]))
        for k in kept:
            k[:2] = (np.searchsorted(names, v).astype(np.int32) for v in k[:2])
        x, y, w = (np.concatenate([k.pop(0) for k in kept]) for _ in range(3))
        del kept
        own = x == y
        loop = np.zeros(len(names))
        loop[x[own]] = w[own]
        if own.any():
            x, y, w = x[~own], y[~own], w[~own]
        graph = _graph(x, y, w, loop)
        del x, y, w
        label, said = settled(graph, names, level, rounds, levels)
        for start in range(0, len(names), _BATCH):
            part = label[start : start + _BATCH]
            yield pa.record_batch([pa.array(names[start : start + _BATCH]), pa.array(names[part]), pa.nulls(len(part), pa.string())], ["h", "c", "said"])
        if said:
            yield pa.record_batch([pa.nulls(len(said), pa.int64()), pa.nulls(len(said), pa.int64()), pa.array(said)], ["h", "c", "said"])

    return emit


def moved_in_one_task(arcs: DataFrame, level: int, rounds: int, levels: int) -> DataFrame:
    """The last label of each node of ``arcs`` (x, y, w; one direction) from ``level`` on: h, c, both hashes. Rows with ``said`` have no node but what hasn't settled."""
    hashed = arcs.select(F.xxhash64("x").alias("hx"), F.xxhash64("y").alias("hy"), F.col("w").cast("double").alias("w"))
    return hashed.coalesce(1).mapInArrow(_task(level, rounds, levels), "h long, c long, said string")
