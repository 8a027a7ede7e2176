"""Large graphs that fall into parts which don't touch each other: a task takes whole parts, as arrays.

Ranges of the edges are connected first, each by itself; the least node of what hangs together there is its label. Nodes that
several ranges hold tie labels together, and these ties, few where neighbours have near ids, give the parts. Small parts are
put into blocks. A graph of up to MOST edges is not divided up, so that no task holds all of a graph here, and one with a part
above MOST edges, or with more than TIES ties, is left to the ways that need no parts (modules sweeps and louvain).
"""

from __future__ import annotations

import sys
from functools import cached_property

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..tables import cut, discard

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edges of a part at the most, edges that are connected at once, and ties of labels that one task takes.
MOST, RANGE, TIES = 1_000_000, 1_000_000, 2_000_000


def numbered(a, b):
    """The distinct names in a and b (arrays) in ascending order, and the places of a and of b among them."""
    import numpy as np
    import pandas as pd

    both = np.concatenate([a, b])
    if both.dtype == object:
        at, names = pd.factorize(both, sort=True)
    else:
        names, at = np.unique(both, return_inverse=True)
    return names, at[: len(a)], at[len(a) :]


def joined(a, b, n: int):
    """For each of n nodes the least node that the edges from a to b (arrays) connect it with."""
    import numpy as np

    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            on = label[label]
            if (on == label).all():
                break
            label = on
    return label


def whole_blocks(batches):
    """An Arrow table for each value of the first column, by which the rows are sorted."""
    import numpy as np
    import pyarrow as pa

    held, own = [], None
    for batch in batches:
        block = batch.column(0).to_numpy()
        starts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist()] if len(block) else []
        for s, e in zip(starts, [*starts[1:], len(block)]):
            if held and block[s] != own:
                yield pa.Table.from_batches(held)
                held = []
            own = block[s]
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _labelled(edges: DataFrame, n: int) -> DataFrame:
    """The edges with label, the least node they hang together with in their range; and a row for each node of a range, without target."""

    def run(batches):
        import pyarrow as pa

        def out(held):
            rows = pa.Table.from_batches(held)
            names, a, b = numbered(rows["source"].to_numpy(), rows["target"].to_numpy())
            label = names[joined(a, b, len(names))]
            kind = rows.schema.field("source").type
            yield from rows.append_column("label", pa.array(label[a], kind)).to_batches()
            every = {"source": pa.array(names, kind), "label": pa.array(label, kind)}
            yield from pa.table([every.get(f.name, pa.nulls(len(names), f.type)) for f in [*rows.schema, pa.field("label", kind)]], names=[*rows.schema.names, "label"]).to_batches()

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= RANGE:
                yield from out(held)
                held, size = [], 0
        if held:
            yield from out(held)

    kind = edges.schema["source"].dataType
    made = T.StructType([*[T.StructField(f.name, f.dataType) for f in edges.schema], T.StructField("label", kind)])
    return edges.repartitionByRange(-(-n // RANGE) + 1, "source").mapInArrow(run, made)


def blocks(edges: DataFrame, only: DataFrame | None = None, times: int = 1) -> DataFrame | None:
    """block (long) and the columns of edges (source, target, more), each part within one block; None if the graph is not divided up.

    Edges that are there several times stay so. only (node): just the parts that hold one of these nodes. times:
    each block so many times, for tasks of their own, as block * times + 0, 1 and so on.
    """
    n = edges.count()
    if n <= MOST:
        return None
    kind = dict(edges.dtypes)["source"]
    rows = cut(_labelled(edges, n))
    nodes, edges_in = rows.where("target is null"), rows.where("target is not null")
    before = F.lag("label").over(W.partitionBy("source").orderBy("label"))
    ties = cut(nodes.select(before.alias("a"), F.col("label").alias("b")).where("a <> b").distinct())

    def run(batches):
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if held:
            pairs = pa.Table.from_batches(held)
            names, a, b = numbered(pairs["a"].to_numpy(), pairs["b"].to_numpy())
            own = pairs.schema.field("a").type
            yield from pa.table([pa.array(names, own), pa.array(names[joined(a, b, len(names))], own)], names=["label", "part"]).to_batches()

    few = ties.count() <= TIES
    if few:
        tied = cut(ties.repartition(1).mapInArrow(run, f"label {kind}, part {kind}"))
        labels = edges_in.groupBy("label").count().join(tied, "label", "left").select("label", "count", F.coalesce("part", "label").alias("part"))
        if only is not None:
            own = nodes.join(only.select(F.col("node").alias("source")), "source", "left_semi").select("label").distinct()
            labels = labels.join(labels.join(own, "label", "left_semi").select("part").distinct(), "part", "left_semi")
        labels = cut(labels.select("label", "count", "part"))
        sizes = labels.groupBy("part").agg(F.sum("count").alias("size"))
        largest, n = (x or 0 for x in sizes.agg(F.max("size"), F.sum("size")).first())
        discard(tied)
    discard(ties)
    if not few or largest > MOST:
        discard(rows, *([labels] if few else []))
        return None
    # large parts are blocks of their own, small ones share some
    number = max(1, -(-2 * n // MOST))
    block = F.when(F.col("size") >= MOST // 4, F.hash("part")).otherwise(F.pmod(F.hash("part"), F.lit(number)))
    found = edges_in.join(labels.join(sizes.select("part", block.alias("block")), "part").select("label", "block"), "label")
    block = F.explode(F.array(*[F.col("block") * F.lit(times).cast("long") + F.lit(k) for k in range(times)]))
    return found.select(block.alias("block"), *edges.columns).repartition(min(1_000, 3 * number * times**2), "block").sortWithinPartitions("block")


def _in_order(a, b, n: int):
    """The level (longest way from a node that nothing leads to) of each of n nodes; -1 on and behind cycles."""
    import numpy as np

    order = a.argsort(kind="stable")
    heads, starts = b[order], np.searchsorted(a[order], np.arange(n + 1))
    waits, level = np.bincount(b, minlength=n), np.full(n, -1)
    front, k = np.flatnonzero(waits == 0), 0
    while len(front):
        level[front] = k
        sizes = starts[front + 1] - starts[front]
        at = np.repeat(starts[front] - np.concatenate([[0], sizes.cumsum()[:-1]]), sizes) + np.arange(sizes.sum())
        near, times = np.unique(heads[at], return_counts=True)
        waits[near] -= times
        front, k = near[waits[near] == 0], k + 1
    return level


def _slices(a, b, level):
    """For each level after the first: places of the edges into it, by head and tail; where each head's start among them; the heads."""
    import numpy as np

    order = np.lexsort((a, b, level[b]))
    ends = level[b[order]].searchsorted(np.arange(1, level.max() + 2)) if len(a) else []
    for s, e in zip(ends[:-1], ends[1:]):
        own = order[s:e]
        heads = b[own]
        starts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
        yield own, starts, heads[starts]


def path_counts(a, b, level, own: int):
    """For each node the paths that end in it, exact: from nodes that nothing leads to; own 1: from any node."""
    import numpy as np

    v = np.array([1] * len(level), object)
    for at, starts, heads in _slices(a, b, level):
        v[heads] = np.add.reduceat(v[a[at]], starts) + own
    return v


def heaviest_sums(a, b, level, w):
    """For each node the greatest sum of weights on a way to it, and the node before on it (the least of equals; -1: none)."""
    import numpy as np

    v, via = np.array([0] * len(level), object), np.full(len(level), -1)
    for at, starts, heads in _slices(a, b, level):
        sums = v[a[at]] + w[at]
        most = np.maximum.reduceat(sums, starts)
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(at)))
        hits = np.flatnonzero(sums == most[group])
        first = hits[np.unique(group[hits], return_index=True)[1]]
        v[heads], via[heads] = most, a[at[first]]
    return v, via


def _led(via, node: int) -> list[int]:
    """The nodes from this one on, by the neighbours in via (-1: none)."""
    path = [node]
    while via[path[-1]] >= 0:
        path.append(int(via[path[-1]]))
    return path


class Ways:
    """The distinct edges of some whole parts, weighed by paths (exact); edges on or behind cycles are left out.

    An edge weighs the paths to its source times those from its target. Of the edges out of a node only the latter differ, and of
    those into it only the former, so greedy walks in one direction count the paths of that direction only.
    """

    def __init__(self, source, target, owns):
        import numpy as np

        self.names, a, b = numbered(source, target)
        n = len(self.names)
        key = a * n + b
        key.sort()
        a, b = np.divmod(key[np.concatenate([[True], key[1:] != key[:-1]])], n)
        self.level, self._owns = _in_order(a, b, n), owns
        kept = self.level[b] >= 0
        #: Ends of the edges, in the order of a and then b.
        self.a, self.b = a[kept], b[kept]
        out, into = np.bincount(self.a, minlength=n), np.bincount(self.b, minlength=n)
        self.first, self.last = np.flatnonzero((out > 0) & (into == 0)), np.flatnonzero((into > 0) & (out == 0))

    def go_by(self, owns) -> None:
        """Count paths by these owns from now on."""
        self._owns = owns
        for name in ("before", "after", "w"):
            vars(self).pop(name, None)

    @cached_property
    def before(self):
        return path_counts(self.a, self.b, self.level, self._owns[0])

    @cached_property
    def after(self):
        return path_counts(self.b, self.a, _in_order(self.b, self.a, len(self.names)), self._owns[1])

    @cached_property
    def w(self):
        return self.before[self.a] * self.after[self.b]

    @cached_property
    def _into(self):
        order = self.b.argsort(kind="stable")
        return self.b[order], self.a[order]

    def walk(self, node: int, back: bool, greatest: bool) -> list[int]:
        """The nodes from this one on (back: against the edges) by the heaviest edge each time, of equals to the greatest or the least."""
        (keys, to), paths = (self._into, self.before) if back else ((self.a, self.b), self.after)
        path, sign = [node], 1 if greatest else -1
        while True:
            near = to[keys.searchsorted(path[-1]) : keys.searchsorted(path[-1], "right")].tolist()
            if not near:
                return path
            path.append(max(near, key=lambda x: (paths[x], sign * x)))

    def named(self, path: list[int]) -> list:
        return self.names[path].tolist()

    def whole(self) -> list[tuple]:
        """(sum, end, end, path) of the heaviest path, of equals the one with the least end."""
        if not len(self.a):
            return []
        v, via = heaviest_sums(self.a, self.b, self.level, self.w)
        path = _led(via, max(self.last.tolist(), key=lambda x: (v[x], -x)))
        name = self.names[path[0]]
        return [(v[path[0]], name, name, self.named(path[::-1]))]

    def forward(self) -> list[tuple]:
        """(paths, start, start, path) from the start with most paths on."""
        if not len(self.a):
            return []
        start = max(self.first.tolist(), key=lambda x: (self.after[x], -x))
        return [(self.after[start], self.names[start], self.names[start], self.named(self.walk(start, False, False)))]

    def backward(self) -> list[tuple]:
        """(weight, end, end, path) of the heaviest last edge, of equals the one with the greatest end."""
        import numpy as np

        if not len(self.a):
            return []
        ends = np.flatnonzero(np.isin(self.b, self.last)).tolist()
        e = max(ends, key=lambda e: (self.before[self.a[e]], self.b[e]))  # one path leads on from an end
        name = self.names[self.b[e]]
        return [(self.before[self.a[e]], name, name, self.named(self.walk(int(self.b[e]), True, True)[::-1]))]

    def routes(self, k: int, whole: bool = False) -> list[tuple]:
        """(weight, source, target, route) of the k heaviest edges, of equals the least; routes follow the heaviest edges both ways.

        whole: they follow the heaviest whole paths from and to the edge instead, of equals the least neighbour.
        """
        import heapq

        import numpy as np

        if not len(self.a):
            return []
        some = np.flatnonzero(self.w >= heapq.nlargest(k, self.w.tolist())[-1]).tolist()
        some = heapq.nsmallest(k, some, key=lambda e: (-self.w[e], self.a[e], self.b[e]))
        ends = [(e, int(self.a[e]), int(self.b[e])) for e in some]
        if whole:
            back = heaviest_sums(self.a, self.b, self.level, self.w)[1]
            on = heaviest_sums(self.b, self.a, _in_order(self.b, self.a, len(self.names)), self.w)[1]
            return [(self.w[e], self.names[u], self.names[v], self.named(_led(back, u)[::-1] + _led(on, v))) for e, u, v in ends]
        return [(self.w[e], self.names[u], self.names[v], self.named(self.walk(u, True, True)[::-1] + self.walk(v, False, True))) for e, u, v in ends]


def best_ways(blocked: DataFrame, owns: tuple[int, int] | list[tuple[int, int]], search: str, k: int = 1) -> DataFrame:
    """w (digits), a, b, path (nodes): what each block has to offer; search: whole, forward, backward, routes (of the k heaviest edges; whole_routes: by whole paths).

    With several owns there is a further column, way: the place of the one that the row goes by.
    """
    kind, several = dict(blocked.dtypes)["source"], isinstance(owns, list)

    def run(batches):
        import pyarrow as pa

        for rows in whole_blocks(batches):
            ways = Ways(rows["source"].to_numpy(), rows["target"].to_numpy(), None)
            t = rows.schema.field("source").type
            for i, own in enumerate(owns if several else [owns]):
                ways.go_by(own)
                found = ways.routes(k, search == "whole_routes") if search.endswith("routes") else getattr(ways, search)()
                columns = list(zip(*found)) if found else [(), (), (), ()]
                made = [pa.array([str(x) for x in columns[0]], pa.string()), *(pa.array(list(c), x) for c, x in zip(columns[1:], (t, t, pa.list_(t))))]
                yield pa.RecordBatch.from_arrays([*made, *([pa.array([i] * len(found), pa.int32())] if several else [])], names=["w", "a", "b", "path", *(["way"] if several else [])])

    return cut(blocked.select("block", "source", "target").mapInArrow(run, f"w string, a {kind}, b {kind}, path array<{kind}>{', way int' if several else ''}"))


def weights(blocked: DataFrame, owns: tuple[int, int]) -> DataFrame:
    """source, target, weight (digits) of the distinct edges that lie neither on nor behind cycles."""
    kind = dict(blocked.dtypes)["source"]

    def run(batches):
        import pyarrow as pa

        for rows in whole_blocks(batches):
            ways, t = Ways(rows["source"].to_numpy(), rows["target"].to_numpy(), owns), rows.schema.field("source").type
            del rows
            for s in range(0, len(ways.a), 50_000):
                a, b = ways.a[s : s + 50_000], ways.b[s : s + 50_000]
                w = ways.before[a] * ways.after[b]
                yield pa.RecordBatch.from_arrays([pa.array(ways.names[a], t), pa.array(ways.names[b], t), pa.array(list(map(str, w)), pa.string())], names=["source", "target", "weight"])

    return blocked.select("block", "source", "target").mapInArrow(run, f"source {kind}, target {kind}, weight string")
