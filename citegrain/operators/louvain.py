"""Deterministic Louvain communities of weighted graphs.

Many small graphs are a grouped task each. One large graph is worked on by joins: in each round the nodes of one class, by a
hash, move at once to the community of greatest gain; then communities become nodes and their links are summed up, until the
graph that is left has few enough links for one task. A large graph that falls into parts (module parts) is worked on part by
part, since no community reaches beyond one: a task makes the same rounds on arrays, with the weight of the whole graph.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut, discard
from . import parts

cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Links that are left to one task; classes that move in turn, rounds through them, and the share of nodes that has to move in one.
LOCAL, CLASSES, SWEEPS, LEAST = 20_000, 3, 6, 0.01


def louvain(edges, resolution: float = 1.0, total: float | None = None) -> list[set]:
    """Communities of a graph given by (a, b, weight), each a set of nodes. total: the sum of all degrees, if these are parts of a graph.

    Nodes are visited in ascending order and move to the community of greatest gain in modularity, on ties to the one of
    the least node; then communities become nodes, until nothing moves.
    """
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    at = {n: i for i, n in enumerate(names)}
    links: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in edges:
        i, j = at[a], at[b]
        links[i][j] = links[i].get(j, 0.0) + w
        if i != j:
            links[j][i] = links[j].get(i, 0.0) + w
    members = [[i] for i in range(len(names))]
    loops = [d.pop(i, 0.0) for i, d in enumerate(links)]
    while True:
        degree = [sum(d.values()) + 2 * loop for d, loop in zip(links, loops)]
        total = sum(degree) if total is None else total
        home = list(range(len(links)))
        weight = degree[:]
        moved_any = False
        while total:
            moved = False
            for i in range(len(links)):
                near: dict[int, float] = {}
                for j, w in links[i].items():
                    near[home[j]] = near.get(home[j], 0.0) + w
                weight[home[i]] -= degree[i]
                best, gain = home[i], near.get(home[i], 0.0) - resolution * degree[i] * weight[home[i]] / total
                for c in sorted(near):
                    g = near[c] - resolution * degree[i] * weight[c] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                weight[best] += degree[i]
                if best != home[i]:
                    home[i], moved, moved_any = best, True, True
            if not moved:
                break
        if not moved_any:
            return [{names[i] for i in m} for m in members]
        # communities in the order of their least member, so that indices stay in the order of names
        order: dict[int, int] = {}
        for c in home:
            order.setdefault(c, len(order))
        new_links: list[dict[int, float]] = [{} for _ in order]
        new_loops, new_members = [0.0] * len(order), [[] for _ in order]
        for i, d in enumerate(links):
            c = order[home[i]]
            new_members[c] += members[i]
            new_loops[c] += loops[i]
            for j, w in d.items():
                e = order[home[j]]
                if e == c:
                    new_loops[c] += w / 2
                else:
                    new_links[c][e] = new_links[c].get(e, 0.0) + w
        links, loops, members = new_links, new_loops, new_members


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """graph, node, community (its least node); edges: graph, a, b, weight. Isolated nodes have no edges and are left out."""
    kinds = dict(edges.dtypes)

    def make(key, rows):
        import pandas as pd

        found = louvain(list(zip(rows["a"], rows["b"], rows["weight"].astype(float))), resolution)
        return pd.DataFrame([(key[0], n, min(c)) for c in found for n in c], columns=["graph", "node", "community"])

    return edges.groupBy("graph").applyInPandas(make, f"graph {kinds['graph']}, node {kinds['a']}, community {kinds['a']}")


def _moved(links: DataFrame, nodes: DataFrame, home: DataFrame, total: float, resolution: float, sweep: int, turn: int) -> DataFrame:
    """home (node, c) after the nodes of one class have moved; moved: whether a node did. nodes: node, degree."""
    own = home.join(nodes, "node")
    size = own.groupBy("c").agg(F.sum("degree").alias("size"))
    movers = own.where(F.pmod(F.xxhash64("node", F.lit(sweep)), F.lit(CLASSES)) == turn)
    near = links.join(home.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node"), F.col("c").alias("to")).agg(F.sum("w").alias("w"))
    alone = size.join(home.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "c")
    at = movers.join(alone.select("c", F.col("size").alias("here"), F.col("n").alias("n_here")), "c")
    options = near.join(at, "node").join(alone.select(F.col("c").alias("to"), F.col("size").alias("there"), F.col("n").alias("n_there")), "to")
    stays = F.col("to") == F.col("c")
    # two nodes alone would change places for ever: the greater joins the less
    swaps = ~stays & (F.col("n_here") == 1) & (F.col("n_there") == 1) & (F.col("to") > F.col("c"))
    gain = F.col("w") - resolution * F.col("degree") * (F.col("there") - F.when(stays, F.col("degree")).otherwise(0.0)) / total
    scored = options.where(~swaps).select("node", "to", "c", stays.alias("stays"), F.round(gain, 9).alias("gain"), "degree", "here")
    kept = F.coalesce(F.max(F.when(F.col("stays"), F.col("gain"))), F.round(-resolution * F.first("degree") * (F.first("here") - F.first("degree")) / total, 9))
    top = scored.groupBy("node").agg(F.max("gain").alias("best"), kept.alias("kept")).where("best > kept")
    goal = scored.join(top, "node").where("gain = best").groupBy("node").agg(F.min("to").alias("to"))
    return cut(home.join(goal, "node", "left").select("node", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")))


def in_arrays(a, b, w, n: int, resolution: float, total: float):
    """For each of n nodes the least node of its community: rounds of moves by classes, as _moved makes them, and contraction."""
    import numpy as np

    label, any_moved = np.arange(n), True
    while any_moved and len(a) > LOCAL:
        inner = a == b
        x, y, both = np.concatenate([a[~inner], b[~inner]]), np.concatenate([b[~inner], a[~inner]]), np.concatenate([w[~inner]] * 2)
        degree = np.bincount(x, both, n) + 2 * np.bincount(a[inner], w[inner], n)
        home, any_moved = np.arange(n), False
        for sweep in range(SWEEPS):
            moved = 0
            for turn in range(CLASSES):
                size, count = np.bincount(home, degree, n), np.bincount(home, minlength=n)
                mixed = (np.arange(n, dtype=np.uint64) + np.uint64(sweep * 0x51ED2701)) * np.uint64(0x9E3779B97F4A7C15)
                own = ((mixed >> np.uint64(40)) % np.uint64(CLASSES) == turn)[x]
                key = x[own] * n + home[y[own]]
                order = key.argsort(kind="stable")
                key = key[order]
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
                if not len(starts):
                    continue
                near, (node, to) = np.add.reduceat(both[own][order], starts), np.divmod(key[starts], n)
                c = home[node]
                stays = to == c
                gain = np.round(near - resolution * degree[node] * (size[to] - np.where(stays, degree[node], 0.0)) / total, 9)
                kept = np.round(-resolution * degree * (size[home] - degree) / total, 9)
                kept[node[stays]] = gain[stays]
                swaps = ~stays & (count[c] == 1) & (count[to] == 1) & (to > c)
                gain[swaps] = -np.inf
                first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                best = np.repeat(np.maximum.reduceat(gain, first), np.diff(first, append=len(node)))
                goal = np.flatnonzero((gain == best) & (gain > kept[node]))
                who, at = np.unique(node[goal], return_index=True)  # of equals the least
                home[who] = to[goal[at]]
                moved += len(who)
            any_moved = any_moved or moved > 0
            if moved <= LEAST * n:
                break
        least = np.full(n, n)
        np.minimum.at(least, home, np.arange(n))
        names, at = np.unique(least[home], return_inverse=True)
        label, x, y, n = at[label], at[a], at[b], len(names)
        key = np.minimum(x, y) * n + np.maximum(x, y)
        key, at = np.unique(key, return_inverse=True)
        a, b, w = key // n, key % n, np.bincount(at, w)
    if any_moved:
        again = np.arange(n)
        for members in louvain(list(zip(a.tolist(), b.tolist(), w.tolist())), resolution, total):
            again[list(members)] = min(members)
        label = again[label]
    least = np.full(n, len(label))
    np.minimum.at(least, label, np.arange(len(label)))
    return least[label]


def by_parts(blocked: DataFrame, resolutions: list[float], total: float) -> DataFrame:
    """at (place of a resolution), node, community of a graph that parts.blocks has divided up, with the weights w of its links; total: the sum of all degrees.

    blocked has each block once for each resolution.
    """
    kind, whole_blocks, numbered = dict(blocked.dtypes)["source"], parts.whole_blocks, parts.numbered  # functions go to tasks by value, modules don't

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for rows in whole_blocks(batches):
            names, a, b = numbered(rows["source"].to_numpy(), rows["target"].to_numpy())
            w, t = rows["w"].to_numpy().astype(np.float64), rows.schema.field("source").type
            k = rows["block"][0].as_py() % len(resolutions)
            found = in_arrays(a, b, w, len(names), resolutions[k], total)
            columns = [pa.array(np.full(len(names), k), pa.int32()), pa.array(names, t), pa.array(names[found], t)]
            yield from pa.table(columns, names=["at", "node", "community"]).to_batches(max_chunksize=100_000)

    return blocked.select("block", "source", "target", "w").mapInArrow(run, f"at int, node {kind}, community {kind}")


def at_resolutions(edges: DataFrame, resolutions: list[float], only: DataFrame | None = None) -> list[DataFrame]:
    """large_communities at each of the resolutions; what divides the graph up is done once.

    only (node): communities of other nodes are not asked for. Parts of a large graph without these nodes are passed over:
    no community reaches from one part to another, and gains go by the weight of the whole graph all the same.
    """
    links = cut(edges.select("a", "b", F.col("weight").cast("double").alias("weight")))
    blocked = parts.blocks(links.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("weight").alias("w")), only, len(resolutions))
    if blocked is None:
        return [large_communities(links, r) for r in resolutions]
    found = cut(by_parts(blocked, resolutions, 2.0 * links.agg(F.sum("weight")).first()[0]))
    return [found.where(F.col("at") == k).select("node", "community") for k in range(len(resolutions))]


def large_communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """node, community (its least node) of one graph of any size, by joins; edges: a, b, weight, each pair once, a = b being a loop."""
    links = cut(edges.select("a", "b", F.col("weight").cast("double").alias("w")))
    homes = None
    while links.limit(LOCAL + 1).count() > LOCAL:
        both = cut(links.where("a <> b").select(F.inline(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w")))))
        loops = links.where("a = b").select(F.col("a").alias("node"), (2 * F.col("w")).alias("d"))
        nodes = cut(both.select(F.col("a").alias("node"), F.col("w").alias("d")).unionByName(loops).groupBy("node").agg(F.sum("d").alias("degree")))
        total, n = nodes.agg(F.sum("degree"), F.count(F.lit(1))).first()
        home, any_moved = cut(nodes.select("node", F.col("node").alias("c"))), False
        for sweep in range(SWEEPS):
            moved = 0
            for turn in range(CLASSES):
                after = _moved(both, nodes, home, total, resolution, sweep, turn)
                moved += after.where("moved").count()
                home = after.select("node", "c")
            any_moved = any_moved or moved > 0
            if moved <= LEAST * n:
                break
        names = cut(home.groupBy("c").agg(F.min("node").alias("name")).join(home, "c").select("node", "name"))
        homes = names.withColumnRenamed("name", "community") if homes is None else cut(homes.join(names, homes.community == names.node).select(homes.node, F.col("name").alias("community")))
        if not any_moved:
            return homes
        one, two = names.select(F.col("node").alias("a"), F.col("name").alias("x")), names.select(F.col("node").alias("b"), F.col("name").alias("y"))
        ends = links.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "w")
        fewer = cut(ends.groupBy("a", "b").agg(F.sum("w").alias("w")))
        discard(links, both, nodes)
        links = fewer
    rest = communities(links.select(F.lit(1).alias("graph"), "a", "b", F.col("w").alias("weight")), resolution).select("node", "community")
    if homes is None:
        return rest
    rest = cut(rest)
    whole = homes.join(rest.select(F.col("node").alias("_n"), F.col("community").alias("_c")), homes.community == F.col("_n"), "left").select("node", F.coalesce("_c", "community").alias("community"))
    return whole


def modularity(edges, parts, resolution: float = 1.0) -> float:
    total = 2 * sum(w for *_, w in edges)
    home = {n: i for i, p in enumerate(parts) for n in p}
    degree = [0.0] * len(parts)
    inside = 0.0
    for a, b, w in edges:
        degree[home[a]] += w
        degree[home[b]] += w
        inside += 2 * w * (home[a] == home[b])
    return inside / total - resolution * sum((d / total) ** 2 for d in degree)
