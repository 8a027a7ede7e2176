"""Large graphs whose parts tasks take whole: the same results as by bands, and no bands."""

import random

import pytest

from citegrain.operators import fronts, louvain, parts, paths, sweeps


@pytest.fixture
def graph(spark, monkeypatch):
    """Parts of unlike sizes, small ones too, and the limits that divide them up."""
    rng = random.Random(5)
    edges, base = set(), 0
    for n in (60, 50, 40, *[4] * 12):
        for v in range(1, n):
            edges |= {(base + u, base + v) for u in rng.sample(range(v), min(v, rng.randint(1, 3)))}
        base += n
    edges = sorted(edges)
    rng.shuffle(edges)
    for name, value in {"MOST": 150, "RANGE": 60}.items():
        monkeypatch.setattr(parts, name, value)
    return edges


def both_ways(monkeypatch, run):
    """What run gives by parts, without bands, and what it gives by bands."""

    def none(*_):
        raise AssertionError("bands")

    with monkeypatch.context() as m:
        m.setattr(sweeps.Bands, "__init__", none)
        by_parts = sorted(map(tuple, run().collect()))
    monkeypatch.setattr(parts, "MOST", 10**9)
    return by_parts, sorted(map(tuple, run().collect()))


def test_parts_stay_whole(spark, graph):
    blocked = parts.blocks(spark.createDataFrame(graph, "source long, target long"))
    rows = blocked.collect()
    assert sorted((r.source, r.target) for r in rows) == sorted(graph)
    home = {}
    for r in rows:
        assert home.setdefault(r.source, r.block) == home.setdefault(r.target, r.block) == r.block
    assert len({r.block for r in rows}) > 2
    one = [(0, v) for v in range(1, 200)]
    assert parts.blocks(spark.createDataFrame(one, "source long, target long")) is None


@pytest.mark.parametrize("kind", ["spc", "spnp"])
def test_global_path_by_parts(spark, monkeypatch, graph, kind):
    edges = spark.createDataFrame(graph, "source long, target long")
    got, want = both_ways(monkeypatch, lambda: paths.main_path(edges, "global", kind))
    assert got == want and len(got) > 5


@pytest.mark.parametrize("search", ["forward", "backward"])
def test_greedy_paths_by_parts(spark, monkeypatch, graph, search):
    edges = spark.createDataFrame([(f"n{u:04}", f"n{v:04}") for u, v in graph], "source string, target string")
    got, want = both_ways(monkeypatch, lambda: paths.main_path(edges, search))
    assert got == want and len(got) > 3


def test_key_routes_by_parts(spark, monkeypatch, graph):
    edges = spark.createDataFrame(graph, "source long, target long")
    got, want = both_ways(monkeypatch, lambda: paths.key_routes(edges, 10))
    assert got == want and sum(n for _, n in got) == 10


def test_fronts_by_parts(spark, monkeypatch):
    """Communities of a large graph in parts come without rounds of joins, within 1 % of the modularity of the search on all of it."""
    rng = random.Random(8)
    links = set()
    for base in (0, 300, 600):
        for _ in range(1_300):
            u = rng.randrange(300)
            v = u // 30 * 30 + rng.randrange(30) if rng.random() < 0.8 else rng.randrange(300)
            if u != v:
                links.add((base + min(u, v), base + max(u, v)))
    rows = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(links)], "a long, b long, weight double")
    monkeypatch.setattr(parts, "MOST", 1_400)
    monkeypatch.setattr(parts, "RANGE", 700)
    monkeypatch.setattr(louvain, "LOCAL", 100)
    monkeypatch.setattr(louvain, "_moved", None)
    each = [{r.node: r.community for r in f.collect()} for f in louvain.at_resolutions(rows, [0.5, 1.0])]
    own = [(a, b, 1.0) for a, b in links]
    for resolution, found in zip((0.5, 1.0), each):
        groups = {}
        for node, c in found.items():
            groups.setdefault(c, set()).add(node)
        assert set(found) == {x for e in links for x in e} and all(min(g) == c for c, g in groups.items())
        assert all(len({x // 300 for x in g}) == 1 for g in groups.values())
        whole = louvain.modularity(own, louvain.louvain(own, resolution), resolution)
        assert louvain.modularity(own, list(groups.values()), resolution) > 0.99 * whole


def test_hops_by_parts(spark, monkeypatch):
    """A hop between two dense groups of one part is separated at all resolutions, one within a group at none."""
    edges = [(base + g + u, base + g + v) for base in (0, 100, 200) for g in (0, 20) for u in range(8) for v in range(u)] + [(0, 20), (100, 120), (200, 220)]
    monkeypatch.setattr(parts, "MOST", 60)
    monkeypatch.setattr(louvain, "_moved", None)
    monkeypatch.setattr(louvain, "LOCAL", 20)
    df = spark.createDataFrame(edges, "source long, target long")
    got = fronts.hop_robustness(df, spark.createDataFrame([(100, 120), (101, 102)], "source long, target long")).collect()
    assert {(r.source, r.target): r.separated for r in got} == {(100, 120): 3, (101, 102): 0}


@pytest.mark.parametrize("owns", [(0, 0), (1, 0), (1, 1)])
def test_greedy_walks_count_one_direction(graph, owns):
    """Walks forward count the paths ahead only, walks backward those behind only; edges that come twice count once."""
    import numpy as np

    twice = np.array(graph + graph[::3])
    make = lambda: parts.Ways(twice[:, 0], twice[:, 1], owns)
    ahead, behind, both = make(), make(), make()
    weight = {(int(both.names[a]), int(both.names[b])): w for a, b, w in zip(both.a, both.b, both.w)}
    assert sorted(weight) == sorted(graph)
    [(_, start, _, path)] = ahead.forward()
    assert path[0] == start and "before" not in vars(ahead) and "w" not in vars(ahead)
    for u, v in zip(path, path[1:]):
        assert v == min(t for s, t in graph if s == u and weight[s, t] == max(w for (x, _), w in weight.items() if x == u))
    [(most, end, _, path)] = behind.backward()
    assert path[-1] == end and "after" not in vars(behind) and "w" not in vars(behind)
    sinks = {t for _, t in graph} - {s for s, _ in graph}
    assert (most, end) == max((w, t) for (_, t), w in weight.items() if t in sinks)
    for u, v in zip(path, path[1:]):
        assert u == max(s for s, t in graph if t == v and weight[s, t] == max(w for (_, y), w in weight.items() if y == v))


@pytest.mark.parametrize("search, most", [("global", 150), ("forward", 10**9), ("backward", 150)])
def test_edges_that_come_twice_count_once(spark, monkeypatch, graph, search, most):
    monkeypatch.setattr(parts, "MOST", most)
    once, twice = (spark.createDataFrame(rows, "source long, target long") for rows in (graph, graph + graph[::3]))
    got, want = (sorted(map(tuple, paths.main_path(edges, search).collect())) for edges in (twice, once))
    assert got == want and len(got) > 3


def test_stand_in_citations(spark, tmp_path):
    """An order that holds a part twice does not follow itself, one that follows another for two parts does so once; no edges are made distinct for what does so itself."""
    from datetime import datetime

    from citegrain.plans.star import citations

    day = lambda n: datetime(2020, 1, n)
    held = [(1, 7), (1, 7), (2, 7), (3, 7), (3, 7), (1, 8), (2, 8), (4, 8), (4, 9), (4, 9), (5, 9), (6, 10)]
    spark.createDataFrame(held, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, day(3)), (2, day(5)), (3, day(5)), (4, day(1)), (5, day(1))], "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    want = [(1, 2), (2, 3), (4, 1), (4, 5)]
    assert sorted(map(tuple, citations(spark, str(tmp_path)).collect())) == want
    repeated = citations(spark, str(tmp_path), repeated=True)
    assert sorted(map(tuple, repeated.collect())) == [(1, 2), *want]
    assert "Aggregate" not in repeated._jdf.queryExecution().optimizedPlan().toString()


def test_hops_ask_for_their_own_parts(spark, monkeypatch):
    """Only the parts that hold a hop get communities, each resolution in a task of its own; ends in fronts under the least size, and without links, are not told apart."""
    edges = [(base + g + u, base + g + v) for base in (0, 100, 200) for g in (0, 20) for u in range(8) for v in range(u)] + [(0, 20), (100, 120), (200, 220)]
    edges += [(300, 301), (302, 303)]
    monkeypatch.setattr(parts, "MOST", 60)
    monkeypatch.setattr(louvain, "_moved", None)
    monkeypatch.setattr(louvain, "LOCAL", 20)
    made, seen = louvain.by_parts, []

    def by_parts(blocked, *rest):
        seen.extend(blocked.collect())
        return made(blocked, *rest)

    monkeypatch.setattr(louvain, "by_parts", by_parts)
    df = spark.createDataFrame(edges, "source long, target long")
    hops = [(100, 120), (101, 102), (300, 302), (300, 999), (121, 302)]
    got = fronts.hop_robustness(df, spark.createDataFrame(hops, "source long, target long")).collect()
    assert {(r.source, r.target): r.separated for r in got} == {(100, 120): 3, (101, 102): 0, (300, 302): 0, (300, 999): 0, (121, 302): 3}
    assert {r.source // 100 for r in seen} <= {1, 3} and len({r.block for r in seen if r.source < 200}) == 3


def test_communities_where_tasks_lack_the_library(tmp_path):
    """Tasks whose Python can't import this package, as on executors of a cluster, find communities by parts."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
from citegrain.operators import louvain, parts
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
parts.MOST = 5
rows = [(b + u, b + v, 1.0) for b in (0, 10, 20) for v in range(3) for u in range(v)]
found = louvain.at_resolutions(spark.createDataFrame(rows, "a long, b long, weight double"), [1.0])[0]
print("found", sorted(map(tuple, found.collect())))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    want = [(b + u, b) for b in (0, 10, 20) for u in range(3)]
    assert f"found {want}" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("kind", ["spc", "splc", "spnp"])
def test_weights_by_parts(spark, monkeypatch, graph, kind):
    """Each edge's weight, of edges that come twice once, and none for a cycle and what is behind it."""
    edges = spark.createDataFrame(graph + graph[::3] + [(900, 901), (901, 900), (901, 902), (903, 900)], "source long, target long")
    got, want = both_ways(monkeypatch, lambda: paths.traversal_weights(edges, kind, as_text=True))
    assert got == want and {r[:2] for r in got} - set(graph) <= {(903, 900)} and len(got) >= len(graph)


def test_global_key_routes_by_parts(spark, monkeypatch, graph):
    edges = spark.createDataFrame(graph + graph[::3], "source long, target long")
    got, want = both_ways(monkeypatch, lambda: paths.key_routes(edges, 10, "global"))
    assert got == want and sum(n for _, n in got) == 10


def test_robustness_by_parts(spark, monkeypatch, graph):
    edges = spark.createDataFrame(graph + graph[::3], "source long, target long")
    got, want = both_ways(monkeypatch, lambda: paths.robustness(edges))
    assert got == want and len(got) == 3
