"""Citation graphs: hand-counted weights, paths, cycles, fronts; invariants on random graphs."""

import random
from itertools import combinations

import pytest

from citegrain.operators import fronts, history, louvain, networks, paths, reports, sweeps
from plain_graphs import Dag

#: A published example of 17 edges with its path counts.
KNOWN = {"AC": 2, "BC": 2, "BD": 5, "BJ": 1, "CE": 2, "CH": 2, "EG": 2, "GH": 2, "DF": 3, "DI": 2, "FH": 1, "FI": 2, "IL": 2, "IM": 2, "JM": 1, "MN": 3, "HK": 5}
DIAMOND = ["AB", "AC", "BD", "CD", "BE"]


def frame(spark, edges):
    return spark.createDataFrame([tuple(e) for e in edges], "source string, target string")


def test_known_weights(spark):
    got = {r.source + r.target: int(r.weight) for r in paths.traversal_weights(frame(spark, KNOWN)).collect()}
    assert got == KNOWN
    dag = Dag(*zip(*KNOWN))
    path, total = dag.heaviest(dag.weigh()[0])
    assert path == list("BDFIMN") and total == 15


def test_flow_is_conserved_and_equals_enumeration():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(3, 9)
        edges = [e for e in combinations(range(n), 2) if rng.random() < 0.45]
        dag = Dag([u for u, _ in edges], [v for _, v in edges])
        out = {x: [v for u, v in edges if u == x] for x in range(n)}
        into = {x: [u for u, v in edges if v == x] for x in range(n)}
        nodes = sorted({x for e in edges for x in e})
        assert dag.edges() == edges and not dag.cyclic
        starts = {"spc": {x for x in nodes if not into[x]}, "splc": set(nodes), "spnp": set(nodes)}
        ends = {"spc": {x for x in nodes if not out[x]}, "splc": {x for x in nodes if not out[x]}, "spnp": set(nodes)}
        whole = []

        def walk(path):
            whole.append(path)
            for v in out[path[-1]]:
                walk([*path, v])

        for s in nodes:
            walk([s])
        for kind in starts:
            want = dict.fromkeys(edges, 0)
            for p in whole:
                if p[0] in starts[kind] and p[-1] in ends[kind]:
                    for e in zip(p, p[1:]):
                        want[e] += 1
            assert dict(zip(edges, dag.weigh(kind)[0])) == want
        w = dict(zip(edges, dag.weigh()[0]))
        for v in nodes:
            if into[v] and out[v]:
                assert sum(w[u, v] for u in into[v]) == sum(w[v, x] for x in out[v])
        full = [p for p in whole if len(p) > 1 and p[0] in starts["spc"] and p[-1] in ends["spc"]]
        total = lambda p: sum(w[e] for e in zip(p, p[1:]))
        best = max(map(total, full), default=0)
        path, found = dag.heaviest(dag.weigh()[0])
        assert found == best and (not full or total(path) == best and path in full)
        # of equally heavy paths the one whose end, then each node before it, is least
        assert not full or path == min((p for p in full if total(p) == best), key=lambda p: p[::-1])


def test_three_weights_on_a_diamond(spark):
    want = {"spc": [2, 1, 1, 1, 1], "splc": [2, 1, 2, 2, 2], "spnp": [3, 2, 2, 2, 2]}
    for kind, values in want.items():
        got = {r.source + r.target: int(r.weight) for r in paths.traversal_weights(frame(spark, DIAMOND), kind).collect()}
        assert got == dict(zip(DIAMOND, values))


def test_counts_beyond_64_bits(spark):
    """Seventy diamonds in a row: 2^70 paths."""
    edges = [(f"{i:03}", f"{i:03}{s}") for i in range(70) for s in "ab"] + [(f"{i:03}{s}", f"{i + 1:03}") for i in range(70) for s in "ab"]
    got = paths.traversal_weights(spark.createDataFrame(edges, "source string, target string"))
    assert {int(r.weight) for r in got.select("weight").distinct().collect()} == {2**69}
    more = spark.createDataFrame([(f"{i:03}", f"{i:03}{s}") for i in range(140) for s in "ab"] + [(f"{i:03}{s}", f"{i + 1:03}") for i in range(140) for s in "ab"], "source string, target string")
    assert {int(r.weight) for r in paths.traversal_weights(more, as_text=True).collect()} == {2**139}
    with pytest.raises(Exception, match="38 digits"):
        paths.traversal_weights(more).collect()


def test_routes_local_and_global():
    edges = ["SX", "SY", "XK", "YK", "KT"]
    dag = Dag(*zip(*edges))
    given = dict(zip(map(tuple, edges), [1, 20, 9, 2, 3]))
    weights, key = [given[e] for e in dag.edges()], dag.edges().index(("K", "T"))
    assert dag.route(weights, key, "local") == list("SXKT")
    assert dag.route(weights, key, "global") == list("SYKT")


def test_key_routes_merge(spark):
    got = {r.route: r.n_key_edges for r in paths.key_routes(frame(spark, ["AB", "BC", "AD"]), 3).collect()}
    assert got == {"A>B>C": 2, "A>D": 1}
    given = spark.createDataFrame([("S", "X", 1), ("S", "Y", 20), ("X", "K", 9), ("Y", "K", 2), ("K", "T", 3)], "source string, target string, weight long")
    assert [r.route for r in paths.key_routes(given, 1, "global").collect()] == ["S>Y>K>T"]


def test_cycle_goes_against_the_dates(spark):
    edges = frame(spark, ["AB", "CB", "AC", "BC", "BD", "CD"])
    dates = spark.createDataFrame([("A", "1997-01-01"), ("B", "2003-06-01"), ("C", "2002-11-01"), ("D", "2010-12-31")], "node string, date string")
    left, gone = paths.acyclic(edges, dates)
    assert [tuple(r) for r in gone.collect()] == [("B", "C")]
    assert left.count() == 5
    rng = random.Random(3)
    for _ in range(30):
        some = {(rng.randrange(8), rng.randrange(8)) for _ in range(20)}
        some = {e for e in some if e[0] != e[1]}
        left = some - set(paths.break_cycles(some, {}))
        assert not Dag([u for u, _ in left], [v for _, v in left]).cyclic


def drawn(seed, n=40, chance=0.12):
    """A random graph without cycles whose nodes are not in order."""
    rng = random.Random(seed)
    names = rng.sample(range(1000), n)
    return names, [(names[i], names[j]) for i, j in combinations(range(n), 2) if rng.random() < chance]


@pytest.mark.parametrize("band, ordered", [(10**6, None), (30, "wrong"), (4, None)])
def test_bands_give_what_one_graph_gives(spark, monkeypatch, band, ordered):
    """One band, bands of levels, wide levels, bands by an order and by one with errors: the same counts and heaviest paths."""
    names, edges = drawn(4, 22, 0.25)
    order = None
    if ordered:
        place = {x: k for k, x in enumerate(names)}
        if ordered == "wrong":
            place[names[3]], place[names[18]], place[names[8]] = 15, 4, None
        order = spark.createDataFrame(list(place.items()), "node long, place long")
    monkeypatch.setattr(sweeps, "BAND", band)
    dag = Dag(*zip(*edges))
    bands, weighed, after = paths._weighed(spark.createDataFrame(edges, "source long, target long"), tuple(paths.KINDS), order)
    assert len(bands.sizes) > 1 or band == 10**6
    got = {(r.source, r.target): [int(x) for x in r.w] for r in weighed.collect()}
    by_kind = [dict(zip(dag.edges(), dag.weigh(kind)[0])) for kind in paths.KINDS]
    assert got == {e: [w[e] for w in by_kind] for e in dag.edges()}
    assert {r.node: int(r.v[0]) for r in after.collect()} == dict(zip(dag.names, dag.weigh("spc")[1]))
    for back in (False, True):
        best = {r.node: (int(r.v[1]), r.via[1]) for r in sweeps.heaviest(bands, weighed, back).collect()}
        into, prev, on = dag.best(dag.weigh("splc")[0])
        want = [dag.names[k] if k >= 0 else None for k in (on if back else prev)]
        assert {n: v[1] for n, v in best.items()} == dict(zip(dag.names, want))
        if not back:
            assert {n: v[0] for n, v in best.items()} == dict(zip(dag.names, into))


def test_parts_of_a_band_are_worked_off_by_many_tasks(spark, monkeypatch):
    """Several graphs side by side: few wide bands whose parts go to tasks of their own; a part too large for a task: narrow bands."""
    from pyspark.sql import functions as F

    for name, value in (("BAND", 10), ("LARGEST", 20), ("TOGETHER", 4)):
        monkeypatch.setattr(sweeps, name, value)
    names, edges = drawn(5, 14, 0.35)
    edges = [(u + 1000 * i, v + 1000 * i) for i in range(6) for u, v in edges]
    order = spark.createDataFrame([(x + 1000 * i, k) for i in range(6) for k, x in enumerate(names)], "node long, place long")
    dag = Dag(*zip(*edges))
    bands, weighed, _ = paths._weighed(spark.createDataFrame(edges, "source long, target long"), ("splc",), order)
    assert bands.in_parts and 1 < len(bands.sizes) < len(edges) / 20 and bands.edges.groupBy("ct").agg(F.countDistinct("pt").alias("n")).where("n > 5").count() > 0
    weights = dag.weigh("splc")[0]
    assert {(r.source, r.target): int(r.w[0]) for r in weighed.collect()} == dict(zip(dag.edges(), weights))
    best = {r.node: r.via[0] for r in sweeps.heaviest(bands, weighed).collect()}
    assert best == {n: dag.names[k] if k >= 0 else None for n, k in zip(dag.names, dag.best(weights)[1])}
    names, edges = drawn(5, 30, 0.4)
    order = spark.createDataFrame([(x, k) for k, x in enumerate(names)], "node long, place long")
    bands = sweeps.Bands(spark.createDataFrame(edges, "source long, target long"), order)
    assert not bands.in_parts and bands.edges.count() == len(edges)


def test_paths_over_bands(spark, monkeypatch):
    names, edges = drawn(9)
    monkeypatch.setattr(sweeps, "BAND", 30)
    df = spark.createDataFrame(edges, "source long, target long")
    order = spark.createDataFrame([(x, k) for k, x in enumerate(names)], "node long, place long")
    dag = Dag(*zip(*edges))
    weights, _ = dag.weigh()
    assert [r.node for r in sorted(paths.main_path(df, order=order).collect())] == dag.heaviest(weights)[0]
    given = spark.createDataFrame([(*e, str(w)) for e, w in zip(dag.edges(), weights)], "source long, target long, weight string")
    want = {}
    for e in sorted(range(len(weights)), key=lambda e: (-weights[e], dag.edges()[e]))[:5]:
        route = ">".join(map(str, dag.route(weights, e, "local")))
        want[route] = want.get(route, 0) + 1
    assert {r.route: r.n_key_edges for r in paths.key_routes(given, 5, "local", order=order).collect()} == want
    found = {k: set(dag.heaviest(dag.weigh(k)[0])[0]) for k in paths.KINDS}
    rows = paths.robustness(df, order).collect()
    assert [(r.a, r.b, r.jaccard) for r in rows] == [(a, b, round(len(found[a] & found[b]) / len(found[a] | found[b]), 2)) for a, b in combinations(found, 2)]
    assert (rows[0].core, rows[0].n_union) == (len(set.intersection(*found.values())), len(set.union(*found.values())))


def test_limbs(spark):
    rng = random.Random(1)
    numbers = [[rng.randrange(10 ** rng.choice([1, 17, 18, 19, 40, 90])) for _ in range(4)] for _ in range(30)]
    df = spark.createDataFrame([(k, str(x)) for k, xs in enumerate(numbers) for x in xs], "k int, d string")
    own = [f"l{j}" for j in range(sweeps.LIMBS)]
    from pyspark.sql import functions as F

    sums = df.select("k", *[c.alias(n) for n, c in zip(own, sweeps.limbs(F.col("d")))]).groupBy("k").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in own])
    assert {r.k: int(r.s) for r in sweeps.carried(sums, own, "s").collect()} == {k: sum(xs) for k, xs in enumerate(numbers)}
    most = spark.createDataFrame([(0, "9" * sweeps.DIGITS)] * 2, "k int, d string")
    sums = most.select("k", *[c.alias(n) for n, c in zip(own, sweeps.limbs(F.col("d")))]).groupBy("k").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in own])
    with pytest.raises(Exception, match="digits"):
        sweeps.carried(sums, own, "s").collect()


def test_strong_components(spark, monkeypatch):
    """Cycles of three and more, by the plain search and by component, within spans of dates and across them."""
    rng = random.Random(12)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(70)})
    edges = [e for e in edges if e[0] != e[1] and e[::-1] not in edges]
    reach = {}
    for s in range(40):
        seen, todo = set(), [s]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[s] = seen
    want = {(u, v): min(x for x in range(40) if x == u or x in reach[u] and u in reach[x]) for u, v in edges if u in reach[v]}
    df = spark.createDataFrame(edges, "source long, target long")
    assert len(set(want.values())) > 0 and {(r.source, r.target): r.component for r in paths.strong_components(df).collect()} == want
    days = [(k, f"20{rng.randrange(10, 30)}-01-01") for k in range(40)]
    dates = spark.createDataFrame(days, "node long, date string")
    for together in (10**6, 1):
        monkeypatch.setattr(paths, "TOGETHER", together)
        left, gone = paths.acyclic(df, dates)
        left = [(r.source, r.target) for r in left.collect()]
        assert not Dag(*zip(*left)).cyclic and len(left) + gone.count() == len(edges)


def test_network_of_digit_weights(spark):
    """Edges of a network go from its table into contexts and routes, the heaviest first by value and not by their digits."""
    rungs = [(f"{i}a", f"{i}{s}") for i in range(5) for s in "bc"] + [(f"{i}{s}", f"{i + 1}a") for i in range(5) for s in "bc"] + [("z", "2a")]
    papers = spark.createDataFrame([(n, f"10.1/{n}", n, 2000 + int(n[0] if n[0] != "z" else 0), f"{2000 + int(n[0] if n[0] != 'z' else 0)}-0{'abc'.find(n[1:]) + 1 or 9}-01") for n in sorted({x for e in rungs for x in e})], "paper_id string, doi string, title string, year int, date string")
    refs = spark.createDataFrame([(v, u, None) for u, v in rungs], "citing_id string, ref_id string, ref_doi string")
    none = spark.createDataFrame([], "doi string, type string, label string, date string")
    net = reports.CitationNetwork(papers, refs, none, spark.createDataFrame([], "doi string, source string, n_refs int"))
    dag = Dag(*zip(*rungs))
    want = sorted(((-w, *e) for e, w in zip(dag.edges(), dag.weigh()[0])))
    back = spark.createDataFrame([], "citing_id string, cited_id string, contexts array<string>")
    got = sorted(net.heaviest_contexts(back, back, 9).collect())
    assert [(-int(r.weight), r.cited_id, r.citing_id) for r in got] == want[:9] and len({len(r.weight) for r in net.edges.collect()}) == 2
    assert net.key_routes.count() > 0 and [r.node for r in sorted(net.main_path.collect())][-1] == "5a"
    assert tuple(net.totals.first()) == (len(papers.collect()), len(papers.collect()), 0, len(rungs), 0, 0, len(papers.collect()), 0)


def test_mutual_and_longer_cycles(spark):
    edges = frame(spark, ["AB", "BA", "BC", "CD", "DB", "XY", "YX"])
    dates = spark.createDataFrame([("A", "2001"), ("B", "2002"), ("C", "2003"), ("D", "2004"), ("X", None), ("Y", "")], "node string, date string")
    left, gone = paths.acyclic(edges, dates)
    assert sorted(r.source + r.target for r in gone.collect()) == ["BA", "DB", "YX"]
    assert sorted(r.source + r.target for r in left.collect()) == ["AB", "BC", "CD", "XY"]


def test_same_generation_edges_go(spark):
    gen = spark.createDataFrame([("A", 0), ("B", 1), ("C", 1), ("D", 3)], "node string, generation int")
    edges = frame(spark, ["AB", "AC", "BC", "AD", "AA"])
    assert {r.source + r.target for r in paths.clean_edges(edges, gen).collect()} == {"AB", "AC", "AD"}


def test_earliest_dates(spark):
    rows = spark.createDataFrame([("2004-01-01", "2002-11-01"), ("2010", None), (None, None)], "a string, b string")
    assert [r[0] for r in rows.select(paths.earliest_date("a", "b")).collect()] == ["2002-11-01", "2010-12-31", ""]


def test_lineage_generations(spark):
    edges = frame(spark, ["AB", "AC", "BC", "BD", "CD", "DE", "EF"])
    seeds = spark.createDataFrame([("A",)], "node string")
    got = sorted((r.node, r.generation, r.parent) for r in paths.lineage(edges, seeds, 3).collect() if r.generation)
    assert got == [("B", 1, "A"), ("C", 1, "A"), ("D", 2, "B"), ("D", 2, "C"), ("E", 3, "D")]
    back = {r.node for r in paths.lineage(edges, spark.createDataFrame([("D",)], "node string"), 1, forward=False).collect()}
    assert back == {"D", "B", "C"}


def two_groups():
    edges = [(f"{g}{j}", f"{g}{i}") for g in "ab" for i in range(5) for j in range(i)]
    return [e for e in edges if e[1] != "b0"] + [("a3", "b0")]


def test_fronts_hops_and_descriptions(spark):
    edges = spark.createDataFrame([*two_groups(), ("x0", "x1")], "source string, target string")
    front = fronts.fronts(edges)
    of = {r.node: r.front for r in front.collect()}
    assert of["a0"] == 1 and of["b0"] == 2 and of["x0"] == 0 and len(of) == 12
    route = fronts.path_route(spark.createDataFrame([(0, "a0"), (1, "a3"), (2, "b0"), (3, "b4")], "position int, node string"), front).collect()
    assert [r.is_hop for r in sorted(route)] == [False, False, True, False]
    hops = spark.createDataFrame([("a3", "b0")], "source string, target string")
    assert fronts.hop_robustness(edges, hops).first().separated == 3
    papers = spark.createDataFrame([(f"{g}{i}", 2000 + i + 10 * (g == "b")) for g in "ab" for i in range(5)], "node string, year int")
    lcs = networks.local_citations(edges.toDF("cited_id", "citing_id"))
    one = {r.front: r for r in fronts.describe(front, papers, edges, lcs).collect()}[1]
    assert (one["size"], one.first_year, one.last_year, one.median_year, one.density, one.core[:2]) == (5, 2000, 2004, 2002, 1.0, "a0")
    terms = spark.createDataFrame([("a0", "v"), ("a1", "v"), ("b0", "f"), ("b1", "f"), *[(n, "d") for n in ("a0", "a1", "b0", "b1")]], "node string, term string")
    assert {r.front: r.term for r in fronts.keywords(terms, front, top=1).collect()} == {1: "v", 2: "f"}


def test_louvain_is_deterministic_and_beats_trivial_parts():
    rng = random.Random(6)
    for _ in range(20):
        edges = [(a, b, rng.random()) for a, b in combinations(range(14), 2) if rng.random() < 0.3]
        parts = louvain.louvain(edges)
        assert sorted(map(sorted, parts)) == sorted(map(sorted, louvain.louvain(edges[::-1])))
        nodes = {x for e in edges for x in e[:2]}
        assert sorted(x for p in parts for x in p) == sorted(nodes)
        for other in ([nodes], [{x} for x in nodes]):
            assert louvain.modularity(edges, parts) >= louvain.modularity(edges, other) - 1e-9


@pytest.mark.parametrize("seed", [1, 2])
def test_a_large_graph_in_rounds(spark, monkeypatch, seed):
    """Moving by classes and contraction come within a hundredth of the modularity of the search in one task, the same each time."""
    rng = random.Random(seed)
    n, parts = 120, 8
    edges = sorted({(a, b) for a, b in combinations(range(n), 2) if rng.random() < (0.45 if a % parts == b % parts else 0.02)})
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a long, b long, weight double")
    monkeypatch.setattr(louvain, "LOCAL", 60)
    runs = []
    for rows in (df, df.orderBy("b").repartition(3)):
        runs.append({r.node: r.community for r in louvain.large_communities(rows).collect()})
    assert runs[0] == runs[1]
    found = {}
    for node, c in runs[0].items():
        found.setdefault(c, set()).add(node)
    assert all(c == min(p) for c, p in found.items()) and set(runs[0]) == {x for e in edges for x in e}
    weighted = [(a, b, 1.0) for a, b in edges]
    best = louvain.modularity(weighted, louvain.louvain(weighted))
    assert louvain.modularity(weighted, list(found.values())) >= best - 0.01 * abs(best)


def test_overlap(spark):
    rows = [("s1", x) for x in "abcd"] + [("s2", x) for x in "bcd"] + [("s3", x) for x in "d"] + [("s2", "b"), ("s4", None)]
    members = spark.createDataFrame(rows, "seed string, item string")
    assert [tuple(r) for r in networks.pairwise_overlap(members).collect()] == [("s1", "s2", 3, round(3 / 12**0.5, 6))]
    assert networks.pairwise_overlap(members.where("false")).collect() == []


def test_links_and_duplicates(spark):
    papers = spark.createDataFrame([("1", "10.1/A", "One Title", 2000), ("2", "10.1/b", "one  title!", 2000), ("3", None, "Other", 2001)], "paper_id string, doi string, title string, year int")
    refs = spark.createDataFrame([("3", "1", None), ("3", "9", "10.1/B"), ("1", "1", None), ("2", None, "10.1/a"), ("2", "1", None), ("7", "1", None)], "citing_id string, ref_id string, ref_doi string")
    assert sorted(map(tuple, networks.link_within(refs, papers).collect())) == [("1", "2"), ("1", "3"), ("2", "3")]
    assert [r.ids for r in networks.duplicate_groups(papers).collect()] == [["1", "2"]]


def test_series(spark):
    years = [y for y in range(1990, 2001) for _ in range(3)] + [1997] * 10
    refs = spark.createDataFrame([(y, f"w{i}") for i, y in enumerate(years[:33])] + [(1997, "root")] * 10 + [(None, "u")], "year int, work string")
    s = history.spectrogram(refs, 1990, 2000)
    assert {r.year: (r.n, r.deviation) for r in s.collect()}[1997] == (13, 10.0)
    top = history.peaks(s)
    assert [r.year for r in top.collect()] == [1997]
    best = history.peak_works(refs, top).where("place = 1").first()
    assert (best.work, best.n_work, best.share_top_work) == ("root", 10, 0.77)
    assert history.undated(refs).first()[0] == 1
    own = spark.createDataFrame([(y,) for y in (1997, 1999, 2003, 2006, 2008, 2010, 2014, 2019, 2021)], "year int")
    bounds = lambda **k: [tuple(r)[1:] for r in sorted(history.period_bounds(own, **k).collect())]
    assert bounds(cuts=[2005, 2013]) == [(1997, 2004), (2005, 2012), (2013, 2021)]
    assert bounds() == [(1997, 2005), (2006, 2013), (2014, 2021)]
    assert bounds(cuts=[1990, 2030]) == [(1997, 2021)]
    assert history.period_bounds(own.where("false")).collect() == []


def test_historiograph(spark):
    papers = spark.createDataFrame([("A", 1997, 600), ("B", 2003, 120), ("C", 2010, 270), ("D", 2019, 800)], "paper_id string, year int, gcs long")
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("C", "D")], "cited_id string, citing_id string")
    nodes, among = history.historiograph(papers, networks.local_citations(edges), edges, 3)
    assert {r.paper_id: r.lcs for r in nodes.collect()} == {"A": 2, "B": 1, "C": 1}
    assert among.count() == 3


def test_empty_graphs(spark):
    none = frame(spark, ["AB"]).where("false")
    assert paths.traversal_weights(none).collect() == [] and paths.main_path(none).collect() == []
    assert fronts.fronts(none).collect() == [] and paths.key_routes(none).collect() == []


@pytest.mark.parametrize("search", ["global", "forward", "backward"])
def test_main_paths_run_from_source_to_sink(spark, search):
    got = [r.node for r in sorted(paths.main_path(frame(spark, KNOWN), search).collect())] if search != "x" else []
    assert got[0] in "AB" and got[-1] in "KLN"


def test_path_transmission(spark):
    """Steps of a path with their weights and labels; too short a path is refused."""
    from citegrain.operators import reports

    edges = frame(spark, ["AB", "BC"])
    papers = spark.createDataFrame([(n, ["Cole"], 2007) for n in "ABC"], "node string, surnames array<string>, year int")
    contexts = spark.createDataFrame([("B", "A", ["A dance language (Cole, 2007) is shown."], ["result"], False)], "citing_id string, cited_id string, contexts array<string>, intents array<string>, is_influential boolean")
    got = sorted(reports.path_transmission(paths.main_path(edges), papers, contexts, paths.traversal_weights(edges), ["dance language"]).collect())
    assert [(r.cited_id, r.citing_id, int(r.weight), r.label) for r in got] == [("A", "B", 1, "substantive"), ("B", "C", 1, "unresolved")]
    with pytest.raises(ValueError):
        reports.path_transmission(paths.main_path(edges).limit(1), papers, contexts, paths.traversal_weights(edges), [])
    heavy = reports.heaviest_contexts(spark.createDataFrame([("A", "B", 1), ("B", "C", 5)], "source string, target string, weight int"), contexts.select("citing_id", "cited_id", "contexts"), contexts.select("citing_id", "cited_id", "contexts").limit(0), 1)
    assert [(r.place, r.cited_id, r.status) for r in heavy.collect()] == [(1, "B", "edge_absent")]


def test_lineage_ranks_and_limits(spark):
    edges = frame(spark, ["AB", "AC", "AD", "BE", "CE", "DF"])
    seeds = spark.createDataFrame([("A",)], "node string")
    papers = spark.createDataFrame([("B", 5, "2001", "x"), ("C", 9, "2003", "y"), ("D", 9, "2002", "x"), ("E", 1, "2004", "x")], "node string, cited_by int, date string, issn string")
    walk = lambda **k: sorted((r.node, r.generation) for r in paths.lineage(edges, seeds, 2, papers=papers, **k).collect() if r.generation)
    assert walk(most_per_node=1, sort="citedby") == [("C", 1), ("E", 2)] and walk(most_per_node=2, sort="citedby") == [("C", 1), ("D", 1), ("E", 2), ("F", 2)]
    assert walk(most_per_node=1, sort="date") == [("C", 1), ("E", 2)] and walk(min_citing=6) == [("C", 1), ("D", 1)]
    assert walk(scope=["x"]) == [("B", 1), ("D", 1), ("E", 2)]
    for wrong in ({"sort": "other"}, {"scope": ["x"], "forward": False}):
        with pytest.raises(ValueError):
            walk(**wrong)
    with pytest.raises(ValueError):
        paths.lineage(edges, seeds, sort="date")


def test_lineage_works_the_citations_out_once(spark, sf):
    """The result's plan reads written tables only, not the line items again for each generation."""
    from citegrain.plans import graphs

    found = graphs.QUERIES["lineage_backward"](spark, sf)
    assert not [f for f in found.inputFiles() if "lineitem" in f]


def test_cycles_are_settled_the_same_when_looked_up_by_a_join(spark, monkeypatch):
    """Mutual pairs with dates that differ, are equal or missing, and what is no pair: sent to all tasks or joined."""
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 4), (4, 3), (5, 6), (6, 5), (1, 3), (7, 8)], "source long, target long")
    dates = spark.createDataFrame([(1, "2001"), (2, "2003"), (3, "2004"), (4, "2004"), (5, "2002"), (7, "2009"), (8, "2001")], "node long, date string")
    got = []
    for few in (500_000, 0):
        monkeypatch.setattr(paths, "FEW", few)
        left, gone = paths.acyclic(edges, dates)
        got.append((sorted(map(tuple, left.collect())), sorted(map(tuple, gone.collect()))))
    assert got[0] == got[1] == ([(1, 2), (1, 3), (3, 4), (5, 6), (7, 8)], [(2, 1), (4, 3), (6, 5)])


def test_references_without_a_doi_stay_out_of_its_look_up(spark):
    """They would share one key, so one task; a row's id counts before its DOI."""
    from citegrain.operators import networks

    refs = spark.createDataFrame([("1", "2", None), ("1", "x", "10.1/C"), ("2", "3", "10.1/a"), ("2", None, "10.1/A"), ("3", "x", None)], "citing_id string, ref_id string, ref_doi string")
    papers = spark.createDataFrame([("1", "10.1/a"), ("2", None), ("3", "10.1/c")], "paper_id string, doi string")
    assert sorted(map(tuple, networks.link_within(refs, papers).collect())) == [("1", "2"), ("2", "1"), ("3", "1"), ("3", "2")]
    none = networks.link_within(refs.selectExpr("citing_id", "ref_id", "cast(null AS string) AS ref_doi"), papers)
    assert "lower(" not in none._jdf.queryExecution().optimizedPlan().toString()
