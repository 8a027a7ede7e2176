"""The library's SQL functions, and layouts."""

import random
from itertools import combinations

import pytest
from plain_graphs import Dag

from citegrain.functions import identity, sql, terms
from citegrain.operators import layout, louvain, paths
from citegrain.sources import sinks


@pytest.fixture(scope="module")
def graphs(spark):
    """Graphs of several sizes, one with a cycle, in a view with its columns in another order."""
    sql.register(spark)
    rng = random.Random(4)
    made = {g: [(u, v) for u, v in combinations(rng.sample(range(50), 12), 2) if rng.random() < 0.3] for g in ("a", "b", "c")}
    made["d"] = [(1, 2), (2, 3), (3, 2), (0, 1), (3, 9)]
    rows = [(v, u, float(1 + (u * v) % 3), g) for g, edges in made.items() for u, v in edges]
    spark.createDataFrame(rows, "target long, source long, weight double, graph string").createOrReplaceTempView("many")
    return made


@pytest.mark.parametrize("kind", ["spc", "splc", "spnp"])
def test_weights_of_many_graphs(spark, graphs, kind):
    got = {(r.graph, r.source, r.target): int(r.weight) for r in spark.sql(f"SELECT * FROM traversal_weights(TABLE(many), '{kind}')").collect()}
    want = {}
    for g, edges in graphs.items():
        dag = Dag(*zip(*edges))
        want |= {(g, *e): w for e, w in zip(dag.edges(), dag.weigh(kind)[0])} if g != "d" else {}
    assert {k: v for k, v in got.items() if k[0] != "d"} == want


@pytest.mark.parametrize("kind", ["spc", "spnp"])
def test_weights_in_bunches(spark, graphs, kind):
    """Edges as arrays, several rows a graph, some twice, with loops and nulls: the weights of the same edges row by row."""
    bunches = "SELECT graph, transform(e, x -> x.source) AS source, transform(e, x -> x.target) AS target FROM (SELECT graph, collect_list(struct(source, target)) AS e FROM (SELECT graph, source, target FROM many UNION ALL SELECT graph, source, target FROM many WHERE source % 3 = 0 UNION ALL SELECT graph, source, source FROM many UNION ALL SELECT graph, NULL, target FROM many) GROUP BY graph, pmod(coalesce(source, 0), 3))"
    got = spark.sql(f"SELECT graph, inline(arrays_zip(source, target, weight)) FROM traversal_weights(TABLE({bunches}), '{kind}')").collect()
    want = spark.sql(f"SELECT graph, source, target, weight FROM traversal_weights(TABLE(many), '{kind}')").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 40


def test_functions_where_tasks_lack_the_library(tmp_path):
    """Table functions work where Python can't import this package, as on executors of a cluster."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
from citegrain.functions import sql
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sql.register(spark)
spark.createDataFrame([("g", 1, 2), ("g", 2, 3)], "graph string, source long, target long").createOrReplaceTempView("e")
for call in ("traversal_weights(TABLE(e))", "main_path(TABLE(e))", "communities(TABLE(e))", "traversal_weights(TABLE(SELECT graph, array(source) AS source, array(target) AS target FROM e))"):
    print("rows", spark.sql("SELECT * FROM " + call).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert [x for x in out.stdout.splitlines() if x.startswith("rows")] == ["rows 2", "rows 3", "rows 3", "rows 1"], out.stderr[-2000:]


def test_a_graph_is_held_in_little_memory():
    """200,000 edges and their weights; as tuples and dictionaries they took 95 MB."""
    import tracemalloc

    rows = [(i, i + k) for i in range(50_000) for k in (7000, 12000, 19000, 25000)]
    tracemalloc.start()
    function = sql.TraversalWeights()
    for u, v in rows:
        function.eval({"graph": "g", "source": u, "target": v}, "spc")
    n, peak = sum(1 for _ in function.terminate()), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(rows) and peak < 40e6


def test_paths_of_many_graphs(spark, graphs):
    got = {}
    for r in spark.sql("SELECT * FROM main_path(TABLE(many)) ORDER BY graph, position").collect():
        got.setdefault(r.graph, []).append(r.node)
    for g in "abc":
        dag = Dag(*zip(*graphs[g]))
        assert got[g] == dag.heaviest(dag.weigh()[0])[0]


def test_communities_of_many_graphs(spark, graphs):
    got = {(r.graph, r.node): r.community for r in spark.sql("SELECT * FROM communities(TABLE(many), 0.7)").collect()}
    for g, edges in graphs.items():
        parts = louvain.louvain([(u, v, float(1 + (u * v) % 3)) for u, v in sorted(edges)], 0.7)
        assert {n: c for (h, n), c in got.items() if h == g} == {n: min(p) for p in parts for n in p}


@pytest.mark.parametrize("query", ["SELECT * FROM traversal_weights(TABLE(many), 'other')", "SELECT * FROM main_path(TABLE(SELECT 1 AS graph))", "SELECT * FROM communities(TABLE(many), -1.0)"])
def test_wrong_arguments_are_refused_when_planned(spark, graphs, query):
    with pytest.raises(Exception, match="not allowed|has no"):
        spark.sql(query)


def test_scalars_are_the_library_s(spark):
    from pyspark.sql import functions as F

    sql.register(spark)
    rows = spark.createDataFrame([("One  Title: é!", "0028-083x", 74.9, "https://doi.org/10.1/AB"), (None, None, None, None), ("", "123", 75.0, " doi:10.2/x "), ("x", "1234 5678", 10.0, "10.3/Y")], "t string, i string, p double, d string")
    got = rows.selectExpr("normal_title(t) AS t", "compact_issn(i) AS i", "quartile(p) AS q", "bare_doi_of(d) AS d").collect()
    want = rows.select(terms.normal_title(F.col("t")).alias("t"), identity.compact_issn(F.col("i")).alias("i"), terms.quartile(F.col("p")).alias("q"), identity.bare_doi(F.col("d")).alias("d")).collect()
    assert got == want


def test_layout(spark):
    nodes = spark.createDataFrame([("a", 0, 5), ("b", 0, 9), ("c", 1, None), ("d", 1, 2), ("e", 1, 2), ("f", 2, 1)], "node string, layer int, weight int")
    edges = spark.createDataFrame([("a", "d"), ("b", "c"), ("b", "e"), ("a", "e"), ("d", "f")], "source string, target string")
    got = {r.node: (r.layer, r.place, r.x, r.y) for r in layout.layered(nodes).collect()}
    assert got == {"b": (0, 0, 60.0, 60), "a": (0, 1, 1140.0, 60), "d": (1, 0, 60.0, 200), "e": (1, 1, 600.0, 200), "c": (1, 2, 1140.0, 200), "f": (2, 0, 600.0, 340)}
    before, after = layout.layered(nodes), layout.layered(nodes, edges, 3)
    assert layout.crossings(before, edges) == 3 and layout.crossings(after, edges) == 0
    page = sinks.html_page(after, edges, "A <net>")
    assert "<svg" in page and "A &lt;net&gt;" in page and '"x": 60.0' in page
    assert layout.layered(nodes.where("false")).collect() == []
