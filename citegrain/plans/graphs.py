"""Networks, citation paths and fronts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql
from ..operators import fronts, history, layout, networks, paths
from ..sources import sinks
from ..tables import cut
from .star import CITES, citations, order_days, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _overlap(members: str, least: int) -> str:
    return f"""WITH m AS ({members}), n AS (SELECT s, count(*) AS c FROM m GROUP BY s)
SELECT a.s AS source, b.s AS target, count(*) AS weight, round(count(*) / sqrt(n1.c * n2.c), 6) AS cosine
FROM m a JOIN m b ON a.i = b.i AND a.s < b.s JOIN n n1 ON n1.s = a.s JOIN n n2 ON n2.s = b.s
GROUP BY a.s, b.s, n1.c, n2.c HAVING count(*) >= {least}"""


@query(_overlap("SELECT DISTINCT l_suppkey AS s, l_partkey AS i FROM lineitem", 2))
def coupling(spark, d):
    lines = table(spark, d, "lineitem")
    return networks.pairwise_overlap(lines.select(F.col("l_suppkey").alias("seed"), F.col("l_partkey").alias("item")))


@query(_overlap("SELECT s, i FROM (SELECT DISTINCT l_partkey AS s, l_orderkey AS i FROM lineitem WHERE l_partkey <> l_orderkey) QUALIFY row_number() OVER (PARTITION BY s ORDER BY i) <= 500", 2))
def co_citation(spark, d):
    lines = table(spark, d, "lineitem")
    return networks.pairwise_overlap(networks.capped(lines.select(F.col("l_partkey").alias("seed"), F.col("l_orderkey").alias("item")), 500))


@query("SELECT p_partkey AS seed FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def seeds_without_items(spark, d):
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return networks.without_items(part.select(F.col("p_partkey").alias("seed")), lines.select(F.col("l_partkey").alias("seed"), F.col("l_orderkey").alias("item")))


@query(_overlap("SELECT DISTINCT l_suppkey AS s, l_partkey AS i FROM lineitem", 2) + " ORDER BY weight DESC, source, target LIMIT 10")
def network_report(spark, d):
    return coupling(spark, d).orderBy(F.desc("weight"), "source", "target").limit(10)


@query(f"SELECT source AS cited_id, count(DISTINCT target) AS lcs FROM ({CITES}) GROUP BY source")
def local_citation_score(spark, d):
    return networks.local_citations(citations(spark, d).select(F.col("source").alias("cited_id"), F.col("target").alias("citing_id")))


def _historiograph(spark, d):
    edges = citations(spark, d).select(F.col("source").alias("cited_id"), F.col("target").alias("citing_id"))
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    gcs = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("gcs"))
    papers = orders.join(gcs, orders.o_orderkey == gcs.l_orderkey).select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("year"), "gcs")
    return history.historiograph(papers, networks.local_citations(edges), edges)


_HISTORY = f"""WITH e AS ({CITES}), l AS (SELECT source, count(DISTINCT target) AS lcs FROM e GROUP BY source),
g AS (SELECT l_orderkey, count(*) AS gcs FROM lineitem GROUP BY l_orderkey),
r AS (SELECT o_orderkey AS paper_id, year(o_orderdate)::INT AS year, coalesce(lcs, 0)::BIGINT AS lcs, gcs FROM orders JOIN g ON o_orderkey = l_orderkey LEFT JOIN l ON o_orderkey = source ORDER BY 3 DESC, 4 DESC, 1 LIMIT 30),
n AS (SELECT * FROM r WHERE lcs > 0 OR (SELECT max(lcs) FROM r) = 0) """


@query(_HISTORY + "SELECT * FROM n")
def historiograph_nodes(spark, d):
    return _historiograph(spark, d)[0]


@query(_HISTORY + "SELECT source AS cited_id, target AS citing_id FROM e WHERE source IN (SELECT paper_id FROM n) AND target IN (SELECT paper_id FROM n)")
def historiograph_edges(spark, d):
    return _historiograph(spark, d)[1]


# The whole graph has far more paths than can be enumerated, and their numbers have some 60 digits. The SQL counts paths by
# their length, all paths of one length into a node at once, in four limbs of 18 digits each (n0 the lowest).
_LIMB = 10**18


def _carried(sums: str, rest: str) -> str:
    """rest and the limbs n0 to n3 of a query with rest and the limbs' sums s0 to s3."""
    q = f"SELECT *, s1 + s0 // {_LIMB} AS c1 FROM ({sums})"
    q = f"SELECT *, s2 + c1 // {_LIMB} AS c2 FROM ({q})"
    q = f"SELECT *, s3 + c2 // {_LIMB} AS c3 FROM ({q})"
    return f"SELECT {rest}, s0 % {_LIMB} AS n0, c1 % {_LIMB} AS n1, c2 % {_LIMB} AS n2, c3 AS n3 FROM ({q})"


_SUMS = ", ".join(f"sum(n{i})::HUGEINT AS s{i}" for i in range(4))
_DIGITS = " || ".join(f"lpad(n{i}::VARCHAR, 18, '0')" for i in (3, 2, 1, 0))


def _product(i: int) -> str:
    return " + ".join(f"np.n{j} * ns.n{i - j}" for j in range(i + 1))


def _counts(kind: str) -> str:
    """CTEs e, np (paths that end in a node), ns (paths that start from it), w (source, target, weight in digits, rank: 72 digits)."""
    start = "SELECT DISTINCT source AS node FROM e WHERE source NOT IN (SELECT target FROM e)" if kind == "spc" else "SELECT source AS node FROM e UNION SELECT target FROM e"
    end = "SELECT source AS node FROM e UNION SELECT target FROM e" if kind == "spnp" else "SELECT DISTINCT target AS node FROM e WHERE target NOT IN (SELECT source FROM e)"
    first = "SELECT node, 0 AS k, 1::HUGEINT AS n0, 0::HUGEINT AS n1, 0::HUGEINT AS n2, 0::HUGEINT AS n3"
    step = lambda f, x, y: _carried(f"SELECT {y} AS node, k + 1 AS k, {_SUMS} FROM {f} JOIN e ON node = {x} GROUP BY {y}, k", "node, k")
    whole = lambda f: _carried(f"SELECT node, {_SUMS} FROM {f} GROUP BY node", "node")
    product = ", ".join(f"{_product(i)} AS s{i}" for i in range(4))
    return f"""WITH RECURSIVE e AS MATERIALIZED ({CITES}),
f AS ({first} FROM ({start}) UNION ALL {step("f", "source", "target")}),
b AS ({first} FROM ({end}) UNION ALL {step("b", "target", "source")}),
np AS MATERIALIZED ({whole("f")}), ns AS MATERIALIZED ({whole("b")}),
w AS MATERIALIZED (SELECT source, target, ltrim(rank, '0') AS weight, rank FROM (SELECT source, target, {_DIGITS} AS rank FROM (
  {_carried(f"SELECT source, target, {product} FROM e JOIN np ON np.node = source JOIN ns ON ns.node = target", "source, target")}))) """


def _weights(kind):
    def run(spark, d):
        return paths.traversal_weights(citations(spark, d, repeated=True), kind, as_text=True, order=order_days(spark, d)).select("source", "target", "weight")

    return run


for _k in ("spc", "splc", "spnp"):
    QUERIES[f"{_k}_weights"] = _weights(_k)
    ORACLE_SQL[f"{_k}_weights"] = _counts(_k) + "SELECT source, target, weight FROM w"


def _best(name: str, into: bool) -> str:
    """CTEs name (node, r): the greatest sum of weights of a path into a node (or out of it), in 72 digits, and name_step (node,
    near): its neighbour on that path, the least of equals."""
    x, y = ("source", "target") if into else ("target", "source")
    limb = lambda r, i: f"substr({r}, {55 - 18 * i}, 18)::HUGEINT"
    sums = ", ".join(f"{limb('p.r', i)} + {limb('w.rank', i)} AS s{i}" for i in range(4))
    added = lambda p, rest: f"SELECT {rest}, {_DIGITS} AS r FROM ({_carried(f'SELECT {rest}, {sums} FROM {p} p JOIN w ON p.node = w.{x}', rest)})"
    return f""", {name}_k AS (SELECT DISTINCT {x} AS node, 0 AS k, repeat('0', 72) AS r FROM w WHERE {x} NOT IN (SELECT {y} FROM w)
  UNION ALL SELECT {y} AS node, k + 1 AS k, max(r) AS r FROM ({added(f"{name}_k", f"{y}, k")}) GROUP BY {y}, k),
{name} AS MATERIALIZED (SELECT node, max(r) AS r FROM {name}_k GROUP BY node),
{name}_step AS MATERIALIZED (SELECT s.{y} AS node, min(s.{x}) AS near FROM ({added(name, "source, target")}) s JOIN {name} t ON t.node = s.{y} AND t.r = s.r GROUP BY s.{y}) """


def _global(kind: str) -> str:
    """CTEs with m: the heaviest path as a list, ties to the least end and then the least node before."""
    return _counts(kind) + _best("h", True) + """, q(node, path) AS (
  SELECT node, [node] FROM (SELECT node FROM h WHERE node NOT IN (SELECT source FROM w) ORDER BY r DESC, node LIMIT 1)
  UNION ALL SELECT near, list_prepend(near, path) FROM q JOIN h_step USING (node)),
m AS (SELECT path FROM q ORDER BY len(path) DESC LIMIT 1) """


_UNROLL = "SELECT (i - 1)::INT AS position, path[i] AS node FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM m)"


@query(_global("spc") + _UNROLL)
def global_main_path(spark, d):
    return paths.main_path(citations(spark, d, repeated=True), "global", order=order_days(spark, d))


@query(_counts("spc") + f""", s AS (SELECT node FROM ns WHERE node NOT IN (SELECT target FROM e) ORDER BY n3 DESC, n2 DESC, n1 DESC, n0 DESC, node LIMIT 1),
best AS (SELECT source, target FROM w QUALIFY row_number() OVER (PARTITION BY source ORDER BY rank DESC, target) = 1),
q(node, path) AS (SELECT node, [node] FROM s UNION ALL SELECT target, list_append(path, target) FROM q JOIN best ON node = source),
m AS (SELECT path FROM q ORDER BY len(path) DESC LIMIT 1) {_UNROLL}""")
def local_forward_path(spark, d):
    return paths.main_path(citations(spark, d, repeated=True), "forward", order=order_days(spark, d))


@query(_counts("spc") + f""", s AS (SELECT target AS node FROM w WHERE target NOT IN (SELECT source FROM e) ORDER BY rank DESC, target DESC LIMIT 1),
best AS (SELECT source, target FROM w QUALIFY row_number() OVER (PARTITION BY target ORDER BY rank DESC, source DESC) = 1),
q(node, path) AS (SELECT node, [node] FROM s UNION ALL SELECT source, list_prepend(source, path) FROM q JOIN best ON node = target),
m AS (SELECT path FROM q ORDER BY len(path) DESC LIMIT 1) {_UNROLL}""")
def local_backward_path(spark, d):
    return paths.main_path(citations(spark, d, repeated=True), "backward", order=order_days(spark, d))


@query(_counts("spc") + """, k AS (SELECT source, target, row_number() OVER (ORDER BY rank DESC, source, target) AS r FROM w QUALIFY r <= 10),
out_best AS (SELECT source, target FROM w QUALIFY row_number() OVER (PARTITION BY source ORDER BY rank DESC, target DESC) = 1),
in_best AS (SELECT source, target FROM w QUALIFY row_number() OVER (PARTITION BY target ORDER BY rank DESC, source DESC) = 1),
fw(r, node, path) AS (SELECT r, target, [target] FROM k UNION ALL SELECT r, o.target, list_append(path, o.target) FROM fw JOIN out_best o ON node = o.source),
bw(r, node, path) AS (SELECT r, source, [source] FROM k UNION ALL SELECT r, i.source, list_prepend(i.source, path) FROM bw JOIN in_best i ON node = i.target),
whole AS (SELECT r, list_concat(arg_max(bw.path, len(bw.path)), arg_max(fw.path, len(fw.path))) AS path FROM fw JOIN bw USING (r) GROUP BY r)
SELECT array_to_string(path, '>') AS route, count(*) AS n_key_edges FROM whole GROUP BY path""")
def key_routes_local(spark, d):
    return paths.key_routes(citations(spark, d, repeated=True), 10, "local", order=order_days(spark, d))


@query(_counts("spc") + _best("h", True) + _best("o", False) + """, k AS (SELECT source, target, row_number() OVER (ORDER BY rank DESC, source, target) AS r FROM w QUALIFY r <= 10),
fw(r, node, path) AS (SELECT r, target, [target] FROM k UNION ALL SELECT r, near, list_append(path, near) FROM fw JOIN o_step USING (node)),
bw(r, node, path) AS (SELECT r, source, [source] FROM k UNION ALL SELECT r, near, list_prepend(near, path) FROM bw JOIN h_step USING (node)),
whole AS (SELECT r, list_concat(arg_max(bw.path, len(bw.path)), arg_max(fw.path, len(fw.path))) AS path FROM fw JOIN bw USING (r) GROUP BY r)
SELECT array_to_string(path, '>') AS route, count(*) AS n_key_edges FROM whole GROUP BY path""")
def key_routes_global(spark, d):
    return paths.key_routes(citations(spark, d, repeated=True), 10, "global", order=order_days(spark, d))


_THREE = " UNION ALL ".join(f"SELECT '{k}' AS k, path FROM ({_global(k)} SELECT path FROM m)" for k in ("spc", "splc", "spnp"))


@query(f"""WITH p AS MATERIALIZED ({_THREE}), x AS (SELECT a.k AS a, b.k AS b, a.path AS x, b.path AS y FROM p a JOIN p b ON (a.k, b.k) IN (('spc', 'splc'), ('spc', 'spnp'), ('splc', 'spnp'))),
n AS (SELECT node, count(*) AS n FROM (SELECT k, unnest(path) AS node FROM p) GROUP BY node)
SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 2) AS jaccard, (SELECT count(*) FROM n WHERE n = 3)::INT AS core, (SELECT count(*) FROM n)::INT AS n_union FROM x""")
def main_path_robustness(spark, d):
    return paths.robustness(citations(spark, d, repeated=True), order_days(spark, d))


@query(f"SELECT target AS source, source AS target FROM ({CITES}) JOIN orders ON o_orderkey = target WHERE o_orderpriority = '1-URGENT'")
def cycle_breaking(spark, d):
    """The citations and the reverse of those by urgent orders: cycles that the dates of orders settle, against the reverse."""
    edges, orders = citations(spark, d), table(spark, d, "orders")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("target"))
    both = edges.union(edges.join(urgent, "target", "left_semi").select("target", "source"))
    return paths.acyclic(both, orders.select(F.col("o_orderkey").alias("node"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")))[1]


_SEEDS = "o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'"


def _lineage_sql(a: str, b: str) -> str:
    near = f"(SELECT {a} AS a, {b} AS x FROM e QUALIFY row_number() OVER (PARTITION BY {a} ORDER BY {b}) <= 200)"
    return f"""WITH e AS ({CITES}), near AS {near}, s AS (SELECT o_orderkey AS node FROM orders WHERE {_SEEDS} AND o_orderkey IN (SELECT source FROM e UNION SELECT target FROM e)),
g1 AS (SELECT DISTINCT x AS node, a AS parent FROM near JOIN s ON a = node WHERE x NOT IN (SELECT node FROM s)),
g2 AS (SELECT DISTINCT x AS node, a AS parent FROM near JOIN (SELECT DISTINCT node FROM g1) ON a = node WHERE x NOT IN (SELECT node FROM s UNION ALL SELECT node FROM g1)),
g3 AS (SELECT DISTINCT x AS node, a AS parent FROM near JOIN (SELECT DISTINCT node FROM g2) ON a = node WHERE x NOT IN (SELECT node FROM s UNION ALL SELECT node FROM g1 UNION ALL SELECT node FROM g2))
SELECT node, 0 AS generation, NULL::BIGINT AS parent FROM s UNION ALL SELECT node, 1, parent FROM g1 UNION ALL SELECT node, 2, parent FROM g2 UNION ALL SELECT node, 3, parent FROM g3"""


def _lineage(forward):
    def run(spark, d):
        edges = cut(citations(spark, d))
        nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
        seeds = table(spark, d, "orders").where(_SEEDS).select(F.col("o_orderkey").alias("node"))
        return paths.lineage(edges, seeds.join(nodes, "node", "left_semi"), 3, 200, forward)

    return run


QUERIES["lineage_forward"], QUERIES["lineage_backward"] = _lineage(True), _lineage(False)
ORACLE_SQL["lineage_forward"], ORACLE_SQL["lineage_backward"] = _lineage_sql("source", "target"), _lineage_sql("target", "source")


@query()
def research_fronts(spark, d):
    return fronts.fronts(citations(spark, d))


def _given_fronts(spark, d):
    """A fixed partition: orders by status; front 0 is what is left."""
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(0)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), status.alias("front"))


_GIVEN = "gf AS (SELECT o_orderkey AS node, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS front FROM orders)"


@query(f"""WITH {_GIVEN}, t AS (SELECT DISTINCT l_orderkey AS node, p_name AS term FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT front, term, count(*) AS count FROM t JOIN gf USING (node) WHERE front > 0 GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT front, term, count, round(count * ln(1 + (count / (SELECT count(DISTINCT node) FROM t JOIN gf USING (node) WHERE gf.front = c.front)) / ((SELECT count(*) FROM t WHERE t.term = c.term) / (SELECT count(DISTINCT node) FROM t))), 6) AS score FROM c)
SELECT *, row_number() OVER (PARTITION BY front ORDER BY score DESC, term)::INT AS place FROM s QUALIFY place <= 4""")
def front_keywords(spark, d):
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    terms = lines.join(part, lines.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("node"), F.col("p_name").alias("term"))
    return fronts.keywords(terms, _given_fronts(spark, d))


@query(f"""WITH e AS ({CITES}), {_GIVEN}, l AS (SELECT source AS node, count(DISTINCT target) AS lcs FROM e GROUP BY source),
o AS (SELECT gf.node, front, year(o_orderdate)::INT AS y, coalesce(lcs, 0) AS lcs FROM gf JOIN orders ON node = o_orderkey LEFT JOIN l ON l.node = gf.node
  WHERE front > 0 AND gf.node IN (SELECT source FROM e UNION SELECT target FROM e)),
c AS (SELECT front, array_to_string(list(node ORDER BY lcs DESC, node)[1:3], ', ') AS core FROM o GROUP BY front),
p AS (SELECT front, count(*) AS size, min(y) AS first_year, max(y) AS last_year, list_sort(list(y))[(count(*) // 2) + 1] AS median_year FROM o GROUP BY front),
i AS (SELECT a.front, count(*) AS n FROM e JOIN o a ON a.node = source JOIN o b ON b.node = target WHERE a.front = b.front GROUP BY a.front)
SELECT front, size, first_year, last_year, median_year, round(coalesce(n, 0) / (size * (size - 1) / 2), 3) AS density, core FROM p JOIN c USING (front) LEFT JOIN i USING (front)""")
def front_description(spark, d):
    edges = citations(spark, d)
    ids = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    papers = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.year("o_orderdate").alias("year"))
    lcs = networks.local_citations(edges.select(F.col("source").alias("cited_id"), F.col("target").alias("citing_id")))
    return fronts.describe(_given_fronts(spark, d).join(ids, "node"), papers, edges, lcs)


@query(_global("spc") + f""", path AS ({_UNROLL}), {_GIVEN}, r AS (SELECT position, node, front, coalesce(lag(front) OVER (ORDER BY position) <> front, false) AS is_hop FROM path JOIN gf USING (node))
SELECT position, node, front, (sum(is_hop::INT) OVER (ORDER BY position) + 1)::BIGINT AS run, is_hop FROM r""")
def front_route_hops(spark, d):
    return fronts.path_route(paths.main_path(citations(spark, d, repeated=True), order=order_days(spark, d)), _given_fronts(spark, d))


@query()
def hop_robustness(spark, d):
    edges = cut(citations(spark, d, repeated=True))
    path = paths.main_path(edges, order=order_days(spark, d))
    from pyspark.sql import Window as W

    hops = path.select(F.col("node").alias("source"), F.lead("node").over(W.orderBy("position")).alias("target")).where("target is not null")
    return fronts.hop_robustness(edges, hops)


def _pajek(spark, d):
    edges = citations(spark, d)
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    label = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"')).alias("label"))
    return sinks.vertices(nodes.join(label, "node")).withColumn("index", F.col("index").cast("int")), edges.withColumn("weight", F.lit(None).cast("string"))


_VERTICES = f"""WITH e AS ({CITES}), v AS (SELECT row_number() OVER (ORDER BY node)::INT AS index, node, '''' || o_orderpriority || '''' AS label
  FROM (SELECT source AS node FROM e UNION SELECT target FROM e) JOIN orders ON o_orderkey = node) """


@query(_VERTICES + "SELECT * FROM v")
def pajek_vertices(spark, d):
    return _pajek(spark, d)[0]


@query(_VERTICES + "SELECT a.index AS a, b.index AS b FROM e JOIN v a ON a.node = source JOIN v b ON b.node = target")
def pajek_arcs(spark, d):
    index, edges = _pajek(spark, d)
    return sinks.arcs(index, edges).select("a", "b")


def _ranked_step(k: int) -> str:
    before = " UNION ALL ".join(["SELECT node FROM s", *[f"SELECT node FROM g{i}" for i in range(1, k)]])
    return f"g{k} AS (SELECT DISTINCT x AS node, a AS parent FROM near JOIN (SELECT DISTINCT node FROM {'s' if k == 1 else f'g{k - 1}'}) ON a = node WHERE x NOT IN ({before}))"


@query(f"""WITH e AS ({CITES}), c AS (SELECT source AS node, count(DISTINCT target) AS n FROM e GROUP BY source),
near AS (SELECT source AS a, target AS x FROM e JOIN c ON node = target WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, target) <= 2),
s AS (SELECT o_orderkey AS node FROM orders WHERE {_SEEDS} AND o_orderkey IN (SELECT source FROM e UNION SELECT target FROM e)), {", ".join(map(_ranked_step, (1, 2, 3)))}
SELECT node, 0 AS generation, NULL::BIGINT AS parent FROM s UNION ALL SELECT node, 1, parent FROM g1 UNION ALL SELECT node, 2, parent FROM g2 UNION ALL SELECT node, 3, parent FROM g3""")
def lineage_ranked(spark, d):
    """The two most cited orders that cite an order, of those cited twice at least."""
    edges = citations(spark, d)
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    lcs = networks.local_citations(edges.select(F.col("source").alias("cited_id"), F.col("target").alias("citing_id")))
    seeds = table(spark, d, "orders").where(_SEEDS).select(F.col("o_orderkey").alias("node")).join(nodes, "node", "left_semi")
    return paths.lineage(edges, seeds, 3, 2, papers=lcs.select(F.col("cited_id").alias("node"), F.col("lcs").alias("cited_by")), sort="citedby", min_citing=2)


@query(f"""WITH g AS ({_lineage_sql("source", "target")}), e AS ({CITES}), n AS (SELECT node, min(generation) AS layer FROM g GROUP BY node), w AS (SELECT source, count(DISTINCT target) AS lcs FROM e GROUP BY source),
r AS (SELECT node, layer::INT AS layer, row_number() OVER (PARTITION BY layer ORDER BY coalesce(lcs, 0) DESC, node) - 1 AS place, count(*) OVER (PARTITION BY layer) AS size FROM n LEFT JOIN w ON source = node)
SELECT node, layer, place, round({layout.LEFT} + ({layout.WIDTH} - 2 * {layout.LEFT}) * CASE WHEN size > 1 THEN place / (size - 1) ELSE 0.5 END, 3) AS x, ({layout.TOP} + {layout.GAP} * layer)::INT AS y FROM r""")
def lineage_layout(spark, d):
    """The coordinates of a lineage: a layer for each generation, the most cited first."""
    found = QUERIES["lineage_forward"](spark, d).groupBy("node").agg(F.min("generation").alias("layer"))
    lcs = networks.local_citations(citations(spark, d).select(F.col("source").alias("cited_id"), F.col("target").alias("citing_id")))
    return layout.layered(found.join(lcs, F.col("node") == F.col("cited_id"), "left").select("node", "layer", F.col("lcs").alias("weight")))


_BY_BRAND = """SELECT DISTINCT g AS graph, source, target FROM (SELECT p_brand AS g, lag(o) OVER (PARTITION BY p_brand, s ORDER BY d, o) AS source, o AS target FROM (
  SELECT DISTINCT p_brand, l_suppkey AS s, l_orderkey AS o, o_orderdate AS d FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)) WHERE source IS NOT NULL"""


# the edges of a brand in bunches; the table function makes them distinct
_BUNCHES = f"""SELECT graph, e.source AS source, e.target AS target FROM (
  SELECT graph, collect_list(struct(source, target)) AS e FROM ({_BY_BRAND.replace("SELECT DISTINCT g AS", "SELECT g AS")}) GROUP BY graph, pmod(hash(source), 64))"""


@query(f"WITH e AS ({_BY_BRAND}) SELECT graph, count(*) AS n_edges, count(DISTINCT source) AS n_sources, true AS whole FROM e GROUP BY graph")
def graphs_in_sql(spark, d):
    """Weights of a graph for each brand by the table function; whole: each weight is what flows in and out of its inner ends."""
    sql.register(spark)
    for name in ("lineitem", "part", "orders"):
        table(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(f"""WITH w AS (SELECT graph, inline(arrays_zip(source, target, weight)) FROM traversal_weights(TABLE({_BUNCHES}), 'spc')),
i AS (SELECT graph, target AS node, sum(weight::DECIMAL(38, 0)) AS n FROM w GROUP BY ALL), o AS (SELECT graph, source AS node, sum(weight::DECIMAL(38, 0)) AS n FROM w GROUP BY ALL),
c AS (SELECT graph, bool_and(i.n = o.n) AS whole FROM i JOIN o USING (graph, node) GROUP BY graph)
SELECT w.graph, count(*) AS n_edges, count(DISTINCT source) AS n_sources, coalesce(any_value(whole), true) AS whole FROM w LEFT JOIN c ON c.graph = w.graph GROUP BY w.graph""")
