"""Citation DAGs: traversal weights, main paths, key routes, cycle breaking, lineages.

Weights and heaviest paths come from sweeps over bands of the graph (module sweeps), so no task holds all of it; the next steps
of greedy searches are grouped maxima; a path is read off its pointers by doubling. Numbers are exact integers, in digits. Ties
go to the least id unless stated.

edges: source (cited, older), target (citing, younger). order, where it is asked for: node, place (a number, such as the day of
publication), older first: it saves rounds, and changes no result.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..tables import cut, discard
from . import parts, sweeps

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edges within one span of dates that cycles are looked for in together; beyond it strong components are found by joins first.
TOGETHER = 200_000
#: Edges not from an older to a younger node that are sent to all tasks to be looked up; more are joined.
FEW = 500_000


def _between_two(edges: DataFrame) -> DataFrame:
    return edges.where("source is not null and target is not null and source <> target").select("source", "target")


def clean_edges(edges: DataFrame, generation: DataFrame | None = None) -> DataFrame:
    """Distinct edges without self loops; with generation (node, generation), those within one generation go."""
    own = _between_two(edges).distinct()
    if generation is None:
        return own
    a, b = generation.select(F.col("node").alias("source"), F.col("generation").alias("g1")), generation.select(F.col("node").alias("target"), F.col("generation").alias("g2"))
    return own.join(a, "source").join(b, "target").where("g1 is null or g2 is null or g1 <> g2").select("source", "target")


def with_component(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges with component: the least node that is connected with them, whatever the direction.

    Labels pass along edges, and each label takes its own label's; a round is a few joins, and their number follows the
    logarithm of a component's width. Running out of rounds is an error.
    """
    both = cut(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source")).distinct())
    state = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"))
    for _ in range(most_rounds):
        around = both.join(state, both.b == state.node).groupBy("a").agg(F.min("root").alias("near"))
        seen = state.join(around, state.node == around.a).select("node", "root", F.least("near", "root").alias("new"))
        # the old root follows too, then every node takes its root's root
        hooks = seen.where("new < root").groupBy(F.col("root").alias("h")).agg(F.min("new").alias("hn"))
        hooked = cut(seen.join(hooks, seen.node == hooks.h, "left").select("node", "root", F.least("new", F.coalesce("hn", "new")).alias("new")))
        up = hooked.select(F.col("node").alias("u"), F.col("new").alias("ur"))
        moved = cut(hooked.join(up, hooked.new == F.col("u"), "left").select("node", F.coalesce("ur", "new").alias("root"), (F.coalesce("ur", "new") != F.col("root")).alias("changed")))
        discard(hooked, state)
        state = moved
        if moved.where("changed").isEmpty():
            discard(both)
            return edges.join(state.select("node", "root"), edges.source == state.node).select(*edges.columns, F.col("root").alias("component"))
    raise RuntimeError("components are not settled")


def break_cycles(edges, dates) -> list[tuple]:
    """Edges to take out until no cycle is left: of each cycle the one that is most against the dates.

    That is an edge whose source is younger than its target (unknown dates count as last), of these the one with the
    youngest source, then the greatest edge. Cycles come as a depth-first search in ascending order meets them; it goes on
    from where the removed edge was left.
    """
    date = lambda n: dates.get(n) or "9999"
    out: dict = {}
    waits: dict = {}
    for u, v in sorted(set(edges)):
        out.setdefault(u, []).append(v)
        waits[v] = waits.get(v, 0) + 1
    # what no cycle leads to is passed over
    free = [u for u in out if u not in waits]
    for u in free:
        for v in out.pop(u, ()):
            waits[v] -= 1
            if not waits[v]:
                free.append(v)
    gone, done = set(), set()
    for start in sorted(out):
        if start in done:
            continue
        path, place, at = [start], {start: 0}, [0]
        while path:
            here = path[-1]
            following = out.get(here, ())
            if at[-1] == len(following):
                done.add(here)
                del place[path.pop()]
                at.pop()
                continue
            nxt = following[at[-1]]
            if nxt in done or (here, nxt) in gone:
                at[-1] += 1
            elif nxt not in place:
                place[nxt] = len(path)
                path.append(nxt)
                at.append(0)
            else:
                ring = path[place[nxt] :]
                worst = max(zip(ring, [*ring[1:], nxt]), key=lambda e: (date(e[0]) > date(e[1]), date(e[0]), e))
                gone.add(worst)
                # back to the node that the removed edge left; what hung on it is looked at again when it is met
                for dropped in path[place[worst[0]] + 1 :]:
                    del place[dropped]
                del path[place[worst[0]] + 1 :], at[place[worst[0]] + 1 :]
    return sorted(gone)


#: Whether paths are counted from any node (else from those that nothing leads to), and to any node.
KINDS = {"spc": (0, 0), "splc": (1, 0), "spnp": (1, 1)}


def _weighed(edges: DataFrame, kinds: tuple[str, ...], order: DataFrame | None, clean: bool = False) -> tuple[sweeps.Bands, DataFrame, DataFrame]:
    """(the graph in bands; source, target, cs, ct, w: the weights by each kind, in digits; node, v: the paths from a node on)."""
    bands = sweeps.Bands(edges if clean else clean_edges(edges), order)
    before_of, after_of = (sorted({KINDS[k][i] for k in kinds}) for i in (0, 1))
    before, after = sweeps.counts(bands, before_of), sweeps.counts(bands, after_of, back=True)
    pick = lambda own, i: F.array(*[F.col("v")[own.index(KINDS[k][i])] for k in kinds])
    a, b = before.select(F.col("node").alias("source"), pick(before_of, 0).alias("a")), after.select(F.col("node").alias("target"), pick(after_of, 1).alias("b"))
    both = bands.edges.join(a, "source").join(b, "target")
    return bands, cut(sweeps.multiplied(both, bands.kind)), after.select("node", pick(after_of, 1).alias("v"))


def traversal_weights(edges: DataFrame, kind: str = "spc", as_text: bool = False, order: DataFrame | None = None) -> DataFrame:
    """source, target, weight of each edge of a DAG: decimal(38,0), or an exact integer of any size in digits (as_text).

    spc: paths from sources to sinks through the edge; splc: from any node to sinks; spnp: from any to any. Edges on or
    behind cycles are left out. Counts above 38 digits raise an error unless asked for as text; nothing wraps.
    """
    edges = cut(_between_two(edges))
    blocked = parts.blocks(edges)
    found = parts.weights(blocked, KINDS[kind]) if blocked is not None else _weighed(edges, (kind,), order)[1].select("source", "target", F.col("w")[0].alias("weight"))
    if as_text:
        return found
    fits = F.when(F.length("weight") <= 38, F.col("weight").cast("decimal(38,0)")).otherwise(F.raise_error(F.lit("a traversal weight has more than 38 digits")).cast("decimal(38,0)"))
    return found.withColumn("weight", fits)


def rank_of(weight: str | Column) -> Column:
    """What integers in digits are ordered by: their length, then the digits."""
    weight = F.col(weight) if isinstance(weight, str) else weight
    return F.struct(F.length(weight).alias("length"), weight.alias("digits"))


def digits_of(weight: str, kind: str) -> Column:
    """A given weight as an integer in digits that orders and adds up alike: digits are left as they are, fractions taken to 18 places."""
    if kind == "string":
        return F.regexp_replace(weight, "^0+(?=.)", "")
    whole = F.col(weight).cast("decimal(38,0)") if kind in ("tinyint", "smallint", "int", "bigint") or kind.endswith(",0)") else (F.col(weight).cast("decimal(38,18)") * F.lit(10**18)).cast("decimal(38,0)")
    return F.when(whole >= 0, whole.cast("string")).otherwise(F.raise_error(F.lit("weights must be numbers of 0 or more")).cast("string"))


def _steps(weighed: DataFrame, at: str, to: str, greatest: bool, i: int = 0) -> DataFrame:
    """node, next: the other end of each node's heaviest edge; of equals the greatest or the least."""
    each = weighed.select(F.col(at).alias("node"), F.col(to).alias("next"), rank_of(F.col("w")[i]).alias("r"))
    if greatest:
        return each.groupBy("node").agg(F.max(F.struct("r", "next")).alias("m")).select("node", "m.next")
    top = each.groupBy("node").agg(F.max("r").alias("m"))
    return each.join(top, "node").where("r = m").groupBy("node").agg(F.min("next").alias("next"))


def _one(steps: DataFrame, start: DataFrame) -> DataFrame:
    """place, node of the path of a single start (node)."""
    return sweeps.follow(steps, start.select(F.lit("").alias("k"), "node"))


def _turned(path: DataFrame) -> DataFrame:
    """k, place, node with each path's order turned round."""
    last = path.groupBy("k").agg(F.max("place").alias("_last"))
    return path.join(last, "k").select("k", (F.col("_last") - F.col("place")).alias("place"), "node")


def main_path(edges: DataFrame, search: str = "global", kind: str = "spc", order: DataFrame | None = None) -> DataFrame:
    """position, node of the main path. search: global (heaviest sum), forward or backward (greedy).

    Global: from a source to a sink, ties to the least end and the least node before. Forward: from the source with most
    paths on, always the heaviest edge. Backward: from the sink with the heaviest edge back, ties to the greatest id.
    """
    edges = cut(_between_two(edges))
    blocked = parts.blocks(edges)
    if blocked is not None:
        each = parts.best_ways(blocked, KINDS[kind], "whole" if search == "global" else search)
        best = each.orderBy(rank_of("w").desc(), F.desc("a") if search == "backward" else "a").limit(1)
        return best.select(F.posexplode("path").alias("position", "node"))
    bands, weighed, after = _weighed(edges.distinct(), (kind,), order, clean=True)
    if search == "global":
        best = sweeps.heaviest(bands, weighed)
        ends = best.where(F.col("via")[0].isNotNull()).join(weighed.select(F.col("source").alias("node")), "node", "left_anti")
        end = ends.orderBy(rank_of(F.col("v")[0]).desc(), "node").limit(1)
        path = _turned(_one(best.select("node", F.col("via")[0].alias("next")), end))
    elif search == "forward":
        starts = weighed.select(F.col("source").alias("node")).distinct().join(weighed.select(F.col("target").alias("node")), "node", "left_anti")
        start = starts.join(after, "node").orderBy(rank_of(F.col("v")[0]).desc(), "node").limit(1)
        path = _one(_steps(weighed, "source", "target", greatest=False), start)
    else:
        last = weighed.join(weighed.select(F.col("source").alias("_s")).distinct(), F.col("target") == F.col("_s"), "left_anti")
        end = last.orderBy(rank_of(F.col("w")[0]).desc(), F.desc("target")).limit(1).select(F.col("target").alias("node"))
        path = _turned(_one(_steps(weighed, "target", "source", greatest=True), end))
    return path.select(F.col("place").cast("int").alias("position"), "node")


def key_routes(edges: DataFrame, k: int = 10, search: str = "local", kind: str = "spc", order: DataFrame | None = None) -> DataFrame:
    """route (nodes joined by >), n_key_edges: the k heaviest edges, each prolonged to a route, equal routes merged.

    local: by the heaviest next edge each time, ties to the greatest id; global: to the heaviest whole path. edges may bring
    their own weight, a number of 0 or more or an integer in digits; else it is the traversal weight of the given kind.
    """
    if "weight" in edges.columns:
        given = edges.where("source is not null and target is not null and source <> target").select("source", "target", digits_of("weight", dict(edges.dtypes)["weight"]).alias("weight"))
        given = cut(given.groupBy("source", "target").agg(F.max(rank_of("weight")).alias("m")).select("source", "target", F.array("m.digits").alias("w")))
        bands = sweeps.Bands(given, order)
        weighed = cut(bands.edges.join(given, ["source", "target"]))
    else:
        edges = cut(_between_two(edges))
        blocked = parts.blocks(edges)
        if blocked is not None:
            top = parts.best_ways(blocked, KINDS[kind], "routes" if search == "local" else "whole_routes", k).orderBy(rank_of("w").desc(), "a", "b").limit(k)
            return top.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n_key_edges"))
        bands, weighed, _ = _weighed(edges.distinct(), (kind,), order, clean=True)
    place = F.row_number().over(W.orderBy(rank_of(F.col("w")[0]).desc(), "source", "target"))
    top = weighed.select("source", "target", "w").orderBy(rank_of(F.col("w")[0]).desc(), "source", "target").limit(k)
    top = cut(top.select(place.cast("string").alias("k"), "source", "target"))
    if search == "global":
        on, back = ((sweeps.heaviest(bands, weighed, back=x).select("node", F.col("via")[0].alias("next"))) for x in (True, False))
    else:
        on, back = _steps(weighed, "source", "target", greatest=True), _steps(weighed, "target", "source", greatest=True)
    way = lambda df, k: df.withColumn("way", F.lit(k))
    starts = way(top.select("k", F.col("target").alias("node")), 1).unionByName(way(top.select("k", F.col("source").alias("node")), -1))
    led = sweeps.follow(way(on, 1).unionByName(way(back, -1)), starts)
    place = F.when(F.col("way") > 0, F.col("place")).otherwise(-F.col("place") - 1)
    whole = led.groupBy("k").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "node"))).alias("p"))
    return whole.select(F.array_join(F.transform("p", lambda x: x["node"].cast("string")), ">").alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n_key_edges"))


def robustness(edges: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """a, b, jaccard of the main paths under each two of the three weights, core (nodes on all three) and n_union."""
    kinds = tuple(KINDS)
    edges = cut(_between_two(edges))
    blocked = parts.blocks(edges)
    if blocked is not None:
        each = parts.best_ways(blocked, list(KINDS.values()), "whole").withColumn("k", F.element_at(F.array(*map(F.lit, kinds)), F.col("way") + 1))
        best = each.withColumn("_r", F.row_number().over(W.partitionBy("k").orderBy(rank_of("w").desc(), "a"))).where("_r = 1")
        return _alike(best.select("k", F.explode("path").alias("node")), kinds)
    bands, weighed, _ = _weighed(edges.distinct(), kinds, order, clean=True)
    best = sweeps.heaviest(bands, weighed)
    each = best.select("node", F.posexplode(F.arrays_zip("v", "via")).alias("i", "x")).select(F.element_at(F.array(*map(F.lit, kinds)), F.col("i") + 1).alias("k"), "node", F.col("x.via").alias("next"), "x.v")
    each = cut(each)
    sinks = each.where("next is not null").join(weighed.select(F.col("source").alias("node")), "node", "left_anti")
    most = sinks.groupBy("k").agg(F.max(rank_of("v")).alias("m"))
    ends = sinks.join(most, "k").where(rank_of("v") == F.col("m")).groupBy("k").agg(F.min("node").alias("node"))
    return _alike(sweeps.follow(each.select("k", "node", "next"), ends), kinds)


def _alike(paths: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """robustness of the paths (k, node)."""
    one = paths.agg(*[F.collect_list(F.when(F.col("k") == k, F.col("node"))).alias(k) for k in kinds])
    like = lambda a, b: F.when(F.size(F.array_union(a, b)) == 0, F.lit(1.0)).otherwise(F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 2))
    core, union = F.size(F.array_intersect(F.array_intersect("spc", "splc"), F.col("spnp"))), F.size(F.array_union(F.array_union("spc", "splc"), F.col("spnp")))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), like(F.col(a), F.col(b)).alias("jaccard")) for a, b in (("spc", "splc"), ("spc", "spnp"), ("splc", "spnp"))])
    return one.select(F.explode(pairs).alias("p"), core.alias("core"), union.alias("n_union")).select("p.a", "p.b", "p.jaccard", "core", "n_union")


def strong_components(edges: DataFrame) -> DataFrame:
    """source, target, component of the edges that lie on a cycle: the least node of those that reach each other.

    Nodes that nothing leads to, or that lead to nothing, are trimmed. Then each node takes the least node that reaches it;
    the nodes of such a colour that reach its node are that node's component. Edges between colours lie on no cycle; what is
    left of a colour goes round again. Each step is a join; a round settles a component at least.
    """
    left, found = cut(edges.select("source", "target").distinct()), []
    while True:
        while True:  # trim
            kept = cut(left.join(left.select(F.col("target").alias("_t")).distinct(), F.col("source") == F.col("_t"), "left_semi").join(left.select(F.col("source").alias("_s")).distinct(), F.col("target") == F.col("_s"), "left_semi"))
            same = kept.count() == left.count()
            left = kept
            if same:
                break
        if left.isEmpty():
            break
        colour = cut(sweeps.ends_of(left).withColumn("c", F.col("node")))
        while True:  # forward: the least node that reaches one
            on = left.join(colour, left.source == colour.node).groupBy("target").agg(F.min("c").alias("n"))
            after = cut(colour.join(on, colour.node == on.target, "left").select("node", F.least("c", F.coalesce("n", "c")).alias("c"), (F.col("n") < F.col("c")).alias("moved")))
            colour = after.select("node", "c")
            if after.where("moved").isEmpty():
                break
        a, b = colour.select(F.col("node").alias("source"), F.col("c")), colour.select(F.col("node").alias("target"), F.col("c").alias("d"))
        inner = cut(left.join(a, "source").join(b, "target").where("c = d").select("source", "target", "c"))
        reach = cut(colour.where("node = c").select("node"))
        front = reach
        while not front.isEmpty():  # backward within a colour, from the node that gave it
            front = cut(inner.join(front, inner.target == front.node).select(F.col("source").alias("node")).distinct().join(reach, "node", "left_anti"))
            reach = cut(reach.unionByName(front))
        s, t = reach.select(F.col("node").alias("source")), reach.select(F.col("node").alias("target"))
        found.append(cut(inner.join(s, "source", "left_semi").join(t, "target", "left_semi").select("source", "target", F.col("c").alias("component"))))
        left = cut(inner.join(s, "source", "left_anti").join(t, "target", "left_anti").select("source", "target"))
    made = left.withColumn("component", F.col("source"))
    for part in found:
        made = made.unionByName(part)
    return made


def acyclic(edges: DataFrame, dates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges without cycles, edges taken out); dates: node, date (ISO string).

    Mutual citations are settled first, by a join: of u to v and v to u the one that is more against the dates goes, as
    in break_cycles(). Of the rest, each cycle holds an edge whose source is not older than its target, and lies within the
    span of dates of such edges, where spans that overlap count as one. Only edges within a span are looked at: those of a
    span of up to TOGETHER edges in one task, those of larger spans by strong component.
    """
    t = dict(edges.dtypes)["source"]
    edges = edges.select("source", "target")
    dated = edges.join(dates.select(F.col("node").alias("source"), F.col("date").alias("d1")), "source", "left").join(dates.select(F.col("node").alias("target"), F.col("date").alias("d2")), "target", "left")
    dated = cut(dated.select("source", "target", *[F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("9999")).alias(c) for c in ("d1", "d2")]).distinct())
    # of a mutual pair the edge that goes is never from an older to a younger node: those that may go are looked up turned round
    turned = dated.where("d1 >= d2").select(F.col("source").alias("_s"), F.col("target").alias("_t"))
    turned = F.broadcast(turned) if turned.limit(FEW + 1).count() <= FEW else turned
    blame = lambda d1, d2, s, t: F.struct((F.col(d1) > F.col(d2)).alias("against"), F.col(d1).alias("d"), F.col(s).alias("s"), F.col(t).alias("t"))
    mutual = dated.join(turned, (F.col("source") == F.col("_t")) & (F.col("target") == F.col("_s")))
    mutual = cut(mutual.where(blame("d2", "d1", "_s", "_t") > blame("d1", "d2", "source", "target")).select(F.col("_s").alias("source"), F.col("_t").alias("target")))
    rest = dated if mutual.isEmpty() else cut(dated.join(mutual, ["source", "target"], "left_anti"))
    # a row for each date at the most: the last date that an edge against the dates comes from
    spans = rest.where("d1 >= d2").groupBy(F.col("d2").alias("low")).agg(F.max("d1").alias("high"))
    before = F.max("high").over(W.orderBy("low").rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce((F.col("low") > before).cast("int"), F.lit(1))).withColumn("span", F.sum("new").over(W.orderBy("low")))
    spans = cut(spans.groupBy("span").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    inside = lambda c: (F.col(c) >= F.col("low")) & (F.col(c) <= F.col("high"))
    days = rest.select(F.col("d1").alias("day")).union(rest.select("d2")).distinct().join(F.broadcast(spans), inside("day")).select("day", "span")
    days = cut(days)
    within = rest.join(days.select(F.col("day").alias("d1"), F.col("span")), "d1").join(days.select(F.col("day").alias("d2"), F.col("span").alias("_s")), "d2").where("span = _s")
    within = cut(within.select("source", "target", "d1", "d2", F.col("span").cast("string").alias("part")))
    large = within.groupBy("part").count().where(F.col("count") > TOGETHER).select("part")
    if not large.isEmpty():
        many = cut(within.join(large, "part", "left_semi"))
        strong = strong_components(many).withColumnRenamed("component", "_c")
        named = many.join(strong, ["source", "target"]).select("source", "target", "d1", "d2", F.concat_ws(" ", "part", F.col("_c").cast("string")).alias("part"))
        within = within.join(large, "part", "left_anti").unionByName(named)

    def make(key, rows):
        import pandas as pd

        known = {n: d for a, b in (("source", "d1"), ("target", "d2")) for n, d in zip(rows[a], rows[b])}
        return pd.DataFrame(break_cycles(zip(rows["source"], rows["target"]), known), columns=["source", "target"]).astype({"source": rows["source"].dtype, "target": rows["target"].dtype})

    gone = cut(mutual.unionByName(within.groupBy("part").applyInPandas(make, f"source {t}, target {t}")))
    whole = dated.select("source", "target")
    return whole if gone.isEmpty() else cut(whole.join(gone, ["source", "target"], "left_anti")), gone


def by_date(dates: DataFrame) -> DataFrame:
    """node, place of node, date (ISO string, or a bare year): an order of nodes; without a place where there is no date."""
    return dates.select("node", F.rpad(F.regexp_replace("date", "-", ""), 8, "0").try_cast("double").alias("place"))


def earliest_date(*cols: str):
    """The least of the dates (10 characters or a bare year, which counts as its last day) as a Column; empty if none."""
    full = [F.when(F.col(c).rlike(r"^\d{4}$"), F.concat(F.col(c), F.lit("-12-31"))).when(F.col(c).rlike(r"^\d{4}"), F.substring(F.col(c), 1, 10)) for c in cols]
    return F.coalesce(F.least(*full) if len(full) > 1 else full[0], F.lit(""))


#: How a node's neighbours are ranked before they are capped: by a column of papers, the greatest first, then by id; None: by id.
SORTS = {"citedby": "cited_by", "date": "date", None: None}


def lineage(edges: DataFrame, seeds: DataFrame, generations: int = 3, most_per_node: int = 200, forward: bool = True, papers: DataFrame | None = None, sort: str | None = None, min_citing: int = 0, scope: list[str] | None = None) -> DataFrame:
    """node, generation, parent of a bounded breadth-first walk from the seeds (node); parents of the generation before only.

    The first discovery fixes a node's generation. Each node's neighbours are capped in the order of sort; papers (node,
    cited_by, date, issn) has what they are ranked by. Neighbours that are cited fewer than min_citing times, or, forward,
    that are in none of the scope's journals (ISSNs), are passed over; neighbours that papers doesn't have are cited 0 times.
    Generations are few, each is one join against the edges and one against what was seen.
    """
    if sort not in SORTS or papers is None and (sort or min_citing or scope):
        raise ValueError("sort is citedby or date, and it, min_citing and scope need papers")
    if scope is not None and not forward:
        raise ValueError("a scope is for walks forward: references have no ISSN")
    near = edges.select(F.col("source").alias("at"), F.col("target").alias("to")) if forward else edges.select(F.col("target").alias("at"), F.col("source").alias("to"))
    near, order = near.distinct(), ["to"]
    if papers is not None:
        near = near.join(papers.select(F.col("node").alias("to"), *[F.col(c).alias(f"_{c}") for c in ("cited_by", "date", "issn") if c in papers.columns]), "to", "left")
        near = near.where(F.coalesce("_cited_by", F.lit(0)) >= min_citing) if min_citing else near
        near = near.where(F.col("_issn").isin(*scope)) if scope is not None else near
        order = [F.col(f"_{SORTS[sort]}").desc_nulls_last(), "to"] if sort else order
    near = near.withColumn("_r", F.row_number().over(W.partitionBy("at").orderBy(*order))).where(F.col("_r") <= most_per_node).select("at", "to")
    near = cut(near)
    front = cut(seeds.select("node").distinct())
    out = front.select("node", F.lit(0).alias("generation"), F.lit(None).cast(dict(front.dtypes)["node"]).alias("parent"))
    seen = front
    for g in range(1, generations + 1):
        step = near.join(front, near["at"] == front.node).select(F.col("to").alias("node"), F.col("at").alias("parent")).join(seen, "node", "left_anti").distinct()
        step = cut(step)
        out = out.unionByName(step.select("node", F.lit(g).alias("generation"), "parent"))
        front = cut(step.select("node").distinct())
        seen = seen.union(front)
    return out
