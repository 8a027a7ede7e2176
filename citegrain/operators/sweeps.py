"""Sweeps over an acyclic graph in topological order, without the graph in one place.

Nodes are put into bands: an edge leads to its own band or a later one. A sweep goes from band to band. What a band needs of
earlier ones is joined to its edges; a band of up to 2 * BAND edges (2 * LARGEST by a given order), which may hold many levels,
is then worked off in one task of bounded size, with exact integers. A level of more edges than that is a band of its own and is worked off by a grouped sum,
its integers in limbs of 18 digits with carries. So a narrow, deep graph takes a job for each BAND edges and not one for each
level, and a wide one takes a distributed job for each level.

Bands come from an order of the nodes if one is given, such as the date of a paper, cut into ranges of like numbers of edges;
nodes that the order puts before what they follow are moved on. Without one, or if that would give too many or too large
bands, they come from levels, which are found by taking away the nodes that nothing leads to, round by round.

A large graph with an order gets bands of up to TOGETHER * LARGEST edges first. The edges within such a band connect its nodes
into parts that don't touch each other; tasks take whole parts, so a band is worked off by many tasks at once. If a part has
too many edges for one task, narrower bands are tried, and then bands for one task each.

Counts and sums are exact; beyond DIGITS digits a wide level raises an error.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut, discard, exists, new_path, remove
from .parts import joined

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edges that are worked on in one task, about, and those in a band by a given order, which grows with the graph up to that;
#: bands by a given order at the most, and rounds in which it is mended.
BAND, LARGEST, MOST_BANDS, ROUNDS = 50_000, 200_000, 1_000, 20
#: Bands of that many times LARGEST edges are worked off by parts; by how much they are narrowed when a part is too large.
TOGETHER, NARROWER = 16, 4
#: Bands from which a sweep lays the edges out by band.
FEW = 8
#: Limbs of 18 digits of the integers of a wide level.
LIMBS = 12
DIGITS, BASE = 18 * LIMBS, 10**18


def ends_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()


def _small_levels(edges: DataFrame, first: int) -> DataFrame:
    """node, level of a graph of bounded size, the least level being first; nodes on or behind cycles have none."""
    t = dict(edges.dtypes)["source"]

    def run(batches):
        import pyarrow as pa

        out: dict = {}
        waits: dict = {}
        for batch in batches:
            for u, v in zip(*[c.to_pylist() for c in batch.columns]):
                out.setdefault(u, []).append(v)
                waits[v] = waits.get(v, 0) + 1
        level = {u: first for u in out if u not in waits}
        ready = list(level)
        for u in ready:
            for v in out.get(u, ()):
                waits[v] -= 1
                level[v] = max(level.get(v, 0), level[u] + 1)
                if not waits[v]:
                    ready.append(v)
        done = [(u, level[u]) for u in ready]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], kind), pa.array([x for _, x in done], pa.int32())], names=["node", "level"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(edges.schema["source"].dataType)
    return edges.select("source", "target").repartition(1).mapInArrow(run, f"node {t}, level int")


def levels(edges: DataFrame) -> DataFrame:
    """node, level (the number of edges of the longest path that leads to it); nodes on or behind cycles are left out."""
    left, found, level = edges, [], 0
    while left.limit(BAND + 1).count() > BAND:
        heads = cut(left.select(F.col("source").alias("node")).distinct().join(left.select(F.col("target").alias("node")), "node", "left_anti"))
        if heads.isEmpty():
            left = left.limit(0)
            break
        found.append(heads.withColumn("level", F.lit(level)))
        before, left = left, cut(left.join(heads, left.source == heads.node, "left_anti"))
        if before is not edges:
            discard(before)
        level += 1
    found.append(_small_levels(left, level))
    known = cut(reduce(DataFrame.unionByName, found))
    # what is the source of nothing is behind the last of its sources, if all of them have a level
    last = edges.join(known, edges.source == known.node, "left").groupBy("target").agg(F.max("level").alias("l"), F.count(F.when(F.col("level").isNull(), 1)).alias("without"))
    rest = last.where("without = 0").join(known, last.target == known.node, "left_anti").select(F.col("target").alias("node"), (F.col("l") + 1).alias("level"))
    sinks = rest.join(edges, rest.node == edges.source, "left_anti")
    return cut(known.unionByName(sinks.select("node", "level")))


def _in_one_part(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "cs", "ct", F.lit(0).cast("long").alias("ps"), F.lit(0).cast("long").alias("pt"))


class Bands:
    """A graph in bands. edges: source, target, cs, ct (their bands), ps, pt (their parts in them); sizes: edges by the band of their target, and of their source (back)."""

    def __init__(self, edges: DataFrame, order: DataFrame | None = None):
        edges = cut(edges.select("source", "target"))
        n = edges.count()
        step = max(BAND, min(LARGEST, n // 4))
        #: Edges of a band above which it is worked off by a grouped sum.
        self.wide = 2 * step
        #: Whether tasks take parts of a band.
        self.in_parts = False
        placed = None
        if n <= BAND:
            placed = cut(_in_one_part(edges.withColumns({"cs": F.lit(0), "ct": F.lit(0)})))
        elif order is not None and n <= step * MOST_BANDS:
            number = max(2, -(-n // (TOGETHER * LARGEST)))
            while placed is None and n >= TOGETHER * LARGEST and 2 * number <= n // step:
                placed, number = self._by_parts(edges, order, number), NARROWER * number
            if placed is not None:
                self.in_parts = True
                self._measure(placed)
            else:
                placed = self._by_order(edges, order, -(-n // step))
                placed = placed and _in_one_part(placed)
        if placed is not None and not self.in_parts:
            self._measure(placed)
            if max([0, *self.sizes.values(), *self.back.values()]) > self.wide:
                placed = None
        if placed is None:
            self.wide = 2 * BAND
            self._measure(_in_one_part(self._by_level(edges)))
        self.kind = dict(edges.dtypes)["source"]

    def _measure(self, edges: DataFrame) -> None:
        self.edges = edges
        each = edges.groupBy("cs", "ct").count().collect()  # a row for each two bands at the most
        self.sizes, self.back = {}, {}
        for r in each:
            self.sizes[r.ct] = self.sizes.get(r.ct, 0) + r["count"]
            self.back[r.cs] = self.back.get(r.cs, 0) + r["count"]

    @staticmethod
    def _in(edges: DataFrame, nodes: DataFrame) -> DataFrame:
        a, b = nodes.select(F.col("node").alias("source"), F.col("band").alias("cs")), nodes.select(F.col("node").alias("target"), F.col("band").alias("ct"))
        return cut(edges.join(a, "source").join(b, "target").select("source", "target", "cs", "ct"))

    def _by_order(self, edges: DataFrame, order: DataFrame, number: int) -> DataFrame | None:
        placed = order.select("node", F.col("place").cast("double").alias("place"))
        bounds = edges.join(placed, edges.target == placed.node).agg(F.percentile_approx("place", [k / number for k in range(1, number)], 100 * number)).first()[0] if number > 1 else []
        band = sum([(F.col("place") > b).cast("int") for b in sorted(set(bounds or []))], F.lit(0))
        nodes = cut(ends_of(edges).join(placed, "node", "left").select("node", F.coalesce(band, F.lit(0)).alias("band")))
        for _ in range(ROUNDS):
            both = self._in(edges, nodes)
            wrong = both.where("cs > ct").groupBy(F.col("target").alias("_n")).agg(F.max("cs").alias("_b"))
            if wrong.isEmpty():
                return both
            nodes = cut(nodes.join(wrong, nodes.node == wrong._n, "left").select("node", F.greatest("band", F.coalesce("_b", "band")).alias("band")))
            discard(both)
        return None

    def _by_parts(self, edges: DataFrame, order: DataFrame, number: int) -> DataFrame | None:
        """The edges in so many bands, with the parts of their ends; None if a part or a band is too large."""
        both = self._by_order(edges, order, number)
        if both is None:
            return None
        inner, t = both.where("cs = ct"), dict(edges.dtypes)["source"]
        if max((r["count"] for r in inner.groupBy("cs").count().collect()), default=0) > 2 * TOGETHER * LARGEST:
            discard(both)
            return None

        def make(rows):
            import numpy as np
            import pandas as pd

            codes, names = pd.factorize(np.concatenate([rows["source"].to_numpy(), rows["target"].to_numpy()]))
            return pd.DataFrame({"node": names, "part": joined(codes[: len(rows)], codes[len(rows) :], len(names))})

        parts = cut(inner.select("cs", "source", "target").groupBy("cs").applyInPandas(make, f"node {t}, part long"))
        for end, part in (("source", "ps"), ("target", "pt")):
            both_parts = parts.select(F.col("node").alias(end), F.col("part").alias(part))
            both = both.join(both_parts, end, "left").withColumn(part, F.coalesce(part, F.xxhash64(end)))
        made = cut(both.select("source", "target", "cs", "ct", "ps", "pt"))
        discard(parts)
        for by in (("cs", "ps"), ("ct", "pt")):
            if made.groupBy(*by).count().agg(F.max("count")).first()[0] > 2 * LARGEST:
                discard(made)
                return None
        return made

    def _by_level(self, edges: DataFrame) -> DataFrame:
        found = levels(edges)
        both = self._in(edges, found.withColumnRenamed("level", "band"))
        into = {r.ct: r["count"] for r in both.groupBy("ct").count().collect()}
        out = {r.cs: r["count"] for r in both.groupBy("cs").count().collect()}
        bands, band, held, lone = {}, 0, [0, 0], False
        for level in range(max(into, default=0) + 1):
            own = [into.get(level, 0), out.get(level, 0)]
            wide = max(own) > BAND
            if level and (wide or lone or max(a + b for a, b in zip(held, own)) > BAND):
                band, held = band + 1, [0, 0]
            bands[level], held, lone = band, [a + b for a, b in zip(held, own)], wide
        named = edges.sparkSession.createDataFrame(sorted(bands.items()) or [(0, 0)], "level int, band int")
        a, b = named.select(F.col("level").alias("cs"), F.col("band").alias("_s")), named.select(F.col("level").alias("ct"), F.col("band").alias("_t"))
        return cut(both.join(F.broadcast(a), "cs").join(F.broadcast(b), "ct").select("source", "target", F.col("_s").alias("cs"), F.col("_t").alias("ct")))

    def sweep(self, edges: DataFrame, start: DataFrame, back: bool, grouped, small) -> DataFrame:
        """start, and what follows from it band by band; start: node, v, via; edges: source, target, cs, ct, ps, pt and w if weights count.

        back: against the edges. small(tails, heads, weights, known) gets the edges of a band and the v of the tails that are
        settled already, grouped(rows) the edges of a wide level (tail, head, v of tail, w); both give node, v, via.
        """
        spark, base, sent = edges.sparkSession, new_path(edges.sparkSession), new_path(edges.sparkSession)
        band, other, part, tail, head = ("cs", "ct", "ps", "target", "source") if back else ("ct", "cs", "pt", "source", "target")
        sizes = self.back if back else self.sizes
        many = len(sizes) > FEW or self.in_parts
        laid = cut(edges.drop(other), band, part) if many else edges
        schema, t = start.schema, self.kind
        start.write.parquet(f"{base}/band=-1")
        # where the values of a band's nodes are needed; with many bands they are sent there as soon as the band is settled
        needs = cut(edges.select(F.col(tail).alias("node"), F.col(other).alias("at"), F.col(band).alias("to"), F.col(part).alias("part")).distinct(), "at", "part") if many else None

        def send(c: int) -> None:
            made = spark.read.schema(schema).parquet(f"{base}/band={c}").select("node", F.concat_ws(",", "v").alias("v"))
            to = needs if c == -1 else needs.where((F.col("at") == c) & (F.col("to") != c))
            made.join(to, "node").select("node", "v", "part", "to").write.partitionBy("to").parquet(f"{sent}/{c}")

        if many:
            send(-1)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def run(batches):
            import pyarrow as pa

            tails, heads, weights, known = [], [], [], {}
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                if batch.column(1).null_count:
                    known |= {x[0]: x[3].split(",") for x in zip(*columns) if x[1] is None}
                    rows = [x for x in zip(*columns) if x[1] is not None]
                    columns = list(zip(*rows)) if rows else [(), (), ()]
                tails += columns[0]
                heads += columns[1]
                weights += columns[2]
            done = small(tails, heads, weights, known)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done), arrow)] if done else [pa.array([], f.type) for f in arrow], schema=arrow)

        order = sorted(sizes, reverse=back)
        for i, c in enumerate(order):
            weighed, nothing = "w" in edges.columns, F.lit(None).cast("string")
            rows = laid.where(F.col(band) == c).select(F.col(tail).alias("tail"), F.col(head).alias("head"), F.col(part).alias("part"), *(["w"] if weighed else []))
            if sizes[c] > self.wide and not self.in_parts:
                so_far = spark.read.schema(schema).parquet(base).select(F.col("node").alias("tail"), "v")
                made = grouped(rows.join(so_far, "tail"))
            else:  # the edges, and a row for each of their tails that is settled; as strings, which Arrow takes far faster than arrays
                written = rows.select("tail", "head", F.concat_ws(",", "w").alias("w") if weighed else nothing.alias("w"), nothing.alias("v"), "part")
                if many:
                    came = [p for x in [-1, *order[:i]] if exists(spark, p := f"{sent}/{x}/to={c}")]
                    known = spark.read.schema(f"node {t}, v string, part long").parquet(*came) if came else written.limit(0).select(F.col("tail").alias("node"), "v", "part")
                else:
                    so_far = spark.read.schema(schema).parquet(base).select("node", F.concat_ws(",", "v").alias("v"))
                    known = so_far.join(rows.select(F.col("tail").alias("node")), "node", "left_semi").withColumn("part", F.lit(0).cast("long"))
                settled_tails = known.select(F.col("node").alias("tail"), F.lit(None).cast(t).alias("head"), nothing.alias("w"), "v", "part")
                both = written.unionByName(settled_tails)
                both = both.repartition(-(-sizes[c] // BAND), "part") if self.in_parts else both.repartition(1)
                made = both.drop("part").mapInArrow(run, f"node {t}, v array<string>, via array<{t}>")
            made.write.parquet(f"{base}/band={c}")
            if many and i + 1 < len(order):
                send(c)
        if many:
            discard(laid, needs)
            remove(spark, sent)
        return spark.read.schema(schema).parquet(base).select(*schema.names)


def settled(rows, of):
    """[(node, v, via)] of the heads of rows (tail, head, v of tail or None, w), as soon as all their tails have a v; of(list of (tail, v, w))."""
    into: dict = {}
    known: dict = {}
    for tail, head, v, w in rows:
        into.setdefault(head, []).append((tail, w))
        if v is not None:
            known[tail] = v
    out: dict = {}
    waits: dict = {}
    ready = []
    for head, tails in into.items():
        n = 0
        for tail, _ in tails:
            if tail not in known:
                out.setdefault(tail, []).append(head)
                n += 1
        waits[head] = n
        if not n:
            ready.append(head)
    done = []
    for node in ready:
        v, via = of([(tail, known[tail], w) for tail, w in into[node]])
        known[node] = v
        done.append((node, v, via))
        for head in out.get(node, ()):
            waits[head] -= 1
            if not waits[head]:
                ready.append(head)
    return done


def limbs(digits: Column) -> list[Column]:
    """The limbs of an integer in digits, the lowest first."""
    wide = F.lpad(digits, DIGITS, "0")
    return [F.substring(wide, DIGITS - 18 * (i + 1) + 1, 18).cast("decimal(38,0)") for i in range(LIMBS)]


def carried(df: DataFrame, sums: list[str], out: str) -> DataFrame:
    """df with the integer whose limbs' sums are in these columns, in digits, instead of them."""
    for i, c in enumerate(sums[:-1]):
        df = df.withColumn(sums[i + 1], (F.col(sums[i + 1]) + F.expr(f"{c} div {BASE}L").cast("decimal(38,0)")).cast("decimal(38,0)"))
        df = df.withColumn(c, F.col(c) % F.lit(BASE))
    whole = F.regexp_replace(F.concat(*[F.lpad(F.col(c).cast("decimal(38,0)").cast("string"), 18, "0") for c in reversed(sums)]), "^0+(?=.)", "")
    fits = F.when(F.col(sums[-1]) < BASE, whole).otherwise(F.raise_error(F.lit(f"an integer has more than {DIGITS} digits")).cast("string"))
    return df.withColumn(out, fits).drop(*sums)


def counts(bands: Bands, owns: list[int], back: bool = False) -> DataFrame:
    """node, v: for each of owns the number of paths that end in a node (back: start from it).

    Paths count from nodes that nothing leads to; own 1: from any node.
    """
    edges, k = bands.edges, len(owns)
    tail, head = ("target", "source") if back else ("source", "target")
    first = edges.select(F.col(tail).alias("node")).distinct().join(edges.select(F.col(head).alias("node")), "node", "left_anti")
    none = F.lit(None).cast(f"array<{bands.kind}>")
    start = first.select("node", F.array(*[F.lit("1")] * k).alias("v"), none.alias("via"))

    def small(tails, heads, weights, known):
        known = {n: [int(x) for x in v] for n, v in known.items()}
        places, sums, waits, out = range(k), {}, {}, {}
        for tail, head in zip(tails, heads):
            own = sums.get(head)
            if own is None:
                own = sums[head] = owns[:]
                waits[head] = 0
            v = known.get(tail)
            if v is None:
                out.setdefault(tail, []).append(head)
                waits[head] += 1
            else:
                for i in places:
                    own[i] += v[i]
        ready = [n for n, w in waits.items() if not w]
        for node in ready:
            v = sums[node]
            for head in out.get(node, ()):
                own = sums[head]
                for i in places:
                    own[i] += v[i]
                waits[head] -= 1
                if not waits[head]:
                    ready.append(head)
        return [(n, [str(x) for x in sums[n]], None) for n in ready]

    def grouped(rows):
        each = rows.select("head", *[x.alias(f"l{i}_{j}") for i in range(k) for j, x in enumerate(limbs(F.col("v")[i]))])
        summed = each.groupBy("head").agg(*[(F.sum(f"l{i}_{j}") + (owns[i] if j == 0 else 0)).cast("decimal(38,0)").alias(f"l{i}_{j}") for i in range(k) for j in range(LIMBS)])
        for i in range(k):
            summed = carried(summed, [f"l{i}_{j}" for j in range(LIMBS)], f"v{i}")
        return summed.select(F.col("head").alias("node"), F.array(*[f"v{i}" for i in range(k)]).alias("v"), none.alias("via"))

    return bands.sweep(edges, start, back, grouped, small)


def heaviest(bands: Bands, weighed: DataFrame, back: bool = False) -> DataFrame:
    """node, v, via: for each weight the sum of the heaviest path to a node (back: from it), and its neighbour there, the least of equals.

    weighed: source, target, cs, ct, ps, pt, w (an array of integers in digits).
    """
    k = len(weighed.select("w").first()[0]) if not weighed.isEmpty() else 1
    tail, head = ("target", "source") if back else ("source", "target")
    first = weighed.select(F.col(tail).alias("node")).distinct().join(weighed.select(F.col(head).alias("node")), "node", "left_anti")
    start = first.select("node", F.array(*[F.lit("0")] * k).alias("v"), F.array(*[F.lit(None).cast(bands.kind)] * k).alias("via"))

    def small(tails, heads, weights, known):
        known = {n: [int(x) for x in v] for n, v in known.items()}
        places, best, waits, out = range(k), {}, {}, {}

        def offered(tail, v, w, own):
            sums, via = own
            for i in places:
                total = v[i] + w[i]
                if total > sums[i] or total == sums[i] and tail < via[i]:
                    sums[i], via[i] = total, tail

        for tail, head, w in zip(tails, heads, ([int(x) for x in w.split(",")] for w in weights)):
            own = best.get(head)
            if own is None:
                own = best[head] = ([-1] * k, [None] * k)
                waits[head] = 0
            v = known.get(tail)
            if v is None:
                out.setdefault(tail, []).append((head, w))
                waits[head] += 1
            else:
                offered(tail, v, w, own)
        ready = [n for n, w in waits.items() if not w]
        for node in ready:
            v = best[node][0]
            for head, w in out.get(node, ()):
                offered(node, v, w, best[head])
                waits[head] -= 1
                if not waits[head]:
                    ready.append(head)
        return [(n, [str(x) for x in best[n][0]], best[n][1]) for n in ready]

    def grouped(rows):
        own = [f"l{j}" for j in range(LIMBS)]
        found = None
        for i in range(k):
            sums = rows.select("tail", "head", *[(a + b).cast("decimal(38,0)").alias(c) for a, b, c in zip(limbs(F.col("v")[i]), limbs(F.col("w")[i]), own)])
            each = carried(sums, own, "d").select("head", "tail", F.struct(F.length("d").alias("n"), "d").alias("s"))
            top = each.groupBy("head").agg(F.max("s").alias("t"))
            one = each.join(top, "head").where("s = t").groupBy("head").agg(F.first("t.d").alias(f"v{i}"), F.min("tail").alias(f"u{i}"))
            found = one if found is None else found.join(one, "head")
        return found.select(F.col("head").alias("node"), F.array(*[f"v{i}" for i in range(k)]).alias("v"), F.array(*[f"u{i}" for i in range(k)]).alias("via"))

    return bands.sweep(weighed, start, back, grouped, small)


def multiplied(rows: DataFrame, kind: str) -> DataFrame:
    """source, target, cs, ct, ps, pt, w: products of the integers in the arrays a and b, which have the same length."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            w = [",".join([str(int(x) * int(y)) for x, y in zip(a.split(","), b.split(","))]) for a, b in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(w, pa.string())], names=["source", "target", "cs", "ct", "ps", "pt", "w"])

    written = rows.select("source", "target", "cs", "ct", "ps", "pt", F.concat_ws(",", "a"), F.concat_ws(",", "b"))
    made = written.mapInArrow(run, f"source {kind}, target {kind}, cs int, ct int, ps long, pt long, w string")
    return made.withColumn("w", F.split("w", ","))


def follow(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """The columns of starts, and place: where the pointers (node, next) lead from the starts (k, node), place 0 being the start.

    Pointers may have further columns, which starts have too: several sets of pointers followed together. Pointer doubling:
    after r rounds the first 2^r nodes of each path are known, and pointers lead 2^r nodes on.
    """
    sets = [c for c in pointers.columns if c not in ("node", "next")]
    own, rest = [*sets, "node"], [c for c in starts.columns if c != "node"]
    jump = cut(pointers.where("next is not null").select(*own, "next"))
    seen = cut(starts.select(*rest, "node", F.lit(0).cast("long").alias("place")))
    step = 1
    while True:
        more = cut(seen.join(jump, own).select(*rest, F.col("next").alias("node"), (F.col("place") + step).alias("place")))
        if more.isEmpty():
            return seen
        seen = seen.unionByName(more)
        on = jump.select(*sets, F.col("node").alias("next"), F.col("next").alias("_on"))
        twice = cut(jump.join(on, [*sets, "next"]).select(*own, F.col("_on").alias("next")))
        discard(jump)
        jump, step = twice, 2 * step
