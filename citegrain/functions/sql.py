"""The library in SQL: scalar functions of titles, identifiers and ranks, and table functions over many graphs.

register(spark) defines them for a session:

    SELECT normal_title(title), compact_issn(issn), quartile(percentile), bare_doi_of(doi) FROM journals
    SELECT * FROM traversal_weights(TABLE(edges), 'splc')
    SELECT * FROM main_path(TABLE(edges))
    SELECT * FROM communities(TABLE(edges), 1.5)

The table functions take a table with graph, source and target (and weight, for communities), in any order of columns, and work
on each graph by itself in one task: for many graphs of bounded size. One large graph is what operators.paths and
operators.louvain are for.

Spark hands table functions row after row, which costs more than the weights do. traversal_weights therefore takes and gives
edges in bunches too, if source and target are arrays: a row is then as many edges, those of a graph in any number of rows.
"""

from __future__ import annotations

import sys
from array import array
from itertools import islice

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..operators.louvain import louvain
from ..operators.parts import numbered
from ..operators.paths import KINDS
from ..operators.sweeps import settled
from . import terms

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edges in a bunch that traversal_weights gives.
BUNCH = 20_000

#: Name, arguments, type and body of further scalar functions.
SCALARS = (
    ("bare_doi_of", "doi STRING", "STRING", r"nullif(lower(regexp_replace(trim(doi), '(?i)^https?://(dx\\.)?doi\\.org/', '')), '')"),
)


def _kinds(table: AnalyzeArgument, *names: str) -> list[T.DataType]:
    if not table.isTable:
        raise ValueError("the first argument has to be a table")
    found = {f.name: f.dataType for f in table.dataType.fields}
    if missing := [n for n in names if n not in found]:
        raise ValueError(f"the table has no {', '.join(missing)}")
    return [found[n] for n in names]


def _given(argument: AnalyzeArgument | None, allowed, otherwise):
    value = otherwise if argument is None else argument.value
    if not allowed(value):
        raise ValueError(f"not allowed: {value!r}")
    return value


class _OnGraph:
    """Gathers the edges of a graph, which come together and in order."""

    def __init__(self):
        self.graph, self.edges, self.more = None, [], ()

    def eval(self, row, *more):
        self.graph, self.more = row["graph"], more
        if row["source"] is not None and row["target"] is not None and row["source"] != row["target"]:
            weight = row["weight"] if "weight" in row else None
            self.edges.append((row["source"], row["target"], 1.0 if weight is None else float(weight)))


class _Numbered:
    """The edges of a graph as numbers of its nodes, 8 bytes an edge; equal edges that follow each other are one."""

    def __init__(self, edges=()):
        self.at: dict = {}
        self.sources, self.targets = array("i"), array("i")
        for source, target in edges:
            self.add(source, target)

    @classmethod
    def of_bunches(cls, bunches: list[tuple]) -> _Numbered:
        """The distinct edges without self loops of bunches (sources, targets), in the order of source and target; an end that is null is none."""
        import numpy as np

        ends = [[], []]
        for sources, targets in bunches:
            if None in sources or None in targets:
                both = [(u, v) for u, v in zip(sources, targets) if u is not None and v is not None]
                sources, targets = [u for u, _ in both], [v for _, v in both]
            for own, x in zip(ends, (sources, targets)):
                own.append(np.array(x, None if len(x) and isinstance(x[0], int) else object))
        made = cls()
        ends = [[x for x in own if len(x)] for own in ends]
        if ends[0]:
            names, a, b = numbered(*map(np.concatenate, ends))
            key = np.unique((a * len(names) + b)[a != b])
            a, b = np.divmod(key, len(names))
            kept = np.unique(np.concatenate([a, b]))
            made.at = dict.fromkeys(names[kept].tolist())
            made.sources, made.targets = (array("i", kept.searchsorted(x).astype(np.intc).tobytes()) for x in (a, b))
        return made

    def add(self, source, target) -> None:
        u, v = self.at.setdefault(source, len(self.at)), self.at.setdefault(target, len(self.at))
        if not self.sources or (self.sources[-1], self.targets[-1]) != (u, v):
            self.sources.append(u)
            self.targets.append(v)

    def counts(self, own: int, back: bool) -> list:
        """For each node the paths that end in it (back: start from it), None on or behind cycles; own 1: from any node."""
        import numpy as np

        tails, heads = (np.frombuffer(x, dtype=np.intc) for x in ((self.targets, self.sources) if back else (self.sources, self.targets)))
        n = len(self.at)
        waits = np.bincount(heads, minlength=n).tolist()
        first = np.concatenate([[0], np.cumsum(np.bincount(tails, minlength=n))])
        after = heads[np.argsort(tails, kind="stable")]
        ready = array("i", [i for i in range(n) if not waits[i]])
        sums = [own if w else 1 for w in waits]
        for u in ready:
            value = sums[u]
            for v in after[first[u] : first[u + 1]].tolist():
                sums[v] += value
                waits[v] -= 1
                if not waits[v]:
                    ready.append(v)
        return [None if w else x for w, x in zip(waits, sums)]

    def weights(self, kind: str):
        """source, target, traversal weight of each edge; edges on or behind cycles are left out."""
        if not self.sources:
            return
        own_in, own_out = KINDS[kind]
        before, after, names = self.counts(own_in, False), self.counts(own_out, True), list(self.at)
        for u, v in zip(self.sources, self.targets):
            if None not in (before[u], before[v], after[u], after[v]):
                yield names[u], names[v], before[u] * after[v]


def weights_of(edges: list[tuple], kind: str) -> dict[tuple, int]:
    """The traversal weight of each edge (source, target) of a graph in memory; edges on or behind cycles are left out."""
    return {(u, v): w for u, v, w in _Numbered(edges).weights(kind)}


class TraversalWeights:
    """graph, source, target, weight (in digits) of the edges of each graph, by spc, splc or spnp."""

    @staticmethod
    def analyze(table: AnalyzeArgument, kind: AnalyzeArgument | None = None) -> AnalyzeResult:
        graph, source, target = _kinds(table, "graph", "source", "target")
        _given(kind, lambda x: x in KINDS, "spc")
        bunches = isinstance(source, T.ArrayType)
        if bunches != isinstance(target, T.ArrayType):
            raise ValueError("not allowed: source and target have to be arrays both, or neither")
        schema = T.StructType().add("graph", graph).add("source", source).add("target", target).add("weight", T.ArrayType(T.StringType()) if bunches else T.StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("graph")], orderBy=[] if bunches else [OrderingColumn("source"), OrderingColumn("target")])

    def __init__(self):
        self.graph, self.numbered, self.bunches, self.more = None, _Numbered(), [], ()

    def eval(self, row, *more):
        self.graph, self.more = row["graph"], more
        if isinstance(row["source"], list):
            self.bunches.append((row["source"], row["target"]))
        elif row["source"] is not None and row["target"] is not None and row["source"] != row["target"]:
            self.numbered.add(row["source"], row["target"])

    def terminate(self):
        kind = self.more[0] if self.more else "spc"
        if self.bunches:
            numbered_edges, self.bunches = _Numbered.of_bunches(self.bunches), []
            weighed = numbered_edges.weights(kind)
            while some := list(islice(weighed, BUNCH)):
                sources, targets, weights = zip(*some)
                yield self.graph, list(sources), list(targets), [str(w) for w in weights]
            return
        for u, v, w in self.numbered.weights(kind):
            yield self.graph, u, v, str(w)


class MainPath(_OnGraph):
    """graph, position, node of each graph's heaviest path by its weights of the given kind; ties as by paths.main_path()."""

    @staticmethod
    def analyze(table: AnalyzeArgument, kind: AnalyzeArgument | None = None) -> AnalyzeResult:
        graph, source, _ = _kinds(table, "graph", "source", "target")
        _given(kind, lambda x: x in KINDS, "spc")
        schema = T.StructType().add("graph", graph).add("position", T.IntegerType()).add("node", source)
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("graph")], orderBy=[OrderingColumn("source"), OrderingColumn("target")])

    def terminate(self):
        weights = weights_of(sorted({e[:2] for e in self.edges}), self.more[0] if self.more else "spc")
        heads, tails = {v for _, v in weights}, {u for u, _ in weights}
        best = {u: (0, None) for u in tails - heads}

        def of(into):
            total, least = max((v[0] + w for _, v, w in into)), None
            least = min(u for u, v, w in into if v[0] + w == total)
            return (total, least), None

        best |= {n: v for n, v, _ in settled([(u, v, best.get(u), w) for (u, v), w in weights.items()], of)}
        ends = [n for n in best if n not in tails]
        if ends:
            path = [min(ends, key=lambda n: (-best[n][0], n))]
            while best[path[-1]][1] is not None:
                path.append(best[path[-1]][1])
            for position, node in enumerate(reversed(path)):
                yield self.graph, position, node


class Communities(_OnGraph):
    """graph, node, community (its least node) of each graph, links being undirected, at a resolution."""

    @staticmethod
    def analyze(table: AnalyzeArgument, resolution: AnalyzeArgument | None = None) -> AnalyzeResult:
        graph, source, _ = _kinds(table, "graph", "source", "target")
        _given(resolution, lambda x: x is not None and float(x) > 0, 1.0)
        schema = T.StructType().add("graph", graph).add("node", source).add("community", source)
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("graph")], orderBy=[OrderingColumn("source"), OrderingColumn("target")])

    def terminate(self):
        for part in louvain(self.edges, float(self.more[0]) if self.more else 1.0):
            for node in sorted(part):
                yield self.graph, node, min(part)


def register(spark: SparkSession) -> None:
    """Define the functions for this session."""
    from pyspark.sql.functions import udtf

    terms.register(spark)
    for name, arguments, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    for name, cls in (("traversal_weights", TraversalWeights), ("main_path", MainPath), ("communities", Communities)):
        spark.udtf.register(name, udtf(cls))
