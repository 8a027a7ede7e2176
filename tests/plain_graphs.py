"""A citation graph in memory: what the distributed sweeps are compared with."""

from __future__ import annotations


class Dag:
    """One graph in memory, by places: nodes in ascending order, edges (a[i], b[i]) in ascending order.

    Nodes on cycles, or behind one, have no level and are left out. Weights are lists in the order of the edges.
    """

    def __init__(self, sources, targets):
        import numpy as np

        sources, targets = list(sources), list(targets)
        names, at = np.unique(np.array([*sources, *targets], dtype=None if not sources or isinstance(sources[0], (int, np.integer)) else object), return_inverse=True)
        n = len(names)
        code = np.unique(at[: len(sources)].astype(np.int64) * max(1, n) + at[len(sources) :])
        a, b = (code // n, code % n) if n else (code, code)
        starts, left, level = np.searchsorted(a, np.arange(n + 1)), np.bincount(b, minlength=n), np.full(n, -1)
        ready, depth = np.flatnonzero(left == 0), 0
        while len(ready):
            level[ready] = depth
            sizes = starts[ready + 1] - starts[ready]
            first = np.repeat(starts[ready] - np.cumsum(sizes) + sizes, sizes)
            to = b[first + np.arange(len(first))]
            np.subtract.at(left, to, 1)
            ready, depth = np.unique(to[left[to] == 0]), depth + 1
        kept = (level[a] >= 0) & (level[b] >= 0)
        self.names, self.level = names.tolist(), level
        self.cyclic = [self.names[k] for k in np.flatnonzero(level < 0)]
        a, b = a[kept], b[kept]
        #: Edges whose targets come level by level, and those whose sources come in the opposite order.
        self.down, self.up = np.argsort(level[b], kind="stable").tolist(), np.argsort(-level[a], kind="stable").tolist()
        self.n_in, self.n_out = np.bincount(b, minlength=n).tolist(), np.bincount(a, minlength=n).tolist()
        self.out_at = np.searchsorted(a, np.arange(n + 1)).tolist()
        order = np.argsort(b, kind="stable")
        self.in_edges, self.in_at = order.tolist(), np.searchsorted(b[order], np.arange(n + 1)).tolist()
        self.a, self.b = a.tolist(), b.tolist()
        self.sources = [k for k in range(n) if level[k] >= 0 and not self.n_in[k] and self.n_out[k]]
        self.sinks = [k for k in range(n) if level[k] >= 0 and not self.n_out[k] and self.n_in[k]]

    def edges(self) -> list[tuple]:
        return [(self.names[u], self.names[v]) for u, v in zip(self.a, self.b)]

    def out(self, k: int):
        return range(self.out_at[k], self.out_at[k + 1])

    def into(self, k: int) -> list[int]:
        return self.in_edges[self.in_at[k] : self.in_at[k + 1]]

    def weigh(self, kind: str = "spc") -> tuple[list[int], list[int]]:
        """Weight n-(u) * n+(v) of each edge, and n+ of each node. spc: paths from sources to sinks; splc: from any node to sinks; spnp: from any to any."""
        own_in, own_out = int(kind in ("splc", "spnp")), int(kind == "spnp")
        before, after = [own_in if x else 1 for x in self.n_in], [own_out if x else 1 for x in self.n_out]
        a, b = self.a, self.b
        for e in self.down:
            before[b[e]] += before[a[e]]
        for e in self.up:
            after[a[e]] += after[b[e]]
        return [before[u] * after[v] for u, v in zip(a, b)], after

    def _named(self, path: list[int]) -> list:
        return [self.names[k] for k in path]

    def _greedy_out(self, path: list[int], weights, last: bool) -> list[int]:
        """The path prolonged by the heaviest next edge each time; ties to the least id, or the greatest (last)."""
        while out := self.out(path[-1]):
            path.append(self.b[max(out, key=lambda e: (weights[e], e if last else -e))])
        return path

    def _greedy_in(self, path: list[int], weights) -> list[int]:
        """The path prolonged backwards by the heaviest edge each time; ties to the greatest id."""
        path = path[::-1]
        while into := self.into(path[-1]):
            path.append(self.a[max(into, key=lambda e: (weights[e], e))])
        return path[::-1]

    def forward(self, weights, after) -> tuple[list, int]:
        """From the source with most paths on, always the heaviest edge; and how many paths these are."""
        if not self.sources:
            return [], 0
        start = min(self.sources, key=lambda s: (-after[s], s))
        return self._named(self._greedy_out([start], weights, last=False)), after[start]

    def backward(self, weights) -> tuple[list, int]:
        """From the sink with the heaviest edge back, always the heaviest; ties to the greatest id. And that edge's weight."""
        if not self.sinks:
            return [], 0
        top, end = max((max(weights[e] for e in self.into(t)), t) for t in self.sinks)
        return self._named(self._greedy_in([end], weights)), top

    def best(self, weights):
        """For each node the sum of the heaviest path into it and the node before it, and the same for paths out of it."""
        n, a, b = len(self.names), self.a, self.b
        back, prev, fore, nxt = [0] * n, [-1] * n, [0] * n, [-1] * n
        for e in self.down:
            u, v = a[e], b[e]
            total = back[u] + weights[e]
            if prev[v] < 0 or total > back[v]:
                back[v], prev[v] = total, u
        for e in self.up:
            u, v = a[e], b[e]
            total = fore[v] + weights[e]
            if nxt[u] < 0 or total > fore[u]:
                fore[u], nxt[u] = total, v
        return back, prev, nxt

    @staticmethod
    def _trace(steps: list[int], at: int) -> list[int]:
        path = [at]
        while steps[path[-1]] >= 0:
            path.append(steps[path[-1]])
        return path

    def heaviest(self, weights) -> tuple[list, int]:
        """The path from a source to a sink with the greatest sum of weights, and the sum."""
        if not self.sinks:
            return [], 0
        back, prev, _ = self.best(weights)
        end = min(self.sinks, key=lambda t: (-back[t], t))
        return self._named(self._trace(prev, end)[::-1]), back[end]

    def route(self, weights, edge: int, search: str, steps=None) -> list:
        """The edge prolonged both ways: by the heaviest next edge each time (local, ties to the greatest id), or to the heaviest whole path (global)."""
        u, v = self.a[edge], self.b[edge]
        if search == "global":
            _, prev, nxt = steps or self.best(weights)
            return self._named(self._trace(prev, u)[::-1] + self._trace(nxt, v))
        return self._named(self._greedy_in([u], weights) + self._greedy_out([v], weights, last=True))
