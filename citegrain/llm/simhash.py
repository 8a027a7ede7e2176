"""SimHash near-duplicates, found by BK-trees.

A fingerprint has a bit set where more than half the XXH64 hashes of a text's word shingles have it. Two fingerprints
link at ``radius`` or fewer differing bits, and groups are the connected components of the links.

Distinct fingerprints only are compared, so copies cost nothing. They are dealt into shards without losing a link: 64
bits are cut into radius + 2 blocks; two fingerprints that differ in at most radius bits agree in at least two whole
blocks, so they share a shard of some pair of blocks (15 pairs for radius 4, shards keyed by 21 or 22 bits). Each shard
has a BK-tree: the children of a node are keyed by their Hamming distance to it, and a search follows only the edges
within the radius. Up to ``SENT`` distinct fingerprints, which is asked first, the trees' values are broadcast, and each
task grows and searches those of its own shards; beyond it, what belongs to a shard travels by shuffle, with the same
result. A shard above ``SHARD`` fingerprints is dealt into parts, every two of which meet in a tree of bounded size. A
search skips a subtree that is known to hold its own component only, which keeps dense groups of near copies from costing
the square of their size. Each tree hands out a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Union, bounded_array, by_cell, cells, components, cut, ships_by_value

ships_by_value(__name__)

#: Fingerprints in a part of a shard; a tree holds two parts at most.
SHARD = 2048
#: Distinct fingerprints that are broadcast (8 bytes each), and the tasks for each pair of blocks then.
SENT, SPLIT = 500_000, 4


def shingle_hashes(text: str | None, width: int, step: int = 65_536):
    """Arrays of the XXH64 hashes of a text's word shingles, in order. Fewer words than the width: the whole sequence is the one shingle."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - width + 1)
    h, ends = xxhash.xxh64_intdigest, ends[min(width, len(words)) - 1 :]
    starts, ends = starts.tolist(), ends.tolist()
    for k in range(0, n, step):
        yield np.array([h(joined[s:e], 42) for s, e in zip(starts[k : min(n, k + step)], ends[k : k + step])], np.uint64)


def bit_counts(hashes):
    """How many of the hashes have each of the 64 bits."""
    import numpy as np

    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduce(bits, axis=0, dtype=np.uint32).astype(np.int64)


def fingerprint(text: str | None, width: int) -> int:
    """The fingerprint of one text as an unsigned integer."""
    import numpy as np

    n, counts = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, width):
        n += len(hashes)
        counts += bit_counts(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key (a hash of the text), fp (the 64 bits as a signed long) of each row. Null text: no words, fingerprint zero."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "key", "fp"])

    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, key long, fp long")


def _masks(radius: int) -> list[int]:
    """For each pair of blocks, the bits of both as a signed long."""
    n = radius + 2
    edges = [64 * k // n for k in range(n + 1)]
    block = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(n)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(block[a] | block[b]) for a, b in combinations(range(n), 2)]


class BKTree:
    """Fingerprints that arrive one by one, each linked to all earlier ones within the radius."""

    def __init__(self, values: list[int], radius: int):
        self.values, self.radius, self.sets = values, radius, Union(len(values))
        self.children: list[dict[int, int]] = [{} for _ in values]
        #: Whether a node's subtree may hold more than one component.
        self.mixed = [False] * len(values)
        #: Pairs within the radius that connect the components.
        self.edges: list[tuple[int, int]] = []
        for k in range(1, len(values)):
            self._link(k)
            self._insert(k)

    def _link(self, k: int) -> None:
        value, radius, sets, stack = self.values[k], self.radius, self.sets, [0]
        while stack:
            x = stack.pop()
            d = (value ^ self.values[x]).bit_count()
            if d <= radius and sets.find(x) != sets.find(k):
                sets.join(x, k)
                self.edges.append((x, k))
            below = self.children[x]
            if below:
                for e in range(max(1, d - radius), d + radius + 1):
                    y = below.get(e)
                    if y is not None and (self.mixed[y] or sets.find(y) != sets.find(k)):
                        stack.append(y)

    def _insert(self, k: int) -> None:
        x, own = 0, self.sets.find(k)
        while True:
            if self.sets.find(x) != own:
                self.mixed[x] = True
            below = self.children[x]
            y = below.setdefault((self.values[k] ^ self.values[x]).bit_count(), k)
            if y == k:
                return
            x = y

    def forest(self) -> list[tuple[int, int]]:
        return [(self.sets.find(k), k) for k in range(len(self.values)) if self.sets.find(k) != k]


def _batch(out):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])


def _forest(own: list[int], radius: int, out: tuple[list[int], list[int]]) -> None:
    """Adds the links of a tree of distinct signed fingerprints to out."""
    mask = (1 << 64) - 1
    if len(own) == 2:
        found = [(0, 1)] if ((own[0] ^ own[1]) & mask).bit_count() <= radius else []
    else:
        found = BKTree([x & mask for x in own], radius).forest()
    for a, b in found:
        out[0].append(own[a])
        out[1].append(own[b])


def _sent_links(spark, values, radius: int) -> DataFrame:
    """links() of a sorted array of fingerprints, which is broadcast: a task grows the trees of a share of a pair's shards."""
    from itertools import combinations_with_replacement

    masks, shard = _masks(radius), SHARD
    sent = spark.sparkContext.broadcast(values)

    def run(batches):
        import numpy as np

        out: tuple[list[int], list[int]] = ([], [])
        for batch in batches:
            for task in batch.column(0).to_pylist():
                which, share = divmod(task, SPLIT)
                key = sent.value & np.int64(masks[which])
                order = key.argsort(kind="stable")
                key, own = key[order], sent.value[order]
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                sizes = np.diff(starts, append=len(key))
                mine = (sizes > 1) & ((starts % SPLIT == share) | (sizes > shard))
                for start, size in zip(starts[mine].tolist(), sizes[mine].tolist()):
                    members = own[start : start + size]
                    if size <= shard:
                        _forest(members.tolist(), radius, out)
                    else:  # every two parts meet, in the tasks of all shares
                        parts = [members[k::-(-size // shard)] for k in range(-(-size // shard))]
                        for k, (x, y) in enumerate(combinations_with_replacement(range(len(parts)), 2)):
                            if x < y and k % SPLIT == share:
                                _forest(np.concatenate([parts[x], parts[y]]).tolist(), radius, out)
                    if len(out[0]) > 50_000:
                        yield _batch(out)
                        out = ([], [])
        yield _batch(out)

    n = len(masks) * SPLIT
    return spark.range(0, n, 1, n).mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int, most_sent: int = SENT) -> DataFrame:
    """Distinct fps (fp long) to links a, b that connect exactly what links within the radius connect."""
    import numpy as np

    few = bounded_array(fps.select("fp"), most_sent)
    if few is not None:
        return _sent_links(fps.sparkSession, np.sort(few[:, 0]), radius)
    shards = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(radius)])).alias("t", "key"))
    dealt = cells(shards, ["t", "key"], "fp", SHARD).select("cell", "fp")
    # Parts of one shard meet in several cells, and cells may share a hash: a cell is a set, more in it only adds true links.

    def run(batches):
        out: tuple[list[int], list[int]] = ([], [])
        for rows in by_cell(batches, 2):
            _forest(sorted({x[1] for x in rows}), radius, out)
            if len(out[0]) > 50_000:
                yield _batch(out)
                out = ([], [])
        yield _batch(out)

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, width: int = 5, radius: int = 4, most_sent: int = SENT) -> DataFrame:
    """doc_id, key, fp, component_id of each row of docs; key is a hash of the text, component_id the component's smallest doc_id (nulls don't count; null if it has only such).

    docs: doc_id, text; other columns are ignored. Rows repeated in docs are repeated in the result; empty docs give an
    empty result. All texts without words have fingerprint zero and make up one group, with what is near zero.
    """
    own = cut(fingerprints(docs, width))
    firsts = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(firsts.select("fp"), radius, most_sent))
    grouped = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "key", "fp", "component_id")


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
