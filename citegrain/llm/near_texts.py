"""Near copies of a stated Jaccard similarity of word shingles: wide SimHash fingerprints in BK-trees, then an exact check.

A radius on 64 bits that reaches similarity 0.8 also reaches unlike texts, so fingerprints have WORDS * 64 bits here, by the
majority over a text's distinct shingles. Two texts of similarity s differ in a bit with probability p(s) =
acos(2s / (1 + s)) / pi, 0.152 at 0.8, and the radius is the expected distance and 1.6 standard deviations.

Such a radius has no pigeonhole shards. A shard is what agrees in some bits that are drawn once for each table: about as many
bits as the number of fingerprints has, so that shards stay small, and as many tables as bring a pair of similarity s
together with probability FOUND. Their number grows with the power 0.24 of the number of fingerprints. Each shard has a
BK-tree, broadcast or shuffled, as in the module simhash. A tree hands out a spanning forest of its shard, and each link of it
is checked on both whole texts.

What the forests connect are candidate groups. Where the links that hold connect a candidate group as well, nothing is left to
be found in it. In the others a link that was turned down may have stood for one that holds. Their members meet again, in cells
of bounded size, every two of them in one, and a BK-tree there checks each pair within a wider radius, whose ends no link that
holds connects yet, on the whole texts before it links them. So groups are made by checked links only, and no link between
members of a candidate group is lost but one beyond the wider radius.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Union, by_cell, cells, components, cut, discard, one_of_each, packed, ships_by_value, unpacked

ships_by_value(__name__)

WORDS = 8
BITS = 64 * WORDS
#: The probability that a pair exactly at the similarity shares a shard.
FOUND = 0.96
#: Distinct fingerprints that are broadcast (72 bytes each), and the tasks for each table then.
SENT, SPLIT = 200_000, 4
#: Members of a cell's part where pairs are checked in the tree, and the characters of its texts; standard deviations of its radius.
PART, CHARACTERS, WIDER = 512, 1 << 23, 2.5


def differing(similar: float) -> float:
    """The probability that a bit differs between two texts of this Jaccard similarity."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def radius_of(similar: float, deviations: float = 1.6) -> int:
    p = differing(similar)
    return int(BITS * p + deviations * math.sqrt(BITS * p * (1 - p)))


def tables_of(n: int, similar: float):
    """The bits that make the key of a shard, a row for each table, for n fingerprints."""
    import numpy as np

    bits = min(60, max(8, n.bit_length() - 2))
    alike = (1 - differing(similar)) ** bits
    number = math.ceil(math.log(1 - FOUND) / math.log(1 - alike))
    rng = np.random.default_rng(20_240_311)
    return np.array([rng.permutation(BITS)[:bits] for _ in range(number)])


def keys(fps, bits):
    """The shard of each fingerprint (rows of WORDS unsigned values) in the table of these bits."""
    import numpy as np

    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits.tolist()):
        out |= (fps[:, b >> 6] >> np.uint64(b & 63) & np.uint64(1)) << np.uint64(k)
    return out


def shingles(text: str | None, width: int):
    """The XXH64 hashes of the text's distinct shingles, sorted."""
    import numpy as np

    parts = list(simhash.shingle_hashes(text, width))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def wide(text: str | None, width: int) -> bytes:
    """The fingerprint of a text: zero if it has no words. Each value of 64 bits takes its bits from another mix of the hashes."""
    import numpy as np

    h = shingles(text, width)
    out = np.zeros(WORDS, np.uint64)
    for k in range(WORDS if len(h) else 0):
        x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(by)
        counts = simhash.bit_counts(x)
        out[k] = np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0]
    return out.tobytes()


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key (a hash of the text), fp (the fingerprint's bytes) of each row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = [wide(t, width) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary())], names=["doc_id", "key", "fp"])

    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, key long, fp binary")


def _forest(nodes: list[int], fps: list[bytes], radius: int, out: tuple[list[int], list[int]]) -> None:
    """Adds the links of a tree of distinct fingerprints to out, as nodes that are within the radius."""
    values = [int.from_bytes(x, "little") for x in fps]
    if len(values) == 2:
        found = [(0, 1)] if (values[0] ^ values[1]).bit_count() <= radius else []
    else:
        found = simhash.BKTree(values, radius).edges
    for a, b in found:
        out[0].append(min(nodes[a], nodes[b]))
        out[1].append(max(nodes[a], nodes[b]))


def _sent(spark, nodes, fps, radius: int, tables) -> DataFrame:
    """The trees' links; nodes and fps are broadcast, a task grows the trees of a share of a table's shards."""
    from itertools import combinations_with_replacement

    shard, split = simhash.SHARD, SPLIT
    sent = spark.sparkContext.broadcast((nodes, fps))

    def run(batches):
        import numpy as np

        nodes, fps = sent.value
        out: tuple[list[int], list[int]] = ([], [])

        def grow(at):
            _forest(nodes[at].tolist(), [x.tobytes() for x in fps[at]], radius, out)

        for batch in batches:
            for task in batch.column(0).to_pylist():
                which, share = divmod(task, split)
                key = keys(fps, tables[which])
                order = key.argsort(kind="stable")
                key = key[order]
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
                sizes = np.diff(starts, append=len(key))
                mine = (sizes > 1) & ((starts % split == share) | (sizes > shard))
                for start, size in zip(starts[mine].tolist(), sizes[mine].tolist()):
                    members = order[start : start + size]
                    if size <= shard:
                        grow(members)
                    else:  # every two parts meet, in the tasks of all shares
                        parts = [members[k :: -(-size // shard)] for k in range(-(-size // shard))]
                        for k, (x, y) in enumerate(combinations_with_replacement(range(len(parts)), 2)):
                            if x < y and k % split == share:
                                grow(np.concatenate([parts[x], parts[y]]))
                    if len(out[0]) > 50_000:
                        yield simhash._batch(out)
                        out[0].clear()
                        out[1].clear()
        yield simhash._batch(out)

    n = len(tables) * split
    return spark.range(0, n, 1, n).mapInArrow(run, "a long, b long")


def _shuffled(firsts: DataFrame, radius: int, tables) -> DataFrame:
    """The trees' links; what belongs to a shard travels by shuffle, fingerprints only where a shard has several."""

    def members(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, WORDS)
                for t, bits in enumerate(tables):
                    own = keys(fps, bits).view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(own), t, np.int32)), pa.array(own)], names=["node", "t", "key"])

    def run(batches):
        out: tuple[list[int], list[int]] = ([], [])
        for rows in by_cell(batches, 3):
            own = sorted({x[1:] for x in rows})
            if len(own) > 1:
                _forest([x[0] for x in own], [x[1] for x in own], radius, out)
            if len(out[0]) > 50_000:
                yield simhash._batch(out)
                out = ([], [])
        yield simhash._batch(out)

    slim = firsts.select("node", "fp")
    dealt = cells(slim.mapInArrow(members, "node long, t int, key long"), ["t", "key"], "node", simhash.SHARD).select("cell", "node")
    dealt = dealt.join(slim, "node").select("cell", "node", "fp")
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def candidates(firsts: DataFrame, similar: float, most_sent: int = SENT) -> DataFrame:
    """Links a, b (nodes) within the radius; firsts: node (long) and fp, both distinct."""
    import numpy as np

    n = firsts.count()
    tables = tables_of(n, similar)
    if n > most_sent:
        return _shuffled(firsts, radius_of(similar), tables)
    got = firsts.select("node", "fp").toArrow()
    fps = np.frombuffer(b"".join(got.column(1).to_pylist()), np.uint64).reshape(-1, WORDS)
    nodes = got.column(0).to_numpy()
    order = nodes.argsort()
    return _sent(firsts.sparkSession, nodes[order], fps[order], radius_of(similar), tables)


def alike(own, other, similar: float) -> bool:
    """Whether two sorted arrays of distinct hashes have this Jaccard similarity or more."""
    m, n = len(own), len(other)
    if min(m, n) < similar * max(m, n) - 1e-9:
        return False
    at = own.searchsorted(other)
    both = int((own.take(at, mode="clip") == other).sum()) if m else 0
    return both >= similar * (m + n - both) - 1e-9


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the texts whose hashes are among the nodes, once each."""
    texts = docs.select(F.xxhash64("text").alias("node"), F.col("text").cast("string").alias("text"))
    return texts.join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def checked(found: DataFrame, docs: DataFrame, width: int, similar: float) -> DataFrame:
    """The links a, b (hashes of texts) whose texts have this Jaccard similarity or more."""

    def run(batches):
        import pyarrow as pa

        hub, own = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for k, node in enumerate(a):
                if node != hub:
                    hub, own = node, shingles(batch.column(2)[k].as_py(), width)
                good.append(alike(own, shingles(batch.column(3)[k].as_py(), width), similar))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    texts = cut(texts_of(docs, found.select(F.explode(F.array("a", "b")).alias("node"))))
    pairs = found.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


class CheckedTree(simhash.BKTree):
    """A BK-tree that links a value to an earlier one within the radius only if accept(k, x) holds; some are linked at first."""

    def __init__(self, values: list[int], radius: int, sets: Union, accept):
        self.values, self.radius, self.sets, self.accept = values, radius, sets, accept
        self.children: list[dict[int, int]] = [{} for _ in values]
        self.mixed = [False] * len(values)
        self.edges: list[tuple[int, int]] = []
        for k in range(1, len(values)):
            self._link(k)
            self._insert(k)

    def _link(self, k: int) -> None:
        value, radius, sets, stack = self.values[k], self.radius, self.sets, [0]
        while stack:
            x = stack.pop()
            d = (value ^ self.values[x]).bit_count()
            if d <= radius and sets.find(x) != sets.find(k) and self.accept(k, x):
                sets.join(x, k)
                self.edges.append((x, k))
            below = self.children[x]
            if below:
                for e in range(max(1, d - radius), d + radius + 1):
                    y = below.get(e)
                    if y is not None and (self.mixed[y] or sets.find(y) != sets.find(k)):
                        stack.append(y)


def within(members: DataFrame, docs: DataFrame, width: int, similar: float) -> DataFrame:
    """Links a, b of this similarity or more that connect what such links connect within a group.

    members: group, node, own (what is linked already has the same), fp. Each two members of a group meet in a cell; a cell
    holds 2 * PART texts at the most, and 2 * CHARACTERS characters or two texts.
    """
    radius = radius_of(similar, WIDER)

    def run(batches):
        out: tuple[list[int], list[int]] = ([], [])
        for rows in by_cell(batches, 5):
            rows = sorted({x[1]: x for x in rows}.values(), key=lambda x: x[1])
            sets, first, arrays = Union(len(rows)), {}, {}
            for k, x in enumerate(rows):
                sets.join(first.setdefault(x[2], k), k)

            def array(k):
                if k not in arrays:
                    arrays[k] = shingles(rows[k][4], width)
                return arrays[k]

            tree = CheckedTree([int.from_bytes(x[3], "little") for x in rows], radius, sets, lambda k, x: alike(array(k), array(x), similar))
            for a, b in tree.edges:
                out[0].append(rows[a][1])
                out[1].append(rows[b][1])
            if len(out[0]) > 50_000:
                yield simhash._batch(out)
                out = ([], [])
        yield simhash._batch(out)

    texts = cut(texts_of(docs, members.select("node")))
    sized = members.select("group", "node").join(texts.select("node", F.length("text").cast("long").alias("size")), "node")
    dealt = cells(sized, ["group"], "node", PART, "size", CHARACTERS).select("cell", "node")
    rows = dealt.join(members.select("node", "own", "fp"), "node").join(texts, "node").select("cell", "node", "own", "fp", "text")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def linked(firsts: DataFrame, docs: DataFrame, width: int, similar: float, most_sent: int = SENT) -> DataFrame:
    """node, root of the groups of firsts (node, fp) that links of this similarity or more connect; nodes without one may be left out."""
    found = cut(candidates(firsts, similar, most_sent).distinct())
    good = cut(checked(found, docs, width, similar))
    groups, own = components(found), components(good)
    named = groups.join(own.select(F.col("node").alias("_n"), F.col("root").alias("_r")), F.col("node") == F.col("_n"), "left")
    named = named.select("node", F.col("root").alias("group"), F.coalesce("_r", "node").alias("own"))
    unsettled = named.groupBy("group").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("group")
    members = cut(named.join(unsettled, "group", "left_semi").join(firsts, "node").select("group", "node", "own", "fp"))
    if members.isEmpty():
        return own
    return components(cut(good.unionByName(within(members, docs, width, similar))))


def similar_groups(docs: DataFrame, width: int = 5, similar: float = 0.8, most_sent: int = SENT) -> DataFrame:
    """doc_id, key (a hash of the text), component_id of each row of docs: the smallest doc_id of its group of near copies (nulls don't count; null if it has only such).

    docs: doc_id, text; other columns are ignored. Rows repeated in docs are repeated in the result; empty docs give an
    empty result. Texts without words, null ones too, make up one group. Texts of any length are compared whole.
    """
    own = cut(fingerprints(docs, width))
    firsts = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("key").alias("node")))
    roots = linked(firsts.select("node", "fp"), docs, width, similar, most_sent)
    grouped = firsts.join(roots, "node", "left").select("fp", "first", F.coalesce("root", "node").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "key", "component_id")


def keep_one(docs: DataFrame, width: int = 5, similar: float = 0.8, most_sent: int = SENT) -> DataFrame:
    """The rows of docs but those that another document of their group stands for; of repeated rows one stays.

    The document of the group's smallest doc_id stays; of its repeated rows the one that common.one_of_each() takes. Rows with a null doc_id stay, too, and rows of one doc_id with
    different texts are documents of their own. Other columns are kept whatever their names. Empty docs: empty result.

    The documents to drop are looked up, not those to keep: they are few where copies are few.
    """
    groups = cut(similar_groups(docs, width, similar, most_sent))
    key = [F.col("doc_id").alias("d"), F.col("key").alias("k")]
    drop = cut(groups.where("doc_id <> component_id").select(*key).distinct())
    own = packed(docs, "doc_id", "text")
    same = (F.col("doc_id") == F.col("d")) & (F.xxhash64("text") == F.col("k"))
    kept = own.join(drop, same, "left_anti")
    repeated = cut(groups.where("doc_id = component_id").groupBy(*key).count().where("count > 1").select("d", "k"))
    discard(groups)
    if not repeated.isEmpty():
        once = one_of_each(kept.join(repeated, same), ["d", "k"]).select(*kept.columns)
        kept = kept.join(repeated, same, "left_anti").unionByName(once)
    return kept.select(*unpacked(kept, docs, "doc_id", "text"))
