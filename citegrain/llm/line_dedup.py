"""Fuzzy line deduplication by MinHash: one line of each group of near-equal lines stays in the whole corpus.

1. Each line of a text (split at \\n) is normalised: A-Z etc. lower-cased, white space single. Blank lines are left alone,
   and lines under ``least`` code points (1: none). Equal normalised lines are counted once, by partial sums.
2. A distinct line has a MinHash signature over its 7-character shingles (a shorter line is its own only shingle): BANDS
   bands of ROWS values. Lines that share a band become candidates: at Jaccard 0.8 with probability 0.997, at 0.85 with
   0.9998, at 0.1 with 1.5e-4, so that chance candidates among unlike lines stay few as the corpus grows.
3. Candidates are compared in cells of bounded size, by lines and by characters, by the exact Jaccard similarity of their
   shingle sets, at least SIMILAR; a cell hands out a spanning forest of the links it has verified.
4. Connected components of the links; the least (doc_id, text hash, line number) of a component stays, its other lines go.

Three tables are looked up: bands that several lines share, candidates (to fetch their texts) and lines to drop. Up to
MOST_SENT rows each goes to the executors with the job, beyond it through a shuffle; both ways give the same result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_array, by_cell, cells, components, cut, discard, packed, ships_by_value, unpacked

ships_by_value(__name__)

SHINGLE, SIMILAR = 7, 0.8
BANDS, ROWS = 15, 5
#: Lines in a part of a cell, and characters of them.
CELL, CELL_CHARS = 256, 2_000_000
MOST_SENT = 400_000
#: Shared bands that are sent along.
MOST_BANDS = 1_000_000
#: Bands that a task sorts at once.
BLOCK = 2_000_000
#: Texts that are held in one piece by a task.
SOME = 256


def normal(line: str) -> str:
    return " ".join(line.lower().split())


#: White space but spaces and line ends (and the soft hyphen): what str.split cuts at.
_OTHER_BLANKS = ("\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\xad", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")


def tidy(text: str, coded: bytes | None = None) -> bool:
    """Whether the white space of all lines is single spaces within them, so that lower case is all that their normal form takes.

    coded: the text or its lower case in UTF-8, if it is at hand.
    """
    import numpy as np

    code = np.frombuffer(text.encode("utf-8", "surrogatepass") if coded is None else coded, np.uint8)
    space = code == 32
    edge = space | (code == 10)
    if text[:1] == " " or text[-1:] == " " or (space[1:] & edge[:-1]).any() or (space[:-1] & edge[1:]).any():
        return False
    for c in _OTHER_BLANKS[:8] if text.isascii() else _OTHER_BLANKS:
        if c in text:
            return False
    return True


def line_table(texts: list[str], least: int = 1, known=None):
    """The lines of some texts that take part: place in texts, line number, two 64-bit hashes (arrays), normalised forms.

    Of lines whose first hash is not in ``known`` (a sorted array; None: all), nothing more is worked out, and they are left out.
    """
    import numpy as np
    import xxhash

    counts, lines, own, raw = [], [], [], []
    shortest = max(1, least)
    for text in texts:
        low = text.lower()
        whole = low.encode("utf-8", "surrogatepass")
        if tidy(text, whole):
            forms, coded = low.split("\n"), whole.split(b"\n")
        else:
            forms = [normal(line) for line in text.split("\n")]
            coded = [x.encode("utf-8", "surrogatepass") for x in forms]
        if least > 1:
            places = [k for k, (line, form) in enumerate(zip(text.split("\n"), forms)) if len(line) >= least and len(form) >= shortest]
        else:
            places = [k for k, form in enumerate(forms) if form]
        if len(places) < len(forms):
            forms, coded = [forms[k] for k in places], [coded[k] for k in places]
        counts.append(len(places))
        lines += places
        own += forms
        raw += coded
    h = xxhash.xxh64_intdigest
    docs, line = np.repeat(np.arange(len(texts)), counts), np.array(lines, np.int32)
    ids = np.fromiter((h(x, 42) for x in raw), np.uint64, len(raw)).view(np.int64)
    if known is not None:
        hit = np.flatnonzero(_among(ids, known)[1])
        docs, line, ids = docs[hit], line[hit], ids[hit]
        own, raw = [own[k] for k in hit.tolist()], [raw[k] for k in hit.tolist()]
    ids2 = np.fromiter((h(x, 7) for x in raw), np.uint64, len(raw)).view(np.int64)
    return docs, line, ids, ids2, own


def doc_key(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42) >> 1


def _donors():
    """For each value of a signature, the other ones in a fixed random order."""
    import numpy as np

    rng = np.random.default_rng(20_240_229)
    n = BANDS * ROWS
    return np.array([rng.permutation([k for k in range(n) if k != own]) for own in range(n)]).T.copy()


def signatures(lines: list[str], donors=None):
    """A row of BANDS signed 64-bit keys for each line; one under SHINGLE code points is filled up with zeros.

    donors: _donors(), for a caller with many lists of lines.

    One-permutation MinHash: a shingle's hash falls into one of BANDS * ROWS ranges, and a range's value is the least hash
    in it. A range without any borrows from another one, the first that has one in a fixed random order of its own.
    """
    import numpy as np

    n, none = BANDS * ROWS, np.uint32(0xFFFFFFFF)
    donors = _donors() if donors is None else donors
    all_sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    if len(lines) and all_sizes.min() < SHINGLE:
        lines, all_sizes = [x.ljust(SHINGLE, "\0") for x in lines], np.maximum(all_sizes, SHINGLE)
    through = all_sizes.cumsum()
    out = np.empty((len(lines), BANDS), np.int64)
    at = 0
    while at < len(lines):
        end = max(at + 1, int(through.searchsorted(through[at] - all_sizes[at] + 60_000, "right")))
        code = np.frombuffer("".join(lines[at:end]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = all_sizes[at:end]
        h = np.zeros(len(code) - SHINGLE + 1, np.uint32)
        spread = code * np.uint32(0x9E3779B1)
        for k in range(SHINGLE):
            h *= np.uint32(0x01000193)
            h ^= spread[k : len(code) - SHINGLE + 1 + k]
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h ^= h >> np.uint32(shift)
            h *= np.uint32(by)
        inside = np.ones(len(code), bool)
        ends = np.cumsum(sizes)
        for k in range(1, SHINGLE):
            inside[ends - k] = False
        h = h[inside[: len(h)]]
        least = np.full((end - at) * n, none, np.uint32)
        place = np.repeat(np.arange(0, (end - at) * n, n), sizes - SHINGLE + 1)
        share = np.multiply(h, np.uint64(n), dtype=np.uint64)
        share >>= np.uint64(32)
        place += share.view(np.int64)
        np.minimum.at(least, place, h)
        empty, filled = np.flatnonzero(least == none), least.copy()
        own = empty % n
        for order in donors:
            if not len(empty):
                break
            got = least[empty - own + order[own]]
            filled[empty] = got
            left = got == none
            empty, own = empty[left], own[left]
        wide = filled.astype(np.uint64).reshape(-1, BANDS, ROWS)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (end - at, BANDS)).copy()
        for r in range(ROWS):
            key = (key ^ wide[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[at:end] = key.view(np.int64)
        at = end
    return out


def shingle_sets(lines: list[str]) -> list:
    """The distinct shingles of each line as a sorted array: seven code points packed into 63 bits, or else strings.

    Code points of 512 and more don't fit; lines that have some are numbered by the strings of this call, so that arrays
    of one call compare exactly.
    """
    import numpy as np

    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = len(code) > 0 and int(code.max()) >= 512
    if not wide and len(code) >= SHINGLE:  # all places at once; those across two lines are not looked at
        every = code.astype(np.int64)
        for k in (1, 2, 3):  # of 2, 4 and 7 code points; the last step has one of them twice
            every = every[:-k] | every[k:] << 9 * k
    out: list = []
    names: dict[str, int] = {}
    at = 0
    for line in lines:
        n = len(line)
        if wide:
            own = np.array([names.setdefault(line[k : k + SHINGLE], len(names)) for k in range(max(1, n - SHINGLE + 1))], np.int64)
        elif n < SHINGLE:  # a negative number, with its length
            own = np.array([-1 - (sum(ord(c) << 9 * k for k, c in enumerate(line)) << 3 | n)], np.int64)
        else:
            own = every[at : at + n - SHINGLE + 1].copy()
        own.sort()
        first = np.ones(len(own), bool)
        np.not_equal(own[1:], own[:-1], out=first[1:])
        out.append(own[first])
        at += n
    return out


def verified(rows: list[tuple]) -> list[tuple[int, int]]:
    """(index, index) links that connect the lines as all pairs with Jaccard SIMILAR or more would. rows: ..., id, text.

    Lines come in the order of their set sizes; each is compared with the groups so far, with a group's members from the
    largest set down until one is near or all are too small.
    """
    import numpy as np

    sets = shingle_sets([x[-1] for x in rows])
    sizes = [len(x) for x in sets]
    groups: list[list[int]] = []
    out = []
    for k in sorted(range(len(rows)), key=lambda k: (sizes[k], k)):
        own, n = sets[k], sizes[k]
        linked, rest = [k], []
        for members in groups:
            for o in reversed(members):
                m = sizes[o]
                if m < SIMILAR * n - 1e-9:
                    rest.append(members)
                    break
                merged = np.concatenate((own, sets[o]))
                merged.sort(kind="stable")  # two sorted runs: a merge
                both = int(np.count_nonzero(merged[1:] == merged[:-1]))
                if both >= SIMILAR * (n + m - both) - 1e-9:
                    out.append((k, o))
                    linked = members + linked if len(linked) == 1 else sorted(members + linked, key=lambda x: (sizes[x], x))
                    break
            else:
                rest.append(members)
        groups = [*rest, linked]
    return out


def _pieces(batches):
    """Arrow batches in pieces of SOME rows."""
    for whole in batches:
        for k in range(0, whole.num_rows, SOME):
            yield whole.slice(k, SOME)


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """A row for each line that takes part: id, id2, nil (1: no doc_id), doc_id, doc_key, line, size (characters), keys (8 bytes a band)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        donors = _donors()
        for batch in _pieces(batches):
            texts = batch.column(2).to_pylist()
            at, line, ids, ids2, own = line_table(texts, least)
            doc_keys = np.array([doc_key(t) if t else 0 for t in texts], np.int64)
            place = {form: k for k, form in enumerate(dict.fromkeys(own))}
            keys = [x.tobytes() for x in signatures(list(place), donors)]
            size = np.fromiter(map(len, own), np.int64, len(own))
            first = [pa.array(x) for x in (ids, ids2, batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at], doc_keys[at], line, size)]
            last = pa.array([keys[place[form]] for form in own], pa.binary())
            yield pa.RecordBatch.from_arrays([*first, last], names=["id", "id2", "nil", "doc_id", "doc_key", "line", "size", "keys"])

    return docs.selectExpr(*_PLACED, _TEXT).mapInArrow(run, "id long, id2 long, nil long, doc_id long, doc_key long, line int, size long, keys binary")


#: Whether there is no doc_id (1 or 0), the doc_id (0 if none), the text (empty if none).
_PLACED = ("cast(doc_id is null as long) as nil", "coalesce(cast(doc_id as long), 0L) as doc_id")
_TEXT = "coalesce(cast(text as string), '') as text"


def _found(docs: DataFrame, sent, least: int) -> DataFrame:
    """id, id2, nil, doc_id, doc_key, line, text of each line whose id is in the first column of the broadcast array (None: of all)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in _pieces(batches):
            texts = batch.column(2).to_pylist()
            at, line, ids, ids2, own = line_table(texts, least, None if sent is None else sent.value[:, 0])
            keys = {d: doc_key(texts[d]) for d in set(at.tolist())}
            key = np.fromiter((keys[d] for d in at.tolist()), np.int64, len(at))
            columns = [pa.array(x) for x in (ids, ids2, batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at], key, line)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.string())], names=["id", "id2", "nil", "doc_id", "doc_key", "line", "text"])

    return docs.selectExpr(*_PLACED, _TEXT).mapInArrow(run, "id long, id2 long, nil long, doc_id long, doc_key long, line int, text string")


def _among(ids, known):
    """The first place of each id in the sorted array ``known``, and whether it is there."""
    import numpy as np

    if not len(known):
        return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    at = np.minimum(known.searchsorted(ids), len(known) - 1)
    return at, known[at] == ids


def _send(df: DataFrame, most: int):
    """The table's rows (longs), sorted by the first column, as a broadcast array, or None if it has more than ``most`` of them."""
    rows = bounded_array(df, most)
    return None if rows is None else df.sparkSession.sparkContext.broadcast(rows[rows[:, 0].argsort(kind="stable")])


def _bands_of(column):
    """The bands of an Arrow column of keys, packed or as lists, one after the other."""
    import numpy as np
    import pyarrow as pa

    if pa.types.is_list(column.type):
        return column.flatten().to_numpy()
    return np.frombuffer(b"".join(column.to_pylist()), np.int64)


def banded(distinct: DataFrame, sent=None) -> DataFrame:
    """id, size, key: a row for each band of ``distinct`` (id, size, keys) that is in the broadcast array (None: for each band)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        if sent is not None:  # most bands are told from all known ones by their first bits
            known = np.ascontiguousarray(sent.value[:, 0])
            near = np.zeros(1 << 22, bool)
            near[known.view(np.uint64) >> np.uint64(42)] = True
        for batch in batches:
            keys = _bands_of(batch.column(2))
            at = np.arange(len(keys))
            if sent is not None:
                at = np.flatnonzero(near[keys.view(np.uint64) >> np.uint64(42)])
                at = at[_among(keys[at], known)[1]]
            row = at // BANDS
            for k in range(0, max(1, len(at)), BLOCK):
                own = row[k : k + BLOCK]
                columns = [batch.column(0).to_numpy()[own], batch.column(1).to_numpy()[own], keys[at[k : k + BLOCK]]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["id", "size", "key"])

    return distinct.select("id", "size", "keys").mapInArrow(run, "id long, size long, key long")


def shared_bands(distinct: DataFrame) -> DataFrame:
    """key: the bands that two or more rows of ``distinct`` (keys) have.

    Most bands have one line only, so they travel packed: each task sorts some BLOCK of them, marks those it has twice, and
    sends each range of hashes as one value; a range, of about as many bands, is merged by one task. A band is sent once
    for each block at the most, however many lines share it.
    """
    ranges = max(1, math.ceil(distinct.count() * BANDS / BLOCK))

    def packs(batches):
        import numpy as np
        import pyarrow as pa

        def out():
            keys = np.concatenate(held)
            keys.sort()
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            at = np.flatnonzero(first)
            twice = np.diff(at, append=len(keys)) > 1
            keys = keys[at]
            ends = keys.searchsorted(((np.arange(1, ranges, dtype=object) << 64) // ranges).astype(np.uint64)).tolist() if ranges > 1 else []
            spans = [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends], [*ends, len(keys)])) if b > a]
            columns = [pa.array([k for k, _, _ in spans], pa.int64()), pa.array([keys[a:b].tobytes() for _, a, b in spans], pa.binary()), pa.array([twice[a:b].tobytes() for _, a, b in spans], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "packed", "twice"])

        held, size = [], 0
        for batch in batches:
            own = _bands_of(batch.column(0)).view(np.uint64)
            for k in range(0, len(own), BLOCK):
                held.append(own[k : k + BLOCK])
                size += len(held[-1])
                if size >= BLOCK:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def merged(batches):
        import numpy as np
        import pyarrow as pa

        for rows in by_cell(batches, 3):
            keys = np.concatenate([np.frombuffer(x[1], np.uint64) for x in rows])
            twice = np.concatenate([np.frombuffer(x[2], bool) for x in rows])
            order = keys.argsort(kind="stable")
            keys, twice = keys[order], twice[order]
            twice[1:] |= keys[1:] == keys[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(keys[twice]).view(np.int64))], names=["key"])

    sent = distinct.select("keys").mapInArrow(packs, "part long, packed binary, twice binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(merged, "key long")


def surplus(docs: DataFrame, most_sent: int = MOST_SENT, least: int = 1) -> DataFrame:
    """id, id2, keep_nil, keep_doc, keep_key, keep_line: a row for each distinct line of which some occurrence goes, and where the one that stays is."""
    place = F.struct("nil", "doc_id", "doc_key", "line")  # orders keepers; a null doc_id comes last
    distinct = cut(_lines(docs, least).groupBy("id", "id2").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    bands = cut(shared_bands(distinct))
    few = _send(bands, MOST_BANDS if most_sent else 0)
    shared = cut(banded(distinct).join(bands, "key") if few is None else banded(distinct, few))
    wanted_ids = shared.select("id").distinct()
    sent = _send(wanted_ids, most_sent)
    texts = _found(docs, sent, least).select("id", "id2", "text")
    if sent is None:
        texts = texts.join(wanted_ids, "id", "left_semi")
    texts = texts.groupBy("id", "id2").agg(F.first("text").alias("text"))
    dealt = cells(shared, ["key"], "id", CELL, "size", CELL_CHARS).select("cell", "id").join(texts, "id").select("cell", "id", "id2", "text")

    def run(batches):
        import pyarrow as pa

        out: list[list[int]] = [[], [], [], []]
        for rows in by_cell(batches, 4):
            rows = list({x[1:]: None for x in rows})
            for k, o in verified(rows):
                for column, value in zip(out, (rows[k][0], rows[k][1], rows[o][0], rows[o][1])):
                    column.append(value)
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "a2", "b", "b2"])
                out = [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "a2", "b", "b2"])

    found = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, a2 long, b long, b2 long")
    found = found.select(F.struct(F.col("a").alias("id"), F.col("a2").alias("id2")).alias("a"), F.struct(F.col("b").alias("id"), F.col("b2").alias("id2")).alias("b"))
    roots = components(found).select("node.id", "node.id2", "root")
    named = distinct.select("id", "id2", "at", "n").join(roots, ["id", "id2"], "left").where("n > 1 or root is not null")
    named = named.withColumn("root", F.coalesce("root", F.struct("id", "id2")))
    first = named.groupBy("root").agg(F.min("at").alias("keep"))
    keep = [F.col(f"keep.{a}").cast("long").alias(f"keep_{b}") for a, b in (("nil", "nil"), ("doc_id", "doc"), ("doc_key", "key"), ("line", "line"))]
    out = cut(named.join(first, "root").select("id", "id2", *keep))
    discard(distinct, bands, shared)
    return out


def drop_lines(docs: DataFrame, most_sent: int = MOST_SENT, least: int = 1) -> DataFrame:
    """docs with the text of the lines that stay, n_lines and n_removed (long; lines before, and how many went).

    Every row of docs stays, in any case, with its other columns whatever their names (one named n_lines or n_removed is
    replaced). Null text: stays null, no lines. Null doc_id: the last to keep a line. Rows that repeat both doc_id and
    text count as one document and are cut alike. A text of which all lines go becomes empty. Empty docs: empty result.
    Texts and lines may be of any length.
    """
    docs = docs.drop("n_lines", "n_removed")
    gone = surplus(docs, most_sent, least)
    sent = _send(gone, most_sent)
    own = packed(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    new = {"text": F.col("text")}
    if sent is None:
        # places to drop, by document
        at = _found(docs, None, least).drop("text").join(gone, ["id", "id2"])
        at = at.where("not (keep_nil = nil and keep_doc = doc_id and keep_key = doc_key and keep_line = line)")
        places = at.groupBy("nil", "doc_id", "doc_key").agg(F.sort_array(F.collect_set("line")).alias("drop"))
        key = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1)
        here = own.withColumns({"key": key, "nil": F.col("doc_id").isNull().cast("long"), "d": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))}).alias("o")
        both = here.join(places.alias("p"), F.expr("o.key = p.doc_key and o.nil = p.nil and o.d = p.doc_id"), "left").select("o.doc_id", "o.text", "o._row", "p.drop")
        lines = F.split("text", "\n", -1)
        left = F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains(F.col("drop"), i), F.lit(False)))
        counts = {"n_lines": F.coalesce(F.when(F.length("text") > 0, F.size(lines)), F.lit(0)).cast("long"), "n_removed": F.greatest(F.coalesce(F.size("drop"), F.lit(0)), F.lit(0)).cast("long")}
        made = both.withColumns(counts).withColumn("text", F.when(F.col("n_removed") > 0, F.array_join(left, "\n")).otherwise(F.col("text")))
        return made.select(*unpacked(made, docs, "doc_id", "text", **new), "n_lines", "n_removed")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        gone = sent.value
        known = np.ascontiguousarray(gone[:, 0])
        for batch in _pieces(batches):
            texts, nil, ids = batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            at, line, id1, id2, _ = line_table([t or "" for t in texts], least, known)
            first, _ = _among(id1, known)
            drop: dict[int, set[int]] = {}
            keys: dict[int, int] = {}
            for k in range(len(at)):
                d, n = int(at[k]), int(line[k])
                for row in range(int(first[k]), len(known)):
                    if known[row] != id1[k]:
                        break
                    if gone[row, 1] == id2[k]:
                        if d not in keys:
                            keys[d] = doc_key(texts[d])
                        if tuple(gone[row, 2:].tolist()) != (nil[d], ids[d], keys[d], n):
                            drop.setdefault(d, set()).add(n)
            left = ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[d]) if d in drop else t for d, t in enumerate(texts)]
            n_lines = [t.count("\n") + 1 if t else 0 for t in texts]
            n_removed = [len(drop.get(d, ())) for d in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string()), batch.column(2), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=["doc_id", "text", "_row", "n_lines", "n_removed"])

    made = own.withColumns({"nil": F.col("doc_id").isNull().cast("long"), "d": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))})
    made = made.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))
    return made.select(*unpacked(made, docs, "doc_id", "text", **new), "n_lines", "n_removed")
