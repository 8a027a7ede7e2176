"""Conversation repair: the cheapest edits that give a conversation its form, as shortest paths with small integer costs.

The form is an optional system turn, then user and assistant by turns, or nothing. A node is (rows done, state); the states are
start, after system, after user and after assistant, the first and the last of which may end. Keep costs 0, reroling 2,
deleting 3, inserting 2, a truncated row that stays 1 more. Since the costs are small integers, distances to the end are settled
by Dial's buckets, one for each distance, without a heap. A walk from the start along tight arcs (those on a shortest path) that
always takes the least letter then gives the least audit, since letter and state fix the next node.

No conversation has to fit into a task. Its rows, as one letter each with keys of their texts, are sorted by range and packed
into slices of SLICE rows. A slice alone is solved at once. For a conversation of several, each slice gives the distances from
its first states to its last ones, a matrix of 16 numbers; the products from the end give the distances behind each slice, a
walk from each of the four states gives where it leads, and following these gives the state in which each slice is entered.
Texts are not moved for any of that; they are joined to the edits at the end.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, discard, ships_by_value

ships_by_value(__name__)

SPACES = " \t\n\x0b\x0c\r"
#: Rows of a conversation that are solved together.
SLICE = 10_000
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: States: 0 start, 1 after system, 2 after user, 3 after assistant; what a new or reroled turn has to be, and leads to.
DUE = (2, 2, 3, 2)
ENDS = (0, 3)
NAMES = {2: "user", 3: "assistant"}
FAR = 1 << 60
#: A row's letter: initial s, u, a or other (o), small, a capital if it is truncated, a digit (its place in KINDS) if it must go.
KINDS = "suao"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with stated damage, chosen by CRC-32 of conv_id, a colon and turn, modulo 20.

    0 drops the row, 1 empties its text, 2 removes its full stops and the like, 3 repeats it, 4 makes its role user. Nulls
    count as one space in the checksum, the role and the text.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    own = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_")).drop("_")


def keyed(rows: DataFrame) -> DataFrame:
    """rows with h, g: two 64-bit hashes of role and text, by which a row's content is told from others."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumns({"h": F.xxhash64("role", "text"), "g": F.xxhash64(F.lit(1), "text", "role")})


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, h, g, kind, blank, truncated, first, n of each distinct row of a conversation.

    n: how many there are; first: whether no row of an earlier turn has the same role and text.
    """
    trimmed = F.rtrim("text", F.lit(SPACES))
    end = F.substring(trimmed, -1, 1)
    kind = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    slim = rows.select("conv_id", "turn", "h", "g", kind.alias("kind"), (trimmed == "").alias("blank"), (~end.isin(".", "!", "?")).alias("truncated"))
    each = cut(slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("n")), tidy=False)
    content = ["conv_id", "h", "g"]
    again = each.groupBy(*content).agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("turn")).alias("low")).where("k > 1")
    again = again.select(*[F.col(c).alias(f"_{c}") for c in content], F.col("low.turn").alias("low"), F.lit(True).alias("met"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))
    return each.join(again, same, "left").select(*each.columns, (F.col("met").isNull() | F.col("turn").eqNullSafe(F.col("low"))).alias("first"))


def sliced(found: DataFrame, size: int = SLICE) -> DataFrame:
    """conv_id, part, block, letters, turns, hs, gs: the rows of faults() in order, so many of one conversation together.

    Rows are sorted by conversation, turn (nulls first) and hash by range, so a conversation may go on in the next part.
    """
    order = ["conv_id", "turn", "h", "g"]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        names = ["conv_id", "part", "block", "letters", "turns", "hs", "gs"]
        now, block, rows, done, held = (), 0, [], [], 0

        def close():
            letters, turns, hs, gs = zip(*rows)
            done.append((now[0], part, block, "".join(letters), turns, hs, gs))

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), kinds)], names=names)

        for batch in batches:
            for conv, turn, h, g, kind, blank, truncated, first, n in zip(*[c.to_pylist() for c in batch.columns]):
                if (conv,) != now:
                    if rows:
                        close()
                    now, block, rows = (conv,), 0, []
                for k in range(n):
                    letter = str(kind) if blank or not first or k else KINDS[kind].upper() if truncated else KINDS[kind]
                    rows.append((letter, turn, h, g))
                    held += 1
                    if len(rows) == size:
                        close()
                        block, rows = block + 1, []
                    if held > 50_000 and done:
                        yield out()
                        done, held = [], len(rows)
        if rows:
            close()
        if done:
            yield out()

    slim = found.select(*[F.col(c).cast("long") for c in order], "kind", "blank", "truncated", "first", "n")
    made = slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "conv_id long, part int, block int, letters string, turns array<long>, hs array<long>, gs array<long>")
    return cut(made, tidy=False)


def arcs(letter: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of what may be done with a row in a state, in the order of the edits' letters."""
    out = [("D", DELETE, state)]
    if letter.isdigit():
        return out
    late = CUT_OFF if letter.isupper() else 0
    kind = letter.lower()
    if kind == "s" and state == 0 or kind == "u" and DUE[state] == 2 or kind == "a" and DUE[state] == 3:
        out.append(("K", KEEP + late, "sua".index(kind) + 1))
    out.append(("R", REROLE + late, DUE[state]))
    return out


#: What may be done, by letter and state; and the arcs that lead to a state.
ARCS = {x: [arcs(x, q) for q in range(4)] for x in "suaoSUAO0123"}
INTO = {x: [[(p, cost) for p in range(4) for _, cost, to in every[p] if to == q] for q in range(4)] for x, every in ARCS.items()}
INSERTED = [[p for p in range(4) if DUE[p] == q] for q in range(4)]


def distances(letters: str, ends, last: bool) -> list[int]:
    """The least cost from each node, 4 * row + state, to the ends: what it costs from each state behind the rows.

    Behind the rows new turns may be inserted only if nothing follows (last); else the next slice does that.
    """
    n = len(letters)
    dist = [FAR] * (4 * n + 4)
    low = min(ends)
    buckets: list[list[int]] = []

    def put(node: int, d: int) -> None:
        dist[node] = d
        while len(buckets) <= d - low:
            buckets.append([])
        buckets[d - low].append(node)

    for q, d in enumerate(ends):
        if d < FAR:
            put(4 * n + q, d)
    at = 0
    while at < len(buckets):
        d = low + at
        for node in buckets[at]:  # an arc of cost 0 puts more into the very bucket that is gone through
            if dist[node] != d:
                continue
            row, q = divmod(node, 4)
            if row < n or last:
                for p in INSERTED[q]:
                    if dist[4 * row + p] > d + INSERT:
                        put(4 * row + p, d + INSERT)
            if row:
                for p, cost in INTO[letters[row - 1]][q]:
                    if dist[node - q - 4 + p] > d + cost:
                        put(node - q - 4 + p, d + cost)
        buckets[at] = []
        at += 1
    return dist


def walk(letters: str, state: int, dist: list[int], last: bool) -> tuple[str, int, list[tuple[int, str, int]]]:
    """(the least audit, the state behind the rows, the turns that stay or are new: row or -1, edit, state after) from a state on."""
    n, row, audit, left = len(letters), 0, [], []
    while True:
        here = dist[4 * row + state]
        if row == n and not (last and here):
            return "".join(audit), state, left
        options = ARCS[letters[row]][state] if row < n else ()
        best = None
        for edit, cost, to in options:
            if dist[4 * row + 4 + to] + cost == here:
                best = (edit, row + 1, to)
                break
        if (best is None or best[0] > "I") and dist[4 * row + DUE[state]] + INSERT == here:
            best = ("I", row, DUE[state])
        edit, after, to = best
        audit.append(edit)
        if edit != "D":
            left.append((row if edit != "I" else -1, edit, to))
        row, state = after, to


GOAL = [0 if q in ENDS else FAR for q in range(4)]


def _entered(slices: DataFrame) -> DataFrame:
    """conv_id, part, block, ends (distances behind the slice), state (in which it is entered) of conversations of several slices."""
    last = F.col("number") == F.col("size")

    def matrix(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for letters, end in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                if end:
                    out.append(distances(letters, GOAL, True)[:4])
                else:  # of each state behind the rows in turn
                    each = [distances(letters, [0 if p == q else FAR for p in range(4)], False)[:4] for q in range(4)]
                    out.append([each[q][p] for p in range(4) for q in range(4)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "part", "block", "number", "m"])

    def behind(key, rows):
        import pandas as pd

        rows = rows.sort_values("number")
        out, after = [], GOAL
        for conv, part, block, m in reversed(list(zip(rows["conv_id"], rows["part"], rows["block"], rows["m"]))):
            out.append((conv, part, block, after))
            after = list(m) if len(m) == 4 else [min(FAR, *(m[4 * p + q] + after[q] for q in range(4))) for p in range(4)]
        made = pd.DataFrame(out, columns=["conv_id", "part", "block", "ends"])
        return made.astype({"conv_id": "Int64"})

    def exits(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for letters, ends in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                dist = distances(letters, ends, False)
                out.append([walk(letters, p, dist, False)[1] if dist[p] < FAR else p for p in range(4)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(5), pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "part", "block", "number", "ends", "to"])

    def follow(key, rows):
        import pandas as pd

        rows = rows.sort_values("number")
        out, state = [], 0
        for conv, part, block, to in zip(rows["conv_id"], rows["part"], rows["block"], rows["to"]):
            out.append((conv, part, block, state))
            state = int(to[state])
        return pd.DataFrame(out, columns=["conv_id", "part", "block", "state"]).astype({"conv_id": "Int64"})

    where = "conv_id long, part int, block int"
    numbers = cut(slices.select("conv_id", "part", "block", "number", "letters", last.alias("end")).mapInArrow(matrix, f"{where}, number int, m array<long>"), tidy=False)
    ends = cut(numbers.groupBy("conv_id").applyInPandas(behind, f"{where}, ends array<long>"), tidy=False)
    named = lambda df: [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("conv_id", "part", "block")]
    both = slices.alias("x").join(ends.alias("y"), named(ends)).select("x.conv_id", "x.part", "x.block", "number", "letters", "ends")
    steps = cut(both.mapInArrow(exits, f"{where}, number int, ends array<long>, to array<long>"), tidy=False)
    states = steps.groupBy("conv_id").applyInPandas(follow, f"{where}, state int")
    return steps.alias("x").join(states.alias("y"), named(states)).select("x.conv_id", "x.part", "x.block", "ends", "state")


def solved(found: DataFrame, size: int = SLICE) -> DataFrame:
    """conv_id, number (of the slice, from 1), size (how many), letters, audit, cost (of the first slice: of the whole), edits (what stays or is new: place, turn, h, g, edit, role)."""
    parts = sliced(found, size)
    own = W.partitionBy("conv_id")
    numbered = parts.withColumn("number", F.row_number().over(own.orderBy("part", "block"))).withColumn("size", F.count(F.lit(1)).over(own))
    columns = ["conv_id", "number", "size", "letters", "turns", "hs", "gs", "ends", "state"]
    numbered = cut(numbered.withColumn("size", F.col("size").cast("int")), tidy=False)
    goal = F.array(*[F.lit(x).cast("long") for x in GOAL])
    ready = numbered.where("size = 1").withColumns({"ends": goal, "state": F.lit(0)}).select(*columns)
    several = numbered.where("size > 1")
    if not several.isEmpty():
        at = cut(_entered(several), tidy=False)
        same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("conv_id", "part", "block")]
        ready = ready.unionByName(several.alias("x").join(at.alias("y"), same).select(*[f"x.{c}" for c in columns[:7]], "ends", "state"))

    def run(batches):
        import pyarrow as pa

        edit = pa.struct([("place", pa.int64()), ("turn", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("edit", pa.string()), ("role", pa.string())])
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                part = whole.slice(k, 64)
                audits, costs, edits = [], [], []
                for number, size, letters, turns, hs, gs, ends, state in zip(*[c.to_pylist() for c in part.columns[1:]]):
                    last = number == size
                    dist = distances(letters, ends, last)
                    audit, _, left = walk(letters, state, dist, last)
                    audits.append(audit)
                    costs.append(dist[state])
                    edits.append([{"place": (number << 32) + i, "turn": turns[r] if r >= 0 else None, "h": hs[r] if r >= 0 else None, "g": gs[r] if r >= 0 else None, "edit": e, "role": NAMES[q] if e != "K" else None} for i, (r, e, q) in enumerate(left)])
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(audits, pa.string()), pa.array(costs, pa.int64()), pa.array(edits, pa.list_(edit))], names=["conv_id", "number", "size", "letters", "audit", "cost", "edits"])

    out = "conv_id long, number int, size int, letters string, audit string, cost long, edits array<struct<place:long,turn:long,h:long,g:long,edit:string,role:string>>"
    made = cut(ready.mapInArrow(run, out), tidy=False)
    discard(parts, numbered)
    return made


def repaired(rows: DataFrame, solution: DataFrame) -> DataFrame:
    """conv_id, place (its order), turn, role, text, edit of the turns after repair; new ones have no turn and an empty text.

    rows: those of keyed(); solution: that of solved().
    """
    edits = solution.select("conv_id", F.explode("edits").alias("e")).select("conv_id", "e.*")
    texts = rows.groupBy("conv_id", "turn", "h", "g").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    same = F.col("e.conv_id").eqNullSafe(F.col("t.conv_id")) & F.col("e.turn").eqNullSafe(F.col("t.turn")) & (F.col("e.h") == F.col("t.h")) & (F.col("e.g") == F.col("t.g"))
    kept = edits.where("edit <> 'I'").alias("e").join(texts.alias("t"), same).select("e.conv_id", "e.place", "e.turn", F.coalesce("e.role", "t.role").alias("role"), "t.text", "e.edit")
    return kept.unionByName(edits.where("edit = 'I'").select("conv_id", "place", "turn", "role", F.lit("").alias("text"), "edit"))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of the lines role:text of each conversation, in order, joined by line ends.

    One hash has to read a conversation from its first turn to its last; it is fed row by row, none is held.
    """

    def run(batches):
        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done], pa.string())], names=["conv_id", "repaired_sha256"])

        now, hash, done = (), None, []
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for conv, role, text in zip(*[c.to_pylist() for c in part.columns]):
                    if (conv,) == now:
                        hash.update(b"\n")
                    else:
                        if now:
                            done.append((now[0], hash.hexdigest()))
                        now, hash = (conv,), hashlib.sha256()
                    hash.update(f"{role}:{text}".encode())
            if len(done) > 10_000:
                yield out()
                done = []
        if now:
            done.append((now[0], hash.hexdigest()))
        yield out()

    ordered = turns.select("conv_id", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def report(rows: DataFrame, every: DataFrame | None = None, size: int = SLICE) -> DataFrame:
    """A row for each conversation: gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.

    rows: conv_id, turn, role, text; other columns are ignored. every: conv_ids that get a row even if they have none in
    rows (zeros, an empty audit, the hash of nothing). Rows go by turn, nulls first; rows of one turn by hashes of role and
    text, since their order is not stated. Null roles and texts are one space; a null conv_id is a conversation of its own.
    A row's first fault counts: blank, duplicate (role and text of an earlier row), truncated. Empty rows: empty result, but
    for every.
    """
    texts = keyed(rows)
    found = cut(faults(texts), tidy=False)
    solution = solved(found, size)
    lost = F.when(F.col("first"), F.col("n") - 1).otherwise(F.col("n"))
    turns = found.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(lost)).alias("duplicate"),
        F.sum(F.when(F.col("blank") | ~F.col("truncated"), 0).otherwise(F.col("first").cast("long"))).alias("truncated"),
    )
    counts = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    # initials of neighbours: of a letter and the next, over the slices' ends too
    kinds = F.translate("letters", "SUAO0123", "suaosuao")
    inner = F.length("letters") - 1 - F.regexp_count(kinds, F.lit("(?=su|ua|au)"))
    joint = F.concat(F.lag(F.substring(kinds, -1, 1)).over(W.partitionBy("conv_id").orderBy("number")), F.substring(kinds, 1, 1))
    seams = solution.select("conv_id", "number", "cost", "audit", (inner + F.coalesce((~joint.isin("su", "ua", "au")).cast("int"), F.lit(0))).alias("illegal"))
    audits = seams.groupBy("conv_id").agg(
        F.sum("illegal").cast("long").alias("illegal"),
        F.max(F.when(F.col("number") == 1, F.col("cost"))).alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    ids = (every if every is not None else rows).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    hashes = digests(repaired(texts, solution))
    out = ids.alias("i")
    for k, df in enumerate((counts, audits, hashes)):
        out = out.join(df.withColumnRenamed("conv_id", f"_{k}"), F.col("i.conv_id").eqNullSafe(F.col(f"_{k}")), "left").drop(f"_{k}")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("i.conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
