"""Mixing sources to target weights, the budgets met by subset sums.

Each source gets a target share of all words; no target is above ``MOST`` times its source's words, and what a capped
source can't take is shared among the others by weight (water filling, solved in closed form over the sources).

Within a source with S words and target T, every document is taken floor(T / S) times. The remaining budget R < S is
fitted by document counts for each exact length: a like share of every length is taken first, rounded down, and a
bounded-knapsack dynamic program over the counts that are left finds the reachable sum closest below what remains. Which
documents of a length are taken is decided by a seeded hash of doc_id, then doc_id and a hash of the text, so that reruns
agree.

Only lengths and counts meet in one task: a source's histogram has a row for each distinct length, however many
documents it has. The documents of a length are ranked in slices of a hash range, so that no length gathers in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, one_of_each, packed, ships_by_value, unpacked

ships_by_value(__name__)

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 17
#: Documents of one source and length in a slice, about.
SLICE = 256
#: Words up to which a remaining budget is always left to the exact program.
EXACT = 100_000


def sizes(docs: DataFrame) -> DataFrame:
    """Adds size: words of the text, 0 for a null one."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def targets(by_source: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size (long) to source, source_size, target (double).

    A source is capped if most * size / weight is at most the level that fills the rest; in the order of that ratio the
    level is (total - caps before) / weights from here on, and the capped sources come first.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ratio = (most * F.col("source_size") / F.col("_w")).alias("r")
    up = W.orderBy(ratio, F.col("source").asc_nulls_last())
    every = W.partitionBy(F.lit(1))
    out = ranked.withColumns({
        "_before": F.coalesce(F.sum(most * F.col("source_size")).over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_rest": F.sum("_w").over(up.rowsBetween(0, W.unboundedFollowing)),
        "_total": F.sum("source_size").over(every),
        "_ratio": ratio,
    }).withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_rest"))
    # the level of the first source that is not capped; all after it have higher ratios
    out = out.withColumn("_free", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_level"))).over(every)["_level"])
    target = F.when(F.col("_free").isNull() | (F.col("_ratio") <= F.col("_free")), (most * F.col("source_size")).cast("double")).otherwise(F.col("_free") * F.col("_w"))
    return out.select("source", "source_size", target.alias("target"))


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that the sum comes as close to the budget from below as it can after the like shares.

    Bounded knapsack: after like shares and a greedy pass from long to short, twice the longest length or EXACT words
    remain at most; a bit set of reachable sums (a count in binary parts) is walked back to the counts. Of n parts, about
    2 * sqrt(n) bit sets are held at a time.
    """
    if budget <= 0 or not lengths:
        return [0] * len(lengths)
    total = sum(a * b for a, b in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    took = [c * budget // total for c in counts]
    rest = budget - sum(a * b for a, b in zip(lengths, took))
    exact = max(2 * max(lengths), EXACT)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        if rest <= exact:
            break
        more = min(counts[k] - took[k], (rest - exact // 2) // lengths[k])
        if more > 0:
            took[k] += more
            rest -= more * lengths[k]
    # one part for each power of two of what is left of a length, no more than can matter
    parts: list[tuple[int, int, int]] = []
    for k, (a, c) in enumerate(zip(lengths, counts)):
        left, n = min(c - took[k], rest // a), 1
        while left > 0:
            n = min(n, left)
            parts.append((k, n, n * a))
            left -= n
            n *= 2
    # the sums that the first parts reach, kept at every so many parts; those in between are worked out again on the way back
    mask, reach, block = (1 << (rest + 1)) - 1, 1, max(1, math.isqrt(len(parts)))
    kept = [reach]
    for done, (_, _, a) in enumerate(parts, 1):
        reach |= (reach << a) & mask
        if done % block == 0:
            kept.append(reach)
        if reach >> rest & 1:
            parts = parts[:done]
            break
    at = reach.bit_length() - 1
    for start in range((len(parts) - 1) // block * block, -1, -block):
        some, reach, first = parts[start : start + block], kept[start // block], []
        for _, _, a in some:
            new = (reach | reach << a) & mask
            first.append(new & ~reach)
            reach = new
        for (k, n, a), reached in zip(reversed(some), reversed(first)):
            if reached >> at & 1:  # the sum was first reached with this part
                took[k] += n
                at -= a
    return took


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, key, source, size, source_size, target, times (how often it is taken) of each row of docs (doc_id, source, text).

    key is a hash of the text, by which rows of one doc_id are told apart. Null text: size 0, taken floor(target / size of source) times like any other.
    Null source: a source of its own, the last. Repeated rows are documents of their own; which of them is taken is then
    arbitrary, but they can't be told apart. Empty docs: empty result.
    """
    own = cut(sizes(docs.select("doc_id", F.xxhash64("text").alias("key"), "source", "text")).drop("text"))
    counted = own.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counted = cut(counted)
    by_source = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    aims = cut(targets(by_source, weights, most))

    def plan(key, rows):
        rows = rows.sort_values("size")
        total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        times = int(target // total) if total else 0
        budget = round(target - times * total)
        use = rows["size"] > 0
        took = dict(zip(rows["size"][use].tolist(), fit(rows["size"][use].tolist(), rows["n"][use].tolist(), budget)))
        return rows.assign(times=times, more=[took.get(x, 0) for x in rows["size"].tolist()])[["source", "size", "n", "source_size", "target", "times", "more"]]

    same = F.col("x.source").eqNullSafe(F.col("y.source"))
    ready = counted.alias("x").join(aims.alias("y"), same).select("x.source", "size", "n", "source_size", "target")
    plans = cut(ready.groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, times long, more long"))
    both = own.alias("d").join(plans.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("d.doc_id")), 11)
    parts = F.ceil(F.col("p.n") / SLICE)
    # slices of the hash range, in order: a document's rank is the count of the slices before and its rank within its own
    part = F.floor((chance / float(1 << 53)) * parts).cast("long")
    cols = [F.col(f"d.`{c}`").alias(c) for c in own.columns]
    partial = both.where("p.more > 0 and p.more < p.n").select(*cols, F.col("p.source_size"), F.col("p.target"), F.col("p.times"), F.col("p.more").alias("_more"), chance.alias("_h"), part.alias("_part"))
    simple = both.where("p.more = 0 or p.more = p.n").select(*cols, F.col("p.source_size"), F.col("p.target"), (F.col("p.times") + (F.col("p.more") > 0).cast("long")).alias("times"))
    group = ["source", "size", "_part"]
    slices = partial.groupBy(*group).agg(F.count(F.lit(1)).alias("_k"))
    before = slices.withColumn("_before", F.coalesce(F.sum("_k").over(W.partitionBy("source", "size").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_k")
    cond = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")) & (F.col("a._part") == F.col("b._part"))
    ranked = partial.alias("a").join(before.alias("b"), cond).select("a.*", "b._before")
    rank = F.col("_before") + F.row_number().over(W.partitionBy(*group).orderBy("_h", "doc_id", "key"))
    picked = ranked.withColumn("times", F.col("times") + (rank <= F.col("_more")).cast("long"))
    return simple.unionByName(picked.select(*simple.columns))


def taken(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as the mix takes them: each as often as mix() says, the others left out.

    All columns stay, whatever their names. Of rows with the same doc_id, text and source the one that common.one_of_each()
    takes stands for all, as often as they are taken together. Null doc_ids, texts and sources are like any other; empty
    docs: empty result.
    """
    plan = mix(docs, **options).groupBy("doc_id", "key", "source").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows"))
    plan = plan.where("times > 0").select(F.struct("doc_id", "key", "source").alias("_s"), "doc_id", "key", "source", "times", "rows")
    plan = cut(plan.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("source").alias("s"), F.xxhash64(F.to_json("_s", {"ignoreNullFields": "false"})).alias("i"), "times", "rows"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("k")) & F.col("source").eqNullSafe(F.col("s"))
    both = packed(docs, "doc_id", "text", "source").join(plan, same)
    if not plan.where("rows > 1").isEmpty():
        both = both.where("rows = 1").unionByName(one_of_each(both.where("rows > 1"), ["i", "k"]))
    return both.withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*unpacked(both, docs, "doc_id", "text", "source"))
