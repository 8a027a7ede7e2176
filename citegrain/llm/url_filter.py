"""URL filter: rules first, then a character language-model ratio.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's; the longest rule
wins. Urls that no rule judges are scored by two variable-order Markov models over the bytes behind ``://``, lower-cased:
one of the urls that rules allow, one of those they block. A model has the counts of contexts of 0 to ORDER bytes and is
smoothed from order to order (Witten-Bell): a context that was seen with few successors leans on the shorter one. All
counted grams are kept, in tables: windows of ORDER + 1 bytes are counted, shorter grams are sums over these, and the
totals and kinds of a context are those of all its grams. Each distinct window of the urls that are to be scored has its
log ratio worked out once. The most frequent windows, HEAD at most, are sent to the executors; the others are joined.

The score is the difference of both log-likelihoods over the number of bytes. A fifth of the ruled hosts, by hash, is held
out of the models and calibrates the threshold: the one with the least mean error of both classes there. The same models
judge. If either class has no urls to count, all others are allowed. Urls of any length are scored whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, packed, ships_by_value, unpacked
from .token_counts import _least

ships_by_value(__name__)

ORDER = 4
#: Windows whose log ratios are sent to the executors; the others are joined, with the same result.
HEAD = 200_000
#: Log ratios are summed as whole multiples of 1/UNIT, so that the order of a sum does not matter.
UNIT = 1 << 36
#: Classes of urls that windows are counted by: allowed and blocked by a rule, the same on held-out hosts, judged by none.
CLASSES = ("allow", "block", "held_allow", "held_block", "open")
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Scores are rounded to 1/BINS for the calibration and cut off at -LIMIT and LIMIT.
BINS, LIMIT = 50, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def grams_of(url: str | None) -> list[bytes]:
    """The bytes that the models see, with ORDER zero bytes in front and one at the end."""
    return b"\0" * ORDER + (url or "").partition("://")[2].lower().encode() + b"\0"


def windows(urls: DataFrame) -> DataFrame:
    """gram (binary, ORDER + 1 bytes) and how often it occurs in the urls of each of CLASSES (long); urls: url, kind (index of the class)."""

    def run(batches):
        import pyarrow as pa

        seen = tuple({} for _ in CLASSES)

        def out():
            every = list(set().union(*seen))
            return pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), *[pa.array([x.get(g, 0) for g in every], pa.int64()) for x in seen]], names=["gram", *CLASSES])

        for batch in batches:
            for url, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, raw = seen[kind], grams_of(url)
                for at in range(len(raw) - ORDER):
                    g = raw[at : at + ORDER + 1]
                    own[g] = own.get(g, 0) + 1
            if sum(map(len, seen)) > 400_000:
                yield out()
                seen = tuple({} for _ in CLASSES)
        yield out()

    found = urls.select(F.col("url").cast("string"), "kind").mapInArrow(run, "gram binary, " + ", ".join(f"{c} long" for c in CLASSES))
    return found.groupBy("gram").agg(*[F.sum(c).alias(c) for c in CLASSES])


#: The classes that the models are counted from.
MODELS = ("allow", "block")


def held_out(host: Column) -> Column:
    """Whether a host is left out of the models."""
    return F.pmod(F.xxhash64(host, F.lit(5)), F.lit(5)) == 0


def _chances(grams: DataFrame, size: int, shorter: DataFrame | None) -> DataFrame:
    """grams (of ``size`` bytes) with the chance of the last byte after the others in each of MODELS, as in compiled().

    A gram that a model has not seen has the shorter one's chance, weighed down if the model knows the context. A context
    has 256 grams at most.
    """
    context = W.partitionBy(F.substring("gram", 1, size - 1))
    own = grams.withColumns({f"{m}_total": F.sum(m).over(context) for m in MODELS} | {f"{m}_kinds": F.sum((F.col(m) > 0).cast("long")).over(context) for m in MODELS})
    if shorter is None:
        own = own.withColumns({f"{m}_up": F.lit(1 / 256) for m in MODELS})
    else:
        up = shorter.select(F.col("gram").alias("_up"), *[F.col(f"p_{m}").alias(f"{m}_up") for m in MODELS])
        own = own.join(up, F.substring("gram", 2, size - 1) == F.col("_up"))
    chance = lambda m: (F.col(m) + F.col(f"{m}_kinds") * F.col(f"{m}_up")) / (F.col(f"{m}_total") + F.col(f"{m}_kinds"))
    return own.select("gram", *[F.when(F.col(f"{m}_total") > 0, chance(m)).otherwise(F.col(f"{m}_up")).alias(f"p_{m}") for m in MODELS], *CLASSES)


def ratios(found: DataFrame) -> DataFrame:
    """gram, n (how often urls that are to be scored have it), r (log ratio of both classes, in 1/UNIT)."""
    levels = {ORDER + 1: found}
    for size in range(ORDER, 0, -1):
        shorter = levels[size + 1].groupBy(F.substring("gram", 2, size).alias("gram")).agg(*[F.sum(c).alias(c) for c in CLASSES])
        levels[size] = cut(shorter) if size > 2 else shorter
    chances = None
    for size in range(1, ORDER + 2):
        chances = _chances(levels[size], size, chances)
        if 2 < size <= ORDER:
            chances = cut(chances)
    ratio = F.round((F.log("p_allow") - F.log("p_block")) * UNIT).cast("long").alias("r")
    return cut(chances.withColumn("n", F.col("held_allow") + F.col("held_block") + F.col("open")).where("n > 0").select("gram", "n", ratio))


def compiled(counts: dict[bytes, int]) -> dict[bytes, float]:
    """A model of counts in memory, the plain form of what ratios() does by tables.

    b"p" + gram: log probability of its last byte after the others; b"b" + context: log of the weight of the shorter context.

    Witten-Bell: P(byte | context) = (count + kinds * P(byte | shorter context)) / (total + kinds), kinds being the
    number of different successors of the context; the shortest context leans on equal chances of all 256 bytes.
    """
    total: dict[bytes, int] = {}
    kinds: dict[bytes, int] = {}
    for g, n in counts.items():
        total[g[:-1]] = total.get(g[:-1], 0) + n
        kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
    back = {c: kinds[c] / (total[c] + kinds[c]) for c in total}
    chance: dict[bytes, float] = {}

    def of(g: bytes) -> float:
        """P of a gram that may not be kept."""
        if g in chance:
            return chance[g]
        if not g:
            return 1 / 256
        return back.get(g[:-1], 1.0) * of(g[1:])

    for g in sorted(counts, key=lambda g: (len(g), g)):
        chance[g] = (counts[g] + kinds[g[:-1]] * of(g[1:])) / (total[g[:-1]] + kinds[g[:-1]])
    return {b"p" + g: math.log(p) for g, p in chance.items()} | {b"b" + c: math.log(w) for c, w in back.items()}


def likelihood(model: dict[bytes, float], raw: bytes) -> float:
    """Log-likelihood of the bytes from ORDER on: the longest kept gram, the contexts above it weighed down."""
    out, base = 0.0, math.log(1 / 256)
    for at in range(ORDER, len(raw)):
        for k in range(ORDER, -1, -1):
            p = model.get(b"p" + raw[at - k : at + 1])
            if p is not None:
                out += p
                break
            out += model.get(b"b" + raw[at - k : at], 0.0)
        else:
            out += base
    return out


def scored(pages: DataFrame, table: DataFrame, head: int = HEAD) -> DataFrame:
    """page (a struct with url) and score; pages: page; table: the ratios of all windows that they have."""
    top = table.where(F.col("n") >= _least(table, head)).select("gram", "r").toArrow()
    sent = pages.sparkSession.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist())))

    def run(batches):
        from collections import Counter

        import pandas as pd

        known = sent.value
        for urls in batches:
            rows = []
            for url in urls:
                raw, got, rest = grams_of(url), 0, Counter()
                for at in range(len(raw) - ORDER):
                    g = raw[at : at + ORDER + 1]
                    r = known.get(g)
                    if r is None:
                        rest[g] += 1
                    else:
                        got += r
                rows.append((got, len(raw) - ORDER, [{"gram": g, "f": f} for g, f in rest.items()]))
            yield pd.DataFrame(rows, columns=["sum", "size", "rest"])

    from collections.abc import Iterator

    import pandas as pd

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    own = F.pandas_udf(run, "sum long, size long, rest array<struct<gram:binary,f:long>>")(F.col("page.url").cast("string"))
    rows = cut(pages.select(F.monotonically_increasing_id().alias("row"), "page", own.alias("own")))  # the ids hold from here on
    each = rows.select("row", F.explode("own.rest").alias("x")).select("row", "x.gram", "x.f").join(table, "gram")
    more = each.groupBy("row").agg(F.sum(F.col("f") * F.col("r")).alias("more"))
    total = F.col("own.sum") + F.coalesce("more", F.lit(0))
    return rows.join(more, "row", "left").select("page", (total / UNIT / F.col("own.size")).alias("score"))


def calibrate(bins: list[tuple[int, str, int]]) -> float:
    """The threshold below which a score blocks, from (bin, verdict, count) of held-out urls; the middle of the best ones."""
    all_of = {v: sum(n for _, w, n in bins if w == v) for v in ("allow", "block")}
    if not all(all_of.values()):
        return 0.0
    by: dict[int, dict[str, int]] = {}
    for b, v, n in bins:
        by.setdefault(b, {"allow": 0, "block": 0})[v] += n
    below, best, where = {"allow": 0, "block": 0}, None, []
    for at in range(min(by), max(by) + 2):
        wrong = below["allow"] / all_of["allow"] + 1 - below["block"] / all_of["block"]
        if best is None or wrong < best - 1e-12:
            best, where = wrong, [at]
        elif wrong <= best + 1e-12:
            where.append(at)
        for v, n in by.get(at, {}).items():
            below[v] += n
    return (where[0] + where[-1]) / 2 / BINS


def judge(pages: DataFrame, rules=RULES, head: int = HEAD) -> DataFrame:
    """pages with host, path, rule, score (null where a rule judges) and verdict; columns of these names are replaced.

    Null url or none with ://: host and path empty, no rule, allowed unless the models say otherwise. Empty pages: empty
    result. Repeated rows are judged alike and count as often in the models. Other columns stay, whatever their names.
    """
    pages = pages.drop("host", "path", "rule", "score", "verdict")
    named = packed(pages, "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    named = named.withColumn("judged", rule_of(F.col("host"), F.col("path"), rules))
    held, none = held_out(F.col("host")), F.lit(None).cast("double")
    kind = F.when(F.col("judged").isNull(), 4).otherwise(F.when(F.col("judged.verdict") == "block", 1).otherwise(0) + F.when(held, 2).otherwise(0))
    found = cut(windows(named.select("url", kind.alias("kind"))))
    if all(found.agg(F.sum("allow"), F.sum("block")).first()):
        own = scored(named.where(F.col("judged").isNull() | held).select(F.struct("*").alias("page")), ratios(found), head)
        at = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score"))) * BINS).cast("int")
        bins = own.where("page.judged is not null").select(at.alias("bin"), F.col("page.judged.verdict").alias("verdict")).groupBy("bin", "verdict").count().collect()
        threshold = calibrate([tuple(x) for x in bins])
        rest = own.where("page.judged is null").select("page.*", "score").withColumn("verdict", F.when(F.col("score") < threshold, "block").otherwise("allow"))
    else:
        rest = named.where("judged is null").withColumns({"score": none, "verdict": F.lit("allow")})
    done = named.where("judged is not null").withColumns({"score": none, "verdict": F.col("judged.verdict")})
    every = done.unionByName(rest)
    return every.select(*unpacked(every, pages, "url"), "host", "path", F.col("judged.rule").alias("rule"), "score", "verdict")
