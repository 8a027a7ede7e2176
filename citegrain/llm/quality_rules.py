"""Quality rules whose cutoffs come with a risk guarantee. DataFrame functions only.

A rule rejects a document whose score is at or above a cutoff. The cutoffs are not chosen by hand: for each stratum
(language) and rule, labelled holdout documents are counted by score, and a cutoff is certified only if the exact
binomial test shows that at most ``risk`` of the good documents of the stratum score that high:

    P(Binomial(n_good, risk / n_rules) <= good documents rejected)  <=  delta / (n_strata * n_rules)

which is the one-sided exact (Clopper-Pearson) bound. Strata and rules are corrected by Bonferroni; the cutoffs of a
rule are tried from the most lenient to the strictest and the trial ends with the first failure (fixed-sequence
testing), which needs no correction along the grid. The risk is split over the rules, so that all rules together
reject at most ``risk`` of a stratum's good documents, with confidence 1 - delta for all strata at once. Of the
certified cutoffs, the one with the best balance of bad over good rejections is taken. A stratum with too few labels
certifies nothing and keeps all its documents.

The test takes labelled documents as independent draws. A text that occurs more than once in a stratum is one draw, with
its least label; near copies that differ in their text still count each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded, cut, let, text_of, words_of

#: Scores are shares of a document's word characters or words; cutoffs are these many steps of 1/200.
STEPS = 200
#: Character classes that are counted.
SYMBOLS, CAPITALS = "#*$%&|<>", "A-ZÀ-ÖØ-Þ"
#: Rules and the feature columns that their score is a share of.
RULES = {"symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars")}
RISK, DELTA = 0.05, 0.05
#: A rejected good document weighs as many rejected bad ones when a certified cutoff is chosen.
GOOD_WEIGHT = 20
#: Above so many strata with certified cutoffs, they are joined and not sent along as literals.
MOST_LITERALS = 2_000


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that the text has twice or more."""
    n = 5

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.when(i == F.size(at) - 1, n).otherwise(F.least(F.lit(n), F.get(at, i + 1) - p)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

    def repeated(order: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        hit = F.filter(order, lambda x, i: ((i > 0) & same(x, F.get(order, i - 1))) | same(x, F.get(order, i + 1)))
        return F.sort_array(F.transform(hit, lambda x: x["p"]))

    def counted(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        at = let(order, repeated)
        # most texts repeat nothing, which a hash set shows without a sort
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(at, covered))

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))

    return let(words, lambda w: F.when(F.size(w) < n, F.lit(0).cast("long")).otherwise(let(hashes(w), counted)))


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _only(text: Column, keep: str) -> Column:
    """Characters of a class in the text; taken out rather than left over, as a negated class of several ranges is slow."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{keep}]", ""))).cast("long")


def measured(text: Column) -> Column:
    """The counts of a text as a struct: FEATURES and n_capitals. Windows are compared by a 64-bit hash within a text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _only(text, SYMBOLS).alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), _repeat_words(w).alias("n_repeat_words"), _only(text, CAPITALS).alias("n_capitals"),
        )

    return let(words_of(text), of)


def features(docs: DataFrame) -> DataFrame:
    """Adds the columns FEATURES."""
    return docs.select("*", F.inline(F.array(measured(text_of())))).drop("n_capitals")


def _bin(rule: str, of=F.col) -> Column:
    """The strictest cutoff (in steps, 1 to STEPS) that the document reaches, 0 for none; of: a count by its name."""
    part, whole = (of(x) for x in RULES[rule])
    return F.when(whole > 0, F.least(F.lit(STEPS).cast("long"), F.floor(part * STEPS / whole))).otherwise(F.lit(0)).cast("int")


def base_failed(of=F.col) -> Column:
    return (of("n_words") < 10) | (100 * of("n_repeat_words") > 20 * of("n_words"))


def _tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed in logarithms from term to term; k is at most about n * p where it matters."""
    odds = math.log(p / (1 - p))

    def step(s: Column, i: Column) -> Column:
        term = s["t"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(s["l"], term)
        return F.struct(term.alias("t"), (top + F.log(F.exp(s["l"] - top) + F.exp(term - top))).alias("l"))

    first = (n * math.log(1 - p)).cast("double")
    start = F.struct(first.alias("t"), first.alias("l"))
    return F.when(k == 0, F.exp(first)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start, step, lambda s: F.exp(s["l"])))


def _named(stratum: Column) -> Column:
    """A stratum's name for joins and maps, null and the empty string apart."""
    return F.coalesce(F.concat(F.lit("="), stratum.cast("string")), F.lit(""))


def fit_cutoffs(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Certified cutoffs: stratum, rule, cutoff (in steps), n_good, good_rejected, bad_rejected.

    docs: doc_id, text and the stratum column; labels: doc_id, quality (1 good, 0 bad; the least of repeated labels,
    nulls ignored). A null stratum is one of its own. Only counts by stratum, rule and step are gathered.
    """
    p = risk / len(RULES)
    label = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q"))
    # only what the scores need, without the costly counts
    needed = {"word_chars": F.length(F.regexp_replace(text_of(), r"[\x20\x09-\x0D]+", "")).cast("long"), "n_symbols": _only(text_of(), SYMBOLS), "n_capitals": _only(text_of(), CAPITALS)}
    slim = docs.select("doc_id", _named(F.col(stratum)).alias("stratum"), F.xxhash64(text_of()).alias("text"), F.struct(*[c.alias(k) for k, c in needed.items()]).alias("_m"))
    slim = slim.select("doc_id", "stratum", "text", *[_bin(r, lambda c: F.col("_m")[c]).alias(r) for r in RULES])
    drawn = slim.join(label, "doc_id").groupBy("stratum", "text", *RULES).agg(F.min("_q").alias("_q"))
    seen = drawn.select("stratum", "_q", F.explode(F.create_map(*[y for r in RULES for y in (F.lit(r), F.col(r))])).alias("rule", "bin"))
    counted = cut(seen.groupBy("stratum", "rule", "bin").agg(F.sum(F.when(F.col("_q") >= 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("_q") >= 1, 0).otherwise(1)).alias("bad")))
    by_rule = W.partitionBy("stratum", "rule")
    # every cutoff 1..STEPS, so that the order of trials does not depend on which scores occur
    steps = counted.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good")).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(STEPS))))
    steps = steps.join(counted, ["stratum", "rule", "bin"], "left")
    down = by_rule.orderBy(F.desc("bin"))
    steps = steps.withColumns({"good_rejected": F.coalesce(F.sum("good").over(down), F.lit(0)).cast("long"), "bad_rejected": F.coalesce(F.sum("bad").over(down), F.lit(0)).cast("long")})
    strata = counted.agg(F.countDistinct("stratum")).first()[0]
    at_most = delta / max(1, strata * len(RULES))
    n, k = F.col("n_good"), F.col("good_rejected")
    passes = F.when(k > n * p, F.lit(False)).otherwise(_tail(n, k, p) <= at_most)
    steps = steps.withColumn("_fails", F.max(F.when(passes, 0).otherwise(1)).over(down)).where("_fails = 0")
    gain = F.col("bad_rejected") - GOOD_WEIGHT * F.col("good_rejected")
    best = steps.withColumn("_rank", F.row_number().over(by_rule.orderBy(gain.desc(), F.desc("bin")))).where((F.col("_rank") == 1) & (gain > 0))
    name = F.when(F.col("stratum") != "", F.expr("substring(stratum, 2)")).alias("stratum")
    return best.select(name, "rule", F.col("bin").alias("cutoff"), "n_good", "good_rejected", "bad_rejected")


def judge(docs: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds the features, base_failed, rejected_by (array of rule names) and kept. docs keeps its rows and other columns.

    Null text: no words, so base_failed. Null stratum: a stratum of its own. Empty cutoffs or labels: only the base rule
    rejects. Repeated rows are judged alike. Columns of docs named like an added one are replaced.
    """
    made = (*FEATURES, "base_failed", "rejected_by", "kept")
    own = docs.drop(*made)
    columns = [F.col(f"o.`{c}`") for c in own.columns]
    own, name = own.alias("o"), _named(F.col(f"o.`{stratum}`"))
    cutoffs = cutoffs.select(_named(F.col("stratum")).alias("stratum"), "rule", "cutoff")
    few = bounded(cutoffs, MOST_LITERALS)
    if few is None:
        wide = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut"))
        own = own.join(wide.alias("w"), name == F.col("w.stratum"), "left")
        limit = {r: F.col("w.cut")[r] for r in RULES}
    else:
        by: dict[str, list] = {r: [F.lit(x) for s, rule, c in few if rule == r for x in (s, c)] for r in RULES}
        limit = {r: F.element_at(F.create_map(*by[r]), name) if by[r] else F.lit(None).cast("int") for r in RULES}

    def verdict(m: Column) -> Column:
        of = lambda c: m[c]
        hit = F.array_compact(F.array(*[F.when(_bin(r, of) >= limit[r], F.lit(r)) for r in RULES]))
        fails = base_failed(of)
        return F.struct(*[m[c].alias(c) for c in FEATURES], fails.alias("base_failed"), hit.alias("rejected_by"), (~fails & (F.size(hit) == 0)).alias("kept"))

    # one generated row from the text to the verdict: neither a filter above nor the choice of fields works it out again
    return own.select(*columns, F.inline(F.array(let(measured(text_of("o.text")), verdict))))
