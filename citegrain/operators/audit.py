"""Audits: coder agreement, completeness, retractions, citer verification, cross-index checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.terms import agreement_words, normal_label
from ..sources import sinks


def _coded(sheet: DataFrame, a: str, b: str) -> DataFrame:
    own = sheet.select(normal_label(F.col(a)).alias("a"), normal_label(F.col(b)).alias("b"))
    return own.where("a <> '' and b <> ''")


def cohen_kappa(sheet: DataFrame, a: str, b: str) -> DataFrame:
    """n, po, pe, kappa, se, ci_low, ci_high, words; kappa and what follows are null if nothing is coded or chance is one."""
    cells = _coded(sheet, a, b).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    one, two = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = one.join(two, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("both"))
    out = total.join(chance).select("n", F.expr("try_divide(same, n)").alias("po"), F.expr("try_divide(both, n * n)").alias("pe"))
    fine = (F.col("n") > 0) & (F.col("pe") < 1)
    out = out.withColumn("kappa", F.when(fine, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))))
    out = out.withColumn("se", F.when(fine, F.sqrt(F.col("po") * (1 - F.col("po")) / (F.col("n") * (1 - F.col("pe")) * (1 - F.col("pe"))))))
    out = out.withColumns({"ci_low": F.col("kappa") - 1.96 * F.col("se"), "ci_high": F.col("kappa") + 1.96 * F.col("se")})
    return out.withColumn("words", agreement_words(F.col("kappa")))


def per_label(sheet: DataFrame, a: str, b: str) -> DataFrame:
    """label, n_a, n_b, both, agreement = 2 both / (n_a + n_b), kappa of the label against the rest."""
    own = _coded(sheet, a, b)
    cells = own.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    ends = cells.select(F.col("a").alias("label"), "n", F.lit(1).alias("ia"), F.lit(0).alias("ib"), F.lit(0).alias("same"))
    ends = ends.unionByName(cells.select(F.col("b").alias("label"), "n", F.lit(0).alias("ia"), F.lit(1).alias("ib"), (F.col("a") == F.col("b")).cast("int").alias("same")))
    per = ends.groupBy("label").agg(F.sum(F.col("n") * F.col("ia")).alias("n_a"), F.sum(F.col("n") * F.col("ib")).alias("n_b"), F.sum(F.col("n") * F.col("same")).alias("both"))
    per = per.join(cells.agg(F.sum("n").alias("t")))
    po = (F.col("t") - F.col("n_a") - F.col("n_b") + 2 * F.col("both")) / F.col("t")
    pe = (F.col("n_a") * F.col("n_b") + (F.col("t") - F.col("n_a")) * (F.col("t") - F.col("n_b"))) / (F.col("t") * F.col("t"))
    return per.select("label", "n_a", "n_b", "both", (2 * F.col("both") / (F.col("n_a") + F.col("n_b"))).alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def confusion(sheet: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n for every two labels of either coder, zeros included."""
    own = _coded(sheet, a, b)
    cells = own.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    labels = cells.select("a").union(cells.select("b")).distinct()
    # a row with all labels, unfolded twice: as many labels as there are codes
    every = labels.agg(F.collect_set("a").alias("s")).select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b"))
    return every.join(cells, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def disagreements(sheet: DataFrame, a: str, b: str) -> DataFrame:
    x, y = normal_label(F.col(a)), normal_label(F.col(b))
    return sheet.where((x != "") & (y != "") & (x != y))


def agreement(sheet: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """The agreement of two coders as tables: overall, labels, confusion, disagreements. Other than two columns, or nothing coded by both: ValueError."""
    if len(columns) != 2 or columns[0] == columns[1] or set(columns) - set(sheet.columns):
        raise ValueError("two different columns of the sheet are needed")
    a, b = columns
    if _coded(sheet, a, b).isEmpty():
        raise ValueError(f"no row is coded in both {a} and {b}")
    return {"overall": cohen_kappa(sheet, a, b), "labels": per_label(sheet, a, b), "confusion": confusion(sheet, a, b), "disagreements": disagreements(sheet, a, b)}


def completeness(papers: DataFrame, retrieved: str, external: str) -> DataFrame:
    """Adds status: unknown if either count is missing or zero, short if five or more and over a tenth are missing, else ok."""
    r, e = F.col(retrieved), F.col(external)
    known = (F.coalesce(r, F.lit(0)) > 0) & (F.coalesce(e, F.lit(0)) > 0)
    return papers.withColumn("status", F.when(~known, "unknown").when((e - r >= 5) & (r < 0.9 * e), "short").otherwise("ok"))


def external_counts(papers: DataFrame, counts: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Adds n_external, external_source: of the first source in the order that has more than zero; counts: doi, source, n_refs."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("source"))
    best = counts.where("n_refs > 0").where(place > 0).groupBy(F.lower("doi").alias("_d")).agg(F.min_by(F.struct("n_refs", "source"), place).alias("_x"))
    return papers.join(best, F.lower("doi") == F.col("_d"), "left").withColumns({"n_external": F.col("_x.n_refs"), "external_source": F.col("_x.source")}).drop("_d", "_x")


#: Notice types in the order of their weight.
SEVERE = ("retraction", "withdrawal", "removal", "partial_retraction")


def retraction_status(checked: DataFrame, notices: DataFrame) -> DataFrame:
    """doi, status, latest (label of the latest notice): retracted, concern, corrected, ok; unknown where the check failed.

    checked: doi, ok (whether the look-up worked); notices: doi, type, label, date.
    """
    weight = F.when(F.col("type").isin(*SEVERE), 3).when(F.col("type") == "expression_of_concern", 2).otherwise(1)
    worst = notices.groupBy(F.lower("doi").alias("_d")).agg(F.max(weight).alias("w"), F.max_by("label", "date").alias("latest"))
    out = checked.join(worst, F.lower("doi") == F.col("_d"), "left")
    status = F.when(~F.col("ok"), "unknown").when(F.col("w") == 3, "retracted").when(F.col("w") == 2, "concern").when(F.col("w") == 1, "corrected").otherwise("ok")
    return out.select("doi", status.alias("status"), "latest")


def resolve_citers(hits: DataFrame, refs: DataFrame | None, seeds: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """paper_id, strategies, status of each hit but the seeds: confirmed, unconfirmed, verification_failed; unverified without refs.

    hits: strategy, paper_id; refs: citing_id, cited_id; seeds, failed: paper_id. Confirmed: its references hold a seed.
    """
    found = hits.join(seeds, "paper_id", "left_anti").groupBy("paper_id").agg(F.array_join(F.sort_array(F.collect_set("strategy")), "; ").alias("strategies"))
    if refs is None:
        return found.select("paper_id", "strategies", F.lit("unverified").alias("status"))
    failed = seeds.limit(0) if failed is None else failed
    citing = refs.join(seeds, refs.cited_id == seeds.paper_id, "left_semi").select(F.col("citing_id").alias("paper_id")).distinct().withColumn("c", F.lit(True))
    bad = failed.select("paper_id").distinct().withColumn("f", F.lit(True))
    out = found.join(citing, "paper_id", "left").join(bad, "paper_id", "left")
    return out.select("paper_id", "strategies", F.when(F.col("f"), "verification_failed").when(F.col("c"), "confirmed").otherwise("unconfirmed").alias("status"))


def strategy_table(hits: DataFrame, resolved: DataFrame) -> DataFrame:
    """strategy, hits (raw rows), confirmed, unconfirmed, failed, confirmed_missed (confirmed papers that it did not find)."""
    raw = hits.groupBy("strategy").agg(F.count(F.lit(1)).alias("hits"))
    each = hits.select("strategy", "paper_id").distinct().join(resolved, "paper_id")
    when = lambda s: F.sum((F.col("status") == s).cast("int"))
    per = each.groupBy("strategy").agg(when("confirmed").alias("confirmed"), when("unconfirmed").alias("unconfirmed"), when("verification_failed").alias("failed"))
    total = resolved.agg(F.coalesce(when("confirmed"), F.lit(0)).alias("t"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return raw.join(per, "strategy", "left").join(total).select("strategy", "hits", zero("confirmed"), zero("unconfirmed"), zero("failed"), (F.col("t") - F.coalesce("confirmed", F.lit(0))).cast("long").alias("confirmed_missed"))


def cross_check(external: DataFrame, confirmed: DataFrame, seeds: DataFrame, indexed: DataFrame, citing: DataFrame, found: DataFrame) -> DataFrame:
    """key, status of external citers that are neither confirmed nor seeds (all inputs: key).

    Not in the index: not_in_index. Indexed, and its references hold a seed: cites_seed_but_missed if no strategy found it,
    else found_but_unconfirmed; without the seed among its references: found_but_seed_not_in_refs, or not_returned_by_search.
    """
    left = external.select("key").distinct().join(confirmed, "key", "left_anti").join(seeds, "key", "left_anti")
    flag = lambda df, n: df.select("key").distinct().withColumn(n, F.lit(True))
    out = left.join(flag(indexed, "i"), "key", "left").join(flag(citing, "c"), "key", "left").join(flag(found, "f"), "key", "left")
    status = F.when(F.col("i").isNull(), "not_in_index").when(F.col("c") & F.col("f").isNull(), "cites_seed_but_missed").when(F.col("c"), "found_but_unconfirmed").when(F.col("f"), "found_but_seed_not_in_refs").otherwise("not_returned_by_search")
    return out.select("key", status.alias("status"))


#: The groups of a cross-check in the order of a report, with their titles; those of which a few are shown.
GROUPS = (
    ("cites_seed_but_missed", "In the index and citing a seed there, but not found"),
    ("not_returned_by_search", "In the index, not found, no seed among its references there"),
    ("found_but_seed_not_in_refs", "Found, no seed among its references in the index"),
    ("found_but_unconfirmed", "Found and citing a seed, not confirmed"),
    ("not_in_index", "Not in the index"),
)
BRIEF, SHOWN = ("not_in_index",), 6


def grouped_report(checked: DataFrame, groups: tuple = GROUPS, brief: tuple = BRIEF, shown: int = SHOWN) -> DataFrame:
    """place (of the group, from 1), status, title, n, item (from 1, by key), key, more: the rows of a report group by group.

    checked: key, status. Groups come in the given order, empty ones not at all; of brief groups the first few are shown, and
    more says how many are not. Other statuses are left out.
    """
    names = checked.sparkSession.createDataFrame([(i + 1, s, t, s in brief) for i, (s, t) in enumerate(groups)], "place int, status string, title string, brief boolean")
    own = checked.join(F.broadcast(names), "status")
    sizes = own.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    item = F.row_number().over(W.partitionBy("status").orderBy("key"))
    short = own.where("brief").withColumn("item", item).where(F.col("item") <= shown)
    # the others are listed whole: an item's number is its place among those of its group, sorted by range
    whole = sinks.numbered(own.where("not brief"), ["place", "key"])
    starts = whole.groupBy("status").agg(F.min("index").alias("_first"))
    whole = whole.join(F.broadcast(starts), "status").withColumn("item", F.col("index") - F.col("_first") + 1).drop("index", "_first")
    listed = short.withColumn("item", F.col("item").cast("long")).unionByName(whole)
    more = F.when(F.col("brief"), F.greatest(F.lit(0), F.col("n") - shown)).otherwise(0).cast("long")
    return listed.join(F.broadcast(sizes), "status").select("place", "status", "title", "n", "item", "key", more.alias("more"))


def deduplicated(records: DataFrame) -> DataFrame:
    """Records of which none shares an identifier or a title and year with another, merged over chains of shared keys.

    records: pos and provider_id, wos_id, doi, norm_title, year (any may be null), keywords (array). The first record of a
    group (least pos) stands for it; blanks are filled from the next ones and the longest keyword list wins. This is the
    transitive closure: a later record that bridges two groups merges them.
    """
    from .paths import with_component

    keys = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{p}:"), F.col(c))) for p, c in (("s", "provider_id"), ("w", "wos_id"), ("d", "doi"))], F.when(F.col("norm_title") != "", F.concat_ws(":", F.lit("t"), "norm_title", F.coalesce(F.col("year").cast("string"), F.lit("None"))))))
    keyed = records.select("pos", F.explode(keys).alias("key"))
    # a record and the first one with the same key
    first = keyed.groupBy("key").agg(F.min("pos").alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    links = keyed.join(first, "key").where("f <> pos").select(F.col("f").alias("source"), F.col("pos").alias("target")).distinct()
    linked = with_component(links).select(F.explode(F.array("source", "target")).alias("pos"), "component").distinct()
    grouped = records.join(linked, "pos", "left").withColumn("component", F.coalesce("component", "pos"))
    fill = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    longest = F.max_by("keywords", F.struct(F.size("keywords"), -F.col("pos"))).alias("keywords")
    return grouped.groupBy(F.col("component").alias("pos")).agg(*[fill(c) for c in ("provider_id", "wos_id", "doi", "norm_title", "year")], longest, F.count(F.lit(1)).alias("n_records"))
