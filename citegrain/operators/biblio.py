"""Journal quality, topic landscapes, BibTeX keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.terms import quartile


def latest_metric(metrics: DataFrame) -> DataFrame:
    """source_id, metric, year, value of each journal's latest year; metrics: source_id, metric, year, value."""
    best = F.max(F.struct("year", "value")).alias("x")
    return metrics.where("year is not null and value is not null").groupBy("source_id", "metric").agg(best).select("source_id", "metric", "x.year", "x.value")


def subject_ranks(ranks: DataFrame) -> DataFrame:
    """source_id, year, category, percentile, rank, quartile of the latest complete year.

    ranks: source_id, year, status, doc_type, category, percentile, rank. Of several document types 'all' counts, else
    the first by name; percentiles outside 0 to 100 are dropped.
    """
    own = ranks.where("status = 'Complete'")
    year = own.groupBy("source_id").agg(F.max("year").alias("year"))
    own = own.join(year, ["source_id", "year"])
    kind = W.partitionBy("source_id", "category").orderBy((F.lower("doc_type") == "all").desc(), "doc_type")
    own = own.where(F.col("percentile").between(0, 100)).withColumn("_k", F.dense_rank().over(kind)).where("_k = 1")
    return own.select("source_id", "year", "category", "percentile", "rank", quartile(F.col("percentile")).alias("quartile"))


def find_journals(ranks: DataFrame, categories: list[str], least: float, journals_only: bool = True) -> DataFrame:
    """category, source_id, percentile, quartile, chunk: journals at or above a percentile, in order; chunk numbers them by hundreds.

    ranks: category, source_id, percentile, venue_type.
    """
    own = ranks.where(F.col("category").isin(categories) & (F.col("percentile") >= least))
    if journals_only:
        own = own.where("venue_type = 'journal'")
    place = F.row_number().over(W.partitionBy("category").orderBy(F.desc("percentile"), "source_id")) - 1
    return own.select("category", "source_id", "percentile", quartile(F.col("percentile")).alias("quartile"), F.floor(place / 100).alias("chunk"))


def resolve_categories(categories: DataFrame, wanted: list[str]) -> list[str]:
    """Codes of the wanted categories: by code, exact name, else the one name that contains it. Ambiguous or unknown: ValueError.

    categories: code, description; a dimension of a few hundred rows.
    """
    rows = categories.select("code", "description").distinct().limit(20_001).collect()
    if len(rows) > 20_000:
        raise ValueError("more than 20,000 categories; this is a look-up in a small dimension")
    out = []
    for w in wanted:
        low = w.strip().lower()
        found = [r.code for r in rows if r.code == w.strip()] or [r.code for r in rows if (r.description or "").lower() == low] or [r.code for r in rows if low in (r.description or "").lower()]
        if len(set(found)) != 1:
            raise ValueError(f"{w!r} is {'no' if not found else 'more than one'} category" + (f": {', '.join(sorted(set(found)))}" if found else ""))
        out.append(found[0])
    return out


def landscape(papers: DataFrame, ranks: DataFrame, top: int = 15) -> DataFrame:
    """category, papers, q1..q4, non_journal, q1_share, top_venues of the categories with most ranked papers, then name.

    papers: paper_id, source_id, venue; ranks: source_id, category, quartile, venue_type (once per journal and category).
    A paper counts in each category of its venue. q1_share is of journal papers only, two places.
    """
    fan = papers.join(ranks, "source_id")
    journal = F.col("venue_type") == "journal"
    q = lambda n: F.sum((journal & (F.col("quartile") == f"Q{n}")).cast("int")).alias(f"q{n}")
    per = fan.groupBy("category").agg(F.sum(journal.cast("int")).alias("papers"), *[q(n) for n in (1, 2, 3, 4)], F.sum((~journal).cast("int")).alias("non_journal"))
    venues = fan.groupBy("category", "venue").agg(F.count(F.lit(1)).alias("n"))
    venues = venues.withColumn("r", F.row_number().over(W.partitionBy("category").orderBy(F.desc("n"), "venue"))).where("r <= 3")
    venues = venues.groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "venue"))), lambda x: x["venue"]), "; ").alias("top_venues"))
    out = per.join(venues, "category").withColumn("q1_share", F.round(F.try_divide(F.col("q1"), F.col("papers")), 2))
    return out.orderBy((F.col("papers") + F.col("non_journal")).desc(), "category").limit(top)


def unranked(papers: DataFrame, ranks: DataFrame, top: int = 5) -> DataFrame:
    """venue, n, share of the venues without a rank that have most papers; share is of all papers."""
    left = papers.join(ranks.select("source_id").distinct(), "source_id", "left_anti")
    total = papers.agg(F.count(F.lit(1)).alias("t"))
    return left.groupBy("venue").agg(F.count(F.lit(1)).alias("n")).join(total).select("venue", "n", F.round(F.col("n") / F.col("t"), 4).alias("share")).orderBy(F.desc("n"), "venue").limit(top)


def by_source_or_issn(papers: DataFrame, journals: DataFrame) -> DataFrame:
    """papers with journal (id): by source id, else by either ISSN, the least id of several.

    papers: source_id, issn (compact); journals: journal, source_id, issn, eissn.
    """
    ids = journals.where("source_id is not null").groupBy("source_id").agg(F.min("journal").alias("_a"))
    issns = journals.select("journal", F.explode(F.array_compact(F.array("issn", "eissn"))).alias("issn")).groupBy("issn").agg(F.min("journal").alias("_b"))
    return papers.join(ids, "source_id", "left").join(issns, "issn", "left").withColumn("journal", F.coalesce("_a", "_b")).drop("_a", "_b")


def unique_keys(entries: DataFrame) -> DataFrame:
    """entries (pos, key) with unique_key: repeated keys get a, b, ... z, then numbers, the first one too."""
    times = F.count(F.lit(1)).over(W.partitionBy("key"))
    place = F.row_number().over(W.partitionBy("key").orderBy("pos")) - 1
    suffix = F.when(place < 26, F.char(place + F.lit(97))).otherwise(place.cast("string"))
    return entries.withColumn("unique_key", F.when(F.col("key").isNull() | (times == 1), F.col("key")).otherwise(F.concat("key", suffix)))
