"""Year series: reference publication years, peaks, historiographs, periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def spectrogram(refs: DataFrame, first: int, last: int) -> DataFrame:
    """year, n, median5, deviation for every year of the span; refs: year (one row for each citation).

    The median is over the years from two before to two after, fewer at the ends. The span is short, so that the one
    window without partitions has a row for each year only.
    """
    counts = refs.where(F.col("year").between(first, last)).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    axis = refs.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    dense = axis.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    around = W.orderBy("year").rowsBetween(-2, 2)
    out = dense.withColumn("median5", F.percentile("n", F.lit(0.5)).over(around))
    return out.withColumn("deviation", F.col("n") - F.col("median5"))


def undated(refs: DataFrame) -> DataFrame:
    return refs.where("year is null").agg(F.count(F.lit(1)).alias("undated"))


def peaks(series: DataFrame, top: int = 10) -> DataFrame:
    """The years with a positive deviation that no neighbour exceeds, by deviation, then year; ranked from 1."""
    by_year = W.orderBy("year")
    low = F.lit(float("-inf"))
    near = series.withColumn("_b", F.coalesce(F.lag("deviation").over(by_year), low)).withColumn("_a", F.coalesce(F.lead("deviation").over(by_year), low))
    hit = near.where("deviation > 0 and deviation >= _b and deviation >= _a").drop("_a", "_b")
    return hit.withColumn("rank", F.row_number().over(W.orderBy(F.desc("deviation"), "year"))).where(F.col("rank") <= top)


def peak_works(refs: DataFrame, found: DataFrame, top: int = 3) -> DataFrame:
    """year, work, n_work, share_top_work of the most cited works of each peak year; refs: year, work."""
    counts = refs.where("work is not null").join(F.broadcast(found.select("year", "n")), "year").groupBy("year", "n", "work").agg(F.count(F.lit(1)).alias("n_work"))
    order = W.partitionBy("year").orderBy(F.desc("n_work"), "work")
    out = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return out.withColumn("share_top_work", F.round(F.first("n_work").over(order.rowsBetween(W.unboundedPreceding, 0)) / F.col("n"), 2)).drop("n")


def historiograph(papers: DataFrame, lcs: DataFrame, edges: DataFrame, top: int = 30) -> tuple[DataFrame, DataFrame]:
    """Nodes (paper_id, year, lcs, gcs, in order of year and id) and the edges among them.

    The top papers by citations within the set, then overall, then id; only cited ones if there are any.
    papers: paper_id, year, gcs; lcs: cited_id, lcs; edges: cited_id, citing_id.
    """
    full = papers.join(lcs, papers.paper_id == lcs.cited_id, "left").select("paper_id", "year", F.coalesce("lcs", F.lit(0)).cast("long").alias("lcs"), "gcs")
    ranked = full.orderBy(F.desc("lcs"), F.desc("gcs"), "paper_id").limit(top)
    some = ranked.agg(F.max("lcs").alias("m"))
    nodes = ranked.join(F.broadcast(some), (F.col("lcs") > 0) | (F.col("m") == 0), "inner").drop("m")
    ids = nodes.select("paper_id")
    among = edges.join(F.broadcast(ids.withColumnRenamed("paper_id", "cited_id")), "cited_id", "left_semi").join(F.broadcast(ids.withColumnRenamed("paper_id", "citing_id")), "citing_id", "left_semi")
    return nodes, among.select("cited_id", "citing_id").distinct()


def yearly_counts(rows: DataFrame, first: int | None = None, last: int | None = None, this_year: int | None = None) -> DataFrame:
    """year, n, is_peak (first of the highest), total for every year from first to last (defaults: as observed); rows: year.

    With this_year, which is not over, also incomplete: whether a year is that one or a later one.
    """
    counts = rows.where("year is not null").groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.coalesce(F.lit(first).cast("int"), F.min("year")).alias("a"), F.coalesce(F.lit(last).cast("int"), F.max("year")).alias("b"))
    axis = span.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    dense = axis.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    every = W.partitionBy(F.lit(1))
    peak = F.max_by("year", F.struct("n", -F.col("year"))).over(every)
    out = dense.select("year", "n", (F.col("year") == peak).alias("is_peak"), F.sum("n").over(every).alias("total"))
    return out if this_year is None else out.withColumn("incomplete", F.col("year") >= this_year)


def cited_references(refs: DataFrame, bibliographies: DataFrame) -> DataFrame:
    """Every cited reference of a set: of a paper that has a bibliography all of its entries, since these are dated; else its list.

    refs, bibliographies: citing_id and the same further columns; adds dated_by: bibliography or references.
    """
    whole = bibliographies.select("citing_id").distinct()
    rest = refs.join(whole, "citing_id", "left_anti").withColumn("dated_by", F.lit("references"))
    return bibliographies.withColumn("dated_by", F.lit("bibliography")).unionByName(rest)


def spectroscopy(refs: DataFrame, bibliographies: DataFrame, first: int, last: int, top: int = 10) -> dict[str, DataFrame]:
    """Reference years of a set as tables: series, peaks, works (of the peaks), undated; refs, bibliographies: citing_id, year, work."""
    cited = cited_references(refs, bibliographies)
    series = spectrogram(cited, first, last)
    found = peaks(series, top)
    return {"series": series, "peaks": found, "works": peak_works(cited, found), "undated": undated(cited)}


def period_bounds(years: DataFrame, cuts: list[int] | None = None, n_periods: int = 3) -> DataFrame:
    """period (from 0), first_year, last_year: cut at the given years, else into periods of like numbers of papers.

    The k-th cut is the year at place round(k * n / periods), halves to even, of the sorted years. Worked out from the
    cumulative counts of years, so that papers are never sorted or collected.
    """
    counts = years.where("year is not null").groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    up = W.orderBy("year")
    cum = counts.withColumn("upto", F.sum("n").over(up))
    span = counts.agg(F.min("year").alias("lo"), F.max("year").alias("hi"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    if cuts:
        at = span.select("lo", "hi", F.explode(F.array(*[F.lit(int(c)) for c in cuts])).alias("cut")).where("cut > lo and cut <= hi")
    else:
        k = span.where("kinds > 1").withColumn("p", F.greatest(F.lit(1), F.least(F.lit(n_periods), F.col("kinds")))).where("p > 1")
        k = k.select("lo", "hi", "n", "p", F.explode(F.expr("sequence(1, int(p) - 1)")).alias("k"))
        k = k.withColumn("place", F.bround(F.col("k") * F.col("n") / F.col("p")))
        at = k.join(cum, F.col("upto") > F.col("place")).groupBy("k", "lo").agg(F.min("year").alias("cut")).where("cut > lo")
    starts = at.select("cut").unionByName(span.where("lo is not null").select(F.col("lo").alias("cut"))).distinct()
    ends = starts.join(F.broadcast(span.select("hi"))).withColumn("last_year", F.coalesce(F.lead("cut").over(W.orderBy("cut")) - 1, F.col("hi")))
    return ends.select((F.row_number().over(W.orderBy("cut")) - 1).alias("period"), F.col("cut").alias("first_year"), "last_year")
