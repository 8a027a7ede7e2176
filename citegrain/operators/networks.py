"""Networks of seeds that share items, local citation counts, links within a set and duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.terms import normal_title
from ..tables import cut


def pairwise_overlap(members: DataFrame, least: int = 2) -> DataFrame:
    """members (seed, item; repeats don't count) to source, target, weight, cosine of all seed pairs sharing ``least`` items or more.

    source < target. cosine = weight / sqrt(items of source * items of target), to six places. One self join on the item;
    partial sums go over the wire, not pairs of rows per item; adaptive execution splits an item that very many seeds have.
    """
    own = members.where("seed is not null and item is not null").select("seed", "item").distinct()
    sizes = own.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    a, b = own.alias("a"), own.alias("b")
    shared = a.join(b, (F.col("a.item") == F.col("b.item")) & (F.col("a.seed") < F.col("b.seed")))
    shared = shared.groupBy(F.col("a.seed").alias("source"), F.col("b.seed").alias("target")).agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least)
    one, two = sizes.select(F.col("seed").alias("source"), F.col("n").alias("n1")), sizes.select(F.col("seed").alias("target"), F.col("n").alias("n2"))
    cosine = F.round(F.col("weight") / F.sqrt(F.col("n1") * F.col("n2")), 6)
    return shared.join(one, "source").join(two, "target").select("source", "target", "weight", cosine.alias("cosine"))


def without_items(seeds: DataFrame, members: DataFrame) -> DataFrame:
    """The seeds that have no items and are left out of a network."""
    return seeds.select("seed").distinct().join(members.where("item is not null"), "seed", "left_anti")


def capped(members: DataFrame, most: int) -> DataFrame:
    """At most so many items of each seed, least first; the seed itself is not its own item."""
    rank = F.row_number().over(W.partitionBy("seed").orderBy("item"))
    return members.where("seed is distinct from item").select("seed", "item").distinct().withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def local_citations(edges: DataFrame) -> DataFrame:
    """cited_id, lcs: how often each paper is cited within the set (edges: cited_id, citing_id, distinct)."""
    return edges.groupBy("cited_id").agg(F.countDistinct("citing_id").alias("lcs"))


def link_within(refs: DataFrame, papers: DataFrame) -> DataFrame:
    """Distinct edges cited_id, citing_id of references that point into the set: by provider id, else by DOI; no self links.

    refs: citing_id, ref_id, ref_doi; papers: paper_id, doi.
    """
    by_id = papers.select(F.col("paper_id").alias("_a"))
    by_doi = papers.where("doi is not null").groupBy(F.lower("doi").alias("_doi")).agg(F.min("paper_id").alias("_b"))
    # references without a DOI stay out of its look-up, where they would all have the same key
    left = refs.where("ref_doi is not null").join(by_id, refs.ref_id == F.col("_a"), "left_anti").join(by_doi, F.lower("ref_doi") == F.col("_doi"))
    found = refs.join(by_id, refs.ref_id == F.col("_a")).select(F.col("_a").alias("cited_id"), "citing_id").union(left.select("_b", "citing_id")).where("cited_id <> citing_id")
    return found.join(papers.select(F.col("paper_id").alias("citing_id")), "citing_id", "left_semi").select("cited_id", "citing_id").distinct()


def duplicate_groups(papers: DataFrame) -> DataFrame:
    """ids (sorted array) of papers with one DOI, or one normal title and year; reported, not merged."""
    by_doi = papers.where("doi is not null").groupBy(F.lower("doi").alias("k")).agg(F.sort_array(F.collect_set("paper_id")).alias("ids"))
    titled = papers.withColumn("_t", normal_title(F.col("title"))).where("_t <> ''")
    by_title = titled.groupBy("_t", "year").agg(F.sort_array(F.collect_set("paper_id")).alias("ids"))
    return by_doi.select("ids").unionByName(by_title.select("ids")).where(F.size("ids") > 1).distinct()


def regions(hits: DataFrame) -> DataFrame:
    """region (index names joined by +), n: how many works each combination of indexes has; hits: index_name, key."""
    per = hits.where("key is not null").groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("index_name")), "+").alias("region"))
    return per.groupBy("region").agg(F.count(F.lit(1)).alias("n"))


def region_totals(hits: DataFrame) -> DataFrame:
    """index_name, n, alone of each index, and of all together (any): how many works it has, and that no other has; hits: index_name, key."""
    own = hits.where("key is not null and index_name is not null").select("index_name", "key").distinct()
    per = own.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    each = own.join(per, "key").groupBy("index_name").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_n") == 1, 1)).alias("alone"))
    every = per.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_n") == 1, 1)).alias("alone")).select(F.lit("any").alias("index_name"), "n", "alone")
    return each.unionByName(every)


def report(members: DataFrame, seeds: DataFrame | None = None, least: int = 2, top: int = 10) -> dict[str, DataFrame]:
    """A network of seeds as tables. nodes: seed, n_items, degree, strength; edges: the heaviest; counts: seeds, with_items, connected, edges, weight in one row.

    members: seed, item; seeds: seed, those that are asked for (default: those with items).
    """
    edges = cut(pairwise_overlap(members, least))
    ends = edges.select(F.explode(F.array("source", "target")).alias("seed"), "weight").groupBy("seed").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
    sizes = members.where("seed is not null and item is not null").groupBy("seed").agg(F.countDistinct("item").alias("n_items"))
    asked = (seeds if seeds is not None else members.where("seed is not null")).select("seed").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    nodes = asked.join(sizes, "seed", "left").join(ends, "seed", "left").select("seed", zero("n_items"), zero("degree"), zero("strength"))
    per = nodes.agg(F.count(F.lit(1)).alias("seeds"), F.count(F.when(F.col("n_items") > 0, 1)).alias("with_items"), F.count(F.when(F.col("degree") > 0, 1)).alias("connected"))
    counts = per.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("weight")))
    return {"nodes": nodes, "edges": edges.orderBy(F.desc("weight"), "source", "target").limit(top), "counts": counts}
