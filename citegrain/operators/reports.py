"""Whole results: what a user asks for in one call, put together from the operators."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import identity
from ..tables import cut
from . import audit, mentions, networks, paths


class CitationNetwork:
    """The citation network within a set of papers; each table is worked out when it is first asked for, by attribute or key.

    papers: paper_id, doi, title, year, date; refs: citing_id, ref_id, ref_doi; notices as for retraction_status; known:
    doi, source, n_refs, the lengths of reference lists elsewhere, looked up in the order of the given sources.

    nodes: paper_id, title, year, lcs, retrieved, n_external, completeness, retraction, isolated; provisional: whether any
    list is short or of unknown completeness; edges: source (cited), target, weight (in digits), on a graph without
    cycles; removed: the edges taken out for that; main_path, key_routes, duplicates as by their operators; totals: papers,
    linked, isolated, links, removed, short, unknown, retracted, in one row.
    """

    def __init__(self, papers: DataFrame, refs: DataFrame, notices: DataFrame, known: DataFrame, sources: tuple[str, ...] = ()):
        self.papers, self.refs, self.notices, self.known, self.sources = papers, refs, notices, known, sources

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def links(self) -> DataFrame:
        return cut(networks.link_within(self.refs, self.papers))

    @cached_property
    def _acyclic(self) -> tuple[DataFrame, DataFrame]:
        return paths.acyclic(self.links.select(F.col("cited_id").alias("source"), F.col("citing_id").alias("target")), self.papers.select(F.col("paper_id").alias("node"), "date"))

    @cached_property
    def _order(self) -> DataFrame:
        return paths.by_date(self.papers.select(F.col("paper_id").alias("node"), "date"))

    @cached_property
    def edges(self) -> DataFrame:
        return cut(paths.traversal_weights(self._acyclic[0], as_text=True, order=self._order))

    @property
    def removed(self) -> DataFrame:
        return self._acyclic[1]

    @cached_property
    def main_path(self) -> DataFrame:
        return paths.main_path(self.edges, order=self._order)

    @cached_property
    def key_routes(self) -> DataFrame:
        return paths.key_routes(self.edges, order=self._order)

    @property
    def duplicates(self) -> DataFrame:
        return networks.duplicate_groups(self.papers)

    @property
    def provisional(self) -> DataFrame:
        return self.nodes.agg(F.coalesce(F.max(F.col("completeness") != "ok"), F.lit(False)).alias("provisional"))

    @property
    def nodes(self) -> DataFrame:
        papers = self.papers
        got = self.refs.groupBy("citing_id").agg(F.count(F.lit(1)).alias("retrieved"))
        own = papers.join(got, papers.paper_id == got.citing_id, "left").drop("citing_id")
        own = audit.completeness(audit.external_counts(own, self.known, self.sources), "retrieved", "n_external").withColumnRenamed("status", "completeness")
        status = audit.retraction_status(papers.where("doi is not null").select("doi", F.lit(True).alias("ok")).distinct(), self.notices)
        own = own.join(status.select(F.lower("doi").alias("_d"), F.col("status").alias("retraction")), F.lower("doi") == F.col("_d"), "left")
        lcs = networks.local_citations(self.links)
        own = own.join(lcs, F.col("paper_id") == F.col("cited_id"), "left").withColumn("lcs", F.coalesce("lcs", F.lit(0).cast("long")))
        linked = self.links.select(F.col("cited_id").alias("paper_id")).union(self.links.select("citing_id")).distinct().withColumn("_in", F.lit(True))
        own = own.join(linked, "paper_id", "left")
        return own.select("paper_id", "title", "year", "lcs", F.coalesce("retrieved", F.lit(0).cast("long")).alias("retrieved"), "n_external", "completeness", F.coalesce("retraction", F.lit("unknown")).alias("retraction"), F.col("_in").isNull().alias("isolated"))

    @property
    def totals(self) -> DataFrame:
        count = lambda c, name: F.count(F.when(c, 1)).alias(name)
        per = self.nodes.agg(F.count(F.lit(1)).alias("papers"), count(~F.col("isolated"), "linked"), count(F.col("isolated"), "isolated"), *[count(F.col("completeness") == x, x) for x in ("short", "unknown")], count(F.col("retraction") == "retracted", "retracted"))
        links, removed = (df.agg(F.count(F.lit(1)).alias(name)) for df, name in ((self.links, "links"), (self.removed, "removed")))
        return per.crossJoin(links).crossJoin(removed).select("papers", "linked", "isolated", "links", "removed", "short", "unknown", "retracted")

    def heaviest_contexts(self, contexts: DataFrame, back: DataFrame, top: int = 40) -> DataFrame:
        return heaviest_contexts(self.edges, contexts, back, top)


def reference_report(refs: DataFrame, papers: DataFrame, count: int = 25) -> tuple[DataFrame, DataFrame]:
    """(the first ``count`` references of each paper; citing_id, total, shown, truncated, reported, unservable, status).

    refs: citing_id, pos and more; papers: citing_id, reported (the length that the service states, or null).
    unservable is what is reported and not there; status as by completeness().
    """
    place = F.row_number().over(W.partitionBy("citing_id").orderBy("pos"))
    shown = refs.withColumn("_r", place).where(F.col("_r") <= count).drop("_r")
    per = papers.join(refs.groupBy("citing_id").agg(F.count(F.lit(1)).alias("total")), "citing_id", "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    per = audit.completeness(per, "total", "reported")
    head = per.select("citing_id", "total", F.least("total", F.lit(count)).alias("shown"), (F.col("total") > count).alias("truncated"), "reported", F.greatest(F.lit(0).cast("long"), F.col("reported") - F.col("total")).alias("unservable"), "status")
    return shown, head


def citing_papers(edges: DataFrame, papers: DataFrame, cited: DataFrame, most: int = 25) -> DataFrame:
    """cited_id, place, citing_id and the columns of papers: the most cited papers that cite each of ``cited`` (cited_id)."""
    found = edges.select("cited_id", "citing_id").distinct().join(cited.select("cited_id").distinct(), "cited_id").join(papers, F.col("citing_id") == F.col("paper_id"))
    place = F.row_number().over(W.partitionBy("cited_id").orderBy(F.desc("cited_by_count"), "citing_id"))
    return found.withColumn("place", place).where(F.col("place") <= most).drop("paper_id")


def import_report(rows: DataFrame, by_doi: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with work_id and resolved_by; resolved_by, n): export records looked up by DOI, else by exact title in the same year.

    rows: pos, provider_id, doi, norm_title, year; a record with a provider id needs no look-up (file). by_doi: doi,
    work_id; works: work_id, norm_title, year. Of several works the least id counts.
    """
    a = by_doi.groupBy(F.lower("doi").alias("_d")).agg(F.min("work_id").alias("_a"))
    b = works.where("norm_title <> ''").groupBy(F.col("norm_title").alias("_t"), F.col("year").alias("_y")).agg(F.min("work_id").alias("_b"))
    own = rows.join(a, F.lower("doi") == F.col("_d"), "left").join(b, (F.col("norm_title") == F.col("_t")) & (F.col("year") == F.col("_y")), "left")
    by = F.when(F.col("provider_id").isNotNull(), "file").when(F.col("_a").isNotNull(), "doi").when(F.col("_b").isNotNull(), "title").otherwise("not found")
    own = own.withColumns({"work_id": F.coalesce("provider_id", "_a", "_b"), "resolved_by": by}).drop("_d", "_a", "_t", "_y", "_b")
    return own, own.groupBy("resolved_by").agg(F.count(F.lit(1)).alias("n"))


def path_transmission(path: DataFrame, papers: DataFrame, contexts: DataFrame, weights: DataFrame, terms: list[str], most: int = 40) -> DataFrame:
    """position, cited_id, citing_id, weight, contexts, construct_mentions, list_citations, label of each step of a path.

    path: position, node, 2 to ``most`` papers, oldest first (ValueError otherwise); papers: node, surnames, year;
    contexts: citing_id, cited_id, contexts, intents, is_influential; weights: source, target, weight.
    """
    n = path.count()
    if not 2 <= n <= most:
        raise ValueError(f"a path of 2 to {most} papers is needed, not {n}")
    steps = path.withColumn("citing_id", F.lead("node").over(W.orderBy("position"))).where("citing_id is not null").withColumnRenamed("node", "cited_id")
    own = steps.join(papers.withColumnRenamed("node", "cited_id"), "cited_id", "left").join(contexts, ["citing_id", "cited_id"], "left")
    own = own.join(weights.select(F.col("source").alias("cited_id"), F.col("target").alias("citing_id"), "weight"), ["citing_id", "cited_id"], "left")
    return mentions.judged(own, terms).select("position", "cited_id", "citing_id", "weight", "contexts", "construct_mentions", "list_citations", "label")


def heaviest_contexts(edges: DataFrame, contexts: DataFrame, back: DataFrame, top: int = 40) -> DataFrame:
    """place, citing_id, cited_id, weight, contexts, status of the heaviest edges.

    edges: source, target, weight (a number of 0 or more, or an integer in digits, as citation_network() gives them); ties
    go to the least source, then target.
    """
    heavy = paths.rank_of(paths.digits_of("weight", dict(edges.dtypes)["weight"])).desc()
    ranked = edges.orderBy(heavy, "source", "target").limit(top)
    ranked = cut(ranked.select(F.col("target").alias("citing_id"), F.col("source").alias("cited_id"), "weight", F.row_number().over(W.orderBy(heavy, "source", "target")).alias("place")))
    # the few edges go to what is known of all of them, not the other way round
    contexts, back = (df.join(F.broadcast(ranked.select("citing_id", "cited_id")), ["citing_id", "cited_id"], "left_semi") for df in (contexts, back))
    return mentions.edge_contexts(ranked, contexts, back).select("place", "citing_id", "cited_id", "weight", "contexts", "status")


def label_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, n, share: how often each label was given, blanks left out."""
    own = rows.where(F.trim(F.col(label)) != "").groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return own.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 4))


def journal_report(papers: DataFrame, journals: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_id with the metrics of the journals that are there, the wanted ids that are not); papers: source_id, journals and metrics: source_id and more."""
    wanted = papers.select("source_id").where("source_id is not null").distinct()
    known = journals.join(wanted, "source_id", "left_semi").join(metrics, "source_id", "left")
    return known, wanted.join(journals, "source_id", "left_anti")


def bibtex_entries(records: DataFrame, served: DataFrame, origin: str) -> DataFrame:
    """pos, entry, generated: one BibTeX entry for each record, records of one DOI once (the first).

    records: pos, doi, authors, year, title, venue; served: doi, entry, what a DOI service gave. Without one an entry is
    generated from the metadata; a record without title and served entry has none and is left out.
    """
    own = records.withColumn("_d", identity.bare_doi(F.col("doi")))
    first = F.row_number().over(W.partitionBy(F.coalesce("_d", F.concat(F.lit("pos "), F.col("pos").cast("string")))).orderBy("pos"))
    own = own.withColumn("_r", first).where("_r = 1").join(served.select(identity.bare_doi(F.col("doi")).alias("_d"), F.col("entry").alias("_e")), "_d", "left")
    made: Column = identity.generated_entry(F.col("authors"), F.col("year"), F.col("title"), F.col("venue"), origin)
    entry = F.coalesce(identity.dashed_pages(F.col("_e")), made)
    return own.select("pos", entry.alias("entry"), F.col("_e").isNull().alias("generated")).where("entry is not null")


def landscape_sample(papers: DataFrame, order: str = "recent", most: int = 2_000) -> DataFrame:
    """The papers (paper_id, cover_date, cited_by_count, relevance) that a landscape is drawn from: recent, cited or relevance."""
    keys = {"recent": F.desc_nulls_last("cover_date"), "cited": F.desc_nulls_last("cited_by_count"), "relevance": F.desc_nulls_last("relevance")}
    if order not in keys:
        raise ValueError(f"order is one of {', '.join(keys)}")
    return papers.orderBy(keys[order], "paper_id").limit(most)


def agreement_report(sheet: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """a, b, n, po, pe, kappa, words, disagreements for every two of the coded columns (reference, coders, consensus)."""
    from itertools import combinations

    out = None
    for a, b in combinations(columns, 2):
        one = audit.cohen_kappa(sheet, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "po", "pe", "kappa", "words")
        one = one.join(audit.disagreements(sheet, a, b).agg(F.count(F.lit(1)).alias("disagreements")))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("at least two columns are needed")
    return out
