"""Co-word themes per period: vocabulary, equivalence index, clusters, centrality and density, evolution, followed constructs.

docs: doc_id, period, term (exploded, distinct per document). Everything but the clustering is joins and partial sums;
Louvain runs per period on the graph of the vocabulary, whose size is bounded by ``top`` terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..tables import cut
from .louvain import communities


def term_frequency(docs: DataFrame) -> DataFrame:
    """period, term, freq: documents with the term."""
    return docs.groupBy("period", "term").agg(F.countDistinct("doc_id").alias("freq"))


def vocabulary(docs: DataFrame, min_freq: int = 2, top: int = 150, max_share: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """period, term, freq of the ``top`` terms by frequency, then name, which min_freq documents have and not more than max_share.

    The ceiling holds from ten documents on. Terms containing one of ``keep`` stay in whatever their frequency and rank.
    """
    n = docs.groupBy("period").agg(F.countDistinct("doc_id").alias("n_docs"))
    freq = term_frequency(docs).where(F.col("freq") >= min_freq).join(F.broadcast(n), "period")
    wanted = F.lit(False)
    for k in keep:
        wanted = wanted | F.col("term").contains(k)
    usual = (F.col("n_docs") < 10) | (F.col("freq") <= max_share * F.col("n_docs"))
    ranked = freq.withColumn("_u", usual).withColumn("_w", wanted)
    ranked = ranked.withColumn("_r", F.row_number().over(W.partitionBy("period").orderBy(F.col("_u").desc(), F.desc("freq"), "term")))
    return ranked.where((F.col("_u") & (F.col("_r") <= top)) | F.col("_w")).select("period", "term", "freq")


def cooccurrence(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """period, a, b (a < b), n, weight = n^2 / (freq a * freq b) of vocabulary terms that share documents."""
    own = docs.select("period", "doc_id", "term").distinct().join(vocab, ["period", "term"])
    x, y = own.alias("x"), own.alias("y")
    pair = (F.col("x.period") == F.col("y.period")) & (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.term") < F.col("y.term"))
    n = F.count(F.lit(1))
    both = x.join(y, pair).groupBy(F.col("x.period").alias("period"), F.col("x.term").alias("a"), F.col("y.term").alias("b"), F.col("x.freq").alias("fa"), F.col("y.freq").alias("fb")).agg(n.alias("n"))
    return both.select("period", "a", "b", "n", (F.col("n") * F.col("n") / (F.col("fa") * F.col("fb"))).alias("weight"))


def clusters(pairs: DataFrame) -> DataFrame:
    """period, term, cluster (its least term) by Louvain on the equivalence graph; pairs: period, a, b, weight."""
    return communities(pairs.select(F.col("period").alias("graph"), "a", "b", "weight")).select(F.col("graph").alias("period"), F.col("node").alias("term"), F.col("community").alias("cluster"))


def themes(docs: DataFrame, vocab: DataFrame, pairs: DataFrame, member: DataFrame) -> DataFrame:
    """period, cluster, label, n_terms, n_docs, centrality, density, quadrant, theme (rank by documents, then label).

    centrality: 10 * the weights of links that leave the theme; density: 100 * the mean weight of links within it. High is
    at or above the upper median of the period.
    """
    m1, m2 = member.select("period", F.col("term").alias("a"), F.col("cluster").alias("ca")), member.select("period", F.col("term").alias("b"), F.col("cluster").alias("cb"))
    tied = cut(pairs.join(m1, ["period", "a"]).join(m2, ["period", "b"]))
    within = tied.where("ca = cb").groupBy("period", F.col("ca").alias("cluster")).agg(F.avg("weight").alias("mean"))
    ends = F.explode(F.array("ca", "cb")).alias("cluster")
    across = tied.where("ca <> cb").select("period", "weight", ends).groupBy("period", "cluster").agg(F.sum("weight").alias("out"))
    touched = docs.join(member, ["period", "term"]).groupBy("period", "cluster").agg(F.countDistinct("doc_id").alias("n_docs"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("freq")).alias("f"), "term")))
    named = member.join(vocab, ["period", "term"]).groupBy("period", "cluster").agg(order.alias("_t"))
    named = named.select("period", "cluster", F.size("_t").alias("n_terms"), F.array_join(F.transform(F.slice("_t", 1, 3), lambda x: x["term"]), " · ").alias("label"))
    out = named.join(touched, ["period", "cluster"]).join(within, ["period", "cluster"], "left").join(across, ["period", "cluster"], "left")
    out = out.select("period", "cluster", "label", "n_terms", "n_docs", F.round(10 * F.coalesce("out", F.lit(0.0)), 3).alias("centrality"), F.round(100 * F.coalesce("mean", F.lit(0.0)), 3).alias("density"))
    return ranked(quadrants(out))


def quadrants(themes: DataFrame) -> DataFrame:
    """Adds quadrant to period, centrality, density: against the upper median, the value at place n div 2 of the sorted ones."""
    every = W.partitionBy("period")
    upper = lambda c: F.element_at(F.array_sort(F.collect_list(c).over(every)), F.floor(F.count(F.lit(1)).over(every) / 2).cast("int") + 1)
    c, d = F.col("centrality") >= upper("centrality"), F.col("density") >= upper("density")
    return themes.withColumn("quadrant", F.when(c & d, "motor").when(c, "basic").when(d, "niche").otherwise("emerging or declining"))


def ranked(themes: DataFrame) -> DataFrame:
    return themes.withColumn("theme", F.row_number().over(W.partitionBy("period").orderBy(F.desc("n_docs"), "label")))


def evolution(member: DataFrame, least: float = 0.1) -> DataFrame:
    """Links from_period, source, to_period, target, shared, inclusion = shared terms / terms of the smaller theme.

    member: period, theme, term. Themes of consecutive periods that share a term; one equi join on period and term.
    """
    size = member.groupBy("period", "theme").agg(F.count(F.lit(1)).alias("n"))
    sized = member.join(size, ["period", "theme"])
    a = sized.select(F.col("period").alias("from_period"), (F.col("period") + 1).alias("to_period"), F.col("theme").alias("source"), "term", F.col("n").alias("n1"))
    b = sized.select(F.col("period").alias("to_period"), F.col("theme").alias("target"), "term", F.col("n").alias("n2"))
    both = a.join(b, ["to_period", "term"]).groupBy("from_period", "source", "to_period", "target", "n1", "n2").agg(F.count(F.lit(1)).alias("shared"))
    inclusion = F.col("shared") / F.least("n1", "n2")
    return both.where(inclusion >= least).select("from_period", "source", "to_period", "target", "shared", F.round(inclusion, 2).alias("inclusion"))


def fates(themes: DataFrame, links: DataFrame) -> DataFrame:
    """period, theme, fate: new or merged from several (but in the first period), vanishes, splits, merges or continues (but in the last)."""
    span = themes.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    pred = links.groupBy(F.col("to_period").alias("period"), F.col("target").alias("theme")).agg(F.count(F.lit(1)).alias("n_pred"))
    of_target = pred.select(F.col("period").alias("to_period"), F.col("theme").alias("target"), F.col("n_pred").alias("t_pred"))
    succ = links.join(of_target, ["to_period", "target"]).groupBy(F.col("from_period").alias("period"), F.col("source").alias("theme")).agg(F.count(F.lit(1)).alias("n_succ"), F.max("t_pred").alias("t_pred"))
    out = themes.select("period", "theme").join(pred, ["period", "theme"], "left").join(succ, ["period", "theme"], "left").join(F.broadcast(span))
    came = F.when(F.col("period") > F.col("lo"), F.when(F.col("n_pred").isNull(), "new").when(F.col("n_pred") > 1, "merged from several"))
    went = F.when(F.col("period") < F.col("hi"), F.when(F.col("n_succ").isNull(), "vanishes").when(F.col("n_succ") > 1, "splits").when(F.col("t_pred") > 1, "merges").otherwise("continues"))
    return out.select("period", "theme", F.concat_ws(", ", came, went).alias("fate"))


def track(docs: DataFrame, words: list[str], top: int = 6) -> DataFrame:
    """period, doc_mentions, keywords, company of a construct: terms containing one of the words, and what they occur with most.

    company: the top terms without the words by co-occurrences with keywords, then name.
    """
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col("term").contains(w)
    own = docs.select("period", "doc_id", "term").distinct().withColumn("hit", hit)
    hits = own.where("hit")
    per = hits.groupBy("period").agg(F.countDistinct("doc_id").alias("doc_mentions"), F.array_join(F.sort_array(F.collect_set("term")), "; ").alias("keywords"))
    met = own.where("not hit").alias("x").join(hits.alias("y"), ["period", "doc_id"]).groupBy("period", F.col("x.term").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    met = met.withColumn("r", F.row_number().over(W.partitionBy("period").orderBy(F.desc("n"), "term"))).where(F.col("r") <= top)
    met = met.groupBy("period").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), "; ").alias("company"))
    return per.join(met, "period", "left").select("period", "doc_mentions", "keywords", F.coalesce("company", F.lit("")).alias("company"))


def thematic_evolution(docs: DataFrame, bounds: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """Themes of periods and what becomes of them, as tables: periods, themes, members, evolution, fates.

    docs: doc_id, year, term, distinct; bounds: period, first_year, last_year (default: three periods of like sizes); options
    are those of vocabulary().
    """
    from .history import period_bounds

    bounds = cut(bounds if bounds is not None else period_bounds(docs.select("doc_id", "year").distinct()))
    dated = cut(docs.join(F.broadcast(bounds), F.col("year").between(F.col("first_year"), F.col("last_year"))).select("doc_id", "year", "period", "term"))
    vocab = cut(vocabulary(dated, **options))
    pairs = cut(cooccurrence(dated, vocab))
    member = cut(clusters(pairs))
    found = themes(dated, vocab, pairs, member)
    found = cut(found)
    named = cut(member.join(found.select("period", "cluster", "theme"), ["period", "cluster"]).select("period", "theme", "term"))
    links = cut(evolution(named))
    return {"periods": bounds, "themes": found, "members": named, "evolution": links, "fates": fates(found, links)}
