"""Search in full texts by a positional inverted index: postings decide what is looked at, the texts are read for the best only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mentions


def index(docs: DataFrame) -> DataFrame:
    """term, doc_id, positions (array of int, ascending): the words between white space of each text (doc_id, text), lower-cased.

    A table to be written once, sorted by term; null and empty texts have no terms.
    """
    words = docs.where("text is not null").select("doc_id", F.posexplode(F.split(F.lower(F.trim("text")), r"\s+")).alias("position", "term"))
    return words.where("term <> ''").groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("position")).alias("positions"))


def _postings(postings: DataFrame, word: str, start: bool, end: bool) -> DataFrame:
    """Postings of the terms that a word of a query may be part of: the first word may end a term, the last may start one."""
    term, word = F.col("term"), word.lower()
    fits = term.contains(word) if start and end else term.endswith(word) if start else term.startswith(word) if end else term == word
    return postings.where(fits).select("doc_id", F.explode("positions").alias("at"))


def phrase_hits(postings: DataFrame, phrase: str) -> DataFrame:
    """doc_id, hits: how often the phrase occurs, by a join of postings, each shifted to the place of the first word."""
    words = phrase.split()
    found = None
    for k, w in enumerate(words):
        own = _postings(postings, w, k == 0, k == len(words) - 1).select("doc_id", (F.col("at") - k).alias("at"))
        found = own if found is None else found.join(own.distinct(), ["doc_id", "at"])
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


def hits(postings: DataFrame, query: str) -> DataFrame:
    """doc_id, hits: occurrences of the phrases of a quoted query; else, of texts with all words, those of the rarest there."""
    asked, whole = mentions.wanted(query)
    each = [phrase_hits(postings, x) for x in asked]
    if not each:
        return postings.where("false").select("doc_id", F.lit(0).cast("long").alias("hits"))
    every = each[0].withColumn("n", F.lit(1))
    for df in each[1:]:
        every = every.unionByName(df.withColumn("n", F.lit(1)))
    if whole:
        return every.groupBy("doc_id").agg(F.sum("hits").alias("hits"))
    return every.groupBy("doc_id").agg(F.min("hits").alias("hits"), F.sum("n").alias("n")).where(F.col("n") == len(each)).drop("n")


def search(docs: DataFrame, postings: DataFrame, query: str, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(place, doc_id, hits and the mentions as by mentions.analyze() of the texts with most hits; total: the number of texts with hits).

    docs: doc_id, text, of which only the best are read; postings: index(docs). Ties go to the least doc_id.
    """
    found = hits(postings, query)
    best = found.orderBy(F.desc("hits"), "doc_id").limit(top)
    analyzed = mentions.analyze(docs.join(F.broadcast(best.select("doc_id")), "doc_id", "left_semi"), query)
    from pyspark.sql import Window as W

    shown = analyzed.join(best, "doc_id").withColumn("place", F.row_number().over(W.orderBy(F.desc("hits"), "doc_id")))
    return shown.select("place", "doc_id", "hits", "body_mentions", "reference_list_mentions", "positions", "snippets"), found.agg(F.count(F.lit(1)).alias("total"))
