"""Journal scopes, reference filters, requests: predicates on landed tables, and the query strings that services take."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import compact_issn

#: Print and electronic ISSNs of a basket of eight journals, and other names of it.
BASKETS = {
    "basket_of_eight": {
        "European Journal of Information Systems": ("0960-085X", "1476-9344"),
        "Information Systems Journal": ("1350-1917", "1365-2575"),
        "Information Systems Research": ("1047-7047", "1526-5536"),
        "Journal of the Association for Information Systems": ("1536-9323", "1558-3457"),
        "Journal of Information Technology": ("0268-3962", "1466-4437"),
        "Journal of Management Information Systems": ("0742-1222", "1557-928X"),
        "Journal of Strategic Information Systems": ("0963-8687", "1873-1198"),
        "MIS Quarterly": ("0276-7783", "2162-9730"),
    }
}
ALIASES = {"ais8": "basket_of_eight", "basket_of_8": "basket_of_eight", "senior_scholars_basket": "basket_of_eight", "ais_basket": "basket_of_eight"}
#: Short names of venues by normal title.
VENUES = {
    "mis quarterly": "MISQ", "mis quarterly management information systems": "MISQ", "information systems research": "ISR",
    "journal of management information systems": "JMIS", "european journal of information systems": "EJIS", "information systems journal": "ISJ",
    "journal of the association for information systems": "JAIS", "journal of information technology": "JIT",
    "journal of strategic information systems": "JSIS", "the journal of strategic information systems": "JSIS", "organization science": "OrgSci", "management science": "MgmtSci",
}


def scope_issns(scope: str | list[str] | None) -> list[str] | None:
    """Hyphened ISSNs of a basket name, an alias, or ISSNs in a list or a string; null for no scope, ValueError for anything else."""
    if not scope:
        return None
    if isinstance(scope, str):
        name = re.sub(r"[ -]", "_", scope.strip().lower())
        basket = BASKETS.get(ALIASES.get(name, name))
        if basket:
            return [i for pair in basket.values() for i in pair]
        scope = [x for x in re.split(r"[,\s;]+", scope) if x]
    found = [re.fullmatch(r"(\d{4})-?(\d{3}[\dXx])", str(x).strip()) for x in scope]
    if not all(found):
        raise ValueError(f"not an ISSN or a basket: {scope}; baskets: {', '.join([*BASKETS, *ALIASES])}")
    return list(dict.fromkeys(f"{m[1]}-{m[2].upper()}" for m in found))


def in_scope(papers: DataFrame, scope: str | list[str] | None, *columns: str) -> DataFrame:
    """The papers of which one of the ISSN columns is in the scope; all without one."""
    issns = scope_issns(scope)
    if issns is None:
        return papers
    wanted, hit = [i.replace("-", "") for i in issns], F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(compact_issn(F.col(c)).isin(wanted), F.lit(False))
    return papers.where(hit)


def issn_clause(issns: list[str]) -> str:
    return "(" + " OR ".join(f"ISSN({i.replace('-', '')})" for i in issns) + ")"


def scoped_query(query: str, issns: list[str] | None) -> str:
    return f"({query}) AND {issn_clause(issns)}" if issns else query


def index_filter(issns: list[str]) -> str:
    return "primary_location.source.issn:" + "|".join(issns)


def source_chunks(ids: list[str], size: int = 100) -> list[str]:
    """Query fragments of ``size`` source ids each."""
    return [" OR ".join(f"SRCID({i})" for i in ids[k : k + size]) for k in range(0, len(ids), size)]


def author_name(name: str) -> tuple[str, str | None]:
    """Surname and given names, from either order."""
    plain = " ".join((name or "").split())
    if "," in plain:
        last, _, first = plain.partition(",")
    else:
        first, _, last = plain.rpartition(" ")
    return last.strip(), first.strip() or None


def author_query(name: str, affiliation: str | None = None) -> str:
    clean = lambda x: " ".join(re.sub(r'[()"\\]', " ", x or "").split())
    last, first = author_name(name)
    if not clean(last):
        raise ValueError("a name is needed")
    fields = (("AUTHLASTNAME", last), ("AUTHFIRST", first), ("AFFIL", affiliation))
    return " AND ".join(f"{k}({clean(v)})" for k, v in fields if clean(v))


def of_author(authors: DataFrame, name: str, affiliation: str | None = None) -> DataFrame:
    """Authors (surname, given, affiliation) with the surname, given names that begin alike, and all words of the affiliation."""
    last, first = author_name(name)
    hit = F.lower("surname") == last.lower()
    if first:
        hit = hit & F.lower("given").startswith(first.lower().rstrip("."))
    for w in (affiliation or "").lower().split():
        hit = hit & F.lower("affiliation").contains(w)
    return authors.where(hit)


def matching_references(refs: DataFrame, ids: list[str]) -> DataFrame:
    """References that one of the mixed ids names: provider id or EID, DOI or its URL, index id; whatever the case."""
    keys = set()
    for raw in ids:
        v = re.sub(r"(?i)^(https?://(dx\.)?doi\.org/|doi:)", "", str(raw).strip())
        if v:
            tail = v.rsplit("/", 1)[-1] if "openalex.org" in v.lower() else v
            keys.add(v.lower() if v.startswith("10.") else re.sub(r"(?i)^(scopus_id:|2-s2\.0-)", "", tail).lower())
    names = ["ref_scopus_id", "ref_doi", *(["ref_openalex_id"] if "ref_openalex_id" in refs.columns else [])]
    return refs.where(reduce(or_, [F.coalesce(F.lower(c).isin(sorted(keys)), F.lit(False)) for c in names]))


def request(hits: DataFrame, journal: str | None = None, first: int = 1823, last: int = 2100, open_only: bool = False, offset: int = 0, show: int = 25, order: str = "date") -> DataFrame:
    """A page of full-text hits (venue, year, open_access, cover_date, title) by journal, years and access."""
    own = hits.where(F.col("year").between(first, last))
    own = own.where(F.lower("venue") == journal.lower()) if journal else own
    own = own.where("open_access") if open_only else own
    keys = [F.desc("cover_date"), F.col("title")] if order == "date" else [F.col("title")]
    return own.orderBy(*keys).offset(offset).limit(show)


def venue_abbreviation(venue: Column) -> Column:
    """A known short name, else the initials of the longer words, ten at most, else a question mark."""
    from ..functions.terms import normal_title

    known = F.create_map(*[F.lit(x) for kv in VENUES.items() for x in kv])
    words = F.filter(F.split(F.trim(F.coalesce(venue, F.lit(""))), r"[\s&-]+"), lambda w: (w != "") & ~F.lower(w).isin("of", "the", "and", "for", "in", "on", "a", "an"))
    initials = F.substring(F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")), 1, 10)
    return F.coalesce(F.element_at(known, normal_title(venue)), F.when(initials != "", initials).otherwise("?"))


def corpus(papers: DataFrame, ids: list[str] | None = None, where: Column | None = None, most: int = 300, wanted: DataFrame | None = None) -> DataFrame:
    """The papers of the ids, in their order, of a table of ids (wanted: paper_id, see sources.sinks), or the most cited of a condition; exactly one of these."""
    if sum(x is not None for x in (ids, where, wanted)) != 1:
        raise ValueError("either ids, a table of ids or a condition")
    if wanted is not None:
        return papers.join(wanted.select("paper_id"), "paper_id", "left_semi")
    if ids is None:
        return papers.where(where).orderBy(F.desc("cited_by_count"), "paper_id").limit(most)
    order = papers.sparkSession.createDataFrame([(x, k) for k, x in enumerate(dict.fromkeys(ids))], "paper_id string, pos long")
    return papers.join(F.broadcast(order), "paper_id").orderBy("pos").drop("pos")


def fulltext(direct: DataFrame, copies: DataFrame, abstracts: DataFrame, least: int = 5_000) -> DataFrame:
    """doi, text, provenance: the publisher's text if it is long enough, else an open copy, else the abstract, else none.

    direct, copies, abstracts: doi, text; doi is that of ``direct``, which has a row for each wanted one.
    """
    a, b, c = direct.select("doi", F.col("text").alias("_a")), copies.select("doi", F.col("text").alias("_b")), abstracts.select("doi", F.col("text").alias("_c"))
    own = a.join(b, "doi", "left").join(c, "doi", "left").withColumn("_a", F.when(F.length("_a") >= least, F.col("_a")))
    source = F.when(F.col("_a").isNotNull(), "publisher").when(F.col("_b").isNotNull(), "open copy").when(F.col("_c").isNotNull(), "abstract").otherwise("none")
    return own.select("doi", F.coalesce("_a", "_b", "_c").alias("text"), source.alias("provenance"))


def degenerate(lineage: DataFrame, path_length: int, cap: int, this_year: int) -> DataFrame:
    """warning: why a lineage may be no real one, a row for each reason. lineage: node, generation, year, cited_by_count.

    The first generation reached its cap and the second is empty; the main path has under three papers; or the five most
    cited of the first generation are all of the last two years, with under 20 citations.
    """
    g1 = lineage.where("generation = 1")
    n = lineage.agg(F.sum((F.col("generation") == 1).cast("int")).alias("n1"), F.sum((F.col("generation") == 2).cast("int")).alias("n2"))
    top = g1.orderBy(F.desc("cited_by_count"), "node").limit(5).agg(F.count(F.lit(1)).alias("k"), F.min("year").alias("y"), F.max("cited_by_count").alias("c"))
    row = n.join(top)
    reasons = F.array_compact(F.array(
        F.when((F.col("n1") >= cap) & (F.coalesce("n2", F.lit(0)) == 0), "first generation capped, second empty"),
        F.when(F.lit(path_length < 3), "main path under three papers"),
        F.when((F.col("k") > 0) & (F.col("y") >= this_year - 1) & (F.col("c") < 20), "first generation too recent"),
    ))
    return row.select(F.explode(reasons).alias("warning"))
