"""Open copies of a paper that services answer with, as locations: doi, url, source, version, kind (pdf, html or jats).

docs: doi and the landed response, json (variant) or, for the preprint server, xml. What can't be read gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import blank_to_null
from ..functions.terms import normal_title
from .landed import at, items

#: Names of versions by what services call them.
VERSIONS = {"publishedVersion": "published", "acceptedVersion": "accepted", "submittedVersion": "preprint"}
#: Where texts are served.
PREPRINTS = "https://arxiv.org/pdf/"
ARTICLES = "https://www.ebi.ac.uk/europepmc/webservices/rest/"


def _version(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in VERSIONS.items() for x in kv]), c)


def _kind(url: Column) -> Column:
    return F.when(F.substring_index(F.lower(url), "?", 1).endswith(".pdf"), "pdf").otherwise("html")


def _located(rows: DataFrame, url: Column, source: Column, version: Column, kind: Column) -> DataFrame:
    found = rows.select("doi", url.alias("url"), source.alias("source"), version.cast("string").alias("version"), kind.alias("kind"))
    return found.where("url is not null")


def from_index(docs: DataFrame, v: str = "json") -> DataFrame:
    """Open locations of an open index's work; a PDF before the landing page."""
    e = items(docs, v, "locations", "e").where(at("e", "is_oa", "boolean"))
    pdf, page = blank_to_null(at("e", "pdf_url")), blank_to_null(at("e", "landing_page_url"))
    source = F.concat(F.lit("OpenAlex: "), F.coalesce(blank_to_null(at("e", "source.display_name")), F.lit("repository")))
    return _located(e, F.coalesce(pdf, page), source, _version(at("e", "version")), F.when(pdf.isNotNull(), "pdf").otherwise("html"))


def from_graph(docs: DataFrame, v: str = "json") -> DataFrame:
    """The open PDF of a paper in a citation graph, and the preprint that it names."""
    pdf, preprint = blank_to_null(F.trim(at(v, "openAccessPdf.url"))), blank_to_null(at(v, "externalIds.ArXiv"))
    none = F.lit(None).cast("string")
    one = _located(docs, pdf, F.lit("Semantic Scholar"), none, _kind(pdf))
    return one.unionByName(_located(docs, F.concat(F.lit(PREPRINTS), preprint), F.lit("arXiv"), F.lit("preprint"), F.lit("pdf")))


def from_preprints(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """The first entry of a preprint server's feed that has the wanted title (docs: doi, title, xml), however it is written."""
    feed = F.from_xml(F.col(xml), "entry array<struct<id string, title string>>")
    same = F.filter(feed["entry"], lambda x: normal_title(x["title"]) == normal_title(F.col("title")))
    page = F.trim(F.get(same, 0)["id"])
    url = F.regexp_replace(F.replace(page, F.lit("/abs/"), F.lit("/pdf/")), "^http://", "https://")
    return _located(docs, url, F.lit("arXiv"), F.lit("preprint"), F.lit("pdf"))


def from_articles(docs: DataFrame, v: str = "json") -> DataFrame:
    """The JATS text of the first hit that is open and held."""
    e = items(docs, v, "resultList.result", "e").where((at("e", "isOpenAccess") == "Y") & (at("e", "inEPMC") == "Y"))
    first = e.withColumn("pmcid", blank_to_null(at("e", "pmcid"))).where("pmcid is not null").groupBy("doi").agg(F.min_by("pmcid", "pos").alias("pmcid"))
    return _located(first, F.concat(F.lit(ARTICLES), F.col("pmcid"), F.lit("/fullTextXML")), F.lit("Europe PMC"), F.lit("published"), F.lit("jats"))


def from_registry(docs: DataFrame, v: str = "json") -> DataFrame:
    """Locations of a registry of open copies."""
    e = items(docs, v, "oa_locations", "e")
    pdf, url = blank_to_null(at("e", "url_for_pdf")), blank_to_null(at("e", "url"))
    source = F.concat(F.lit("Unpaywall: "), F.coalesce(blank_to_null(at("e", "repository_institution")), blank_to_null(at("e", "host_type")), F.lit("Unpaywall")))
    return _located(e, F.coalesce(pdf, url), source, _version(at("e", "version")), F.when(pdf.isNotNull(), "pdf").otherwise(_kind(url)))


def from_aggregator(docs: DataFrame, v: str = "json") -> DataFrame:
    """Downloads of an aggregator's works."""
    url = blank_to_null(at("e", "downloadUrl"))
    return _located(items(docs, v, "results", "e"), url, F.lit("CORE"), F.lit(None), _kind(url))
