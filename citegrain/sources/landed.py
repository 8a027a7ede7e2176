"""Landed JSON responses of bibliographic services as tables. Values that come as a string, {'$': string} or a list are read alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.identity import bare_doi, blank_to_null, compact_issn, short_id, to_provider_id, year_of
from ..functions.terms import normal_title, venue_type
from ..operators.titles import SIMILAR, bare_title, ratio


def responses(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON document (whole files or lines of them): json (variant), file."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_name").alias("file"))
    return raw.select(F.try_parse_json("value").alias("json"), "file").where("json is not null")


def at(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v), _path(path), kind)


def _path(path: str) -> str:
    return f"${path}" if path.startswith("[") else f"$.{path}"


def scalar(v: str, path: str) -> Column:
    """The first value that is not empty of a string, an object with '$', or a list of either."""

    def plain(x: Column) -> Column:
        is_object = F.try_variant_get(x, "$", "map<string,variant>").isNotNull()
        return blank_to_null(F.when(is_object, F.try_variant_get(x, "$['$']", "string")).otherwise(F.try_variant_get(x, "$", "string")))

    one, many = (F.try_variant_get(F.col(v), _path(path), kind) for kind in ("variant", "array<variant>"))
    listed = F.coalesce(many, F.array_compact(F.array(one)))
    return F.get(F.filter(F.transform(listed, plain), lambda x: x.isNotNull()), 0)


def items(df: DataFrame, v: str, path: str, to: str) -> DataFrame:
    """A row for each element of a list, or one for a single object; pos is its place."""
    one = F.try_variant_get(F.col(v), _path(path), "variant")
    many = F.try_variant_get(F.col(v), _path(path), "array<variant>")
    return df.select("*", F.posexplode(F.coalesce(many, F.array_compact(F.array(one)))).alias("pos", to))


def search_results(docs: DataFrame, v: str = "json") -> DataFrame:
    """Flat records of search responses; error entries are left out, and an answer with a total of 0 has none."""
    own = docs.where(F.coalesce(at(v, "['search-results']['opensearch:totalResults']"), F.lit("1")) != "0")
    e = items(own, v, "['search-results'].entry", "e").where(at("e", "error").isNull())
    get = lambda name: scalar("e", f"['{name}']")
    issn = F.coalesce(compact_issn(get("prism:issn")), compact_issn(get("prism:eIssn")))
    return e.select("pos", to_provider_id(get("dc:identifier")).alias("scopus_id"), get("eid").alias("eid"), bare_doi(get("prism:doi")).alias("doi"), get("dc:title").alias("title"), get("dc:creator").alias("creator"), get("prism:publicationName").alias("venue"), issn.alias("issn"), get("source-id").alias("source_id"), get("prism:coverDate").alias("cover_date"), year_of(get("prism:coverDate")).alias("year"), venue_type(get("prism:aggregationType")).alias("venue_type"), F.coalesce(get("citedby-count").try_cast("long"), F.lit(0)).alias("cited_by_count"))


def paged(pages: DataFrame, entries: DataFrame, size: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(the entries that paging takes, with place; query, pages, fetched, stopped: how far each query was read and why).

    pages: query, page (from 0), cursor, next, total; entries: query, page, pos, key and more. Pages are read in order, up to
    the first that is empty, holds fewer than ``size`` entries, brings no new key or has a next cursor that is null or its
    own (empty, short, nothing new, stuck), until ``most`` entries are there (enough), or to the last one landed (end). An
    entry counts at its first place; null keys are one key.
    """
    of, at = ["query", "page"], F.struct("page", "pos")
    first = entries.groupBy("query", "key").agg(F.min(at).alias("_f"))
    same = F.col("x.query").eqNullSafe(F.col("y.query")) & F.col("x.key").eqNullSafe(F.col("y.key"))
    marked = entries.alias("x").join(first.alias("y"), same).select("x.*", (F.struct("x.page", "x.pos") == F.col("y._f")).alias("_new"))
    per = marked.groupBy(*of).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("_new"), 1)).alias("_added"))
    read = pages.join(per, of, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_n", "_added")})
    before = F.coalesce(F.sum("_added").over(W.partitionBy("query").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    read = read.withColumn("_before", before)
    stuck = F.col("next").isNull() | F.col("next").eqNullSafe(F.col("cursor"))
    why = F.when(F.col("_n") == 0, "empty").when(F.col("_before") + F.col("_added") >= most, "enough").when(F.col("_n") < size, "short").when(F.col("_added") == 0, "nothing new").when(stuck, "stuck")
    read = read.withColumn("_why", why)
    stop = read.groupBy("query").agg(F.min(F.when(F.col("_why").isNotNull(), F.struct("page", "_why"))).alias("_s"), F.max("page").alias("_l"))
    stop = stop.select("query", F.coalesce("_s.page", "_l").alias("_last"), F.coalesce("_s._why", F.lit("end")).alias("stopped"))
    kept = read.join(stop, "query").where(F.col("page") <= F.col("_last"))
    report = kept.groupBy("query", "stopped").agg(F.count(F.lit(1)).alias("pages"), F.least(F.sum("_added"), F.lit(most)).alias("fetched"), F.max("total").alias("total"))
    report = report.select("query", "pages", "fetched", "stopped", "total", (F.col("total") > F.col("fetched")).alias("truncated"))
    within = F.row_number().over(W.partitionBy(*of).orderBy("pos"))
    taken = marked.where("_new").join(kept.select(*of, "_before"), of).withColumn("place", F.col("_before") + within).where(F.col("place") <= most)
    return taken.drop("_new", "_before"), report


def reference_totals(docs: DataFrame, citing: str, v: str = "json") -> DataFrame:
    """citing, reported (the length that the response states), retrieved, unservable: how many are stated and not there.

    A list that is one short is whole but for its last entry, which this view never gives: phantom.
    """
    block = "['abstracts-retrieval-response'].references"
    got = F.size(_list_of(v, f"{block}.reference"))
    own = docs.select(citing, scalar(v, f"{block}['@total-references']").try_cast("int").alias("reported"), got.alias("retrieved"))
    return own.withColumns({"unservable": F.greatest(F.lit(0), F.coalesce(F.col("reported"), F.lit(0)) - F.col("retrieved")), "phantom": F.coalesce(F.col("reported") - F.col("retrieved") == 1, F.lit(False))})


def references(docs: DataFrame, citing: str, v: str = "json", limit: int | None = None) -> DataFrame:
    """One row for each reference of abstract responses; authors distinct by id, in order."""
    e = items(docs, v, "['abstracts-retrieval-response'].references.reference", "e")
    if limit is not None:
        e = e.where(F.col("pos") < limit)
    authors = F.transform(F.coalesce(F.try_variant_get(F.col("e"), "$['author-list'].author", "array<variant>"), F.array().cast("array<variant>")), lambda a: F.struct(F.try_variant_get(a, "$['@auid']", "string").alias("id"), F.try_variant_get(a, "$['ce:indexed-name']", "string").alias("name")))
    first = F.filter(authors, lambda x, i: x["name"].isNotNull() & (x["id"].isNull() | (F.array_position(F.transform(authors, lambda y: y["id"]), x["id"]) == i + 1)))
    date = scalar("e", "['prism:coverDate']")
    return e.select(citing, "pos", to_provider_id(scalar("e", "['scopus-id']")).alias("ref_scopus_id"), bare_doi(scalar("e", "['ce:doi']")).alias("ref_doi"), scalar("e", "title").alias("title"), F.transform(first, lambda x: x["name"]).alias("authors"), scalar("e", "sourcetitle").alias("source"), year_of(date).alias("year"))


def missing_tail(refs: DataFrame, bibliography: DataFrame) -> DataFrame:
    """References with those that only the full bibliography has after the last position, marked recovered_from."""
    last = refs.groupBy("citing_id").agg(F.max("pos").alias("_last"))
    tail = bibliography.join(last, "citing_id", "left").where("_last is null or pos > _last").drop("_last")
    return refs.withColumn("recovered_from", F.lit(None).cast("string")).unionByName(tail.withColumn("recovered_from", F.lit("bibliography")), allowMissingColumns=True)


def inverted_abstract(index: Column) -> Column:
    """The text of a map word -> positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.sort_array(pairs), lambda x: x["w"]), " ")


def works(docs: DataFrame, v: str = "json") -> DataFrame:
    """Records of an open index's works."""
    e = items(docs, v, "results", "e")
    name = lambda a: F.try_variant_get(a, "$.author.display_name", "string")
    authors = F.array_compact(F.transform(F.coalesce(F.try_variant_get(F.col("e"), "$.authorships", "array<variant>"), F.array().cast("array<variant>")), name))
    index = F.try_variant_get(F.col("e"), "$.abstract_inverted_index", "map<string,array<int>>")
    return e.select("pos", short_id(at("e", "id")).alias("openalex_id"), bare_doi(at("e", "doi")).alias("doi"), at("e", "title").alias("title"), authors.alias("authors"), at("e", "publication_year", "int").alias("year"), at("e", "publication_date").alias("publication_date"), at("e", "primary_location.source.display_name").alias("venue"), F.coalesce(at("e", "cited_by_count", "long"), F.lit(0).cast("long")).alias("cited_by_count"), inverted_abstract(index).alias("abstract"), F.transform(F.coalesce(F.try_variant_get(F.col("e"), "$.referenced_works", "array<string>"), F.array().cast("array<string>")), lambda x: short_id(x)).alias("references"))


def journal_metrics(docs: DataFrame, v: str = "json") -> DataFrame:
    """source_id, title, issn, eissn, venue_type, sjr, snip (struct year, value; the latest) of serial-title responses."""
    e = items(docs, v, "['serial-metadata-response'].entry", "e")

    def latest(name: str) -> Column:
        rows = F.coalesce(F.try_variant_get(F.col("e"), f"$.{name}List.{name}", "array<variant>"), F.array_compact(F.array(F.try_variant_get(F.col("e"), f"$.{name}List.{name}", "variant"))))
        made = F.transform(rows, lambda x: F.struct(F.try_variant_get(x, "$['@year']", "string").try_cast("int").alias("year"), F.try_variant_get(x, "$['$']", "string").try_cast("double").alias("value")))
        return F.array_max(F.filter(made, lambda x: x["year"].isNotNull() & x["value"].isNotNull()))

    return e.select(at("e", "['source-id']").alias("source_id"), at("e", "['dc:title']").alias("title"), compact_issn(at("e", "['prism:issn']")).alias("issn"), compact_issn(at("e", "['prism:eIssn']")).alias("eissn"), venue_type(at("e", "['prism:aggregationType']")).alias("venue_type"), latest("SJR").alias("sjr"), latest("SNIP").alias("snip"))


def notices(docs: DataFrame, v: str = "json") -> DataFrame:
    """doi, type, label, date, notice_doi, source of update notices; a date's parts are joined as they come."""
    e = items(docs, v, "message.items", "e").drop("pos")
    u = items(e, "e", "['update-to']", "u")
    parts = F.coalesce(F.try_variant_get(F.col("u"), "$.updated['date-parts'][0]", "array<string>"), F.array().cast("array<string>"))
    return u.select(bare_doi(at("u", "DOI")).alias("doi"), F.lower(at("u", "type")).alias("type"), at("u", "label").alias("label"), F.array_join(parts, "-").alias("date"), bare_doi(at("e", "DOI")).alias("notice_doi"), at("u", "source").alias("source"))


def by_title(wanted: DataFrame, works: DataFrame) -> DataFrame:
    """wanted (wanted_id, title, year) to the work with the same normal title within a year, most references first.

    works: work_id, title, year, n_refs. An equi join on the title, the year a residual condition.
    """
    a = wanted.withColumn("_t", normal_title(F.col("title"))).where("_t <> ''").select("wanted_id", "_t", F.col("year").alias("_y"))
    b = works.withColumn("_t", normal_title(F.col("title"))).select("work_id", "_t", "year", "n_refs")
    near = a.join(b, "_t").where("_y is null or year is null or abs(_y - year) <= 1")
    place = F.row_number().over(W.partitionBy("wanted_id").orderBy(F.desc("n_refs"), "work_id"))
    return near.withColumn("_r", place).where("_r = 1").select("wanted_id", "work_id")


def ranked_copies(locations: DataFrame, least: int = 5_000, tries: int = 6) -> DataFrame:
    """The best open copy of each doi: other kinds before HTML, published before accepted before unknown before preprint.

    locations: doi, url, kind, version, title, text. Urls that differ in case or a last slash are one; the first ``tries`` of a doi; a text needs ``least``
    characters and, but for JATS, its title near its beginning.
    """
    version = F.array_position(F.array(*[F.lit(x) for x in ("published", "accepted", "unknown", "preprint")]), F.coalesce("version", F.lit("unknown")))
    order = [(F.col("kind") == "html").cast("int"), version, "url"]
    same = F.lower(F.rtrim(F.col("url"), F.lit("/")))
    own = locations.withColumn("_s", F.row_number().over(W.partitionBy("doi", same).orderBy(*order))).where("_s = 1").drop("_s")
    own = own.withColumn("_r", F.row_number().over(W.partitionBy("doi").orderBy(*order))).where(F.col("_r") <= tries)
    squash = lambda c: F.regexp_replace(F.lower(c), r"(?U)[^\w]+|_", "")
    fits = (F.length("text") >= least) & ((F.col("kind") == "jats") | F.substring(squash(F.col("text")), 1, 6000).contains(squash(F.col("title"))))
    return own.where(fits).withColumn("_p", F.row_number().over(W.partitionBy("doi").orderBy("_r"))).where("_p = 1").drop("_r", "_p")


def facet_counts(rows: DataFrame, facet: str) -> DataFrame:
    return rows.where(F.col(facet).isNotNull()).groupBy(facet).agg(F.count(F.lit(1)).alias("n"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A coding sheet; its delimiter is the most frequent of comma, semicolon and tab in the header line."""
    head = (spark.read.text(path).limit(1).first() or [""])[0].lstrip("﻿")
    sep = max(",;\t", key=head.count)
    return spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)


def _list_of(v: str, path: str) -> Column:
    """The elements of a list as variants, or the one object."""
    one, many = (F.try_variant_get(F.col(v), _path(path), kind) for kind in ("variant", "array<variant>"))
    return F.coalesce(many, F.array_compact(F.array(one)))


def _part(x: Column, path: str) -> Column:
    return F.try_variant_get(x, _path(path), "string")


def abstract_details(docs: DataFrame, v: str = "json") -> DataFrame:
    """scopus_id, doi, title, description, abstract_source, venue, cover_date, cited_by_count, authors (structs) of abstract responses.

    Authors come from the authors block, else from the creators.
    """
    r, core = "['abstracts-retrieval-response']", "['abstracts-retrieval-response'].coredata"
    full, brief = _list_of(v, f"{r}.authors.author"), _list_of(v, f"{core}['dc:creator'].author")
    authors = F.transform(F.when(F.size(full) > 0, full).otherwise(brief), lambda a: F.struct(_part(a, "['@auid']").alias("auth_id"), _part(a, "['ce:indexed-name']").alias("name"), _part(a, "['ce:surname']").alias("surname"), F.coalesce(_part(a, "['ce:initials']"), _part(a, "['ce:given-name']")).alias("initials")))
    text = scalar(v, f"{core}['dc:description']")
    get = lambda n: scalar(v, f"{core}['{n}']")
    return docs.select(to_provider_id(get("dc:identifier")).alias("scopus_id"), get("prism:doi").alias("doi"), get("dc:title").alias("title"), text.alias("description"), F.when(text.isNotNull(), "scopus").otherwise("none").alias("abstract_source"), get("prism:publicationName").alias("venue"), get("prism:coverDate").alias("cover_date"), get("citedby-count").try_cast("long").alias("cited_by_count"), authors.alias("authors"), scalar(v, f"{r}.item.bibrecord.tail.bibliography['@refcount']").try_cast("int").alias("refs_reported"))


def best_view(answers: DataFrame, order: tuple[str, ...] = ("FULL", "META_ABS", "META", "REF")) -> DataFrame:
    """key, view, json: of each key's answers (key, view, json, null where the view was refused) the first in the order of views."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("view"))
    own = answers.where(F.col("json").isNotNull()).withColumn("_p", place).where("_p > 0")
    least = own.groupBy("key").agg(F.min("_p").alias("_p"))
    return own.join(least, ["key", "_p"]).select("key", "view", "json").dropDuplicates(["key"])


def with_abstract(details: DataFrame, others: list[tuple[str, DataFrame]], own: str = "scopus") -> DataFrame:
    """details (doi, description and more) with description and abstract_source of the first that has a text: the record itself (own), then the others by DOI, else none.

    others: (name, a table of doi, abstract); of several abstracts of a DOI the least counts. Records without a DOI keep what
    they have.
    """
    out = details.drop("abstract_source").withColumn("_0", blank_to_null(F.col("description")))
    for k, (_, df) in enumerate(others, 1):
        each = df.where(blank_to_null(F.col("abstract")).isNotNull()).groupBy(F.lower("doi").alias("_d")).agg(F.min("abstract").alias(f"_{k}"))
        out = out.join(each, F.lower("doi") == F.col("_d"), "left").drop("_d")
    names = [own, *[name for name, _ in others]]
    source = F.coalesce(*[F.when(F.col(f"_{k}").isNotNull(), F.lit(name)) for k, name in enumerate(names)], F.lit("none"))
    return out.withColumns({"description": F.coalesce(*[F.col(f"_{k}") for k in range(len(names))]), "abstract_source": source}).drop(*[f"_{k}" for k in range(len(names))])


def identifiers(docs: DataFrame, v: str = "json") -> DataFrame:
    """scopus_id, eid, doi, pii, pubmed_id of abstract responses."""
    get = lambda n: scalar(v, f"['abstracts-retrieval-response'].coredata['{n}']")
    return docs.select(to_provider_id(get("dc:identifier")).alias("scopus_id"), get("eid").alias("eid"), get("prism:doi").alias("doi"), get("pii").alias("pii"), get("pubmed-id").alias("pubmed_id"))


def author_profiles(docs: DataFrame, v: str = "json") -> DataFrame:
    """author_id, orcid, counts, surname, given_name, affiliation (the first current one) of author responses."""
    r = "['author-retrieval-response']"
    get, name = (lambda n: scalar(v, f"{r}.coredata['{n}']")), (lambda n: scalar(v, f"{r}['author-profile']['preferred-name']['{n}']"))
    place = F.get(_list_of(v, f"{r}['author-profile']['affiliation-current'].affiliation"), 0)
    return docs.select(F.replace(get("dc:identifier"), F.lit("AUTHOR_ID:"), F.lit("")).alias("author_id"), get("orcid").alias("orcid"), get("document-count").try_cast("long").alias("document_count"), get("cited-by-count").try_cast("long").alias("cited_by_count"), get("citation-count").try_cast("long").alias("citation_count"), name("surname").alias("surname"), name("given-name").alias("given_name"), _part(place, "['ip-doc'].afdispname").alias("affiliation"))


def found_authors(docs: DataFrame, v: str = "json") -> DataFrame:
    """author_id, name, variants, subjects, document_count, affiliation of author searches; lists distinct, in order."""
    e = items(docs, v, "['search-results'].entry", "e").where(at("e", "error").isNull())
    full = lambda x: F.concat_ws(", ", blank_to_null(_part(x, "surname")), blank_to_null(_part(x, "['given-name']")))
    variants = F.array_distinct(F.filter(F.transform(_list_of("e", "['name-variant']"), full), lambda x: x != ""))
    subjects = F.array_distinct(F.array_compact(F.transform(_list_of("e", "['subject-area']"), lambda x: _part(x, "['$']"))))
    name = F.concat_ws(", ", scalar("e", "['preferred-name'].surname"), scalar("e", "['preferred-name']['given-name']"))
    return e.select("pos", F.replace(scalar("e", "['dc:identifier']"), F.lit("AUTHOR_ID:"), F.lit("")).alias("author_id"), name.alias("name"), variants.alias("variants"), subjects.alias("subjects"), scalar("e", "['document-count']").try_cast("long").alias("document_count"), scalar("e", "['affiliation-current']['affiliation-name']").alias("affiliation"))


def index_authors(docs: DataFrame, v: str = "json") -> DataFrame:
    """openalex_id, name, works_count, cited_by_count, topics (the first three) of an open index's authors."""
    e = items(docs, v, "results", "e")
    topics = F.slice(F.array_compact(F.transform(_list_of("e", "topics"), lambda x: _part(x, "display_name"))), 1, 3)
    return e.select("pos", short_id(at("e", "id")).alias("openalex_id"), at("e", "display_name").alias("name"), at("e", "orcid").alias("orcid"), at("e", "works_count", "long").alias("works_count"), at("e", "cited_by_count", "long").alias("cited_by_count"), topics.alias("topics"))


def index_sources(docs: DataFrame, v: str = "json") -> DataFrame:
    """An open index's journals with its own measures."""
    e = items(docs, v, "results", "e")
    return e.select(short_id(at("e", "id")).alias("openalex_id"), at("e", "display_name").alias("title"), at("e", "host_organization_name").alias("publisher"), compact_issn(at("e", "issn_l")).alias("issn"), F.try_variant_get(F.col("e"), "$.issn", "array<string>").alias("issns"), at("e", "summary_stats['2yr_mean_citedness']", "double").alias("two_year_mean_citedness"), at("e", "summary_stats.h_index", "int").alias("h_index"), at("e", "summary_stats.i10_index", "int").alias("i10_index"), at("e", "works_count", "long").alias("works_count"), at("e", "cited_by_count", "long").alias("cited_by_count"))


def article_hits(docs: DataFrame, v: str = "json") -> DataFrame:
    """title, creator, authors, venue, cover_date, doi, pii, open_access of a publisher's full-text search."""
    e = items(docs, v, "results", "e")
    names = F.array_compact(F.transform(_list_of("e", "authors"), lambda a: _part(a, "name")))
    return e.select("pos", at("e", "title").alias("title"), F.get(names, 0).alias("creator"), names.alias("authors"), at("e", "sourceTitle").alias("venue"), at("e", "publicationDate").alias("cover_date"), bare_doi(at("e", "doi")).alias("doi"), at("e", "pii").alias("pii"), F.coalesce(at("e", "openAccess", "boolean"), F.lit(False)).alias("open_access"))


def bibliographies(docs: DataFrame, citing: str, v: str = "json") -> DataFrame:
    """Entries of full bibliographies in the shape of references: ids by their type, the year as it stands."""
    e = items(docs, v, "['abstracts-retrieval-response'].item.bibrecord.tail.bibliography.reference", "e")
    ids = _list_of("e", "['ref-info']['refd-itemidlist'].itemid")
    of = lambda kind: _part(F.get(F.filter(ids, lambda x: F.upper(_part(x, "['@idtype']")) == kind), 0), "['$']")
    authors = F.array_compact(F.transform(_list_of("e", "['ref-info']['ref-authors'].author"), lambda a: _part(a, "['ce:indexed-name']")))
    return e.select(citing, "pos", of("SGR").alias("ref_scopus_id"), bare_doi(of("DOI")).alias("ref_doi"), scalar("e", "['ref-info']['ref-title']['ref-titletext']").alias("title"), authors.alias("authors"), scalar("e", "['ref-info']['ref-sourcetitle']").alias("source"), year_of(scalar("e", "['ref-info']['ref-publicationyear']['@first']")).alias("year"))


def resolved(wanted: DataFrame, by_doi: DataFrame, by_other: DataFrame, by_name: DataFrame) -> DataFrame:
    """wanted_id, work_id, route of the first way that finds a work: DOI, another id, exact title within a year.

    wanted: wanted_id, doi, other; by_doi: doi, work_id; by_other: other, work_id; by_name: wanted_id, work_id (see by_title).
    Where wanted and by_other have titles, a work found by the other id counts only if its title is nearly the same.
    """
    if "title" in wanted.columns and "title" in by_other.columns:
        met = wanted.select("other", bare_title(F.col("title")).alias("_t")).join(by_other, "other").withColumn("_u", bare_title(F.col("title")))
        by_other = met.where("_t <> '' and _u <> ''").where(ratio(F.col("_t"), F.col("_u")) >= SIMILAR).select("other", "work_id").distinct()
    a, b, c = by_doi.select(F.lower("doi").alias("_d"), F.col("work_id").alias("_a")), by_other.select(F.col("other").alias("_o"), F.col("work_id").alias("_b")), by_name.select("wanted_id", F.col("work_id").alias("_c"))
    own = wanted.join(a, F.lower("doi") == F.col("_d"), "left").join(b, F.col("other") == F.col("_o"), "left").join(c, "wanted_id", "left")
    route = F.when(F.col("_a").isNotNull(), "doi").when(F.col("_b").isNotNull(), "other id").when(F.col("_c").isNotNull(), "title").otherwise("none")
    return own.select("wanted_id", F.coalesce("_a", "_b", "_c").alias("work_id"), route.alias("route"))
