"""Landed responses: rows of the star schema are written as the JSON that services answer with, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import identity
from ..operators import networks, paths, scopes
from ..sources import landed, sinks
from .star import CITES, citations, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _object(**fields) -> Column:
    """A struct; a name's __ stands for a colon, its _- for a hyphen."""
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k.replace("__", ":").replace("_-", "-")) for k, v in fields.items()])


def _named(name: str, value: Column) -> Column:
    return F.struct(value.alias(name))


def _text(key: str, width: int = 10) -> Column:
    return F.lpad(F.col(key).cast("string"), width, "0")


#: Entries of a page of a group's answers, about.
PAGE = 1_000


def _answers(rows: DataFrame, group: str, key: str | Column, entry: Column, wrap) -> DataFrame:
    """One response for each group, its entries in the order of the key."""
    return _listed(rows, [group], key, entry, wrap)


def _pages(rows: DataFrame, group: str, key: str, entry: Column, wrap) -> DataFrame:
    """As many responses of about PAGE entries, or fewer, for each group as its size asks for, an entry's page by its key."""
    number = F.greatest(F.lit(1), F.ceil(F.lit(rows.count()) / PAGE))
    return _listed(rows.withColumn("_page", F.pmod(F.xxhash64(key), number)), [group, "_page"], key, entry, wrap)


def _listed(rows: DataFrame, by: list[str], key: str | Column, entry: Column, wrap) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    by_key = lambda x, y: F.when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(0)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), entry.alias("e"))), by_key), lambda x: x["e"])
    return rows.groupBy(*by).agg(listed.alias("es")).select(by[0], F.parse_json(F.to_json(wrap(F.col("es")))).alias("json"))


_ID = "lpad(c_custkey::VARCHAR, 10, '0')"


@query(f"""SELECT {_ID} AS scopus_id, '2-s2.0-' || {_ID} AS eid, '10.1000/ab' || c_custkey AS doi, c_name AS title, nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, '') AS creator,
lpad((c_custkey * 7919 % 10000000)::VARCHAR, 7, '0') || 'X' AS issn, (1950 + c_custkey % 70)::INT AS year, c_custkey % 50 AS cited_by_count FROM customer""")
def search_results(spark, d):
    """Customers as search results, a response for each nation; titles as objects, some creators blank."""
    k = F.col("c_custkey")
    entry = _object(
        dc__identifier=F.concat(F.lit("SCOPUS_ID:"), _text("c_custkey")), eid=F.concat(F.lit("2-s2.0-"), _text("c_custkey")), prism__doi=F.concat(F.lit("https://doi.org/10.1000/AB"), k.cast("string")),
        dc__title=_named("$", F.col("c_name")), dc__creator=F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(""), prism__issn=F.concat(F.lpad((k * 7919 % 10_000_000).cast("string"), 7, "0"), F.lit("x")),
        prism__coverDate=F.concat((1950 + k % 70).cast("string"), F.lit("-05-06")), prism__aggregationType="Journal", **{"citedby_-count": (k % 50).cast("string")},
    )
    wrap = lambda es: _named("search-results", F.struct(F.size(es).cast("string").alias("opensearch:totalResults"), es.alias("entry")))
    found = landed.search_results(_pages(table(spark, d, "customer"), "c_nationkey", "c_custkey", entry, wrap))
    return found.select("scopus_id", "eid", "doi", "title", "creator", "issn", "year", "cited_by_count")



def _reference_lists(spark, d):
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    rows = lines.join(part, lines.l_partkey == part.p_partkey)
    p = F.col("l_partkey")
    author = lambda i: F.struct((p + i).cast("string").alias("@auid"), F.concat(F.lit("Author "), (p + i).cast("string")).alias("ce:indexed-name"))
    entry = F.struct(
        _text("l_partkey", 8).alias("scopus-id"), F.concat(F.lit("10.2000/P"), p.cast("string")).alias("ce:doi"), F.col("p_name").alias("title"), F.col("p_brand").alias("sourcetitle"),
        F.concat((1950 + F.col("p_size")).cast("string"), F.lit("-01-01")).alias("prism:coverDate"), F.struct(F.array(author(0), author(1), author(0)).alias("author")).alias("author-list"),
    )
    wrap = lambda es: _named("abstracts-retrieval-response", _named("references", _named("reference", es)))
    return _answers(rows, "l_orderkey", F.struct("l_linenumber", _text("l_partkey", 8)), entry, wrap)


@query("""SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, lpad(l_partkey::VARCHAR, 8, '0')) - 1)::INT AS pos, lpad(l_partkey::VARCHAR, 8, '0') AS ref_scopus_id, '10.2000/p' || l_partkey AS ref_doi, p_name AS title,
'Author ' || l_partkey || '; Author ' || (l_partkey + 1) AS authors, p_brand AS source, (1950 + p_size)::INT AS year FROM lineitem JOIN part ON l_partkey = p_partkey""")
def reference_lists(spark, d):
    """Line items as reference lists of orders; a repeated author is named once."""
    return landed.references(_reference_lists(spark, d), "l_orderkey").withColumn("authors", F.array_join("authors", "; "))


@query(f"""WITH e AS (SELECT DISTINCT l_partkey AS cited_id, l_orderkey AS citing_id FROM lineitem) SELECT 'o' || a.citing_id AS citing_id, 'p' || a.cited_id AS cited_id FROM e a""")
def references_within(spark, d):
    """References that point into a set of orders and parts: half by id, half by DOI."""
    lines, orders, part = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    ident = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    papers = orders.select(ident("o", "o_orderkey").alias("paper_id"), F.lit(None).cast("string").alias("doi")).unionByName(part.select(ident("p", "p_partkey").alias("paper_id"), ident("10.2000/P", "p_partkey").alias("doi")))
    by_id = F.col("l_returnflag") == "R"
    refs = lines.select(ident("o", "l_orderkey").alias("citing_id"), F.when(by_id, ident("p", "l_partkey")).alias("ref_id"), F.when(~by_id, ident("10.2000/p", "l_partkey")).alias("ref_doi"))
    return networks.link_within(refs, papers).select("citing_id", "cited_id")


@query("""SELECT 'W' || p_partkey AS openalex_id, '10.2000/w' || p_partkey AS doi, p_name AS title, p_brand || '; ' || p_type AS authors, (1950 + p_size)::INT AS year, p_type AS venue, p_partkey % 90 AS cited_by_count,
p_brand || ' of ' || p_type || ' of' AS abstract, 'W' || (p_partkey + 1) AS refs FROM part""")
def index_works(spark, d):
    """Parts as works of an open index, abstracts as word positions."""
    p = F.col("p_partkey")
    url = lambda k: F.concat(F.lit("https://openalex.org/W"), k.cast("string"))
    words = F.create_map(F.lit("of"), F.array(F.lit(1), F.lit(3)), F.col("p_brand"), F.array(F.lit(0)), F.col("p_type"), F.array(F.lit(2)))
    person = lambda c: _named("author", _named("display_name", F.col(c)))
    entry = _object(id=url(p), doi=F.concat(F.lit("https://doi.org/10.2000/W"), p.cast("string")), title=F.col("p_name"), authorships=F.array(person("p_brand"), person("p_type")), publication_year=1950 + F.col("p_size"),
        primary_location=_named("source", _named("display_name", F.col("p_type"))), cited_by_count=p % 90, abstract_inverted_index=words, referenced_works=F.array(url(p + 1)))
    found = landed.works(_pages(table(spark, d, "part"), "p_brand", "p_partkey", entry, lambda es: _named("results", es)))
    return found.select("openalex_id", "doi", "title", F.array_join("authors", "; ").alias("authors"), "year", "venue", "cited_by_count", "abstract", F.array_join("references", ";").alias("refs"))


@query("""SELECT s_suppkey::VARCHAR AS source_id, s_name AS title, lpad((s_suppkey * 7919 % 10000000)::VARCHAR, 7, '0') || '5' AS issn, 2021::INT AS sjr_year, s_suppkey / 4 AS sjr, (2015 + s_nationkey)::INT AS snip_year, s_suppkey / 8 AS snip FROM supplier""")
def journal_metrics(spark, d):
    """Suppliers as journals with yearly measures; the latest counts, and what is no number does not."""
    s = F.col("s_suppkey")
    year = lambda y, v: F.struct(y.cast("string").alias("@year"), v.cast("string").alias("$"))
    entry = F.struct(
        s.cast("string").alias("source-id"), F.col("s_name").alias("dc:title"), F.concat(F.lpad((s * 7919 % 10_000_000).cast("string"), 7, "0"), F.lit("5")).alias("prism:issn"),
        _named("SJR", F.array(year(F.lit(2019), s), year(F.lit(2021), s / 4), year(F.lit(2022), F.lit("n/a")))).alias("SJRList"), _named("SNIP", year(2015 + F.col("s_nationkey"), s / 8)).alias("SNIPList"),
    )
    found = landed.journal_metrics(_pages(table(spark, d, "supplier"), "s_nationkey", "s_suppkey", entry, lambda es: _named("serial-metadata-response", _named("entry", es))))
    return found.select("source_id", "title", "issn", F.col("sjr.year").alias("sjr_year"), F.col("sjr.value").alias("sjr"), F.col("snip.year").alias("snip_year"), F.col("snip.value").alias("snip"))


@query("""SELECT '10.3000/c' || o_custkey AS doi, CASE WHEN o_orderstatus = 'F' THEN 'retraction' ELSE 'correction' END AS type, o_orderpriority AS label, year(o_orderdate) || '-' || month(o_orderdate) AS date, '10.4000/n' || o_orderkey AS notice_doi FROM orders""")
def update_notices(spark, d):
    """Orders as notices on their customers, dates in parts."""
    orders = table(spark, d, "orders")
    parts = F.array(F.array(F.year("o_orderdate"), F.month("o_orderdate")))
    update = F.struct(F.concat(F.lit("10.3000/C"), F.col("o_custkey").cast("string")).alias("DOI"), F.when(F.col("o_orderstatus") == "F", "Retraction").otherwise("Correction").alias("type"), F.col("o_orderpriority").alias("label"), _named("date-parts", parts).alias("updated"))
    entry = F.struct(F.concat(F.lit("10.4000/N"), F.col("o_orderkey").cast("string")).alias("DOI"), F.array(update).alias("update-to"))
    found = landed.notices(_pages(orders, "o_orderpriority", "o_orderkey", entry, lambda es: _named("message", _named("items", es))))
    return found.select("doi", "type", "label", "date", "notice_doi")


def _abstracts(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    core = F.struct(
        F.concat(F.lit("SCOPUS_ID:"), _text("c_custkey")).alias("dc:identifier"), F.concat(F.lit("2-s2.0-"), _text("c_custkey")).alias("eid"), F.concat(F.lit("10.1000/AB"), k.cast("string")).alias("prism:doi"), F.concat(F.lit("S"), _text("c_custkey")).alias("pii"),
        F.col("c_name").alias("dc:title"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("dc:description"), F.col("c_mktsegment").alias("prism:publicationName"), F.lit("2001-02-03").alias("prism:coverDate"), (k % 50).cast("string").alias("citedby-count"),
        _named("author", F.array(F.struct(k.cast("string").alias("@auid"), F.col("c_name").alias("ce:indexed-name")))).alias("dc:creator"),
    )
    return c.select("c_custkey", F.parse_json(F.to_json(_named("abstracts-retrieval-response", _named("coredata", core)))).alias("json"))


@query(f"""SELECT {_ID} AS scopus_id, '10.1000/AB' || c_custkey AS doi, c_name AS title, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS description, CASE WHEN c_acctbal > 0 THEN 'scopus' ELSE 'none' END AS abstract_source,
c_mktsegment AS venue, '2001-02-03' AS cover_date, c_custkey % 50 AS cited_by_count, c_custkey || ' ' || c_name AS authors FROM customer""")
def abstract_details(spark, d):
    found = landed.abstract_details(_abstracts(spark, d))
    return found.select("scopus_id", "doi", "title", "description", "abstract_source", "venue", "cover_date", "cited_by_count", F.array_join(F.transform("authors", lambda a: F.concat_ws(" ", a["auth_id"], a["name"])), ";").alias("authors"))


@query(f"SELECT {_ID} AS scopus_id, '2-s2.0-' || {_ID} AS eid, '10.1000/AB' || c_custkey AS doi, 'S' || {_ID} AS pii FROM customer")
def record_identifiers(spark, d):
    return landed.identifiers(_abstracts(spark, d)).select("scopus_id", "eid", "doi", "pii")


@query("SELECT c_custkey::VARCHAR AS author_id, c_mktsegment AS surname, c_name AS given_name, c_custkey % 9 AS document_count, c_custkey % 90 AS cited_by_count, n_name AS affiliation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def author_profiles(spark, d):
    """Customers as authors; the first of two current affiliations counts."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    core = F.struct(F.concat(F.lit("AUTHOR_ID:"), k.cast("string")).alias("dc:identifier"), (k % 9).cast("string").alias("document-count"), (k % 90).cast("string").alias("cited-by-count"))
    place = lambda c: _named("ip-doc", _named("afdispname", c))
    profile = F.struct(F.struct(F.col("c_mktsegment").alias("surname"), F.col("c_name").alias("given-name")).alias("preferred-name"), _named("affiliation", F.array(place(F.col("n_name")), place(F.lit("elsewhere")))).alias("affiliation-current"))
    docs = rows.select(F.parse_json(F.to_json(_named("author-retrieval-response", F.struct(core.alias("coredata"), profile.alias("author-profile"))))).alias("json"))
    return landed.author_profiles(docs).select("author_id", "surname", "given_name", "document_count", "cited_by_count", "affiliation")


@query("SELECT c_custkey::VARCHAR AS author_id, c_mktsegment || ', ' || c_name AS name, c_name || ', X' AS variants, c_mktsegment AS subjects, c_custkey % 9 AS document_count FROM customer")
def found_authors(spark, d):
    """Customers as hits of an author search; variants and subjects named twice count once."""
    k, variant = F.col("c_custkey"), F.struct(F.col("c_name").alias("surname"), F.lit("X").alias("given-name"))
    entry = F.struct(F.concat(F.lit("AUTHOR_ID:"), k.cast("string")).alias("dc:identifier"), F.struct(F.col("c_mktsegment").alias("surname"), F.col("c_name").alias("given-name")).alias("preferred-name"), F.array(variant, variant).alias("name-variant"),
        F.array(_named("$", F.col("c_mktsegment")), _named("$", F.col("c_mktsegment"))).alias("subject-area"), (k % 9).cast("string").alias("document-count"))
    found = landed.found_authors(_pages(table(spark, d, "customer"), "c_nationkey", "c_custkey", entry, lambda es: _named("search-results", _named("entry", es))))
    return found.select("author_id", "name", F.array_join("variants", ";").alias("variants"), F.array_join("subjects", ";").alias("subjects"), "document_count")


@query("SELECT 'S' || s_suppkey AS openalex_id, s_name AS title, n_name AS publisher, lpad(s_suppkey::VARCHAR, 7, '0') || 'X' AS issn, s_suppkey / 8 AS two_year_mean_citedness, s_nationkey AS h_index FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def index_sources(spark, d):
    s = F.col("s_suppkey")
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    entry = _object(id=F.concat(F.lit("https://openalex.org/S"), s.cast("string")), display_name=F.col("s_name"), host_organization_name=F.col("n_name"), issn_l=F.concat(F.lpad(s.cast("string"), 7, "0"), F.lit("X")), summary_stats=F.struct((s / 8).alias("2yr_mean_citedness"), F.col("s_nationkey").alias("h_index")))
    found = landed.index_sources(_pages(rows, "s_nationkey", "s_suppkey", entry, lambda es: _named("results", es)))
    return found.select("openalex_id", "title", "publisher", "issn", "two_year_mean_citedness", "h_index")


@query("SELECT p_name AS title, p_brand AS creator, p_type AS venue, '10.5000/a' || p_partkey AS doi, p_size > 25 AS open_access FROM part")
def article_hits(spark, d):
    entry = _object(title=F.col("p_name"), authors=F.array(_named("name", F.col("p_brand")), _named("name", F.col("p_type"))), sourceTitle=F.col("p_type"), doi=F.concat(F.lit("10.5000/A"), F.col("p_partkey").cast("string")), openAccess=F.when(F.col("p_size") > 25, True))
    found = landed.article_hits(_pages(table(spark, d, "part"), "p_brand", "p_partkey", entry, lambda es: _named("results", es)))
    return found.select("title", "creator", "venue", "doi", "open_access")


@query("""SELECT c_custkey AS wanted_id, CASE c_custkey % 4 WHEN 0 THEN 'd' || c_custkey WHEN 1 THEN 'o' || c_custkey WHEN 2 THEN 't' || c_custkey END AS work_id, CASE c_custkey % 4 WHEN 0 THEN 'doi' WHEN 1 THEN 'other id' WHEN 2 THEN 'title' ELSE 'none' END AS route FROM customer""")
def resolution_routes(spark, d):
    """Customers found by DOI, by another id, by title, or not at all."""
    k = F.col("c_custkey")
    own = table(spark, d, "customer").select(k.alias("wanted_id"), F.concat(F.lit("10.1/A"), k.cast("string")).alias("doi"), F.concat(F.lit("x"), k.cast("string")).alias("other"))
    work = lambda rest, p: own.where(F.col("wanted_id") % 4 == rest).withColumn("work_id", F.concat(F.lit(p), F.col("wanted_id").cast("string")))
    by_doi = work(0, "d").select(F.lower("doi").alias("doi"), "work_id")
    return landed.resolved(own, by_doi, work(1, "o").select("other", "work_id"), work(2, "t").select("wanted_id", "work_id"))


@query("""SELECT doc_id::VARCHAR AS doi, CASE WHEN length(text) >= 5000 THEN 'publisher' WHEN n_chars % 2 = 0 THEN 'open copy' WHEN lang = 'en' THEN 'abstract' ELSE 'none' END AS provenance,
length(CASE WHEN length(text) >= 5000 THEN text WHEN n_chars % 2 = 0 THEN 'copy ' || doc_id WHEN lang = 'en' THEN 'short' END)::INT AS n FROM documents""")
def fulltext_provenance(spark, d):
    """Documents as publishers' texts, if they are long enough; else copies for some and abstracts for others."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doi"), "text", "n_chars", "lang")
    copies = docs.where("n_chars % 2 = 0").select("doi", F.concat(F.lit("copy "), F.col("doi")).alias("text"))
    found = scopes.fulltext(docs.select("doi", "text"), copies, docs.where("lang = 'en'").select("doi", F.lit("short").alias("text")))
    return found.select("doi", "provenance", F.length("text").alias("n"))


@query("SELECT p_partkey AS id, p_brand || ' ' || (1950 + p_size) AS label, 't:' || lower(regexp_replace(p_brand, '#.*', '')) || ':' || p_name AS key, regexp_replace(p_brand, '[^A-Za-z]', '', 'g') || '_' || (1950 + p_size) AS bib FROM part")
def record_labels(spark, d):
    """Labels and keys of parts as works without ids."""
    p = table(spark, d, "part")
    none, year, authors = F.lit(None).cast("string"), 1950 + F.col("p_size"), F.array(F.col("p_brand"))
    return p.select(F.col("p_partkey").alias("id"), identity.node_label(F.col("p_brand"), year, F.col("p_name"), none).alias("label"), identity.cited_work_key(none, none, none, F.array(F.regexp_replace("p_brand", "#.*", "")), F.col("p_name")).alias("key"), identity.citation_key_parts(authors, year).alias("bib"))


@query(f"SELECT source, target FROM ({CITES}) JOIN orders a ON a.o_orderkey = source JOIN orders b ON b.o_orderkey = target WHERE year(a.o_orderdate) <> year(b.o_orderdate)")
def edges_between_generations(spark, d):
    """Citations among orders of different years; a year is a generation."""
    years = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.year("o_orderdate").alias("generation"))
    return paths.clean_edges(citations(spark, d), years)


@query("SELECT c_custkey, c_name FROM customer WHERE lpad((c_custkey * 7919 % 10000000)::VARCHAR, 7, '0') || '5' IN ('00079195', '00158385', '00237575')")
def journals_in_scope(spark, d):
    """Customers by ISSN, the scope given as a string of ISSNs of either form."""
    c = table(spark, d, "customer").withColumn("issn", F.concat(F.lpad((F.col("c_custkey") * 7919 % 10_000_000).cast("string"), 7, "0"), F.lit("5")))
    return scopes.in_scope(c, "0007-9195, 00158385;0023-7575", "issn").select("c_custkey", "c_name")


#: Entries of a page, and those that are asked for.
_SIZE, _MOST = 25, 100


@query(f"""WITH e AS (SELECT l_suppkey AS query, (row_number() OVER w - 1) // {_SIZE} AS page, row_number() OVER w AS pos, l_partkey AS key FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey)),
f AS (SELECT *, row_number() OVER (PARTITION BY query, key ORDER BY page, pos) = 1 AS new FROM e),
p AS (SELECT query, page, count(*) AS n, count(*) FILTER (new) AS added FROM f GROUP BY ALL),
b AS (SELECT *, coalesce(sum(added) OVER (PARTITION BY query ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY query) AS total FROM p),
w AS (SELECT *, CASE WHEN before + added >= {_MOST} THEN 'enough' WHEN n < {_SIZE} THEN 'short' WHEN added = 0 THEN 'nothing new' WHEN query % 5 = 0 AND page = 3 THEN 'stuck' END AS why FROM b),
s AS (SELECT query AS q, coalesce(min(page) FILTER (why IS NOT NULL), max(page)) AS last FROM w GROUP BY query)
SELECT query, count(*) AS pages, least(sum(added), {_MOST})::BIGINT AS fetched, coalesce(max(why), 'end') AS stopped, max(total)::BIGINT AS total, max(total) > least(sum(added), {_MOST}) AS truncated FROM w JOIN s ON q = query WHERE page <= last GROUP BY query""")
def paged_results(spark, d):
    """Suppliers as queries, their lines as entries on pages; parts come up again, and some cursors stay where they are."""
    number = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query"), number.alias("pos"), F.col("l_partkey").alias("key"))
    entries = lines.withColumn("page", F.floor(F.col("pos") / _SIZE).cast("long"))
    sizes = entries.groupBy("query").agg(F.count(F.lit(1)).alias("total"), F.max("page").alias("_l"))
    pages = sizes.select("query", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_l"))).alias("page"))
    cursor = lambda c: F.concat(F.lit("c"), c.cast("string"))
    stays = (F.col("query") % 5 == 0) & (F.col("page") == 3)
    pages = pages.withColumns({"cursor": cursor(F.col("page")), "next": cursor(F.when(stays, F.col("page")).otherwise(F.col("page") + 1))})
    return landed.paged(pages, entries, _SIZE, _MOST)[1]


@query("""SELECT l_orderkey AS order_key, (count(*) + l_orderkey % 3)::INT AS reported, count(*)::INT AS retrieved, (l_orderkey % 3)::INT AS unservable, l_orderkey % 3 = 1 AS phantom FROM lineitem GROUP BY l_orderkey""")
def reference_totals(spark, d):
    """Orders as papers whose lists are stated to be up to two references longer than they are."""
    lines = table(spark, d, "lineitem").withColumn("order_key", F.col("l_orderkey"))
    entry = F.struct(F.col("l_partkey").cast("string").alias("scopus-id"))
    extra = F.col("order_key") % 3
    wrap = lambda es: _named("abstracts-retrieval-response", _named("references", F.struct((F.size(es) + extra).cast("string").alias("@total-references"), es.alias("reference"))))
    return landed.reference_totals(_answers(lines, "order_key", "l_linenumber", entry, wrap), "order_key")


@query("""SELECT row_number() OVER (ORDER BY c_custkey) AS place, '{"scopus_id":"' || lpad(c_custkey::VARCHAR, 12, '0') || '"' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',"doi":"10.1/c' || c_custkey || '"' END || ',"year":"' || (1950 + c_custkey % 70) || '"'
|| CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ',"creator":"' || c_mktsegment || '"' END || ',"title":"' || c_name || '","cited_by_count":' || (c_custkey % 50) || '}' AS line FROM customer""")
def compact_results(spark, d):
    """Customers as records in the short form, by id."""
    k = F.col("c_custkey")
    records = table(spark, d, "customer").select(
        _text("c_custkey", 12).alias("scopus_id"), F.when(k % 3 != 0, F.concat(F.lit("10.1/c"), k.cast("string"))).alias("doi"), F.concat((1950 + k % 70).cast("string"), F.lit("-05-06")).alias("cover_date"),
        F.when(k % 2 == 0, " ").otherwise(F.col("c_mktsegment")).alias("creator"), F.col("c_name").alias("title"), (k % 50).alias("cited_by_count"), F.lit("not shown").alias("publisher"),
    )
    return sinks.result_lines(records, ["scopus_id"], "compact")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_name WHEN c_custkey % 4 IN (1, 2) AND c_nationkey > 12 THEN 'index ' || c_custkey WHEN c_custkey % 4 = 1 THEN 'registry ' || c_custkey END AS description,
CASE WHEN c_custkey % 4 = 0 THEN 'scopus' WHEN c_custkey % 4 IN (1, 2) AND c_nationkey > 12 THEN 'openalex' WHEN c_custkey % 4 = 1 THEN 'crossref' ELSE 'none' END AS abstract_source FROM customer""")
def abstract_sources(spark, d):
    """Customers whose abstract is their own, an index's (as an inverted list) or a registry's."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    doi = lambda p: F.concat(F.lit(p), k.cast("string"))
    details = c.select(k.alias("id"), doi("10.1/c").alias("doi"), F.when(k % 4 == 0, F.col("c_name")).otherwise(" ").alias("description"))
    words = F.create_map(F.lit("index"), F.array(F.lit(0)), k.cast("string"), F.array(F.lit(1)))
    index = c.where("c_custkey % 4 < 3 and c_nationkey > 12").select(doi("10.1/C").alias("doi"), landed.inverted_abstract(words).alias("abstract"))
    registry = c.where("c_custkey % 4 = 1").select(doi("10.1/c").alias("doi"), F.concat(F.lit("registry "), k.cast("string")).alias("abstract"))
    return landed.with_abstract(details, [("openalex", index), ("crossref", registry)]).select("id", "description", "abstract_source")
