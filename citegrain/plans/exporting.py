"""Export files and open copies: rows of the star schema are written as files and answers of services, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import copies, export_source, exports, landed, sinks
from ..tables import new_path
from .star import CITES, citations, table

QUERIES, ORACLE_SQL = {}, {}

#: Records of a stand-in file.
IN_FILE = 500


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(rows: DataFrame, key: str, suffix: str, entry: Column, head: str = "") -> DataFrame:
    """The records of files of IN_FILE entries each, in a head and the order of the key."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), entry.alias("e")))), lambda x: x["e"])
    files = rows.groupBy(F.floor(F.col(key) / IN_FILE).alias("n")).agg(F.concat(F.lit(head), F.array_join(entries, "\n"), F.lit("\n")).alias("t"))
    found = exports.records(files.select(F.concat(F.lit("f"), F.col("n").cast("string"), F.lit(suffix)).alias("file"), F.encode("t", "utf-8").alias("content")))
    listed = lambda c: F.array_join(c, ";").alias(c)
    return found.select("scopus_id", "wos_id", "doi", "title", "year", listed("authors"), "source", listed("author_keywords"), listed("index_keywords"), "abstract", "format")


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _tagged(*pairs: tuple[str, Column], joint: str) -> Column:
    return F.array_join(F.array(*[F.concat(F.lit(tag + joint), value) for tag, value in pairs]), "\n")


def _parts(spark, d):
    return table(spark, d, "part").withColumns({"year": (1950 + F.col("p_size")).cast("string"), "maker": F.col("p_brand")})


_COMMON = "p_name AS title, (1950 + p_size)::INT AS year"


@query(f"""SELECT p_partkey::VARCHAR AS scopus_id, NULL::VARCHAR AS wos_id, '10.1/p' || p_partkey AS doi, {_COMMON}, 'One A.;Two ' || p_size AS authors, p_type AS source, p_name || ';' || p_brand AS author_keywords,
p_type AS index_keywords, 'Of "' || p_name || '", and more' AS abstract, 'scopus_csv' AS format FROM part""")
def export_csv(spark, d):
    """Parts as a table of comma-separated fields with quotes in them."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    fields = [
        F.concat(F.lit("One A., Two "), _s("p_size")), F.col("p_name"), F.col("year"), F.col("p_type"), F.concat(F.lit("https://doi.org/10.1/P"), _s("p_partkey")),
        F.concat_ws("; ", "p_name", "p_brand"), F.col("p_type"), F.concat(F.lit('Of "'), F.col("p_name"), F.lit('", and more')), F.concat(F.lit("2-s2.0-"), _s("p_partkey")),
    ]
    head = "Authors,Title,Year,Source title,DOI,Author Keywords,Index Keywords,Abstract,EID\n"
    return _read(_parts(spark, d), "p_partkey", ".csv", F.concat_ws(",", *[quoted(x) for x in fields]), "﻿" + head)


_RIS = f"""SELECT CASE WHEN p_size > 25 THEN p_partkey::VARCHAR END AS scopus_id, NULL::VARCHAR AS wos_id, '10.1/p' || p_partkey AS doi, {_COMMON}, 'One, A.;' || p_brand AS authors, p_type AS source, p_brand || ';' || p_type AS author_keywords,
'' AS index_keywords, p_comment AS abstract, 'ris' AS format FROM (SELECT *, p_name || '!' AS p_comment FROM part)"""


def _ris() -> Column:
    link = F.concat(F.when(F.col("p_size") > 25, F.lit("https://x/?eid=2-s2.0-")).otherwise(F.lit("https://x/")), _s("p_partkey"))
    return _tagged(
        ("TY", F.lit("JOUR")), ("TI", F.col("p_name")), ("TI", F.lit("no title")), ("AU", F.lit("One, A.")), ("A1", F.col("maker")), ("PY", F.concat(F.col("year"), F.lit("/05/06"))), ("JO", F.col("p_type")),
        ("DO", F.concat(F.lit("10.1/P"), _s("p_partkey"))), ("KW", F.col("p_brand")), ("KW", F.col("p_type")), ("N2", F.concat("p_name", F.lit("!"))), ("UR", link), ("ER", F.lit("")), joint="  - ",
    )


@query(_RIS)
def export_ris(spark, d):
    """Parts as tagged records; some have their id in a link, and the first of two titles counts."""
    return _read(_parts(spark, d), "p_partkey", ".txt", _ris())


@query(_RIS)
def export_split(spark, d):
    """The same records, written as files and read by the data source, each file in ranges of 16 KB."""
    path = new_path(spark)
    _parts(spark, d).select(_ris().alias("value")).write.text(path)
    found = export_source.read(spark, path, 16_384)
    listed = lambda c: F.array_join(c, ";").alias(c)
    return found.select("scopus_id", "wos_id", "doi", "title", "year", listed("authors"), "source", listed("author_keywords"), listed("index_keywords"), "abstract", "format")


@query(f"""SELECT NULL::VARCHAR AS scopus_id, NULL::VARCHAR AS wos_id, CASE WHEN p_size > 25 THEN '10.1/p' || p_partkey END AS doi, {_COMMON}, 'One, A.;' || p_brand AS authors, p_type AS source, p_brand || ';' || p_type AS author_keywords,
'' AS index_keywords, NULL::VARCHAR AS abstract, 'bibtex' AS format FROM part""")
def export_bibtex(spark, d):
    """Parts as BibTeX with braces in titles; the venue is a journal's or a book's."""
    venue = F.when(F.col("p_size") % 2 == 0, F.lit("journal")).otherwise(F.lit("booktitle"))
    doi = F.when(F.col("p_size") > 25, F.concat(F.lit(",\n  doi = {10.1/P"), _s("p_partkey"), F.lit("}"))).otherwise(F.lit(""))
    entry = F.concat(
        F.lit("@article{k"), _s("p_partkey"), F.lit(",\n  title = {{"), F.col("p_name"), F.lit("}},\n  author = {One, A. and "), F.col("maker"), F.lit("},\n  year = "), F.col("year"), F.lit(",\n  "), venue, F.lit(' = "'), F.col("p_type"),
        F.lit('",\n  keywords = {'), F.col("p_brand"), F.lit("; "), F.col("p_type"), F.lit("}"), doi, F.lit("\n}"),
    )
    return _read(_parts(spark, d), "p_partkey", ".bib", entry)


_FIELDS = f"""SELECT NULL::VARCHAR AS scopus_id, lpad(p_partkey::VARCHAR, 9, '0') AS wos_id, '10.1/p' || p_partkey AS doi, {_COMMON}, 'One, A;' || p_brand AS authors, p_type AS source, p_brand || ';' || p_type AS author_keywords,
p_type AS index_keywords, p_name || ' and more' AS abstract, """


def _wos(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"ut": F.concat(F.lit("WOS:"), F.lpad(_s("p_partkey"), 9, "0")), "di": F.concat(F.lit("10.1/P"), _s("p_partkey")), "de": F.concat_ws("; ", "p_brand", "p_type")})


@query(_FIELDS + "'wos_plain' AS format FROM part")
def export_field_lists(spark, d):
    """Parts as records of two-letter tags, authors and abstracts on several lines."""
    lines = (("PT", "J"), ("AU", "One, A\n   "), ("TI", "p_name"), ("SO", "p_type"), ("DE", "de"), ("ID", "p_type"), ("AB", "p_name"), ("PY", "year"), ("DI", "di"), ("UT", "ut"))
    own = _wos(_parts(spark, d))
    value = {"PT": F.lit("J"), "AU": F.concat(F.lit("One, A\n   "), F.col("maker")), "AB": F.concat("p_name", F.lit("\n   and more"))}
    entry = F.concat(_tagged(*[(tag, value.get(tag, F.col(c) if c in own.columns else F.lit(c))) for tag, c in lines], joint=" "), F.lit("\nER\n"))
    return _read(own, "p_partkey", ".txt", entry, "FN some index\nVR 1.0\n")


@query(_FIELDS + "'wos_tab' AS format FROM part")
def export_tab_delimited(spark, d):
    """Parts as a table delimited by tabs, without quoting."""
    own = _wos(_parts(spark, d))
    fields = [F.lit("J"), F.concat(F.lit("One, A; "), F.col("maker")), "p_name", "p_type", "de", "p_type", F.concat("p_name", F.lit(" and more")), "year", "di", "ut"]
    return _read(own, "p_partkey", ".txt", F.concat_ws("\t", *fields), "\t".join(("PT", "AU", "TI", "SO", "DE", "ID", "AB", "PY", "DI", "UT")) + "\n")


def _locations(spark, d) -> DataFrame:
    """Suppliers as papers with copies at six services."""
    s = table(spark, d, "supplier").withColumns({"doi": F.concat(F.lit("10.1/s"), _s("s_suppkey")), "k": _s("s_suppkey")})
    answer = lambda c: s.select("doi", F.parse_json(F.to_json(c)).alias("json"))
    place = lambda *cs: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in cs])
    x = lambda prefix, suffix="": F.concat(F.lit(prefix), F.col("k"), F.lit(suffix))
    index = F.struct(F.array(place(("is_oa", True), ("pdf_url", x("http://i/", ".pdf")), ("version", "acceptedVersion")), place(("is_oa", False), ("pdf_url", x("http://closed/")), ("version", "acceptedVersion"))).alias("locations"))
    graph = F.struct(place(("url", x(" http://g/", "?a=.pdf "))).alias("openAccessPdf"), place(("ArXiv", F.when(F.col("s_nationkey") < 10, x("p.")))).alias("externalIds"))
    articles = F.struct(place(("result", F.array(place(("pmcid", x("PMC")), ("isOpenAccess", F.when(F.col("s_nationkey") < 5, "Y").otherwise("N")), ("inEPMC", "Y"))))).alias("resultList"))
    registry = F.struct(F.array(place(("url_for_pdf", F.lit(None).cast("string")), ("url", x("HTTP://I/", ".PDF/")), ("host_type", "publisher"), ("version", "publishedVersion"))).alias("oa_locations"))
    works = F.struct(F.array(place(("downloadUrl", x("http://c/", ".pdf"))), place(("downloadUrl", F.lit("")))).alias("results"))
    feed = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>http://arxiv.org/abs/0</id><title>Other</title></entry><entry><id>http://arxiv.org/abs/"), F.col("k"), F.lit("</id><title>\n "), F.upper("s_name"), F.lit("</title></entry></feed>"))
    made = [copies.from_index(answer(index)), copies.from_graph(answer(graph)), copies.from_preprints(s.select("doi", F.col("s_name").alias("title"), feed.alias("xml"))), copies.from_articles(answer(articles)), copies.from_registry(answer(registry)), copies.from_aggregator(answer(works))]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


_COPIES = """SELECT '10.1/s' || s_suppkey AS doi, u AS url, source, version, kind FROM (
SELECT s_suppkey, 'http://i/' || s_suppkey || '.pdf' AS u, 'OpenAlex: repository' AS source, 'accepted' AS version, 'pdf' AS kind FROM supplier
UNION ALL SELECT s_suppkey, 'http://g/' || s_suppkey || '?a=.pdf', 'Semantic Scholar', NULL, 'html' FROM supplier
UNION ALL SELECT s_suppkey, 'https://arxiv.org/pdf/p.' || s_suppkey, 'arXiv', 'preprint', 'pdf' FROM supplier WHERE s_nationkey < 10
UNION ALL SELECT s_suppkey, 'https://arxiv.org/pdf/' || s_suppkey, 'arXiv', 'preprint', 'pdf' FROM supplier
UNION ALL SELECT s_suppkey, 'https://www.ebi.ac.uk/europepmc/webservices/rest/PMC' || s_suppkey || '/fullTextXML', 'Europe PMC', 'published', 'jats' FROM supplier WHERE s_nationkey < 5
UNION ALL SELECT s_suppkey, 'HTTP://I/' || s_suppkey || '.PDF/', 'Unpaywall: publisher', 'published', 'html' FROM supplier
UNION ALL SELECT s_suppkey, 'http://c/' || s_suppkey || '.pdf', 'CORE', NULL, 'pdf' FROM supplier)"""


@query(_COPIES)
def open_copies(spark, d):
    return _locations(spark, d)


@query(f"""WITH l AS ({_COPIES}), t AS (SELECT *, array_position(['published', 'accepted', 'unknown', 'preprint'], coalesce(version, 'unknown')) AS v FROM l),
o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY doi, lower(rtrim(url, '/')) ORDER BY kind = 'html', v, url) = 1)
SELECT doi, url, source FROM o WHERE kind <> 'html' QUALIFY row_number() OVER (PARTITION BY doi ORDER BY v, url) = 1""")
def best_copies(spark, d):
    """The first copy in rank whose text is long and has the title at its beginning; landing pages are short."""
    text = F.concat(F.when(F.col("kind") == "html", F.lit("short")).otherwise(F.repeat(F.lit("Some Title, "), 500)))
    return landed.ranked_copies(_locations(spark, d).withColumns({"title": F.lit("some title"), "text": text})).select("doi", "url", "source")


@query(f"""WITH e AS MATERIALIZED ({CITES}), n AS (SELECT o_orderkey AS node, o_orderpriority AS label, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders)
SELECT '*Vertices ' || count(*) AS line FROM n UNION ALL SELECT i || ' "' || label || '"' FROM n UNION ALL SELECT '*Arcs' UNION ALL SELECT a.i || ' ' || b.i || ' 1' FROM e JOIN n a ON a.node = source JOIN n b ON b.node = target""")
def pajek_lines(spark, d):
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("label"))
    return sinks.pajek_lines(nodes, citations(spark, d).withColumn("weight", F.lit(1))).select("line")


@query("""SELECT o_custkey AS corpus_id, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey""")
def corpus_members(spark, d):
    """Orders of the customers that a table of ids names."""
    from ..operators import scopes

    wanted = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("paper_id"))
    papers = table(spark, d, "orders").select(F.col("o_custkey").alias("paper_id"))
    return scopes.corpus(papers, wanted=wanted).groupBy(F.col("paper_id").alias("corpus_id")).agg(F.count(F.lit(1)).alias("n"))
