"""Audits, coder agreement, journal quality, records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import identity, terms
from ..operators import audit, biblio, networks
from ..sources import sinks
from .star import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_SHEET = "WITH s AS (SELECT quality::VARCHAR AS a, toxic::VARCHAR AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT count(*) AS n FROM s) "


@query(_SHEET + """, k AS (SELECT n, (SELECT count(*) FROM s WHERE a = b) / n AS po, (SELECT sum(x.c * y.c) FROM (SELECT a AS l, count(*) AS c FROM s GROUP BY a) x JOIN (SELECT b AS l, count(*) AS c FROM s GROUP BY b) y USING (l)) / (n * n) AS pe FROM t),
m AS (SELECT *, (po - pe) / (1 - pe) AS kappa, sqrt(po * (1 - po) / (n * (1 - pe) * (1 - pe))) AS se FROM k)
SELECT n, round(po, 9) AS po, round(pe, 9) AS pe, round(kappa, 9) AS kappa, round(se, 9) AS se, round(kappa - 1.96 * se, 9) AS ci_low, round(kappa + 1.96 * se, 9) AS ci_high,
CASE WHEN kappa < 0 THEN 'worse than chance' WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'substantial' ELSE 'almost perfect' END AS words FROM m""")
def cohen_kappa(spark, d):
    found = audit.cohen_kappa(table(spark, d, "labels"), "quality", "toxic")
    return found.select("n", *[F.round(c, 9).alias(c) for c in ("po", "pe", "kappa", "se", "ci_low", "ci_high")], "words")


@query(_SHEET + """, l AS (SELECT a AS label FROM s UNION SELECT b FROM s),
c AS (SELECT label, (SELECT count(*) FROM s WHERE a = label) AS n_a, (SELECT count(*) FROM s WHERE b = label) AS n_b, (SELECT count(*) FROM s WHERE a = label AND b = label) AS "both" FROM l),
k AS (SELECT c.*, (n - n_a - n_b + 2 * "both") / n AS po, (n_a * n_b + (n - n_a) * (n - n_b)) / (n * n) AS pe FROM c, t)
SELECT label, n_a, n_b, "both", round(2 * "both" / (n_a + n_b), 9) AS agreement, round((po - pe) / (1 - pe), 9) AS kappa FROM k""")
def kappa_per_label(spark, d):
    found = audit.per_label(table(spark, d, "labels"), "quality", "toxic")
    return found.withColumns({c: F.round(c, 9) for c in ("agreement", "kappa")})


@query(_SHEET + "SELECT x.l AS a, y.l AS b, (SELECT count(*) FROM s WHERE s.a = x.l AND s.b = y.l) AS n FROM (SELECT a AS l FROM s UNION SELECT b FROM s) x, (SELECT a AS l FROM s UNION SELECT b FROM s) y")
def confusion_matrix(spark, d):
    return audit.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality <> toxic")
def coding_disagreements(spark, d):
    return audit.disagreements(table(spark, d, "labels"), "quality", "toxic").select("doc_id", "quality", "toxic")


@query("""WITH r AS (SELECT o_orderkey AS paper_id, count(l_orderkey) AS got, (o_custkey % 12) AS known FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT paper_id, CASE WHEN got = 0 OR known = 0 THEN 'unknown' WHEN known - got >= 5 AND got < 0.9 * known THEN 'short' ELSE 'ok' END AS status FROM r""")
def completeness_flags(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    got = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("got"))
    papers = orders.join(got, orders.o_orderkey == got.l_orderkey, "left").select(F.col("o_orderkey").alias("paper_id"), "got", (F.col("o_custkey") % 12).alias("known"))
    return audit.completeness(papers, "got", "known").select("paper_id", "status")


@query("""SELECT p_partkey::VARCHAR AS doi, CASE WHEN p_partkey % 11 = 0 THEN 'a' WHEN p_partkey % 7 = 0 THEN 'b' ELSE 'c' END AS external_source,
CASE WHEN p_partkey % 11 = 0 THEN p_size WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size + 2 END AS n_external FROM part""")
def reference_counts_by_source(spark, d):
    part = table(spark, d, "part")
    doi = F.col("p_partkey").cast("string").alias("doi")
    rows = [part.select(doi, F.lit(s).alias("source"), F.when(cond, F.col("p_size") + add).otherwise(0).alias("n_refs")) for s, cond, add in (("a", F.col("p_partkey") % 11 == 0, 0), ("b", F.col("p_partkey") % 7 == 0, 1), ("c", F.lit(True), 2))]
    counts = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return audit.external_counts(part.select(doi), counts, ("a", "b", "c")).select("doi", "external_source", "n_external")


_KINDS = {"1-URGENT": "retraction", "2-HIGH": "expression_of_concern", "3-MEDIUM": "correction"}


@query("""WITH n AS (SELECT o_custkey AS c, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END AS w, o_orderkey AS k, o_orderdate AS d FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')),
g AS (SELECT c, max(w) AS w, max(strftime(d, '%Y-%m-%d') || lpad(k::VARCHAR, 12, '0')) AS m FROM n GROUP BY c)
SELECT c_custkey::VARCHAR AS doi, CASE WHEN c_custkey % 10 = 9 THEN 'unknown' WHEN w = 3 THEN 'retracted' WHEN w = 2 THEN 'concern' WHEN w = 1 THEN 'corrected' ELSE 'ok' END AS status, m AS latest FROM customer LEFT JOIN g ON c = c_custkey""")
def retraction_status(spark, d):
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.col("o_orderpriority"))
    day = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    own = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("doi"), kind.alias("type"), day.alias("label"), day.alias("date")).where("type is not null")
    checked = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("doi"), (F.col("c_custkey") % 10 != 9).alias("ok"))
    return audit.retraction_status(checked, own)


@query("""WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g')) AS t FROM documents),
g AS (SELECT list_sort(list(DISTINCT doc_id)) AS ids FROM n WHERE t <> '' GROUP BY t HAVING count(DISTINCT doc_id) > 1) SELECT array_to_string(ids, ',') AS ids FROM g""")
def possible_duplicates(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.lit(None).cast("string").alias("doi"), F.col("text").alias("title"), F.lit(2000).alias("year"))
    return networks.duplicate_groups(docs).select(F.array_join("ids", ",").alias("ids"))


def _citers(spark, d):
    """Orders found by the returned parts they hold, by status and by priority; seeds are the largest parts, what can't be verified is the dearest."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    refs = lines.select(F.col("l_orderkey").alias("citing_id"), (F.lit(1_000_000_000_000) + F.col("l_partkey")).alias("cited_id"))
    seeds = table(spark, d, "part").where("p_size = 50").select((F.lit(1_000_000_000_000) + F.col("p_partkey")).alias("paper_id"))
    found = lambda rows, name, key: rows.select(F.lit(name).alias("strategy"), F.col(key).alias("paper_id"))
    one = found(lines.where("l_returnflag = 'R'"), "by reference", "l_orderkey")
    two = found(orders.where("o_orderstatus = 'P'"), "by phrase", "o_orderkey")
    three = found(orders.where("o_orderpriority = '1-URGENT'"), "by venue", "o_orderkey")
    failed = orders.where("o_totalprice > 400000").select(F.col("o_orderkey").alias("paper_id"))
    hits = one.unionByName(two).unionByName(three)
    return hits, audit.resolve_citers(hits, refs, seeds, failed)


_CITERS = """WITH h AS (SELECT 'by reference' AS strategy, l_orderkey AS paper_id FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'by phrase', o_orderkey FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'by venue', o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'),
c AS (SELECT DISTINCT l_orderkey AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 50),
r AS (SELECT h.paper_id, array_to_string(list_sort(list(DISTINCT strategy)), '; ') AS strategies,
  CASE WHEN bool_or(o_totalprice > 400000) THEN 'verification_failed' WHEN bool_or(k IS NOT NULL) THEN 'confirmed' ELSE 'unconfirmed' END AS status
  FROM h JOIN orders ON h.paper_id = o_orderkey LEFT JOIN c ON k = h.paper_id GROUP BY h.paper_id) """


@query(_CITERS + "SELECT * FROM r")
def citer_verification(spark, d):
    return _citers(spark, d)[1]


@query(_CITERS + """, x AS (SELECT strategy, count(*) AS hits FROM h GROUP BY strategy), y AS (SELECT DISTINCT strategy, paper_id FROM h)
SELECT x.strategy, hits, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'unconfirmed') AS unconfirmed, count(*) FILTER (status = 'verification_failed') AS failed,
(SELECT count(*) FROM r WHERE status = 'confirmed') - count(*) FILTER (status = 'confirmed') AS confirmed_missed FROM x JOIN y USING (strategy) LEFT JOIN r USING (paper_id) GROUP BY x.strategy, hits""")
def strategy_table(spark, d):
    return audit.strategy_table(*_citers(spark, d))


@query(r"""WITH h AS (SELECT DISTINCT 'index ' || (regexp_extract(p_brand, '\d+')::INT % 3) AS i, l_orderkey AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT k, array_to_string(list_sort(list(i)), '+') AS region FROM h GROUP BY k) SELECT region, count(*) AS n FROM r GROUP BY region""")
def index_overlap_regions(spark, d):
    """Orders as works: a third of the brands is covered by each of three indexes."""
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    name = F.concat(F.lit("index "), (F.regexp_extract("p_brand", r"\d+", 0).cast("int") % 3).cast("string"))
    hits = lines.join(part, lines.l_partkey == part.p_partkey)
    return networks.regions(hits.select(name.alias("index_name"), F.col("l_orderkey").alias("key")))


_CHECKED = """WITH c AS (SELECT DISTINCT l_orderkey AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'ECONOMY'),
x AS (SELECT o_orderkey AS key, CASE WHEN o_orderpriority = '5-LOW' THEN 'not_in_index' WHEN o_orderkey IN (SELECT k FROM c) AND o_orderstatus <> 'F' THEN 'cites_seed_but_missed'
WHEN o_orderkey IN (SELECT k FROM c) THEN 'found_but_unconfirmed' WHEN o_orderstatus = 'F' THEN 'found_but_seed_not_in_refs' ELSE 'not_returned_by_search' END AS status FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'P') """


@query(_CHECKED + "SELECT * FROM x")
def cross_check(spark, d):
    """All orders as citers elsewhere; urgent ones are confirmed, part-shipped ones are seeds, low ones not indexed, finished ones found."""
    orders, part = table(spark, d, "orders").withColumn("key", F.col("o_orderkey")), table(spark, d, "part").where("p_type = 'ECONOMY'")
    citing = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("key"))
    of = lambda c: orders.where(c).select("key")
    return audit.cross_check(orders, of("o_orderpriority = '1-URGENT'"), of("o_orderstatus = 'P'"), of("o_orderpriority <> '5-LOW'"), citing, of("o_orderstatus = 'F'"))


_GROUPS = ", ".join(f"({i + 1}, '{s}', '{t}', {str(s in audit.BRIEF).lower()})" for i, (s, t) in enumerate(audit.GROUPS))


@query(_CHECKED + f""", g(place, status, title, brief) AS (VALUES {_GROUPS}), r AS (SELECT g.*, key, row_number() OVER (PARTITION BY status ORDER BY key) AS item, count(*) OVER (PARTITION BY status) AS n FROM x JOIN g USING (status))
SELECT place, status, title, n, item, key, CASE WHEN brief THEN greatest(0, n - {audit.SHOWN}) ELSE 0 END::BIGINT AS more FROM r WHERE NOT brief OR item <= {audit.SHOWN}""")
def cross_check_report(spark, d):
    return audit.grouped_report(cross_check(spark, d))


def _ranks(spark, d):
    """Parts as journals: category p_type and, of every third, the brand; percentile by price within the category."""
    part = table(spark, d, "part")
    cats = F.when(F.col("p_partkey") % 3 == 0, F.array("p_type", "p_brand")).otherwise(F.array("p_type"))
    fan = part.select(F.col("p_partkey").alias("source_id"), "p_retailprice", F.when(F.col("p_partkey") % 10 == 0, "conference proceedings").otherwise("journal").alias("venue_type"), F.explode(cats).alias("category"))
    pct = F.round(100 * F.percent_rank().over(W.partitionBy("category").orderBy("p_retailprice", "source_id")), 6)
    return fan.withColumn("percentile", pct).select("source_id", "category", "venue_type", "percentile", terms.quartile(F.col("percentile")).alias("quartile"))


_RANKS = """WITH f AS (SELECT p_partkey AS source_id, p_retailprice, CASE WHEN p_partkey % 10 = 0 THEN 'conference proceedings' ELSE 'journal' END AS venue_type, unnest(CASE WHEN p_partkey % 3 = 0 THEN [p_type, p_brand] ELSE [p_type] END) AS category FROM part),
g AS (SELECT *, round(100 * percent_rank() OVER (PARTITION BY category ORDER BY p_retailprice, source_id), 6) AS percentile FROM f),
r AS (SELECT source_id, category, venue_type, percentile, CASE WHEN percentile >= 75 THEN 'Q1' WHEN percentile >= 50 THEN 'Q2' WHEN percentile >= 25 THEN 'Q3' ELSE 'Q4' END AS quartile FROM g) """


@query(_RANKS + "SELECT * FROM r")
def quartiles(spark, d):
    return _ranks(spark, d)


@query(_RANKS + "SELECT category, source_id, percentile, quartile, ((row_number() OVER (PARTITION BY category ORDER BY percentile DESC, source_id) - 1) // 100)::BIGINT AS chunk FROM r WHERE category IN ('ECONOMY', 'Brand#1') AND percentile >= 60 AND venue_type = 'journal'")
def find_journals(spark, d):
    return biblio.find_journals(_ranks(spark, d), ["ECONOMY", "Brand#1"], 60)


@query(_RANKS + """, p AS (SELECT l_orderkey, l_partkey AS source_id, p_name AS venue FROM lineitem JOIN part ON l_partkey = p_partkey), x AS (SELECT * FROM p JOIN r USING (source_id)),
v AS (SELECT category, venue, count(*) AS n FROM x GROUP BY category, venue QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, venue) <= 3),
c AS (SELECT category, count(*) FILTER (venue_type = 'journal') AS papers, count(*) FILTER (venue_type = 'journal' AND quartile = 'Q1') AS q1, count(*) FILTER (venue_type = 'journal' AND quartile = 'Q2') AS q2,
  count(*) FILTER (venue_type = 'journal' AND quartile = 'Q3') AS q3, count(*) FILTER (venue_type = 'journal' AND quartile = 'Q4') AS q4, count(*) FILTER (venue_type <> 'journal') AS non_journal FROM x GROUP BY category)
SELECT c.*, (SELECT string_agg(venue, '; ' ORDER BY n DESC, venue) FROM v WHERE v.category = c.category) AS top_venues, round(q1 / papers, 2) AS q1_share FROM c ORDER BY papers + non_journal DESC, category LIMIT 15""")
def topic_landscape(spark, d):
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    papers = lines.join(part, lines.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("source_id"), F.col("p_name").alias("venue"))
    return biblio.landscape(papers, _ranks(spark, d))


@query("""WITH p AS (SELECT l_partkey AS source_id, p_name AS venue FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT venue, count(*) AS n, round(count(*) / (SELECT count(*) FROM p), 4) AS share FROM p WHERE source_id % 4 = 0 GROUP BY venue ORDER BY n DESC, venue LIMIT 5""")
def venue_mix(spark, d):
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    papers = lines.join(part, lines.l_partkey == part.p_partkey).select(F.col("l_partkey").alias("source_id"), F.col("p_name").alias("venue"))
    return biblio.unranked(papers, part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("source_id")))


@query("""SELECT p_type AS metric, p_brand AS source_id, max_by(p_retailprice, p_size * 1000000 + p_retailprice) AS value, max(p_size) AS year FROM part GROUP BY ALL""")
def latest_metric(spark, d):
    part = table(spark, d, "part")
    return biblio.latest_metric(part.select(F.col("p_brand").alias("source_id"), F.col("p_type").alias("metric"), F.col("p_size").alias("year"), F.col("p_retailprice").alias("value"))).select("metric", "source_id", "value", "year")


def _records(spark, d):
    """Customers as records: provider ids shared by some, DOIs by others."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 200).cast("string")).alias("provider_id"), F.lit(None).cast("string").alias("wos_id"), F.when(F.col("c_custkey") % 3 == 1, (F.col("c_custkey") % 150).cast("string")).alias("doi"), F.lit("").alias("norm_title"), F.col("c_nationkey").alias("year"), F.array_repeat(F.lit("k"), (F.col("c_custkey") % 5).cast("int")).alias("keywords"))


@query("""WITH r AS (SELECT c_custkey AS pos, CASE c_custkey % 3 WHEN 0 THEN 's' || (c_custkey % 200) WHEN 1 THEN 'd' || (c_custkey % 150) ELSE 'p' || c_custkey END AS k, c_nationkey AS y, c_custkey % 5 AS w FROM customer)
SELECT min(pos) AS pos, min_by(y, pos) AS year, max(w)::INT AS n_keywords, count(*) AS n_records FROM r GROUP BY k""")
def dedup_records(spark, d):
    return audit.deduplicated(_records(spark, d)).select("pos", "year", F.size("keywords").alias("n_keywords"), "n_records")


@query("SELECT pos, key, CASE WHEN n = 1 THEN key WHEN r < 26 THEN key || chr((97 + r)::INT) ELSE key || r END AS unique_key FROM (SELECT p_partkey AS pos, replace(p_name, ' ', '_') AS key, count(*) OVER (PARTITION BY p_name) AS n, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS r FROM part)")
def bibtex_keys(spark, d):
    return biblio.unique_keys(table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("key")))


_ISSN = "lpad((p_partkey * 7919 % 10000000)::VARCHAR, 7, '0') || CASE p_size % 3 WHEN 0 THEN 'x' WHEN 1 THEN '5' ELSE 'q' END"


@query(f"SELECT p_partkey AS id, CASE WHEN p_size % 3 < 2 THEN upper({_ISSN}) END AS compact, CASE WHEN p_size % 3 < 2 THEN left(upper({_ISSN}), 4) || '-' || right(upper({_ISSN}), 4) END AS hyphened FROM part")
def issn_normalise(spark, d):
    raw = F.concat(F.lpad((F.col("p_partkey") * 7919 % 10_000_000).cast("string"), 7, "0"), F.element_at(F.array(F.lit("x"), F.lit("5"), F.lit("q")), F.col("p_size") % 3 + 1))
    shown = F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 4))
    full = lambda c: F.when(identity.compact_issn(shown).isNotNull(), c)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), identity.compact_issn(shown).alias("compact"), full(identity.hyphened_issn(shown)).alias("hyphened"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'eid' WHEN 1 THEN 'doi' WHEN 2 THEN 'pii' ELSE 'scopus_id' END AS kind FROM customer""")
def id_type(spark, d):
    n = F.lpad(F.col("c_custkey").cast("string"), 15, "0")
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("2-s2.0-"), n)).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("https://doi.org/10.1000/"), n)).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("S"), n, F.lit("X"))).otherwise(n)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), identity.id_type(raw).alias("kind"))


@query("SELECT s_suppkey AS source, s_name AS x, s_acctbal AS y, (s_nationkey + 2000)::INT AS y_year, s_name || '; ' || s_nationkey AS tags FROM supplier")
def flat_rows(spark, d):
    s = table(spark, d, "supplier")
    return sinks.flat(s.select(F.col("s_suppkey").alias("source"), F.col("s_name").alias("x"), F.struct((F.col("s_nationkey") + 2000).alias("year"), F.col("s_acctbal").alias("value")).alias("y"), F.array("s_name", F.col("s_nationkey").cast("string")).alias("tags")))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50")
def second_page(spark, d):
    return sinks.page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 2)


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def facet_counts(spark, d):
    from ..sources.landed import facet_counts as counts

    return counts(table(spark, d, "events"), "event_type")
