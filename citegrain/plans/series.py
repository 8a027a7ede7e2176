"""Year series, periods and themes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, themes
from .star import TERMS, order_terms, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _refs(spark, d):
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return lines.join(part, lines.l_partkey == part.p_partkey).select((F.col("p_size") + 1950).alias("year"), F.col("p_partkey").alias("work"))


_RPYS = """WITH r AS (SELECT (p_size + 1950)::INT AS year, p_partkey AS work FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT y::INT AS year, count(work) AS n FROM range(1950, 2006) t(y) LEFT JOIN r ON r.year = y GROUP BY y),
g AS (SELECT year, n, median(n) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS median5 FROM s),
v AS (SELECT *, n - median5 AS deviation FROM g),
h AS (SELECT *, coalesce(lag(deviation) OVER (ORDER BY year), '-infinity'::DOUBLE) AS b, coalesce(lead(deviation) OVER (ORDER BY year), '-infinity'::DOUBLE) AS a FROM v),
k AS (SELECT year, n, median5, deviation, row_number() OVER (ORDER BY deviation DESC, year)::INT AS rank FROM h WHERE deviation > 0 AND deviation >= a AND deviation >= b QUALIFY rank <= 10) """


@query(_RPYS + "SELECT * FROM v")
def rpys_spectrogram(spark, d):
    return history.spectrogram(_refs(spark, d), 1950, 2005)


@query(_RPYS + "SELECT * FROM k")
def rpys_peaks(spark, d):
    return history.peaks(rpys_spectrogram(spark, d))


@query(_RPYS + """, c AS (SELECT r.year, work, k.n, count(*) AS n_work FROM r JOIN k ON k.year = r.year GROUP BY ALL)
SELECT year, work, n_work, row_number() OVER (PARTITION BY year ORDER BY n_work DESC, work)::INT AS place, round(max(n_work) OVER (PARTITION BY year) / n, 2) AS share_top_work FROM c QUALIFY place <= 3""")
def rpys_peak_works(spark, d):
    return history.peak_works(_refs(spark, d), rpys_peaks(spark, d))


def _yearly(rows: str) -> str:
    return f"""WITH r AS ({rows}), s AS (SELECT unnest(range(min(year), max(year) + 1))::INT AS year FROM r),
c AS (SELECT s.year, count(r.year) AS n FROM s LEFT JOIN r ON r.year = s.year GROUP BY s.year)
SELECT year, n, year = (SELECT year FROM c ORDER BY n DESC, year LIMIT 1) AS is_peak, (SELECT sum(n) FROM c)::BIGINT AS total FROM c"""


@query(_yearly("SELECT year(o_orderdate)::INT AS year FROM orders"))
def yearly_counts(spark, d):
    return history.yearly_counts(table(spark, d, "orders").select(F.year("o_orderdate").alias("year")))


@query("""WITH n AS (SELECT list_sort(list(year(o_orderdate)::INT)) AS ys, count(*) AS n FROM orders),
c AS (SELECT DISTINCT ys[round_even(k * n / 3.0, 0)::BIGINT + 1] AS cut FROM n, range(1, 3) t(k)),
s AS (SELECT cut FROM c, n WHERE cut > ys[1] UNION SELECT ys[1] FROM n)
SELECT (row_number() OVER (ORDER BY cut) - 1)::INT AS period, cut AS first_year, coalesce(lead(cut) OVER (ORDER BY cut) - 1, (SELECT ys[-1] FROM n))::INT AS last_year FROM s""")
def period_assignment(spark, d):
    return history.period_bounds(table(spark, d, "orders").select(F.year("o_orderdate").alias("year")))


@query(f"SELECT period, term, count(DISTINCT doc_id) AS freq FROM ({TERMS}) GROUP BY ALL")
def term_frequency(spark, d):
    return themes.term_frequency(order_terms(spark, d))


_VOCAB = f"""WITH t AS ({TERMS}), n AS (SELECT period, count(DISTINCT doc_id) AS n FROM t GROUP BY period),
v AS (SELECT period, term, count(DISTINCT doc_id) AS freq FROM t JOIN n USING (period) GROUP BY period, term, n HAVING freq >= 2 AND (n < 10 OR freq <= 0.5 * n)
  QUALIFY row_number() OVER (PARTITION BY period ORDER BY freq DESC, term) <= 150) """


def _vocabulary(spark, d):
    return themes.vocabulary(order_terms(spark, d))


@query(_VOCAB + "SELECT * FROM v")
def vocabulary_topk(spark, d):
    return _vocabulary(spark, d)


_PAIRS = _VOCAB + """, p AS (SELECT a.period, a.term AS a, b.term AS b, count(*) AS n, count(*) * count(*) / (va.freq * vb.freq) AS weight
  FROM t a JOIN t b ON a.period = b.period AND a.doc_id = b.doc_id AND a.term < b.term JOIN v va ON va.period = a.period AND va.term = a.term JOIN v vb ON vb.period = b.period AND vb.term = b.term
  GROUP BY a.period, a.term, b.term, va.freq, vb.freq) """


def _pairs(spark, d):
    return themes.cooccurrence(order_terms(spark, d), _vocabulary(spark, d))


@query(_PAIRS + "SELECT period, a, b, n, round(weight, 9) AS weight FROM p")
def cooccurrence_equivalence(spark, d):
    return _pairs(spark, d).withColumn("weight", F.round("weight", 9))


@query()
def theme_clusters(spark, d):
    return themes.clusters(_pairs(spark, d))


@query()
def theme_quadrants(spark, d):
    pairs = _pairs(spark, d)
    return themes.themes(order_terms(spark, d), _vocabulary(spark, d), pairs, themes.clusters(pairs))


def _member(spark, d):
    """A fixed partition of the terms: by their last word, named by the least term of the period."""
    from pyspark.sql import Window as W

    kind = F.element_at(F.split("term", " "), -1)
    return _vocabulary(spark, d).select("period", "term", F.min("term").over(W.partitionBy("period", kind)).alias("cluster"))


_MEMBER = _PAIRS + """, m AS (SELECT period, term, min(term) OVER (PARTITION BY period, string_split(term, ' ')[-1]) AS cluster FROM v),
w AS (SELECT p.*, x.cluster AS ca, y.cluster AS cb FROM p JOIN m x ON x.period = p.period AND x.term = a JOIN m y ON y.period = p.period AND y.term = b),
i AS (SELECT period, ca AS cluster, avg(weight) AS mean FROM w WHERE ca = cb GROUP BY ALL),
o AS (SELECT period, cluster, sum(weight) AS out FROM (SELECT period, weight, ca AS cluster FROM w WHERE ca <> cb UNION ALL SELECT period, weight, cb FROM w WHERE ca <> cb) GROUP BY ALL),
d AS (SELECT period, cluster, count(DISTINCT doc_id) AS n_docs FROM t JOIN m USING (period, term) GROUP BY ALL),
l AS (SELECT period, cluster, count(*)::INT AS n_terms, array_to_string(list(term ORDER BY freq DESC, term)[1:3], ' · ') AS label FROM m JOIN v USING (period, term) GROUP BY ALL),
q AS (SELECT period, cluster, label, n_terms, n_docs, round(10 * coalesce(out, 0), 3) AS centrality, round(100 * coalesce(mean, 0), 3) AS density FROM l JOIN d USING (period, cluster) LEFT JOIN i USING (period, cluster) LEFT JOIN o USING (period, cluster)),
u AS (SELECT period, list_sort(list(centrality))[(count(*) // 2) + 1] AS cm, list_sort(list(density))[(count(*) // 2) + 1] AS dm FROM q GROUP BY period),
h AS (SELECT q.*, CASE WHEN centrality >= cm AND density >= dm THEN 'motor' WHEN centrality >= cm THEN 'basic' WHEN density >= dm THEN 'niche' ELSE 'emerging or declining' END AS quadrant,
  row_number() OVER (PARTITION BY period ORDER BY n_docs DESC, label)::INT AS theme FROM q JOIN u USING (period)),
k AS (SELECT a.period AS from_period, a.theme AS source, b.period AS to_period, b.theme AS target, count(*) AS shared, count(*) / least(a.n_terms, b.n_terms) AS inc
  FROM h a JOIN m x ON x.period = a.period AND x.cluster = a.cluster JOIN m y ON y.period = x.period + 1 AND y.term = x.term JOIN h b ON b.period = y.period AND b.cluster = y.cluster GROUP BY a.period, a.theme, b.period, b.theme, a.n_terms, b.n_terms HAVING inc >= 0.1) """


def _given(spark, d):
    member = _member(spark, d)
    found = themes.themes(order_terms(spark, d), _vocabulary(spark, d), _pairs(spark, d), member)
    return found, member.join(found.select("period", "cluster", "theme"), ["period", "cluster"]).select("period", "theme", "term")


@query(_MEMBER + "SELECT * FROM h")
def theme_measures(spark, d):
    return _given(spark, d)[0]


@query(_MEMBER + "SELECT from_period, source, to_period, target, shared, round(inc, 2) AS inclusion FROM k")
def theme_evolution(spark, d):
    return themes.evolution(_given(spark, d)[1])


@query(_MEMBER + """, pr AS (SELECT to_period AS period, target AS theme, count(*) AS n FROM k GROUP BY ALL),
su AS (SELECT from_period AS period, source AS theme, count(*) AS n, max(pr.n) AS t FROM k JOIN pr ON pr.period = to_period AND pr.theme = target GROUP BY ALL)
SELECT h.period, h.theme, concat_ws(', ', CASE WHEN h.period > 0 THEN CASE WHEN pr.n IS NULL THEN 'new' WHEN pr.n > 1 THEN 'merged from several' END END,
  CASE WHEN h.period < 2 THEN CASE WHEN su.n IS NULL THEN 'vanishes' WHEN su.n > 1 THEN 'splits' WHEN t > 1 THEN 'merges' ELSE 'continues' END END) AS fate
FROM h LEFT JOIN pr ON pr.period = h.period AND pr.theme = h.theme LEFT JOIN su ON su.period = h.period AND su.theme = h.theme""")
def theme_fates(spark, d):
    found, member = _given(spark, d)
    return themes.fates(found, themes.evolution(member))


@query(f"""WITH t AS ({TERMS}), h AS (SELECT * FROM t WHERE contains(term, 'ring')), c AS (SELECT h.period, t.term, count(*) AS n FROM h JOIN t ON t.period = h.period AND t.doc_id = h.doc_id AND NOT contains(t.term, 'ring') GROUP BY h.period, t.term
  QUALIFY row_number() OVER (PARTITION BY h.period ORDER BY n DESC, t.term) <= 6)
SELECT h.period, count(DISTINCT doc_id) AS doc_mentions, array_to_string(list_sort(list(DISTINCT term)), '; ') AS keywords, (SELECT string_agg(term, '; ' ORDER BY n DESC, term) FROM c WHERE c.period = h.period) AS company FROM h GROUP BY h.period""")
def construct_track(spark, d):
    return themes.track(order_terms(spark, d), ["ring"])
