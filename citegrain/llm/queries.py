"""The queries op1 to op13 and the pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversations, importance, licenses, line_dedup, mixing, quality_rules, secret_scan, simhash, spelling, spotsigs, token_counts, url_filter
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = quality_rules.judge(docs, quality_rules.fit_cutoffs(docs, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), width=4, radius=4)
    return groups.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_docs(table(spark, sf_dir, "documents"))
    base = ("assign", "access", "hex")
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own: Column = F.filter("spans", lambda x: x["kind"].isin(*base))
    return found.select("doc_id", *[number(k) for k in base], F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 2048)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.likeness(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), every=31)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_docs(table(spark, sf_dir, "documents"))
    places = [F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word")]
    return found.select("doc_id", "n_words", *places, *[F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")], "score", F.array_join("expressions", "; ").alias("expressions"), "openness")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damaged(rows), rows)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_simhash, op3_mixing, op4_line_dedup, op5_byte_bpe, op6_secret_scan, op7_token_counts, op8_url_filter, op9_spotsigs, op10_importance, op11_spelling, op12_licenses, op13_conversations, pipeline)
}

_RULES = quality_rules
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS r FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY rid),
f AS (
  SELECT rid, doc_id, stratum, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g'))::BIGINT AS n_capitals,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, CASE WHEN word_chars > 0 THEN least({_RULES.STEPS}, floor(n_symbols * {_RULES.STEPS} / word_chars)) ELSE 0 END AS symbols,
    CASE WHEN word_chars > 0 THEN least({_RULES.STEPS}, floor(n_capitals * {_RULES.STEPS} / word_chars)) ELSE 0 END AS capitals FROM f),
l AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
s AS (SELECT stratum, q, rule, bin FROM (SELECT stratum, min(q) AS q, symbols, capitals FROM b JOIN l USING (doc_id) GROUP BY stratum, t, symbols, capitals) UNPIVOT (bin FOR rule IN (symbols, capitals))),
g AS (SELECT stratum, rule, count(*) FILTER (q >= 1) AS n_good FROM s GROUP BY ALL),
k AS (SELECT g.stratum, g.rule, g.n_good, c.cut, (SELECT count(*) FROM s WHERE s.stratum = g.stratum AND s.rule = g.rule AND s.bin >= c.cut AND s.q >= 1) AS good,
    (SELECT count(*) FROM s WHERE s.stratum = g.stratum AND s.rule = g.rule AND s.bin >= c.cut AND s.q < 1) AS bad
  FROM g, (SELECT unnest(range(1, {_RULES.STEPS} + 1)) AS cut) c),
p AS (SELECT {_RULES.RISK / len(_RULES.RULES)!r}::DOUBLE AS risk, {_RULES.DELTA / len(_RULES.RULES)!r}::DOUBLE / (SELECT greatest(1, count(DISTINCT stratum)) FROM g) AS delta),
t AS (SELECT k.*, CASE WHEN good > n_good * risk THEN false
    ELSE list_sum(list_transform(range(0, good + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln(risk) + (n_good - i) * ln(1 - risk)))) <= delta END AS passes
  FROM k, p),
c AS (SELECT stratum, rule, cut FROM (
    SELECT *, bool_and(passes) OVER (PARTITION BY stratum, rule ORDER BY cut DESC) AS ok FROM t)
  WHERE ok AND bad - {_RULES.GOOD_WEIGHT} * good > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad - {_RULES.GOOD_WEIGHT} * good DESC, cut DESC) = 1),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(symbols >= (SELECT cut FROM c WHERE c.stratum = v.stratum AND rule = 'symbols'), false)
    AND NOT coalesce(capitals >= (SELECT cut FROM c WHERE c.stratum = v.stratum AND rule = 'capitals'), false) AS kept
FROM v
""",
}
