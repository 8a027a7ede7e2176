"""Title joins against all pairs, searches by the index against the texts themselves, and other look-ups."""

import random
from difflib import SequenceMatcher
from itertools import product

import pytest
from pyspark.sql import functions as F

from citegrain.operators import audit, fulltext, mentions, titles
from citegrain.sources import landed, sinks


def made_titles(seed=7):
    """Short and long titles, and others that differ by a few letters, whole words or nothing."""
    rng = random.Random(seed)
    words = "journal of the applied logistics review on models in supply chain risk and trust a new data study".split()
    left = [" ".join(rng.choices(words, k=rng.choice([1, 1, 2, 3, 6, 12, 25]))).capitalize() for _ in range(70)] + ["", None, "ab", "abc", "abcdefgh", "Technology1", "one two"]
    right = []
    for t in left:
        for _ in range(3):
            x = list(t or "")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if x:
                    k = rng.randrange(len(x))
                    x[k : k + rng.choice([0, 1])] = rng.choice(["", "q", "z"])
            right.append("".join(x) + rng.choice(["", "", "1", "."]))
    return list(enumerate(left)), list(enumerate(right))


def plain(t):
    import re

    return re.sub(r"(?<=[a-z])\d$", "", " ".join(re.findall("[0-9a-z]+", (t or "").lower())))


@pytest.mark.parametrize("least", [0.9, 0.85, 1.0])
def test_similar_titles_are_all_pairs(spark, least):
    left, right = made_titles()
    got = {(r.a, r.b): round(r.ratio, 9) for r in titles.similar_titles(spark.createDataFrame(left, "a long, title string"), spark.createDataFrame(right, "b long, title string"), least).collect()}
    want = {}
    for (a, s), (b, t) in product(left, right):
        s, t = plain(s), plain(t)
        if s and t and (q := SequenceMatcher(None, s, t).ratio()) >= least:
            want[a, b] = round(q, 9)
    assert got == want and len(want) > 40


def test_a_least_ratio_that_the_index_cannot_serve(spark):
    df = spark.createDataFrame([(1, "x")], "a long, title string")
    with pytest.raises(ValueError):
        titles.similar_titles(df, df.withColumnRenamed("a", "b"), 0.8)


TEXTS = [
    (1, "A dance language is shown. The Dance  language of bees. No abundance\nlanguages here."),
    (2, "Bees dance. Language follows."),
    (3, "language dance dance language dance language"),
    (4, None),
    (5, ""),
    (6, "The bees and their dance; a language (see below). dance\tlanguage"),
    (7, "Nothing of it.\nReferences\nSmith, A. (2001). The dance language.\n"),
]


@pytest.mark.parametrize("query", ['"dance language"', '"language"', "dance bees", '"bees" "dance language"', "language", "absentword", '"dance language of"', "a of"])
def test_search_is_what_the_texts_say(spark, query):
    """The texts that the index gives are those with mentions, and the mentions shown are those of analyze()."""
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    shown, total = fulltext.search(docs, fulltext.index(docs), query, 10)
    rows = {r.doc_id: r for r in shown.collect()}
    every = {r.doc_id: r for r in mentions.analyze(docs, query).collect()}
    with_mentions = {d for d, r in every.items() if r.body_mentions + r.reference_list_mentions}
    assert with_mentions <= set(rows) and total.first().total == len(rows)
    assert all((r.body_mentions, r.reference_list_mentions, r.positions, r.snippets) == tuple(every[d])[1:] for d, r in rows.items())
    if query.startswith('"') and query.count('"') == 2:
        assert all(r.hits >= r.body_mentions for r in rows.values())


def test_search_orders_and_cuts(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    shown, total = fulltext.search(docs, fulltext.index(docs), '"dance language"', 2)
    assert [(r.place, r.doc_id, r.hits) for r in sorted(shown.collect())] == [(1, 1, 3), (2, 3, 2)] and total.first().total == 4
    assert fulltext.search(docs.where("false"), fulltext.index(docs.where("false")), "dance")[0].collect() == []


def test_pages_stop(spark):
    """A page that is empty, short, without anything new or with a stuck cursor ends a query; keys count where they are first."""
    full = {
        "enough": [["a", "b"], ["c", "d"], ["e", "f"], ["g", "h"]],
        "short": [["a", "b"], ["c"], ["x", "y"]],
        "empty": [["a", "b"], [], ["x", "y"]],
        "nothing new": [["a", "b"], ["b", "a"], ["x", "y"]],
        "stuck": [["a", "b"], ["b", "c"], ["x", "y"]],
        "end": [["a", "a"], ["b", None]],
    }
    entries = [(q, p, k, key) for q, ps in full.items() for p, keys in enumerate(ps) for k, key in enumerate(keys)]
    pages = [(q, p, f"c{p}", f"c{p if q == 'stuck' and p == 1 else p + 1}", 8) for q, ps in full.items() for p in range(len(ps))]
    dfs = [spark.createDataFrame(rows, schema).repartition(3) for rows, schema in ((pages, "query string, page int, cursor string, next string, total int"), (entries, "query string, page int, pos int, key string"))]
    taken, report = landed.paged(*dfs, 2, 5)
    assert {r.query: (r.pages, r.fetched, r.stopped, r.truncated) for r in report.collect()} == {
        "enough": (3, 5, "enough", True), "short": (2, 3, "short", True), "empty": (2, 2, "empty", True), "nothing new": (2, 2, "nothing new", True), "stuck": (2, 3, "stuck", True), "end": (2, 3, "end", True),
    }
    got = {}
    for r in sorted(taken.collect(), key=lambda r: (r.query, r.place)):
        got.setdefault(r.query, []).append(r.key)
    assert got == {"enough": list("abcde"), "short": list("abc"), "empty": list("ab"), "nothing new": list("ab"), "stuck": list("abc"), "end": ["a", "b", None]}


def test_numbers_without_one_task(spark):
    rows = spark.createDataFrame([(k * 7919 % 1009,) for k in range(1009)], "k long").repartition(7)
    assert {r.k: r["index"] for r in sinks.numbered(rows, ["k"]).collect()} == {k: k + 1 for k in range(1009)}
    assert sinks.numbered(rows.where("false"), ["k"]).collect() == []


def test_result_lines(spark):
    rows = spark.createDataFrame([("2", None, "2001-05-06", "x", 3), ("1", " ", "1999-01-01", "y", None)], "scopus_id string, doi string, cover_date string, publisher string, cited_by_count int")
    lines = lambda form: [r.line for r in sorted(sinks.result_lines(rows, ["scopus_id"], form, 1).collect())]
    assert lines("compact") == ['{"scopus_id":"1","year":"1999"}', '{"scopus_id":"2","year":"2001","cited_by_count":3}']
    assert lines("sample") == ['{"scopus_id":"1","cover_date":"1999-01-01","publisher":"y"}'] and len(lines("full")) == 2
    with pytest.raises(ValueError):
        lines("all")


def test_groups_of_a_report(spark):
    keys = [(f"k{k:02}", "not_in_index") for k in range(9)] + [("b", "cites_seed_but_missed"), ("a", "cites_seed_but_missed"), ("z", "found_but_unconfirmed"), ("q", "something else")]
    rows = sorted(audit.grouped_report(spark.createDataFrame(keys, "key string, status string")).collect(), key=lambda r: (r.place, r.item))
    assert [(r.place, r.n, r.item, r.key, r.more) for r in rows] == [(1, 2, 1, "a", 0), (1, 2, 2, "b", 0), (4, 1, 1, "z", 0), *[(5, 9, k + 1, f"k{k:02}", 3) for k in range(6)]]


def test_reference_totals(spark):
    from pyspark.sql import functions as F

    body = lambda total, refs: '{"abstracts-retrieval-response":{"references":{%s"reference":%s}}}' % (f'"@total-references":"{total}",' if total else "", refs)
    docs = spark.createDataFrame([("a", body(3, "[{},{}]")), ("b", body(5, "[{}]")), ("c", body(0, "{}")), ("d", body(2, "[{},{}]"))], "id string, j string").select("id", F.parse_json("j").alias("json"))
    assert {r.id: tuple(r)[1:] for r in landed.reference_totals(docs, "id").collect()} == {"a": (3, 2, 1, True), "b": (5, 1, 4, False), "c": (None, 1, 0, False), "d": (2, 2, 0, False)}


def test_views_and_abstracts_fall_back(spark):
    answers = spark.createDataFrame([("a", "META_ABS", "1"), ("a", "FULL", None), ("b", "META_ABS", "2"), ("b", "FULL", "3"), ("c", "FULL", None), ("d", "OTHER", "4")], "key string, view string, json string")
    assert {r.key: (r.view, r.json) for r in landed.best_view(answers).collect()} == {"a": ("META_ABS", "1"), "b": ("FULL", "3")}
    details = spark.createDataFrame([(1, "10.1/A", "own"), (2, "10.1/b", ""), (3, "10.1/c", None), (4, None, None), (5, None, "kept")], "id int, doi string, description string")
    one = spark.createDataFrame([("10.1/a", "x"), ("10.1/B", "of one"), ("10.1/c", " ")], "doi string, abstract string")
    two = spark.createDataFrame([("10.1/b", "of two"), ("10.1/C", "z"), ("10.1/C", "y")], "doi string, abstract string")
    got = {r.id: (r.description, r.abstract_source) for r in landed.with_abstract(details, [("one", one), ("two", two)]).collect()}
    assert got == {1: ("own", "scopus"), 2: ("of one", "one"), 3: ("y", "two"), 4: (None, "none"), 5: ("kept", "scopus")}
