"""Whole results, and small functions of identifiers, journals, scopes and writers."""

import json

import pytest
from pyspark.sql import functions as F

from citegrain.functions import identity
from citegrain.operators import audit, biblio, fronts, history, mentions, networks, scopes, themes
from citegrain.sources import landed, sinks


def test_keys_of_works(spark):
    rows = spark.createDataFrame([("007", "W1", "10.1/A"), ("", "W1", "10.1/A"), (None, " ", "10.1/A"), (None, None, None)], "s string, o string, d string")
    got = rows.select(identity.node_key(F.col("s"), F.col("o"), F.col("d")).alias("n"), identity.coupling_key(F.col("s"), F.col("d")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("007", "007"), ("W1", "10.1/A"), ("doi:10.1/A", "10.1/A"), (None, None)]
    eids = spark.createDataFrame([("SCOPUS_ID:85",), ("2-s2.0-85",), ("85",)], "x string").select(identity.to_eid(F.col("x")).alias("e")).collect()
    assert {r.e for r in eids} == {"2-s2.0-85"}


def test_subject_ranks(spark):
    rows = [("s", 2020, "Complete", "all", "A", 80.0, 3), ("s", 2021, "Complete", "article", "A", 90.0, 1), ("s", 2021, "Complete", "ALL", "A", 50.0, 2), ("s", 2021, "Complete", "review", "B", 20.0, 9), ("s", 2022, "In-Progress", "all", "A", 99.0, 1), ("s", 2021, "Complete", "all", "C", 101.0, 1)]
    ranks = spark.createDataFrame(rows, "source_id string, year int, status string, doc_type string, category string, percentile double, rank int")
    assert sorted((r.category, r.percentile, r.quartile) for r in biblio.subject_ranks(ranks).collect()) == [("A", 50.0, "Q2"), ("B", 20.0, "Q4")]
    names = spark.createDataFrame([("1802", "Information Systems"), ("1400", "Management"), ("1405", "Management of Technology")], "code string, description string")
    assert biblio.resolve_categories(names, ["1802", "management", "technology"]) == ["1802", "1400", "1405"]
    for wrong in ("manage", "nothing"):
        with pytest.raises(ValueError):
            biblio.resolve_categories(names, [wrong])


def test_scopes(spark):
    people = spark.createDataFrame([("Cole", "Ann B.", "Univ of Nowhere"), ("Cole", "Bob", "Nowhere"), ("Coleman", "Ann", "Nowhere")], "surname string, given string, affiliation string")
    assert scopes.of_author(people, "Ann Cole", "nowhere univ").count() == 1 and scopes.of_author(people, "Cole,").count() == 2
    hits = spark.createDataFrame([("J", 2001, True, "2001-01-01", "b"), ("j", 2003, False, "2003-01-01", "a"), ("K", 2002, True, "2002-01-01", "c")], "venue string, year int, open_access boolean, cover_date string, title string")
    assert [r.title for r in scopes.request(hits, "J").collect()] == ["a", "b"] and [r.title for r in scopes.request(hits, open_only=True, offset=1, show=1).collect()] == ["b"]
    assert scopes.index_filter(["12345678", "1234567X"]) == "primary_location.source.issn:12345678|1234567X"


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("1", "10.1/a", "One", 3, "more")], "scopus_id string, doi string, title string, cited_by_count int, other string")
    sinks.write_records(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/json")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).columns == ["scopus_id", "doi", "title", "cited_by_count"]
    edges = spark.createDataFrame([("a", "b", 2)], "source string, target string, weight int")
    sinks.write_lineage("1", rows, ["a", "b"], edges, str(tmp_path / "l.json"))
    made = json.loads((tmp_path / "l.json").read_text())
    assert made["seed_id"] == "1" and made["main_path"] == ["a", "b"] and made["spc_edges"] == [{"source": "a", "target": "b", "weight": 2}]
    with pytest.raises(ValueError):
        sinks.write_lineage("1", rows, [], edges.union(edges), str(tmp_path / "m.json"), most=1)


def test_references_with_their_tail(spark):
    refs = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "citing_id string, pos int, title string")
    whole = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 0, "w")], "citing_id string, pos int, title string")
    got = sorted((r.citing_id, r.pos, r.recovered_from) for r in landed.missing_tail(refs, whole).collect())
    assert got == [("a", 0, None), ("a", 1, None), ("a", 2, "bibliography"), ("b", 0, "bibliography")]


def test_other_ids_need_a_like_title(spark):
    wanted = spark.createDataFrame([(1, None, "m1", "The Old Title of it"), (2, None, "m2", "Something quite else"), (3, "10.1/A", "m9", "x")], "wanted_id int, doi string, other string, title string")
    by_doi = spark.createDataFrame([("10.1/a", "w3")], "doi string, work_id string")
    by_other = spark.createDataFrame([("m1", "w1", "The old title of it1"), ("m2", "w2", "The old title")], "other string, work_id string, title string")
    by_name = spark.createDataFrame([(2, "w8")], "wanted_id int, work_id string")
    assert {r.wanted_id: (r.work_id, r.route) for r in landed.resolved(wanted, by_doi, by_other, by_name).collect()} == {1: ("w1", "other id"), 2: ("w8", "title"), 3: ("w3", "doi")}


def test_contexts_of_pairs(spark):
    long = "and this sentence is of sufficient length"
    texts = [f"Cole shows {long}", f"In Vol. 12, No. 3 of 2007, pp. 1-9 {long}", f"Vol 12, No 3 by COLE {long}", f"someone in 2007 {long}", f"someone in 1999 {long}", f"as in [3, 4] {long}", f"Coleman says {long}", f"others et al. say {long}", f"cole SHOWS {long}"]
    rows = spark.createDataFrame([("a", "b", k, t, "Cole", 2007, "sufficient") for k, t in enumerate(texts)], "citing_id string, cited_id string, pos int, context string, surname string, year int, term string")
    got = [r.context for r in sorted(mentions.clean_contexts(rows, 9).collect(), key=lambda r: r.place)]
    assert got == [texts[0], texts[2], texts[3], texts[5], texts[7]]
    pair = "citing_id string, cited_id string"
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("x", "b"), ("a", "y"), ("a", "e")], pair)
    lists = spark.createDataFrame([("a", "b", ["one"]), ("a", "c", [])], pair + ", contexts array<string>")
    back = spark.createDataFrame([("a", "d", ["two"])], pair + ", contexts array<string>")
    full = spark.createDataFrame([("a", "c", ["three"])], pair + ", contexts array<string>")
    known = spark.createDataFrame([(x,) for x in "abcde"], "paper_id string")
    out = {(r.citing_id, r.cited_id): (r.status, r.via) for r in mentions.edge_contexts(edges, lists, back, known, full).collect()}
    assert out == {("a", "b"): ("found", "references"), ("a", "c"): ("found", "full text"), ("a", "d"): ("found", "citations"), ("x", "b"): ("citing_paper_unresolved", None), ("a", "y"): ("cited_paper_unresolved", None), ("a", "e"): ("edge_absent", None)}


def test_unverified_hits_and_agreement(spark):
    hits = spark.createDataFrame([("s1", "p"), ("s2", "p"), ("s1", "seed")], "strategy string, paper_id string")
    seeds = spark.createDataFrame([("seed",)], "paper_id string")
    assert [tuple(r) for r in audit.resolve_citers(hits, None, seeds).collect()] == [("p", "s1; s2", "unverified")]
    sheet = spark.createDataFrame([("x", "x"), ("x", "y"), ("", "y")], "a string, b string")
    found = audit.agreement(sheet, ["a", "b"])
    assert found["overall"].first().n == 2 and found["disagreements"].count() == 1
    for wrong in (["a"], ["a", "a"], ["a", "zzz"]):
        with pytest.raises(ValueError):
            audit.agreement(sheet, wrong)
    with pytest.raises(ValueError):
        audit.agreement(sheet.where("a = ''"), ["a", "b"])


def test_reports_of_networks(spark):
    members = spark.createDataFrame([(s, i) for s, items in {"p": "abc", "q": "bcd", "r": "d", "t": "abc"}.items() for i in items], "seed string, item string")
    made = networks.report(members, spark.createDataFrame([(x,) for x in "pqrtz"], "seed string"), top=1)
    assert {r.seed: (r.n_items, r.degree, r.strength) for r in made["nodes"].collect()} == {"p": (3, 2, 5), "q": (3, 2, 4), "r": (1, 0, 0), "t": (3, 2, 5), "z": (0, 0, 0)}
    assert tuple(made["counts"].first()) == (5, 4, 3, 3, 7) and [(r.source, r.target) for r in made["edges"].collect()] == [("p", "t")]
    hits = spark.createDataFrame([("one", "k1"), ("one", "k2"), ("two", "k2"), ("two", "k2"), ("two", None)], "index_name string, key string")
    assert {r.index_name: (r.n, r.alone) for r in networks.region_totals(hits).collect()} == {"one": (2, 1), "two": (1, 0), "any": (2, 1)}


def test_years_of_references(spark):
    years = spark.createDataFrame([(2001,), (2003,), (2003,), (2004,)], "year int")
    assert [(r.year, r.incomplete) for r in sorted(history.yearly_counts(years, this_year=2004).collect())] == [(2001, False), (2002, False), (2003, False), (2004, True)]
    refs = spark.createDataFrame([("a", None, "w1"), ("a", 1990, "w2"), ("b", 1991, "w1")], "citing_id string, year int, work string")
    whole = spark.createDataFrame([("a", 1988, "w1"), ("a", 1990, "w2"), ("a", 1990, "w3")], "citing_id string, year int, work string")
    made = history.spectroscopy(refs, whole, 1985, 1995, 2)
    assert {r.year: r.n for r in made["series"].collect() if r.n} == {1988: 1, 1990: 2, 1991: 1} and made["undated"].first()[0] == 0
    assert {r.dated_by for r in history.cited_references(refs, whole).collect()} == {"bibliography", "references"} and made["works"].count() > 0


def test_whole_fronts_and_themes(spark):
    edges = spark.createDataFrame([(f"{g}{j}", f"{g}{i}") for g in "ab" for i in range(5) for j in range(i) if (g, i) != ("b", 0)] + [("a3", "b0")], "source string, target string")
    papers = spark.createDataFrame([(f"{g}{i}", 2000 + i) for g in "ab" for i in range(5)], "node string, year int")
    terms = spark.createDataFrame([(f"{g}{i}", f"{g} words") for g in "ab" for i in range(3)], "node string, term string")
    path = spark.createDataFrame([(0, "a0"), (1, "a3"), (2, "b0"), (3, "b4")], "position int, node string")
    made = fronts.research_fronts(edges, papers, terms, path)
    assert {r.front: (r["size"], r.keywords) for r in made["fronts"].collect()} == {1: (5, "a words"), 2: (5, "b words")}
    assert [(r.source, r.target, r.separated) for r in made["hops"].collect()] == [("a3", "b0", 3)]
    docs = [(d, 2000 + 5 * p, t) for p in range(3) for d, ts in ((10 * p, "ab"), (10 * p + 1, "ab"), (10 * p + 2, "cd"), (10 * p + 3, "cd")) for t in ts]
    made = themes.thematic_evolution(spark.createDataFrame(docs, "doc_id int, year int, term string"))
    assert made["periods"].count() == 3 and made["themes"].count() == 6 and made["evolution"].count() == 4
    assert {r.fate for r in made["fates"].collect()} == {"continues", "", } or made["fates"].count() == 6
