"""Terms, themes, contexts, agreement, exports and writers."""

import pytest
from pyspark.sql import functions as F

from citegrain.functions import identity, terms
from citegrain.operators import audit, biblio, mentions, scopes, themes
from citegrain.sources import copies, exports, landed, markup, sinks


def one(spark, column, *values, kind="string"):
    names = [f"c{i}" for i in range(len(values))]
    row = spark.createDataFrame([values], ", ".join(f"{n} {kind}" for n in names))
    return row.select(column(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize("raw,want", [("Organising Visions", "organizing vision"), ("IT-fashion", "it fashion"), ("Institutionalisation", "institutionalization"), ("Analysis", "analysis"), ("Technologies", "technology"), ("", ""), ("café/plans", "café plan")])
def test_terms(spark, raw, want):
    assert one(spark, terms.normal_term, raw) == want


def test_phrases(spark):
    found = lambda t: one(spark, terms.phrases, t)
    got = found("This paper examines organizing visions in IT innovation. © 2009 Some Press. All rights reserved.")
    assert "organizing vision" in got and "it innovation" in got and "visions in it" not in got
    assert not any("press" in x or x.startswith("paper") for x in got)
    assert "adoption and diffusion" in found("Studies of adoption and diffusion abound.")
    assert found(None) == [] and found("a. b! c") == []


def test_phrases_are_normal_terms(spark):
    words = ["user-oriented", "organisation's", "theory--based", "kettles-", "organising", "realised-visions", "trends_", "AI", "cross-glasses", "boats'", "standardisations"]
    raw = [" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)]
    rows = spark.createDataFrame([(x.lower(),) for x in raw], "g string")
    want = {r[0].replace("_", "") for r in rows.select(terms.normal_term(F.col("g"))).collect()}
    assert one(spark, terms.phrases, " ".join(words)) == sorted(want)


def test_spread(spark):
    from citegrain.plans.star import spread

    rows = spark.range(0, 50, 1, 1)
    dealt = spread(rows)
    assert dealt.rdd.getNumPartitions() > 1 and sorted(r.id for r in dealt.collect()) == list(range(50))
    assert spread(spark.range(0, 50, 1, 40)).rdd.getNumPartitions() == 40


def test_identity(spark):
    assert one(spark, identity.bare_doi, " https://dx.doi.org/10.1/AbC") == "10.1/abc"
    assert one(spark, identity.compact_issn, "0960-085x") == "0960085X" and one(spark, identity.compact_issn, "12-3") is None
    assert one(spark, identity.surname, "Di Maggio P.J.") == "Di Maggio" and one(spark, identity.surname, "van de Ven A.H.") == "van de Ven"
    label = lambda a, t, s: spark.createDataFrame([(a, t, s)], "a array<string>, t string, s string").select(identity.cited_work_label(*map(F.col, "ats"))).first()[0]
    assert label(["DiMaggio P.J.", "Powell W.W."], "The iron cage revisited", None) == "DiMaggio & Powell: The iron cage revisited"
    assert label(["A B.", "C D.", "E F."], None, "Venue") == "A et al.: Venue"
    assert one(spark, identity.year_of, "c. 1997-98") == 1997
    key = lambda *v: spark.createDataFrame([v], "i string, o string, d string, a array<string>, t string").select(identity.cited_work_key(*map(F.col, "iodat"))).first()[0]
    assert key("1", None, "x", None, None) == "sid:1" and key(None, None, "10.1/X", None, None) == "doi:10.1/x"
    assert key(None, None, None, ["Wang P."], "The Title!") == "t:wang:the title" and key(None, None, None, None, "") is None
    terms.register(spark)
    assert spark.sql("SELECT normal_title('Ab-C é'), quartile(60), compact_issn('0276-7783')").first()[:] == ("ab c", "Q2", "02767783")


def test_bibtex(spark):
    rows = spark.createDataFrame([(["Wang, P.", "Li, Q."], "2010", "A {T}", "Proceedings of X"), ([], None, "T", None), (["A"], "1", "", "J")], "a array<string>, y string, t string, v string")
    made = [r[0] for r in rows.select(identity.generated_entry(F.col("a"), F.col("y"), F.col("t"), F.col("v"), "index")).collect()]
    assert made[0].startswith("@inproceedings{Wang_2010,\n  title = {A T},\n  author = {Wang, P. and Li, Q.}") and made[0].endswith("\n}")
    assert made[1].startswith("@article{Anon_nd,") and made[2] is None
    assert one(spark, identity.dashed_pages, "@a{x, pages = {1–2–3} }\n") == "@a{x, pages = {1--2--3} }"
    assert one(spark, identity.entry_key, " @article{ k1 , title={}}") == "k1"
    keys = spark.createDataFrame([(i, "k") for i in range(28)] + [(90, "z"), (91, None)], "pos int, key string")
    got = {r.pos: r.unique_key for r in biblio.unique_keys(keys).collect()}
    assert (got[0], got[25], got[26], got[90], got[91]) == ("ka", "kz", "k26", "z", None)


def docs(spark, groups, period=0):
    rows, i = [], 0
    for ts, n in groups:
        for _ in range(n):
            rows += [(period * 1000 + i, period, t) for t in ts]
            i += 1
    return spark.createDataFrame(rows, "doc_id long, period int, term string")


def of_period(d):
    vocab = themes.vocabulary(d)
    pairs = themes.cooccurrence(d, vocab)
    member = themes.clusters(pairs)
    found = themes.themes(d, vocab, pairs, member)
    return found, member.join(found.select("period", "cluster", "theme"), ["period", "cluster"]).select("period", "theme", "term")


def test_two_themes(spark):
    found, member = of_period(docs(spark, [(("vision", "discourse", "legitimacy"), 4), (("fashion", "bandwagon", "hype"), 3), (("vision", "fashion"), 1)]))
    sets = {}
    for r in member.collect():
        sets.setdefault(r.theme, set()).add(r.term)
    assert sets == {1: {"vision", "discourse", "legitimacy"}, 2: {"fashion", "bandwagon", "hype"}}
    assert {r.theme: r.n_docs for r in found.collect()} == {1: 5, 2: 4}


def test_common_terms_and_followed_ones(spark):
    d = docs(spark, [(("vision", "discourse"), 8), (("vision", "erp"), 4)])
    assert {r.term for r in themes.vocabulary(d).collect()} == {"erp"}
    assert {r.term for r in themes.vocabulary(d, keep=("vision",)).collect()} == {"erp", "vision"}


def test_evolution_and_fates(spark):
    d = docs(spark, [(("vision", "discourse"), 3), (("erp", "adoption"), 3)]).union(docs(spark, [(("vision", "infrastructure"), 3), (("discourse", "blogging"), 3)], 1))
    found, member = of_period(d)
    fate = {(r.period, r.theme): r.fate for r in themes.fates(found, themes.evolution(member)).collect()}
    at = {(r.period, r.term): r.theme for r in member.collect()}
    assert fate[0, at[0, "vision"]] == "splits" and fate[0, at[0, "erp"]] == "vanishes"
    got = {r.period: (r.doc_mentions, r.company) for r in themes.track(d, ["vision"]).collect()}
    assert got == {0: (3, "discourse"), 1: (3, "infrastructure")}


CROWDED = "Bees have been watched for colour (Abel et al., 1981), for scent (Brook et al., 1992), for sleep (Cole, 2007), and for dance language (Dunn & Eley, 2011)."
ESSAY = """A Short Heading

The garden is seldom quiet. On warm days the hive
sends its scouts far out (Finch and Gray
2008). Some count the flowers (Hale 2012; Finch and Gray 2001,
2008; Gray 2015). Colour matters too (Ives 1990).

References

Finch, A. B., and Gray, C. D. 2001. "Counting
Hives," pp. 11-25.
Finch, A. B., and Gray, C. D. 2008. "Scouts on Warm Days,"
pp. 70-92.
Ives, E. 1990. "Colour," pp. 1-9.
"""
BRACKETS = """Opening
The idea goes back to Finch and Gray [14], whose scouts are famous. Later work repeats it [2, 14]. Not this one [5].

REFERENCES
[5] Ives, E. Colour. 1990.
[14] Finch, A.B., and Gray, C.D. Counting hives. 3, 2 (2001), 11-25.
"""


def column(spark, made, **values):
    """A Column made of columns with the given values."""
    kinds = {str: "string", list: "array<string>", type(None): "string"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return row.select(made(**{k: F.col(k) for k in values})).first()[0]


def test_contexts(spark):
    names = ["Finch", "Gray"]
    rows = [(1, ESSAY, names, 2008, "Scouts on warm days"), (2, BRACKETS, names, 2001, "Counting hives"), (3, BRACKETS, ["Kerr"], 1970, "Wax"), (4, "No list.", ["A"], 1999, "x"), (5, None, None, None, None)]
    found = {r.id: r for r in mentions.contexts(spark.createDataFrame(rows, "id int, text string, surnames array<string>, year int, title string")).collect()}
    assert found[1].contexts == ["On warm days the hive sends its scouts far out (Finch and Gray 2008).", "Some count the flowers (Hale 2012; Finch and Gray 2001, 2008; Gray 2015)."]
    assert found[1].reference_entry == 'Finch, A. B., and Gray, C. D. 2008. "Scouts on Warm Days," pp. 70-92.' and found[1].reason is None
    assert found[2].reference_number == "14" and len(found[2].contexts) == 2
    assert found[3].reason == "cited work not found in the reference list"
    assert found[4].reason == found[5].reason == "no reference list found in the text" and found[5].contexts == []
    listed = lambda c: column(spark, mentions.in_list, context=c, surnames=["Finch"], year="2008", number=None)
    assert not listed(found[1].contexts[0]) and listed(found[1].contexts[1])


def test_sentences_and_headings(spark):
    parts = lambda body: column(spark, mentions.sentences, body=body)
    assert parts("1. Start\nOver Here\nBees fly. They re-\nturn home.\nAn Aside\nThen night falls") == ["Bees fly.", "They return home.", "Then night falls"]
    assert parts("no heading here\nBees fly.") == ["no heading here Bees fly."]
    assert parts("Bees fly.\nLast Words") == ["Bees fly.", "Last Words"]


def test_leaked_references_are_no_context(spark):
    body = "As Finch and Gray (2001) tell, scouts return. Brill Garden 2008 Press 301 322 Finch and Gray, 2001 A.B. Finch C.D. Gray Counting."
    assert column(spark, lambda body, s, y, n: mentions.citing(body, mentions.marker(s, y, n)), body=body, s=["Finch"], y="2001", n=None) == ["As Finch and Gray (2001) tell, scouts return."]


@pytest.mark.parametrize("context,names,year,near", [
    (CROWDED, ["Cole"], "2007", False),
    (CROWDED, ["Dunn", "Eley"], "2011", True),
    (CROWDED, ["Nobody"], "1999", False),
    ("As Finch and Gray (2001) tell, a dance language is learnt by most (Moss, 1977).", ["Finch"], "2001", True),
    ("As Finch and Gray (2001) tell, scouts return, but dance language came later (Moss, 1977).", ["Moss"], "1977", False),
    ("It goes back to Finch and Gray [14], whose dance language is famous.", ["Finch"], "2001", True),
    ("Dance language without any name.", ["Finch"], "2001", True),
])
def test_construct_beside_its_own_citation(spark, context, names, year, near):
    got = column(spark, lambda **k: mentions.names_construct(**k, terms=["dance language"]), context=context, surnames=names, year=year, number=None)
    assert got == (near or context.startswith("As Finch") and names == ["Moss"])


def test_works_in_a_list(spark):
    assert column(spark, mentions.in_list, context=CROWDED, surnames=["Cole"], year="2007", number=None)
    assert column(spark, mentions.in_list, context="So do others [2, 5, 14].", surnames=["Finch"], year="2001", number="14")
    assert not column(spark, mentions.in_list, context="So do others [2, 14].", surnames=["Finch"], year="2001", number="14")


def test_draft_labels(spark):
    rows = [(1, [], [], False), (2, ["A dance language (Cole, 2007) is shown."], ["result"], False), (3, ["Honey (Cole, 2007) here."], [], True), (4, ["Honey (Cole, 2007) here."], [], False), (5, None, None, None)]
    rows = [(k, c, ["Cole"], 2007, i, f) for k, c, i, f in rows]
    got = mentions.judged(spark.createDataFrame(rows, "id int, contexts array<string>, surnames array<string>, year int, intents array<string>, is_influential boolean"), ["dance language"])
    assert [r.label for r in sorted(got.collect())] == ["unresolved", "substantive", "construct-shifted", "hollow", "unresolved"]


def test_mentions(spark):
    text = "First References Y. A waggle dance helps. Other matters fill this place for now. We watch the Waggle  Dance again. Further matters fill the rest, about wax and honey. At last, the waggle dance ends. References Finch 2001. The waggle dance of bees. "
    d = spark.createDataFrame([(1, text), (2, None), (3, "Waggle alone. Dance alone. Their waggle dance is here. "), (4, "Words " * 200 + "the waggle dance appears " + "more " * 200 + ".")], "doc_id long, text string")
    got = {r.doc_id: r for r in mentions.analyze(d, '"waggle dance"').collect()}
    assert (got[1].body_mentions, got[1].reference_list_mentions, len(got[1].snippets)) == (3, 1, 3)
    body = text[: text.rindex("References")]
    assert got[1].positions == [round(100 * body.lower().replace("  ", "#").replace("#", "  ").index(x) / len(body)) for x in ("waggle dance helps", "waggle  dance again", "waggle dance ends")]
    assert got[1].snippets == ["A waggle dance helps.", "We watch the Waggle Dance again.", "At last, the waggle dance ends."]
    assert got[2].body_mentions == 0 and got[2].snippets == []
    assert len(got[4].snippets[0]) <= 362 and "waggle dance" in got[4].snippets[0]
    words = {r.doc_id: r for r in mentions.analyze(d, "waggle dance").collect()}
    assert words[3].snippets == ["Their waggle dance is here."] and words[3].body_mentions == 1 and words[1].reference_list_mentions == 1
    assert mentions.wanted('"a b" AND "c"') == (["a b", "c"], True) and mentions.wanted("bee* OR ai") == (["bee"], False)


def test_contexts_of_edges(spark):
    """The citing paper's sentences first, else the cited paper's; of a pair's contexts the best three."""
    edges = spark.createDataFrame([("p", "q"), ("p", "r"), ("p", "s")], "citing_id string, cited_id string")
    own = spark.createDataFrame([("p", "q", ["one"]), ("p", "r", [])], "citing_id string, cited_id string, contexts array<string>")
    back = spark.createDataFrame([("p", "q", ["two"])], "citing_id string, cited_id string, contexts array<string>")
    assert {r.cited_id: (r.contexts, r.status) for r in mentions.edge_contexts(edges, own, back).collect()} == {"q": (["one"], "found"), "r": ([], "contexts_withheld"), "s": ([], "edge_absent")}
    rows = [("p", "q", k, c, "Cole", "2007", "dance") for k, c in enumerate(["Too short 2007.", "Nothing that fits is in this one at all.", "A sentence with some year 1999 in it.", "Cole says in 2007 that bees dance often.", "COLE says in 2007 that bees  dance often.", "By Cole, but without any year at hand.", "One more with a year, it is 2007 here."])]
    got = mentions.clean_contexts(spark.createDataFrame(rows, "citing_id string, cited_id string, pos int, context string, surname string, year string, term string"))
    assert [r.context for r in sorted(got.collect(), key=lambda r: r.place)] == [rows[3][3], rows[5][3], rows[6][3]]


def test_agreement(spark):
    rows = [("y", "Y ")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15 + [("", "y"), (None, "n")]
    sheet = spark.createDataFrame(rows, "a string, b string")
    k = audit.cohen_kappa(sheet, "a", "b").first()
    assert (k.n, round(k.kappa, 9), k.po, k.pe, k.words) == (50, 0.4, 0.7, 0.5, "fair") and k.ci_low < 0.4 < k.ci_high
    assert audit.cohen_kappa(sheet.where("false"), "a", "b").first().kappa is None
    assert audit.cohen_kappa(spark.createDataFrame([("x", "x")], "a string, b string"), "a", "b").first().kappa is None
    assert {(r.a, r.b): r.n for r in audit.confusion(sheet, "a", "b").collect()} == {("y", "y"): 20, ("y", "n"): 5, ("n", "y"): 10, ("n", "n"): 15}
    assert audit.disagreements(sheet, "a", "b").count() == 15
    assert {r.label: r.both for r in audit.per_label(sheet, "a", "b").collect()} == {"y": 20, "n": 15}


def test_completeness_and_retractions(spark):
    rows = spark.createDataFrame([(10, 20), (18, 20), (50, 56), (50, 55), (None, 5), (5, 0)], "r int, e int")
    assert [x.status for x in audit.completeness(rows, "r", "e").collect()] == ["short", "ok", "short" if 50 < 0.9 * 56 else "ok", "ok", "unknown", "unknown"]
    checked = spark.createDataFrame([("10.1/A", True), ("10.1/b", True), ("10.1/c", False), ("10.1/d", True)], "doi string, ok boolean")
    notes = spark.createDataFrame([("10.1/a", "correction", "Correction", "2020-1-1"), ("10.1/a", "retraction", "Retraction", "2021-1-1"), ("10.1/d", "erratum", "Erratum", "2020-1-1")], "doi string, type string, label string, date string")
    assert {r.doi: (r.status, r.latest) for r in audit.retraction_status(checked, notes).collect()} == {"10.1/A": ("retracted", "Retraction"), "10.1/b": ("ok", None), "10.1/c": ("unknown", None), "10.1/d": ("corrected", "Erratum")}


def test_bridging_record_merges(spark):
    rows = [(0, "1", None, None, "", None, ["a"]), (1, None, None, "d1", "", None, ["a", "b"]), (2, "1", None, "d1", "t", 2000, []), (3, None, None, None, "u", 2000, ["z"])]
    got = audit.deduplicated(spark.createDataFrame(rows, "pos long, provider_id string, wos_id string, doi string, norm_title string, year int, keywords array<string>"))
    assert sorted((r.pos, r.provider_id, r.doi, r.keywords, r.n_records) for r in got.collect()) == [(0, "1", "d1", ["a", "b"], 3), (3, None, None, ["z"], 1)]


EXPORTS = {
    "a.csv": '﻿"Authors","Title","Year","Source title","DOI","Link","Author Keywords","EID"\n"Roe A.; Doe B.C.","A title, with comma","1997","Venue","https://doi.org/10.1/ABC","","Kw one; Kw two","2-s2.0-0031"\n',
    "b.txt": "FN X\nVR 1.0\nPT J\nAU Roe, A\n   Doe, B\nTI A long title that\n   goes on\nDE k one; k two; k three\nPY 2010\nDI 10.1/abc\nUT WOS:0002\nER\n\nEF\n",
    "c.ris": "TY  - JOUR\nAU  - Roe, A.\nA1  - Doe, B.\nT1  - Some title\nPY  - 2003/05\nJO  - Venue\nUR  - https://x/?eid=2-s2.0-0041&p=4\nKW  - one\nKW  - two\nER  - \n",
    "d.bib": '@ARTICLE{Key1,\n\tauthor = {Roe, A. and Doe, B.},\n\ttitle = {An {IS} title},\n\tyear = 2004,\n\tbooktitle = "Venue",\n\turl = {https://x/?eid=2-s2.0-0097&p=4},\n\tkeywords = {x}, author_keywords = {one; two}\n}\n',
    "e.tsv": "PT\tAU\tTI\tPY\tUT\nJ\tRoe, A; Doe, B\tTab \"title\tpub 2011\tWOS:0005\n",
}


def test_exports(spark, tmp_path):
    for name, text in EXPORTS.items():
        (tmp_path / name).write_text(text, encoding="utf-8" if name != "c.ris" else "utf-16")
    got = {r.file: r for r in exports.read_exports(spark, str(tmp_path)).collect()}
    assert {n: r.format for n, r in got.items()} == {"a.csv": "scopus_csv", "b.txt": "wos_plain", "c.ris": "ris", "d.bib": "bibtex", "e.tsv": "wos_tab"}
    a, b, c, d, e = (got[n] for n in sorted(got))
    assert (a.scopus_id, a.doi, a.year, a.authors, a.author_keywords) == ("0031", "10.1/abc", 1997, ["Roe A.", "Doe B.C."], ["Kw one", "Kw two"])
    assert (b.wos_id, b.title, b.authors, len(b.author_keywords)) == ("0002", "A long title that goes on", ["Roe, A", "Doe, B"], 3)
    assert (c.scopus_id, c.title, c.year, c.authors, c.source, c.author_keywords) == ("0041", "Some title", 2003, ["Roe, A.", "Doe, B."], "Venue", ["one", "two"])
    assert (d.scopus_id, d.title, d.year, d.source, d.authors, d.author_keywords) == ("0097", "An IS title", 2004, "Venue", ["Roe, A.", "Doe, B."], ["one", "two"])
    assert (e.wos_id, e.title, e.year, e.authors) == ("0005", 'Tab "title', 2011, ["Roe, A", "Doe, B"])
    (tmp_path / "f.exe").write_text("x")
    with pytest.raises(ValueError):
        exports.read_exports(spark, str(tmp_path / "f.exe"))
    with pytest.raises(ValueError):
        exports.sniff("nothing known", ".txt")


def test_landed_responses(spark, tmp_path):
    import json

    doc = {"search-results": {"opensearch:totalResults": "2", "entry": [{"dc:identifier": "SCOPUS_ID:007", "dc:title": "T", "prism:coverDate": "2001-02-03", "prism:doi": "10.1/X", "citedby-count": "5", "prism:issn": "0276-7783"}, {"error": "none"}]}}
    ref = {"abstracts-retrieval-response": {"references": {"reference": [{"scopus-id": [{"$": ""}, {"$": "9"}], "ce:doi": {"$": "10.1/Y"}, "title": "R", "prism:coverDate": "1999-01-01", "author-list": {"author": [{"@auid": "1", "ce:indexed-name": "A B."}, {"@auid": "1", "ce:indexed-name": "A B."}, {"@auid": "2", "ce:indexed-name": "C D."}]}}]}}}
    work = {"results": [{"id": "https://x/W1", "doi": "https://doi.org/10.1/Z", "title": "W", "publication_year": 2005, "authorships": [{"author": {"display_name": "N"}}], "abstract_inverted_index": {"world": [1], "hello": [0, 2]}, "referenced_works": ["https://x/W7"]}]}
    for n, x in (("s", doc), ("r", ref), ("w", work)):
        (tmp_path / n).mkdir()
        (tmp_path / n / "1.json").write_text(json.dumps(x))
    s = landed.search_results(landed.responses(spark, str(tmp_path / "s"))).collect()
    assert [(r.scopus_id, r.doi, r.year, r.cited_by_count, r.issn) for r in s] == [("007", "10.1/x", 2001, 5, "02767783")]
    r = landed.references(landed.responses(spark, str(tmp_path / "r")).withColumn("citing_id", F.lit("1")), "citing_id").first()
    assert (r.ref_scopus_id, r.ref_doi, r.year, r.authors) == ("9", "10.1/y", 1999, ["A B.", "C D."])
    w = landed.works(landed.responses(spark, str(tmp_path / "w"))).first()
    assert (w.openalex_id, w.doi, w.abstract, w.references) == ("W1", "10.1/z", "hello world hello", ["W7"])


def test_markup(spark):
    html = "<html><head><script>x<y</script></head><body><nav>skip <b>me</b></nav><p>One &amp; two</p><footer>no</footer> three </body>"
    assert one(spark, markup.html_text, html) == "One & two three"
    assert one(spark, markup.jats_text, "<article><front>f</front><body><p>a\n b</p><p>c</p></body></article>") == "a b c"
    assert one(spark, markup.jats_text, "<broken") == ""


def test_html_references_without_semicolon(spark):
    html = "<title>a&amp;&amp</title><p>&lt;b &copyx; &#65; &#66 &nosuch; R&D</p>"
    assert one(spark, markup.html_text, html) == "a&& <b ©x; A B &nosuch; R&D"
    assert one(spark, lambda c: markup.html_text(c, closed=True), html) == "a&&amp <b &copyx; A &#66 &nosuch; R&D"


def test_writers(spark, tmp_path):
    nodes = spark.createDataFrame([("x", 'Swanson "1997"'), ("y", None)], "node string, label string")
    edges = spark.createDataFrame([("x", "y", 3), ("x", "zz", None)], "source string, target string, weight int")
    sinks.write_pajek(nodes, edges, str(tmp_path / "n.net"))
    assert (tmp_path / "n.net").read_text() == "*Vertices 2\n1 \"Swanson '1997'\"\n2 \"y\"\n*Arcs\n1 2 3\n"
    sinks.write_partition(spark.createDataFrame([("a", 1), ("b", 0)], "node string, part int"), str(tmp_path / "n.clu"))
    assert (tmp_path / "n.clu").read_text().splitlines() == ["*Vertices 2", "1", "0"]
    sinks.write_graphml(nodes, edges, str(tmp_path / "n.graphml"))
    text = (tmp_path / "n.graphml").read_text()
    assert '<edge source="x" target="y"><data key="weight">3</data></edge>' in text and "zz" in text and "None" not in text
    assert "<\\/script>" in sinks.html_page(spark.createDataFrame([("</script>",)], "node string"), edges, "t")
    assert sinks.compact(spark.createDataFrame([("a", " ", None)], "a string, b string, c int")).first().line == '{"a":"a"}'
    rows = spark.range(120).withColumnRenamed("id", "n")
    assert [r.n for r in sinks.page(rows, [F.col("n")], 99).collect()] == list(range(100, 120)) and sinks.goes_to_file(rows)


def test_streams(spark, sf, tmp_path):
    from citegrain import streaming

    source = spark.read.parquet(f"{sf}/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = streaming.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == source.count()


def test_scopes(spark):
    assert len(scopes.scope_issns("AIS8")) == 16 and scopes.scope_issns("0276-7783, 0960085x; 02767783") == ["0276-7783", "0960-085X"]
    assert scopes.scope_issns(None) is None
    with pytest.raises(ValueError):
        scopes.scope_issns("basket of nine")
    rows = spark.createDataFrame([("02767783", None), ("1111-1111", "1047-7047"), ("3333-3333", None)], "issn string, eissn string")
    assert scopes.in_scope(rows, "basket_of_eight", "issn", "eissn").count() == 2
    assert scopes.scoped_query("x", ["0276-7783"]) == "(x) AND (ISSN(02767783))" and scopes.scoped_query("x", None) == "x"
    assert scopes.author_query("Roe, A. (B)", "Some Uni") == "AUTHLASTNAME(Roe) AND AUTHFIRST(A. B) AND AFFIL(Some Uni)"
    assert scopes.author_name("E. Burton Roe") == ("Roe", "E. Burton") and scopes.author_name("Roe") == ("Roe", None)
    assert [len(x.split(" OR ")) for x in scopes.source_chunks([str(i) for i in range(250)])] == [100, 100, 50]
    refs = spark.createDataFrame([("007", None), ("8", "10.1/a"), ("9", "10.1/b")], "ref_scopus_id string, ref_doi string")
    assert scopes.matching_references(refs, ["2-s2.0-007", "https://doi.org/10.1/A"]).count() == 2
    assert [one(spark, scopes.venue_abbreviation, v) for v in ("MIS Quarterly", "Annals of the Big Idea", "")] == ["MISQ", "ABI", "?"]
    papers = spark.createDataFrame([("1", 5), ("2", 9), ("3", 1)], "paper_id string, cited_by_count long")
    assert [r.paper_id for r in scopes.corpus(papers, ["3", "1", "3"]).collect()] == ["3", "1"]
    assert [r.paper_id for r in scopes.corpus(papers, where=F.col("cited_by_count") > 1, most=1).collect()] == ["2"]
    t = lambda *rows: spark.createDataFrame(list(rows), "doi string, text string")
    got = scopes.fulltext(t(("a", "x" * 5000), ("b", "x"), ("c", None), ("d", None)), t(("b", "open")), t(("c", "abs"), ("b", "abs")))
    assert {r.doi: r.provenance for r in got.collect()} == {"a": "publisher", "b": "open copy", "c": "abstract", "d": "none"}
    walk = spark.createDataFrame([("s", 0, 2000, 5), ("a", 1, 2025, 3), ("b", 1, 2026, 2)], "node string, generation int, year int, cited_by_count long")
    assert scopes.degenerate(walk, 2, 2, 2026).count() == 3 and scopes.degenerate(walk, 5, 200, 2040).count() == 0


def test_more_responses(spark, tmp_path):
    import json

    def read(doc):
        (tmp_path / "x.json").write_text(json.dumps(doc))
        return landed.responses(spark, str(tmp_path / "x.json")).withColumn("citing_id", F.lit("c"))

    abstract = {"abstracts-retrieval-response": {"coredata": {"dc:identifier": "SCOPUS_ID:01", "eid": "2-s2.0-01", "prism:doi": "10.1/x", "dc:title": "T", "dc:creator": {"author": {"@auid": "7", "ce:indexed-name": "A B."}}}, "item": {"bibrecord": {"tail": {"bibliography": {"@refcount": "3", "reference": {"ref-info": {"refd-itemidlist": {"itemid": [{"@idtype": "SGR", "$": "55"}, {"@idtype": "DOI", "$": "10.1/Q"}]}, "ref-publicationyear": {"@first": "1988"}, "ref-title": {"ref-titletext": "Old"}}}}}}}}}
    got = landed.abstract_details(read(abstract)).first()
    assert (got.scopus_id, got.abstract_source, got.authors[0].name, got.refs_reported) == ("01", "none", "A B.", 3)
    assert landed.identifiers(read(abstract)).first().eid == "2-s2.0-01"
    b = landed.bibliographies(read(abstract), "citing_id").first()
    assert (b.ref_scopus_id, b.ref_doi, b.year, b.title) == ("55", "10.1/q", 1988, "Old")
    author = {"author-retrieval-response": {"coredata": {"dc:identifier": "AUTHOR_ID:9", "document-count": "4"}, "author-profile": {"preferred-name": {"surname": "Roe", "given-name": "A"}, "affiliation-current": {"affiliation": [{"ip-doc": {"afdispname": "Uni"}}]}}}}
    p = landed.author_profiles(read(author)).first()
    assert (p.author_id, p.document_count, p.surname, p.affiliation) == ("9", 4, "Roe", "Uni")
    search = {"search-results": {"entry": [{"dc:identifier": "AUTHOR_ID:9", "preferred-name": {"surname": "Roe", "given-name": "A"}, "name-variant": [{"surname": "Roe", "given-name": "Al"}, {"surname": "Roe", "given-name": "Al"}], "subject-area": {"$": "Math"}}]}}
    f = landed.found_authors(read(search)).first()
    assert (f.name, f.variants, f.subjects) == ("Roe, A", ["Roe, Al"], ["Math"])
    hits = {"results": [{"title": "T", "authors": [{"name": "N"}], "sourceTitle": "V", "publicationDate": "2020-01-01", "doi": "10.1/H", "openAccess": True, "id": "https://x/S1", "display_name": "J", "issn_l": "0276-7783", "summary_stats": {"h_index": 4, "2yr_mean_citedness": 1.5}, "topics": [{"display_name": t} for t in "abcd"]}]}
    assert (landed.article_hits(read(hits)).first().creator, landed.article_hits(read(hits)).first().open_access) == ("N", True)
    assert (landed.index_sources(read(hits)).first().h_index, landed.index_sources(read(hits)).first().two_year_mean_citedness) == (4, 1.5)
    assert landed.index_authors(read(hits)).first().topics == ["a", "b", "c"]


def test_corpus_files(spark, tmp_path):
    records = spark.createDataFrame([("1", "10.1/a"), ("2", None), ("1", "10.1/b")], "scopus_id string, doi string")
    sinks.write_corpus(records, str(tmp_path / "c"))
    wanted = sinks.corpus_ids(spark, str(tmp_path / "c"))
    assert sorted(r[0] for r in wanted.collect()) == ["1", "2"]
    assert sorted(r[0] for r in sinks.corpus_ids(spark, str(tmp_path / "c"), "doi").collect()) == ["10.1/a", "10.1/b"]
    papers = spark.createDataFrame([("1", 3), ("3", 5)], "paper_id string, cited_by_count int")
    assert [r.paper_id for r in scopes.corpus(papers, wanted=wanted).collect()] == ["1"]
    with pytest.raises(ValueError, match="either"):
        scopes.corpus(papers, ["1"], wanted=wanted)
    with pytest.raises(ValueError, match="no corpus"):
        sinks.corpus_ids(spark, str(tmp_path))
    sinks.write_corpus(records.where("doi is null"), str(tmp_path / "d"))
    with pytest.raises(ValueError, match="no doi"):
        sinks.corpus_ids(spark, str(tmp_path / "d"), "doi")


def test_text_files(spark, tmp_path):
    sinks.write_texts(spark.createDataFrame([("p1", "one\ntwo"), ("p2", None)], "paper_id string, text string"), str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["one", "two"]
    sinks.write_bibtex(spark.createDataFrame([(2, "@b{y}"), (1, "@a{x}")], "pos int, entry string"), str(tmp_path / "b"))
    parts = sorted((tmp_path / "b").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "@a{x}\n\n@b{y}\n\n"
    edges = spark.createDataFrame([("a", "b", ['said "so", é'])], "source string, target string, contexts array<string>")
    sinks.write_sheet(edges, str(tmp_path / "s"))
    assert next((tmp_path / "s").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbfsource,")
    back = landed.read_sheet(spark, str(tmp_path / "s"))
    assert back.columns == ["source", "target", "contexts", "coder_1_label", "coder_2_label"]
    assert back.first().contexts == 'said "so", é'


def test_pajek_lines(spark):
    nodes = spark.createDataFrame([("b", 'B "x"'), ("a", None)], "node string, label string")
    edges = spark.createDataFrame([("a", "b", 2), ("a", "z", 1), ("b", "a", None)], "source string, target string, weight int")
    rows = sinks.pajek_lines(nodes, edges).orderBy("block", "place").collect()
    assert [r.line for r in rows] == ["*Vertices 2", '1 "a"', "2 \"B 'x'\"", "*Arcs", "1 2 2", "2 1"]


def test_copies_of_odd_answers(spark):
    for reader in (copies.from_index, copies.from_graph, copies.from_articles, copies.from_registry, copies.from_aggregator):
        for answer in ("{}", "[]", "null", '{"locations": null, "oa_locations": [], "results": [{}], "openAccessPdf": {"url": " "}}'):
            docs = spark.createDataFrame([("10.1/a", answer)], "doi string, t string").select("doi", F.parse_json("t").alias("json"))
            assert reader(docs).collect() == []
    feeds = spark.createDataFrame([("10.1/a", "T", "<feed/>"), ("10.1/b", "T", "no feed"), ("10.1/c", "T", None)], "doi string, title string, xml string")
    assert copies.from_preprints(feeds).collect() == []


def test_ranked_copies_of_one_url(spark):
    long = "Some Title " + "x" * 6000
    rows = [("d", "http://a/x", "html", "published", "some title", long), ("d", "HTTP://A/X/", "pdf", "preprint", "some title", long), ("d", "http://b", "pdf", "accepted", "some title", "short")]
    got = landed.ranked_copies(spark.createDataFrame(rows, "doi string, url string, kind string, version string, title string, text string")).collect()
    assert [(r.url, r.kind) for r in got] == [("HTTP://A/X/", "pdf")]


def test_large_answers_come_in_pages(spark):
    from citegrain.plans import landing

    rows = spark.range(5000).select("id", F.lit("g").alias("g"))
    pages = landing._pages(rows, "g", "id", F.struct("id"), lambda es: F.struct(es.alias("items")))
    sizes = [r.n for r in pages.select(F.size(F.try_variant_get("json", "$.items", "array<variant>")).alias("n")).collect()]
    assert sum(sizes) == 5000 and max(sizes) < 2 * landing.PAGE
