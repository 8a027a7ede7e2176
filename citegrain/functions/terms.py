"""Titles, terms and phrases; labels and scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: British stems whose -ise forms count as -ize.
ISE_STEMS = (
    "organis theoris legitimis institutionalis digitalis conceptualis standardis categoris recognis realis optimis mobilis "
    "commercialis globalis personalis customis virtualis modernis rationalis prioritis characteris utilis specialis centralis "
    "decentralis formalis normalis operationalis contextualis servitis platformis materialis socialis visualis"
).split()

#: Words that a phrase neither starts nor ends with.
STOPWORDS = """
a about above after again against all also am an and any are as at be because been before being
below between both but by can could did do does doing down during each few for from further had
has have having he her here hers him his how i if in into is it its itself just me more most my
no nor not now of off on once only or other our ours out over own same she should so some such
than that the their theirs them then there these they this those through to too under until up
very was we were what when where which while who whom why will with would you your yours
study paper research article approach results findings using based use used new however
through toward towards within across among via thus therefore whereas furthermore moreover
suggest suggests examine examines examined show shows shown find finds found identify identifies
provide provides provided propose proposes develop develops developed present presents
discuss discusses explore explores explored argue argues offer offers draw draws
one two three four five first second third several various different many much well
also overall important particular implication implications contribution contributions
literature paper papers purpose design methodology originality value limitations
right rights reserved copyright elsevier ltd inc palgrave macmillan taylor francis wiley
sage publishing published springer emerald informs association society journal
year years period around positively negatively associated make made take taken
""".split()

#: Acronyms that are short and still terms.
ACRONYMS = "it ai ar vr ml hr ux ui bi".split()


def normal_title(c: Column) -> Column:
    """Lower case, everything but ASCII letters and digits a space, single-spaced."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z]+", " "))


def _let(value: Column, body) -> Column:
    """body(value), worked out once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def singular(word: Column) -> Column:
    long = F.length(word) > 4
    plain_s = word.endswith("s") & ~word.rlike("(ss|is|us|ics|sis)$")
    return F.when(long & word.endswith("ies"), F.regexp_replace(word, "ies$", "y")).when(long & plain_s, F.regexp_replace(word, "s$", "")).otherwise(word)


def normal_term(c: Column) -> Column:
    """Organising Visions -> organizing vision: hyphens and punctuation to spaces, -ise to -ize, the last word singular."""
    t = F.regexp_replace(F.translate(F.lower(c), "-/", "  "), r"(?U)[^\w\s]", " ")
    stems = "|".join(x[:-1] for x in ISE_STEMS)
    t = F.regexp_replace(t, rf"(?U)\b({stems})s(e|ed|es|ing|ation|ations)\b", "$1z$2")
    last = lambda w: F.array(_let(F.element_at(w, -1), singular))
    joined = lambda w: F.when(F.size(w) == 0, "").otherwise(F.array_join(F.concat(F.slice(w, 1, F.size(w) - 1), last(w)), " "))
    return F.when(c.isNotNull(), _let(F.array_remove(F.split(t, r"(?U)\s+"), ""), joined))


def phrases(text: Column, least: int = 2, most: int = 3) -> Column:
    """Sorted distinct 2- and 3-word phrases within clauses, as an array; single words tell themes apart too badly.

    A phrase is a normal term (normal_term) whose words are made normal one by one, once for all phrases that they are in:
    as words within a phrase, and as the last one, which is singular.
    """
    stop = [*dict.fromkeys(STOPWORDS)]
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?im)(©|\(c\)|copyright).*$|all rights reserved.*$", " ")
    t = F.regexp_replace(t, rf"\b({'|'.join(ACRONYMS).upper()})\b", "$1_")
    clauses = F.split(F.lower(t), r"[.;:!?()\[\]]")
    stems = "|".join(x[:-1] for x in ISE_STEMS)
    short = lambda w: (F.length(w) < 3) & ~w.isin(ACRONYMS)

    def plain(w: Column) -> Column:
        """A word of letters, underscores, hyphens and apostrophes; all stems end in what is asked for first, regexes being slow."""
        spaced = F.when(w.contains("-") | w.contains("'"), F.trim(F.regexp_replace(w, "[-']+", " "))).otherwise(w)
        return F.when(w.contains("is"), F.regexp_replace(spaced, rf"\b({stems})s(e|ed|es|ing|ation|ations)\b", "$1z$2")).otherwise(spaced)

    def last(w: Column) -> Column:
        end = F.substring_index(w, " ", -1)
        one = F.when(w.contains(" "), F.concat(F.substring(w, F.lit(1), F.length(w) - F.length(end)), singular(end))).otherwise(singular(w))
        return F.when(w.contains("s"), one).otherwise(w)

    def rated(w: Column) -> Column:
        """The word, whether it may begin or end a phrase, and whether it may be within one."""
        return _let(w.isin(stop), lambda x: F.struct(plain(w).alias("w"), (~x & ~short(F.rtrim(w, F.lit("_")))).alias("e"), (~x | w.isin("of", "and", "for")).alias("m")))

    clear = lambda w: F.when(w.contains("_"), F.replace(w, F.lit("_"), F.lit(""))).otherwise(w)
    made = lambda x: F.struct(clear(x["w"]).alias("w"), F.when(x["e"], clear(last(x["w"]))).alias("l"), x["e"].alias("e"), x["m"].alias("m"))

    def grams(tokens: Column, n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
        inner = lambda i: F.get(tokens, i + 1)["m"] if n == 3 else F.lit(True)
        good = F.filter(starts, lambda i: F.get(tokens, i)["e"] & F.get(tokens, i + (n - 1))["e"] & inner(i))
        return F.transform(good, lambda i: F.concat_ws(" ", *[F.get(tokens, i + k)["w"] for k in range(n - 1)], F.get(tokens, i + (n - 1))["l"]))

    def of_clause(clause: Column) -> Column:
        words = F.regexp_extract_all(clause, F.lit(r"[a-z][a-z_\-']+"), F.lit(0))
        return _let(F.transform(F.transform(words, rated), made), lambda t: F.concat(*[grams(t, n) for n in range(least, most + 1)]))

    return F.sort_array(F.array_distinct(F.flatten(F.transform(clauses, of_clause))))


def normal_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"(?U)[\s_]+", " "))


def agreement_words(kappa: Column) -> Column:
    """The usual words for a kappa, upper bounds included."""
    return (
        F.when(kappa.isNull(), F.lit(None).cast("string")).when(kappa < 0, "worse than chance").when(kappa <= 0.2, "slight")
        .when(kappa <= 0.4, "fair").when(kappa <= 0.6, "moderate").when(kappa <= 0.8, "substantial").otherwise("almost perfect")
    )


def quartile(percentile: Column) -> Column:
    return F.when(percentile >= 75, "Q1").when(percentile >= 50, "Q2").when(percentile >= 25, "Q3").when(percentile.isNotNull(), "Q4")


#: Names of venue types by the compact form of what sources call them.
VENUES = {"journal": "journal", "conferenceproceeding": "conference proceedings", "bookseries": "book series", "book": "book", "tradejournal": "trade journal"}


def venue_type(c: Column) -> Column:
    key = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(""))
    pairs = [F.lit(x) for kv in VENUES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit("other"))


def tagless(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "<[^>]+>", ""))


def register(spark) -> None:
    """SQL functions normal_title, normal_term, phrases, issn and quartile, as SQL macros where Spark can: temporary functions."""
    for name, arg, body in (
        ("normal_title", "x STRING", "trim(regexp_replace(lower(coalesce(x, '')), '[^0-9a-z]+', ' '))"),
        ("compact_issn", "x STRING", "CASE WHEN upper(regexp_replace(x, '[ -]', '')) RLIKE '^[0-9]{7}[0-9X]$' THEN upper(regexp_replace(x, '[ -]', '')) END"),
        ("quartile", "x DOUBLE", "CASE WHEN x >= 75 THEN 'Q1' WHEN x >= 50 THEN 'Q2' WHEN x >= 25 THEN 'Q3' WHEN x IS NOT NULL THEN 'Q4' END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arg}) RETURNS STRING RETURN {body}")
