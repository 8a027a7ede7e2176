"""Identifiers: DOIs, provider ids, ISSNs, keys of papers and cited works."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import normal_title


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def bare_doi(c: Column) -> Column:
    """Lower-case DOI without a resolver prefix; null for an empty one."""
    return blank_to_null(F.lower(F.regexp_replace(F.trim(c), r"(?i)^https?://(dx\.)?doi\.org/", "")))


def short_id(c: Column) -> Column:
    """The last part of a URL-like id."""
    return blank_to_null(F.element_at(F.split(c, "/"), -1))


def to_provider_id(c: Column) -> Column:
    """Digits of an EID or a prefixed id, leading zeros kept."""
    return F.regexp_replace(F.replace(F.trim(c), F.lit("SCOPUS_ID:"), F.lit("")), r"(?i)^2-s2\.0-", "")


def to_eid(c: Column) -> Column:
    return F.concat(F.lit("2-s2.0-"), to_provider_id(c))


def eid_digits(*cs: Column) -> Column:
    """The digits of the first value that holds an EID."""
    return F.coalesce(*[blank_to_null(F.regexp_extract(F.coalesce(c, F.lit("")), r"2-s2\.0-(\d+)", 1)) for c in cs])


def id_type(c: Column) -> Column:
    """eid, doi, pii or scopus_id, by the look of it."""
    x = F.trim(c)
    bare = F.replace(x, F.lit("SCOPUS_ID:"), F.lit(""))
    return (
        F.when(F.lower(x).startswith("2-s2.0-"), "eid").when(x.startswith("10.") | x.contains("/"), "doi").when(bare.rlike(r"^\d+$"), "scopus_id")
        .when(bare.rlike(r"^[SB][A-Za-z0-9-]*$"), "pii").otherwise("scopus_id")
    )


def compact_issn(c: Column) -> Column:
    """Eight characters, upper case; null if it is no ISSN."""
    x = F.upper(F.regexp_replace(c, r"[\s-]", ""))
    return F.when(x.rlike(r"^\d{7}[\dX]$"), x)


def hyphened_issn(c: Column) -> Column:
    x = compact_issn(c)
    return F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 4))


def year_of(c: Column) -> Column:
    """The first year 1900 to 2099 in a string, as int."""
    return blank_to_null(F.regexp_extract(c.cast("string"), r"(19|20)\d{2}", 0)).cast("int")


def node_key(scopus_id: Column, openalex_id: Column, doi: Column) -> Column:
    return F.coalesce(blank_to_null(scopus_id), blank_to_null(openalex_id), F.concat(F.lit("doi:"), blank_to_null(doi)))


def coupling_key(scopus_id: Column, doi: Column) -> Column:
    return F.coalesce(blank_to_null(scopus_id), blank_to_null(doi))


def cited_work_key(scopus_id: Column, openalex_id: Column, doi: Column, authors: Column, title: Column) -> Column:
    """sid:, oa:, doi: or t:<first word of the first author>:<title>; null if nothing identifies the work."""
    t = normal_title(title)
    first = F.lower(F.element_at(F.split(F.coalesce(F.get(authors, 0), F.lit("")), " "), 1))
    return F.coalesce(
        F.concat(F.lit("sid:"), blank_to_null(scopus_id)),
        F.concat(F.lit("oa:"), blank_to_null(openalex_id)),
        F.concat(F.lit("doi:"), F.lower(blank_to_null(doi))),
        F.when(t != "", F.concat(F.lit("t:"), first, F.lit(":"), F.substring(t, 1, 80))),
    )


def surname(c: Column) -> Column:
    """An indexed name without its initials."""
    left = F.array_join(F.filter(F.split(F.trim(c), r"\s+"), lambda x: ~x.rlike(r"^([A-Z]\.)+(-[A-Z]\.)*$")), " ")
    return F.when(left != "", left).otherwise(c)


def cited_work_label(authors: Column, title: Column, source: Column) -> Column:
    n = F.size(F.coalesce(authors, F.array().cast("array<string>")))
    who = F.when(n > 0, surname(F.get(authors, 0))).otherwise(F.coalesce(source, F.lit("?")))
    who = F.when(n == 2, F.concat(who, F.lit(" & "), surname(F.get(authors, 1)))).when(n > 2, F.concat(who, F.lit(" et al."))).otherwise(who)
    return F.trim(F.concat(who, F.lit(": "), F.substring(F.trim(F.coalesce(blank_to_null(title), source, F.lit(""))), 1, 90)))


def node_label(creator: Column, year: Column, title: Column, node: Column) -> Column:
    first = F.element_at(F.split(F.trim(creator), r"[\s,]+"), 1)
    named = F.concat_ws(" ", first, year.cast("string"))
    return F.when(blank_to_null(creator).isNotNull(), named).otherwise(F.coalesce(F.substring(blank_to_null(title), 1, 40), node))


def citation_key_parts(authors: Column, year: Column) -> Column:
    """Surname_year of a generated BibTeX entry."""
    first = F.regexp_replace(F.element_at(F.split(F.coalesce(F.get(authors, 0), F.lit("")), ","), 1), "[^A-Za-z]", "")
    return F.concat_ws("_", F.when(first == "", "Anon").otherwise(first), F.coalesce(blank_to_null(year.cast("string")), F.lit("nd")))


#: Words that make a venue a conference.
CONFERENCE = r"(?i)conference|proceedings|symposium|workshop"


def generated_entry(authors: Column, year: Column, title: Column, venue: Column, origin: str) -> Column:
    """A minimal BibTeX entry from metadata; null without a title."""
    plain = lambda c: F.trim(F.regexp_replace(c, "[{}]", ""))
    field = lambda name, c: F.concat(F.lit(f"  {name} = {{"), c, F.lit("}"))
    proc = F.coalesce(venue.rlike(CONFERENCE), F.lit(False))
    named = F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: a != "")
    venue_field = F.when(proc, field("booktitle", plain(venue))).otherwise(field("journal", plain(venue)))
    fields = F.array_compact(F.array(
        field("title", plain(title)),
        F.when(F.size(named) > 0, field("author", F.array_join(F.transform(named, plain), " and "))),
        F.when(blank_to_null(year.cast("string")).isNotNull(), field("year", F.trim(year.cast("string")))),
        F.when(blank_to_null(venue).isNotNull(), venue_field),
        field("note", F.lit(f"Generated from {origin} metadata; no DOI")),
    ))
    head = F.concat(F.lit("@"), F.when(proc, "inproceedings").otherwise("article"), F.lit("{"), citation_key_parts(named, year), F.lit(",\n"))
    return F.when(blank_to_null(title).isNotNull(), F.concat(head, F.array_join(fields, ",\n"), F.lit("\n}")))


def entry_key(entry: Column) -> Column:
    return blank_to_null(F.regexp_extract(entry, r"^\s*@\w+\s*\{\s*([^,\s]*)\s*,", 1))


def dashed_pages(entry: Column) -> Column:
    """A trimmed entry with two hyphens for en dashes in its pages field."""
    field = r"(pages\s*=\s*\{)([^}]*)(\})"
    inner = F.regexp_extract(entry, field, 2)
    return F.regexp_replace(F.when(inner.contains("–"), F.replace(entry, inner, F.replace(inner, F.lit("–"), F.lit("--")))).otherwise(entry), r"^\s+|\s+$", "")
