"""Export files of bibliographic databases as one table of records: CSV, RIS, BibTeX, plain and tab-delimited field lists.

Files are read whole by Spark (binaryFile), so any file system it knows will do; an export is small and its format is
told from its head. Parsing is per file, files are the unit of parallelism; fields are then normalised by expressions.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import bare_doi, eid_digits, year_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUFFIXES = (".csv", ".txt", ".ris", ".bib", ".tsv", ".tab")
MAX_BYTES = 50 * 1024 * 1024
#: Raw fields of a record, before they are normalised.
RAW = "format string, ids array<string>, wos string, doi string, title string, year string, authors array<string>, source string, author_keywords string, index_keywords string, keyword_list array<string>, abstract string"


def decode(raw: bytes) -> str:
    """The text in UTF-16 if it has that mark, else in UTF-8, else in Latin-1."""
    for name in ("utf-16",) if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8-sig", "latin-1"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def sniff(text: str, suffix: str) -> str:
    """The format by the suffix and the first 4000 characters; ValueError if it is none of those known."""
    head = text.lstrip("﻿")[:4000]
    first = head.splitlines()[0] if head.strip() else ""
    tests = (
        ("bibtex", suffix == ".bib" or re.match(r"\s*@\w+\s*\{", head)),
        ("ris", re.search(r"(?m)^TY  - ", head)),
        ("wos_plain", head[:3] in ("FN ", "PT ") and re.search(r"(?m)^ER\s*$", text)),
        ("wos_tab", first.startswith("PT\t") or "\tUT" in first),
        ("scopus_csv", "EID" in first or ("Title" in first and "Source title" in first)),
    )
    for name, fits in tests:
        if fits:
            return name
    raise ValueError("unknown export format")


def _row(fmt: str, **fields) -> tuple:
    names = [x.split()[0] for x in re.split(r", (?=\w+ )", RAW)]
    return tuple({"format": fmt, **fields}.get(n) for n in names)


def _table(text, **options):
    """Rows of a text, or of a stream of one."""
    import csv
    import io

    for row in csv.DictReader(io.StringIO(text.lstrip("﻿")) if isinstance(text, str) else text, **options):
        yield {(k or "").strip(): v for k, v in row.items() if k is not None}


def from_csv(text):
    for r in _table(text):
        names = re.split(r";|,(?= [A-Z])", r.get("Authors") or "")
        yield _row("scopus_csv", ids=[r.get("EID"), r.get("Link")], doi=r.get("DOI"), title=r.get("Title"), year=r.get("Year"), authors=names, source=r.get("Source title"), author_keywords=r.get("Author Keywords"), index_keywords=r.get("Index Keywords"), abstract=r.get("Abstract"))


def _first(fields: dict, *tags: str):
    return next((fields[t][0] for t in tags if fields.get(t) and fields[t][0]), None)


def from_ris(text: str):
    fields: dict | None = None
    for tag, value in re.findall(r"(?m)^([A-Z][A-Z0-9])  - ?(.*?)\r?$", text):
        value = value.strip()
        if tag == "TY":
            fields = {}
        elif fields is None:
            continue
        elif tag == "ER":
            yield _row("ris", ids=[_first(fields, t) for t in ("UR", "M3", "AN")], doi=_first(fields, "DO"), title=_first(fields, "TI", "T1"), year=_first(fields, "PY", "Y1"), authors=fields.get("AU"), source=_first(fields, "T2", "JO", "JF"), keyword_list=fields.get("KW"), abstract=_first(fields, "AB", "N2"))
            fields = None
        else:
            fields.setdefault("AU" if tag == "A1" else tag, []).append(value)


def from_bibtex(text: str):
    for entry in re.split(r"\n(?=@\w+\s*\{)", text):
        if entry.lstrip().startswith("@"):
            found = re.findall(r'(\w[\w-]*)\s*=\s*(\{(?:[^{}]|\{[^{}]*\})*\}|"[^"]*"|\d+)', entry)
            f = {k.lower(): re.sub(r'[{}"]', "", v).strip() for k, v in found}
            if f:
                yield _row("bibtex", ids=[f.get(x) for x in ("url", "note", "eid")], doi=f.get("doi"), title=f.get("title"), year=f.get("year"), authors=re.split(r"\s+and\s+", f.get("author", "")), source=f.get("journal") or f.get("booktitle"), author_keywords=f.get("author_keywords") or f.get("keywords"), abstract=f.get("abstract"))


def _fields(fmt: str, f: dict) -> tuple:
    joined = lambda tag: " ".join(f.get(tag) or []) or None
    return _row(fmt, wos=joined("UT"), doi=joined("DI"), title=joined("TI"), year=joined("PY"), authors=f.get("AU"), source=joined("SO"), author_keywords=joined("DE"), index_keywords=joined("ID"), abstract=joined("AB"))


def from_wos_plain(text: str):
    fields: dict | None = None
    tag = None
    for line in text.splitlines():
        if line.startswith("ER"):
            if fields:
                yield _fields("wos_plain", fields)
            fields = tag = None
        elif re.match(r"[A-Z][A-Z0-9] ", line):
            tag = line[:2]
            fields = {} if tag == "PT" else fields
            if fields is not None:
                fields.setdefault(tag, []).append(line[3:].strip())
        elif line.startswith("   ") and fields is not None and tag:
            fields.setdefault(tag, []).append(line.strip())


def from_wos_tab(text: str):
    import csv

    for r in _table(text, delimiter="\t", quoting=csv.QUOTE_NONE):
        yield _fields("wos_tab", {k: [v] for k, v in r.items() if v and k != "AU"} | {"AU": (r.get("AU") or "").split(";")})


READERS = {"scopus_csv": from_csv, "ris": from_ris, "bibtex": from_bibtex, "wos_plain": from_wos_plain, "wos_tab": from_wos_tab}


def parse(text: str, suffix: str) -> list[tuple]:
    return list(READERS[sniff(text, suffix)](text))


def normalised(raw: DataFrame) -> DataFrame:
    """Records from raw fields: blanks null, DOIs bare, years four digits, lists trimmed and without blanks."""
    listed = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c)).alias(c)
    keys = lambda c: listed(F.split(F.coalesce(F.col(c), F.lit("")), ";"))
    return raw.select(
        eid_digits(*[F.get("ids", i) for i in range(3)]).alias("scopus_id"),
        F.when(F.col("wos") != "", F.replace("wos", F.lit("WOS:"), F.lit(""))).alias("wos_id"),
        bare_doi(F.col("doi")).alias("doi"), blank("title"), year_of(F.col("year")).alias("year"), listed(F.col("authors")).alias("authors"), blank("source"),
        F.when(F.size(F.coalesce("keyword_list", F.array().cast("array<string>"))) > 0, listed(F.col("keyword_list"))).otherwise(keys("author_keywords")).alias("author_keywords"),
        keys("index_keywords").alias("index_keywords"), blank("abstract"), "format", *[c for c in ("file", "pos") if c in raw.columns],
    )


def read_exports(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of all export files at the paths, with file and pos. Other suffixes or files over 50 MB: ValueError."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length", "content")
    for path, length in files.select("path", "length").collect():
        name = path.rsplit("/", 1)[-1]
        if not name.lower().endswith(SUFFIXES):
            raise ValueError(f"{name}: only {', '.join(SUFFIXES)} files are read")
        if length > MAX_BYTES:
            raise ValueError(f"{name} is larger than {MAX_BYTES // 2**20} MB")

    return records(files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))


def records(files: DataFrame) -> DataFrame:
    """Records of export files that are landed as rows: file (its name), content (binary); with file and pos."""

    def run(batches):
        import pandas as pd

        names = [x.split()[0] for x in re.split(r", (?=\w+ )", RAW)]
        for pdf in batches:
            for name, content in zip(pdf["file"], pdf["content"]):
                rows = parse(decode(bytes(content)), "." + name.lower().rsplit(".", 1)[-1])
                yield pd.DataFrame(rows, columns=names).assign(file=name, pos=range(len(rows)))

    return normalised(files.select("file", "content").mapInPandas(run, f"{RAW}, file string, pos long"))
