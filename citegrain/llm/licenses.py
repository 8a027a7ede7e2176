"""License scans: tags and notice phrases by Aho-Corasick, licence expressions by a shunting-yard parser.

Phrases are looked for in a text's words (lower-cased letters, digits and all that is not ASCII, single spaces between),
tags in the lower-cased text itself. What follows a tag is read as an expression of licence identifiers with ``and``, ``or``,
``with`` and brackets: a shunting-yard turns it into postfix order, which is evaluated twice, once for how sure the find is
and once for how open the terms are. ``or`` leaves the choice (the greater), ``and`` binds to both (the lesser), ``with`` adds
an exception, which loosens a copyleft.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ships_by_value

ships_by_value(__name__)

#: The base phrases, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further phrases, and their labels.
PHRASES = {
    "cc by nc": "cc-by-nc", "cc by nc nd": "cc-by-nc-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "cc0": "cc0",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "public domain": "public-domain",
    "apache license": "apache", "bsd license": "bsd", "isc license": "isc", "mit license": "mit", "mozilla public license": "mpl", "eclipse public license": "epl",
    "lesser general public license": "lgpl", "affero general public license": "agpl",
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd",
}
#: Words that make a notice of a phrase that follows them, within so many words.
NOTICE, NEAR = frozenset(("licensed", "released", "distributed", "copyright", "license", "terms")), 8
#: Tags, and whether what follows has to be known identifiers only.
TAGS = {"spdx-license-identifier:": False, "license-expression:": False, "license:": True, "licence:": True}
#: Families of identifiers, and how open their terms are: 1 without conditions, 0 none granted.
OPEN = {
    "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "0bsd": 1.0, "apache": 0.9, "bsd": 0.9, "bsl": 0.9, "cc-by": 0.9, "isc": 0.9, "mit": 0.9, "zlib": 0.9,
    "cc-by-sa": 0.6, "cc-by-nd": 0.3, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "epl": 0.6, "mpl": 0.6, "lgpl": 0.5, "gpl": 0.4, "agpl": 0.3, "reserved": 0.0,
}
#: How open the terms of an unknown identifier are taken to be, and what an exception adds to a copyleft.
UNKNOWN, LOOSER = 0.1, 0.2
#: How sure a find is: a phrase, a phrase of a notice, a known identifier behind a tag, an unknown one.
SURE = {"phrase": 0.6, "notice": 0.9, "known": 0.95, "unknown": 0.5}
RANK = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+-]*)")
VERSION = re.compile(r"(?:-\d+(?:\.\d+)*)?(?:-only|-or-later|\+)?(?:-clause)?$")


def family(name: str) -> str | None:
    """The family of an identifier without its version (gpl of GPL-2.0-or-later), or None if it is unknown."""
    name = name.lower()
    while name not in OPEN:
        shorter = VERSION.sub("", name, count=1)
        if shorter in ("", name):
            return None
        name = shorter
    return name


def postfix(tokens: list[str]) -> list[str] | None:
    """Identifiers and operators in postfix order by the shunting-yard; None for what is no expression."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # whether an identifier or an opening bracket is due
    for t in tokens:
        word = t.lower()
        if word in RANK:
            if operand:
                return None
            while waiting and RANK.get(waiting[-1], 0) >= RANK[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand = True
        elif t == "(":
            if not operand:
                return None
            waiting.append(t)
        elif t == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluated(steps: list[str]) -> tuple[float, float, str] | None:
    """(how sure, how open, the expression written out) of a postfix expression; None if an exception is not a plain name."""
    stack: list[tuple[float, float, str, int]] = []
    for t in steps:
        if t not in RANK:
            known = family(t)
            stack.append((SURE["known" if known else "unknown"], OPEN.get(known, UNKNOWN), t, 4))
            continue
        b, a = stack.pop(), stack.pop()
        text = [f"({x[2]})" if x[3] < RANK[t] else x[2] for x in (a, b)]
        if t == "with":
            if b[3] != 4 or a[3] != 4:
                return None
            sure, free = a[0], min(1.0, a[1] + LOOSER) if a[1] < 0.9 else a[1]
        else:
            pick = max if t == "or" else min
            sure, free = pick(a[0], b[0]), pick(a[1], b[1])
        stack.append((sure, free, f"{text[0]} {t.upper()} {text[1]}", RANK[t]))
    return stack[0][:3]


def expression(text: str, at: int, known: bool = False) -> list[str]:
    """The tokens of the expression that starts at this place, as far as the grammar allows (and identifiers are known), on one line."""
    tokens: list[str] = []
    depth, operand, good = 0, True, 0
    while m := TOKEN.match(text, at):
        t = m[1]
        word = t.lower()
        if operand and (word in RANK or t == ")") or not operand and (word not in RANK and t != ")") or t == ")" and not depth:
            break
        t = t if t in "()" else t.rstrip(".")
        if known and operand and t != "(" and tokens[-1:] not in (["with"], ["WITH"]) and not family(t):
            break
        depth += (t == "(") - (t == ")")
        operand = word in RANK or t == "("
        tokens.append(t)
        at = m.end()
        if not operand and not depth:
            good = len(tokens)
    return tokens[:good]


def scanner():
    """A function from a text to (number of words, places of base phrases, base labels, all labels, expressions, score, openness)."""
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for words in {**BASE, **PHRASES}:
        phrases.add_word(f" {words} ", words)
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    # bytes to words: A-Z lower-cased, what is no word byte a space
    table = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

    def scan(text: str):
        raw = text.encode()
        words = raw.translate(table).split()
        joined = f" {b' '.join(words).decode('latin-1')} "
        places: list[int] = []
        base, found, expressions = set(), {}, []
        seen, number = 0, 0  # the character up to which words are counted, and their number

        def add(label: str, sure: float, free: float) -> None:
            was = found.get(label, (0.0, 1.0))
            found[label] = (max(was[0], sure), min(was[1], free))

        hits = sorted((last - len(w) - 1, w) for last, w in phrases.iter(joined))
        for start, phrase in hits:
            number += joined.count(" ", seen, start)
            seen = start
            at, size = number, phrase.count(" ") + 1
            if phrase in BASE:
                places.append(at)
                base.add(BASE[phrase])
            label = BASE.get(phrase) or PHRASES[phrase]
            notice = any(w.decode("latin-1") in NOTICE for w in words[max(0, at - NEAR) : at])
            add(label, SURE["notice" if notice else "phrase"], OPEN[label])
            # a version behind it: "version 2 0", "v3", "4 0"
            after = [w.decode("latin-1") for w in words[at + size : at + size + 3]]
            if after and after[0] in ("version", "v"):
                after = after[1:]
            elif after and re.fullmatch(r"v\d+", after[0]):
                after[0] = after[0][1:]
            if after and re.fullmatch(r"\d{1,2}", after[0]):
                numbers = after[:2] if len(after) > 1 and re.fullmatch(r"\d", after[1]) else after[:1]
                add(f"{label}-{'.'.join(numbers)}", SURE["notice" if notice else "phrase"], OPEN[label])
        low, plain = raw.lower().decode("latin-1"), raw.decode("latin-1")
        for last, tag in tags.iter(low):
            before = last - len(tag)
            if before >= 0 and (low[before].isalnum() or low[before] == "-"):
                continue  # the end of a longer word
            tokens = expression(plain, last + 1, TAGS[tag])
            names = [t for k, t in enumerate(tokens) if t.lower() not in RANK and t not in "()" and (not k or tokens[k - 1].lower() != "with")]
            steps = postfix(tokens) if names else None
            value = evaluated(steps) if steps else None
            if value:
                expressions.append(value[2])
                for label in {x.lower() for x in names} | {family(x) for x in names} - {None}:
                    add(label, value[0], value[1])
        doubt = 1.0
        for label in sorted(found):
            doubt *= 1 - found[label][0]
        free = min((x[1] for x in found.values()), default=None)
        return len(words), places, sorted(base), sorted({*found, *base}), expressions, 1 - doubt, free

    return scan


def scan_docs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (of base phrases, words from 0), base_labels, labels, expressions (arrays), score, openness of each row of docs.

    score: how sure it is that the text bears terms of a licence, 0 if nothing is found. openness: of the strictest terms found,
    null if nothing is found; an expression counts as a whole. Null text: like an empty one. Other columns are ignored, rows
    may repeat, empty docs give an empty result, texts of any length are scanned whole.
    """

    def rows(batches):
        import pyarrow as pa

        scan = scanner()
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.float64())
        names = ["doc_id", "n_words", "places", "base_labels", "labels", "expressions", "score", "openness"]
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                part = whole.slice(k, 256)
                found = [scan(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(list(c), t) for c, t in zip(zip(*found), kinds)]], names=names)

    out = "doc_id long, n_words long, places array<long>, base_labels array<string>, labels array<string>, expressions array<string>, score double, openness double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, out)
