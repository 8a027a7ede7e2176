"""Licence scans against a plain search of the words, and expressions by hand."""

import re

import pytest

from citegrain.llm import licenses, queries

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def base_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_query_is_a_plain_search(spark, sf, docs):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = queries.op12_licenses(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and any(r.n_base for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(texts[r.doc_id])
        labels = [x for x in r.labels.split(",") if x]
        assert labels == sorted(set(labels)) and {x for x in r.base_labels.split(",") if x} <= set(labels)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels) == (r.openness is not None)


@pytest.mark.parametrize("text, labels, openness", [
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc,cc-by-nc-4.0", 0.2),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3", 0.4),
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0", 0.9),
    ("All rights reserved all rights reserved", "reserved", 0.0),
    ("// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\ncode", "bsd,bsd-3-clause,gpl,gpl-2.0-only,mit", 0.9),
    ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */", "gpl,gpl-2.0-or-later", 0.6),
    ("license: MIT and some more words", "mit", 0.9),
    ("license: none of these words", "", None),
    ("SPDX-License-Identifier: LicenseRef-Own", "licenseref-own", 0.1),
    ("sublicense: MIT", "", None),
    ("SPDX-License-Identifier: AND OR", "", None),
    ("", "", None),
])
def test_texts(text, labels, openness):
    found = licenses.scanner()(text)
    assert ",".join(found[3]) == labels
    assert found[6] == pytest.approx(openness) if openness is not None else found[6] is None


@pytest.mark.parametrize("tokens, want", [
    ("a or b and c", "a b c and or"), ("a and b or c", "a b and c or"), ("( a or b ) and c", "a b or c and"), ("a with x and b or c", "a x with b and c or"),
    ("a or b or c", "a b or c or"), ("( a", None), ("a )", None), ("a b", None), ("and", None), ("a or", None), ("( )", None),
])
def test_shunting_yard(tokens, want):
    got = licenses.postfix(tokens.split())
    assert got == (want.split() if want else None)


def test_written_out():
    value = lambda x: licenses.evaluated(licenses.postfix(x.split()))
    assert value("( MIT or GPL-3.0-only ) and Zlib")[1:] == (0.9, "(MIT OR GPL-3.0-only) AND Zlib")
    assert value("MIT or GPL-3.0-only and Zlib")[2] == "MIT OR GPL-3.0-only AND Zlib"
    assert value("( MIT and x ) with y") is None


def test_odd_rows(odd, none):
    rows = licenses.scan_docs(odd).collect()
    texts = sorted((r.doc_id or -1, base_of(r.text)[:2]) for r in odd.select("doc_id", "text").collect())
    assert sorted((r.doc_id or -1, (r.n_words, len(r.places))) for r in rows) == texts
    assert licenses.scan_docs(none).collect() == []
