"""Spelling variants against all pairs of the vocabulary, worked out from the texts again."""

import re
from collections import Counter
from zlib import crc32

import pytest

from citegrain.llm import queries, spelling


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(texts, every=31, letters=7, times=2, ratio=10):
    counts = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= times}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    forms, out = {}, {}
    for w, n in words.items():
        near = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, ()) if one_apart(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = (n, len(near), forms[w], words[best] if forms[w] else None)
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] += (root,)
    return out


def rows_of(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def test_query_is_all_pairs(spark, sf, docs):
    want = expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = rows_of(queries.op11_spelling(spark, sf))
    assert got == want and sum(x[1] for x in got.values()) and any(x[2] for x in got.values())


@pytest.fixture(scope="module")
def planted(spark):
    """Chains of forms, ties, rows of equal letters, words of 64 letters and more, other alphabets."""
    words = {"absolute": 3000, "absolut": 200, "absolutt": 20, "absollut": 2, "absolate": 20, "absalute": 20, "committee": 50, "comittee": 5, "commmittee": 2, "Ünïversé": 40, "ünïversé": 4, "Ünïvers×": 4, "seventy": 7, "sevents": 7}
    for n in (63, 64, 65, 66, 300):
        long = ("abcdefghij" * 40)[:n]
        words |= {long: 30, long[:20] + "z" + long[21:]: 3, long[:-1] + "y": 2, long[:5] + "q" + long[5:]: 2, "k" + long[1:]: 30}
    return [(k, " ".join([w] * n)) for k, (w, n) in enumerate(words.items())] + [(None, None), (5, ""), (None, "committee absolute"), (7, "word " * 30), (7, "word " * 30)]


@pytest.mark.parametrize("every", [None, 3])
def test_planted_words(spark, planted, every):
    df = spark.createDataFrame(planted, "doc_id long, text string")
    got = rows_of(spelling.variants(df, every))
    assert got == expected(planted, every)
    if not every:
        assert got["absollut"][2:] == ("absolut", 200, "absolute") and got["committee"][1] == 2


def test_counts_are_handed_out_in_parts(spark, planted):
    df = spark.createDataFrame(planted, "doc_id long, text string")
    assert sorted(spelling.word_counts(df, 3, held=2).collect()) == sorted(spelling.word_counts(df, 3).collect())


def test_odd_rows(odd, none):
    got = rows_of(spelling.variants(odd, 31))
    assert got == expected([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert spelling.variants(none).collect() == []
