"""Near copies of similarity 0.8 or more against all pairs of texts."""

import random
import re
from itertools import combinations

import pytest

from citegrain.llm import near_texts, simhash


def shingle_set(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def like(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def pairs_of(rows, least):
    sets = [shingle_set(t) for _, t in rows]
    return [(a, b) for a, b in combinations(range(len(rows)), 2) if like(sets[a], sets[b]) >= least]


def edited(rng, words, edits):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"w{rng.randrange(10**6)}"
    return out


def wrapped(rng, words):
    """The words on lines of random length."""
    return "".join(w + ("\n" if rng.random() < 0.1 else " ") for w in words)


def copies(seed, n=120, most=8):
    """Pairs of a text and a copy with its words on other lines and some of them replaced, and texts of their own."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        rows += [(len(rows), wrapped(rng, words)), (len(rows) + 1, wrapped(rng, edited(rng, words, rng.randint(0, len(words) * most // 200))))]
    return rows


@pytest.mark.parametrize("sent", [near_texts.SENT, 0])
def test_recall_and_exactness(spark, sent):
    """Nine of ten pairs of 0.8 or more are found, and nothing is grouped that no chain of such pairs connects."""
    rows = copies(3)
    got = {r.doc_id: r.component_id for r in near_texts.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), most_sent=sent).collect()}
    near = pairs_of(rows, 0.8)
    found = [(a, b) for a, b in near if got[a] == got[b]]
    assert len(near) > 60 and len(found) >= 0.95 * len(near)
    assert {(c, d) for d, c in got.items() if c != d} <= set(near)


@pytest.mark.parametrize("sent", [near_texts.SENT, 0])
@pytest.mark.parametrize("size, groups, edits", [(40, 2, 2), (100, 1, 2), (300, 1, 3)])
def test_dense_groups_around_the_similarity(spark, sent, size, groups, edits):
    """Groups in which few of very many pairs within the radius are similar enough: nine of ten of those are found."""
    rng = random.Random(size)
    base = [[f"w{rng.randrange(3000)}" for _ in range(200)] for _ in range(groups)]
    texts = [wrapped(rng, edited(rng, b, rng.randint(edits, 6))) for b in base for _ in range(size)] + [" ".join(f"w{rng.randrange(3000)}" for _ in range(150)) for _ in range(60)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in near_texts.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), most_sent=sent).collect()}
    near = pairs_of(rows, 0.8)
    assert len(near) > 20 and sum(got[a] == got[b] for a, b in near) >= 0.97 * len(near)
    partners = {x for pair in near for x in pair}
    assert all(d in partners and c in partners for d, c in got.items() if c != d)


def test_both_ways_agree_on_cut_shards(spark):
    """Dense groups in shards of a few parts, broadcast and shuffled, find the same groups."""
    rng = random.Random(8)
    base = [[f"w{rng.randrange(3000)}" for _ in range(300)] for _ in range(3)]
    rows = [(k, wrapped(rng, edited(rng, base[k % 3], rng.randint(0, 3)))) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before, simhash.SHARD = simhash.SHARD, 8
    try:
        one, two = ({r.doc_id: r.component_id for r in near_texts.similar_groups(df, most_sent=n).collect()} for n in (1000, 0))
    finally:
        simhash.SHARD = before
    assert one == two == {k: k % 3 for k in range(90)}


def test_no_group_without_a_similar_pair(spark):
    """Pairs of similarity 0.6 to 0.79 stay apart, and a long repetition does not hide what else a text says."""
    rng = random.Random(5)
    rows = []
    for edits in (8, 9, 10, 11, 12):
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(edited(rng, words, edits)))]
    filler = "spam " * 500
    rows += [(100 + k, filler + " ".join(f"w{rng.randrange(3000)}" for _ in range(60))) for k in range(2)]
    got = {r.doc_id: r.component_id for r in near_texts.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = set(pairs_of(rows, 0.8))
    at = {d: k for k, (d, _) in enumerate(rows)}
    assert {(at[c], at[d]) for d, c in got.items() if c != d} <= linked
    assert got[101] == 101


@pytest.mark.parametrize("sent", [near_texts.SENT, 0])
def test_one_of_each_group_stays(docs, odd, none, sent):
    left = near_texts.keep_one(odd, most_sent=sent)
    assert left.columns == odd.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(1) == 1 and ids.count(None) == 2 and 8 not in ids
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = {r.doc_id for r in near_texts.keep_one(docs, most_sent=sent).collect()}
    near = pairs_of(rows, 0.8)
    partners = {}
    for a, b in near:
        partners.setdefault(rows[b][0], []).append(rows[a][0])
    assert all(d in partners or any(d in p for p in partners.values()) for d, _ in rows if d not in kept)
    both = [1 for a, b in near if rows[a][0] in kept and rows[b][0] in kept]
    assert len(near) > 10 and len(both) <= 0.1 * len(near)
    assert near_texts.keep_one(none, most_sent=sent).collect() == []
