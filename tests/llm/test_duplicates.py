"""SimHash groups, line dedup and SpotSigs against all pairs; the pipeline's stages."""

import random
import re
from hashlib import sha256
from itertools import combinations

import pytest
import xxhash

from citegrain.llm import line_dedup, near_texts, simhash, spotsigs
from citegrain.llm.common import components
from citegrain.llm.queries import op2_simhash, op9_spotsigs


def classes(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_fingerprint(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows, width, radius):
    fps = [plain_fingerprint(t, width) for _, t in rows]
    root = classes(len(rows), [(a, b) for a, b in combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= radius])
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, root)), key=str)


def test_simhash_groups(spark, sf, docs, odd, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, op2_simhash(spark, sf).collect()), key=str) == plain_groups(rows, 4, 4)
    got = simhash.near_groups(odd, 4, 4).select("doc_id", simhash.hex_of("fp"), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == plain_groups([(r.doc_id, r.text) for r in odd.collect()], 4, 4)
    assert simhash.near_groups(none).collect() == []


def spread_fps(rng, centres, near, flips):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        out |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, flips))) for _ in range(near)}
    return sorted(out)


@pytest.mark.parametrize("sent", [500_000, 0])
@pytest.mark.parametrize("radius,shard", [(4, 2048), (4, 8), (7, 16)])
def test_links_connect_as_all_pairs_do(spark, radius, shard, sent):
    """Random points and dense balls, in whole shards and in shards that are cut into parts; trees broadcast or shuffled."""
    rng = random.Random(radius * 100 + shard)
    fps = sorted({*spread_fps(rng, 12, 25, 4), *(rng.getrandbits(64) for _ in range(200))})
    want = classes(len(fps), [(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= radius])
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    before, simhash.SHARD = simhash.SHARD, shard
    try:
        found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, sent).collect()
    finally:
        simhash.SHARD = before
    at = {x: i for i, x in enumerate(signed)}
    assert all((fps[at[r.a]] ^ fps[at[r.b]]).bit_count() <= 64 for r in found)
    assert classes(len(fps), [(at[r.a], at[r.b]) for r in found]) == want


def test_tree_follows_all_links():
    rng = random.Random(1)
    for _ in range(40):
        fps = spread_fps(rng, 4, 30, 5)
        rng.shuffle(fps)
        want = classes(len(fps), [(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
        assert classes(len(fps), simhash.BKTree(fps, 4).forest()) == want


def test_components(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(60)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(300)] + [(950, 950)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = classes(1000, pairs)
    assert got == {x: want[x] for p in pairs for x in p if p[0] != p[1]}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_lines(rows):
    """Texts after dedup by all pairs of lines."""
    at = []
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            own = " ".join(line.lower().split())
            if own:
                at.append((own, (d is None, d or 0, xxhash.xxh64_intdigest((t or "").encode(), 42) >> 1, k)))
    texts = sorted({x for x, _ in at})
    sets = [{x[k : k + 7] for k in range(max(1, len(x) - 6))} for x in texts]
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])]
    root = dict(zip(texts, classes(len(texts), near)))
    keep = {}
    for x, place in at:
        keep[root[x]] = min(place, keep.get(root[x], place))
    gone = {place for x, place in at if keep[root[x]] != place}
    out = []
    for d, t in rows:
        key = (d is None, d or 0, xxhash.xxh64_intdigest((t or "").encode(), 42) >> 1)
        lines = (t or "").split("\n")
        left = [x for k, x in enumerate(lines) if (*key, k) not in gone]
        out.append((d, None if t is None else "\n".join(left), len(lines) if t else 0, len(lines) - len(left)))
    return sorted(out, key=str)


def near_lines(n=60):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    base = [[word() for _ in range(40)] for _ in range(6)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(3):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = word()
            lines.append(" ".join(w))
        lines.append(" ".join(word() for _ in range(30)))
        rows.append((d, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("sent", [400_000, 0])
def test_lines_as_by_all_pairs(spark, odd, none, docs, sent):
    got = lambda df: sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.drop_lines(df, sent).collect()), key=str)
    rows = near_lines()
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain_lines(rows)
    assert got(odd) == plain_lines([(r.doc_id, r.text) for r in odd.collect()])
    some = docs.where("n_chars < 1500").limit(60)
    some = spark.createDataFrame(some.collect(), some.schema)
    assert got(some) == plain_lines([(r.doc_id, r.text) for r in some.collect()])
    assert got(none) == []
    assert line_dedup.drop_lines(odd, sent).columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_removed"]


@pytest.mark.parametrize("sent", [400_000, 0])
def test_short_lines_take_part(spark, sent):
    """Equal lines of any length and near lines of 7 to 19 characters by all pairs; blank lines stay."""
    rows = [(d, t) for d, (t, _) in enumerate(SHORT)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), sent).collect()}
    lines = [(d, k, " ".join(x.lower().split())) for d, t in rows for k, x in enumerate(t.split("\n")) if x.strip()]
    sets = [{x[k : k + 7] for k in range(max(1, len(x) - 6))} for _, _, x in lines]
    root = classes(len(lines), [(a, b) for a, b in combinations(range(len(lines)), 2) if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])])
    gone = {lines[i][:2] for i, r in enumerate(root) if r != i}
    want = {d: ("\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone), sum(x == d for x, _ in gone)) for d, t in rows}
    assert got == want == dict(enumerate((left, n) for _, (left, n) in SHORT))


#: Texts, and what is left of them with the number of lines that go.
SHORT = [
    ("Les.\nOf, edti oner.\nab\n", ("Les.\nOf, edti oner.\nab\n", 0)),
    ("les.\nOF,  edti oner.\na\n\n", ("a\n\n", 2)),
    ("Les.\nab\nnew", ("new", 2)),
    ("abcdefghijklmnopq", ("abcdefghijklmnopq", 0)),
    ("abcdefghijklmnopqr", ("", 1)),
    ("abcdefgh\nabcdefg", ("abcdefgh\nabcdefg", 0)),
    ("Les.\nnew", ("", 2)),
]


def test_pipeline_drops_copies_with_short_lines(spark, sf):
    """A document of which every line stays elsewhere goes, short lines or not."""
    from citegrain.llm import stages as p

    text = "Les.\nthis is a longer line of some words that counts"
    docs = spark.createDataFrame([(1, text), (2, text + "\nshort"), (3, text)], "doc_id long, text string")
    left = p.lines(spark, docs.selectExpr("*", "length(text) as n_chars"), sf)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, text), (2, "short")]


@pytest.mark.parametrize("sent", [400_000, 0])
def test_a_line_is_never_lost(spark, sent):
    """Ids that floats can't tell apart, beside a null one: one copy of each line stays."""
    line = "a line of some words that three documents have"
    rows = [((1 << 60) + 1, line), ((1 << 60) + 3, line), (None, "something else that only stands here"), (None, line)]
    got = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), sent).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(rows[0][0], line), (rows[1][0], ""), rows[2], (None, "")], key=str)


def test_long_lines_in_small_cells(spark):
    """Near-equal lines of many characters are dealt into more cells, not held at once, and come out whole."""
    rng = random.Random(3)
    base = [rng.choice("abcdefghij klm") for _ in range(3000)]
    rows = []
    for d in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 20)):
            w[rng.randrange(len(w))] = "Z"
        rows.append((d, "x".join(["", *"".join(w).split(), ""])))
    before, line_dedup.CELL_CHARS = line_dedup.CELL_CHARS, 20_000
    try:
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    finally:
        line_dedup.CELL_CHARS = before
    assert got == plain_lines(rows)


def test_wide_and_short_shingles():
    """Packed and named shingles give the same sets as slices do, within one call."""
    for lines in (["abcdefgh", "abcdefg", "abc", "cba", "ab", "aaaaaaaaaa", "aaaaaaa", "ÿÿÿÿÿÿÿÿ"], ["жжжжжжжж", "abcdefgh", "abc", "\U0001f600" * 9, "abcdefgхx"]):
        own = line_dedup.shingle_sets(lines)
        plain = [{x[k : k + 7] for k in range(max(1, len(x) - 6))} for x in lines]
        for i, j in combinations(range(len(lines)), 2):
            assert len(own[i]) == len(plain[i]) and len(set(own[i].tolist()) & set(own[j].tolist())) == len(plain[i] & plain[j])


def test_shared_bands_in_blocks(spark):
    rng = random.Random(2)
    rows = [([rng.randrange(-31, 31) << 58 | rng.randrange(300) for _ in range(line_dedup.BANDS)],) for _ in range(200)]
    count = {}
    for (r,) in rows:
        for x in r:
            count[x] = count.get(x, 0) + 1
    before, line_dedup.BLOCK = line_dedup.BLOCK, 90
    try:
        got = sorted(r.key for r in line_dedup.shared_bands(spark.createDataFrame(rows, "keys array<long>").repartition(5)).collect())
    finally:
        line_dedup.BLOCK = before
    assert got == sorted(x for x, n in count.items() if n > 1)


def test_cells_choose_the_same_keys_in_any_order(spark):
    """Of keys with the same members one is dealt, the same one in whatever order rows come."""
    from citegrain.llm.common import cells

    rows = [(k, m) for k in range(40) for m in (1, 2, 3)]
    seen = set()
    for n in range(6):
        random.Random(n).shuffle(rows)
        dealt = cells(spark.createDataFrame(rows, "key long, id long").repartition(n + 1), ["key"], "id", 10)
        seen.add(tuple(sorted((r.key, r.id) for r in dealt.collect())))
    assert seen == {((0, 1), (0, 2), (0, 3))}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from citegrain.llm import common

    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def test_many_near_lines_in_cells(spark):
    """A group that is larger than a cell comes out whole."""
    before, line_dedup.CELL = line_dedup.CELL, 10
    try:
        rows = near_lines(80)
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    finally:
        line_dedup.CELL = before
    assert got == plain_lines(rows)


def plain_signatures(text):
    tokens = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    common = set(spotsigs.ANCHORS)
    out = set()
    for i, a in enumerate(tokens):
        if a in common:
            chain = [t for t in tokens[i + 1 :] if t not in common][:2]
            if chain:
                out.add((a, *chain, *[""] * (2 - len(chain))))
    return out or ({tuple(tokens)} if tokens else set())


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_spotsigs_likeness(request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - ((h >> 63) << 64)
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, signed(x[1])))
    want = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        m = len(t) // 4
        edited = t[: len(t) - m] + nxt[:m]
        a, b, c = plain_signatures(t), plain_signatures(edited), plain_signatures(nxt)
        near = [round(like(a, x), 9) for x in (b, c)]
        want.append((d, len(t), sha256(edited.encode()).hexdigest(), *near))
    from pyspark.sql import functions as F

    got = [(r.doc_id, r.n_chars, r.sha, round(r.near_edited, 9), round(r.near_next, 9)) for r in spotsigs.likeness(df).withColumn("sha", F.sha2("edited", 256)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_spotsigs_of_equal_texts(spark, sf, none):
    rows = op9_spotsigs(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = {}
    for r in rows:
        assert seen.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    assert spotsigs.likeness(none).collect() == []
    one = spark.createDataFrame([(5, "the quick brown fox and the lazy dog")], "doc_id long, text string")
    assert spotsigs.likeness(one).first().near_next == 1.0


def test_similar_pairs_are_all_found(spark, docs):
    members, links = spotsigs.similar(docs, 0.5)
    rows = [(r.doc_id, plain_signatures(r.text)) for r in docs.collect()]
    least = {}
    for d, s in rows:
        least[frozenset(s)] = min(d, least.get(frozenset(s), d))
    assert {(r.doc_id, r["class"]) for r in members.collect()} == {(d, least[frozenset(s)]) for d, s in rows}
    want = {tuple(sorted((a, b))) for (s, a), (t, b) in combinations(least.items(), 2) if s and t and like(s, t) >= 0.5}
    assert {tuple(sorted((r.class_a, r.class_b))) for r in links.collect()} == want


def test_pipeline_stages(spark, sf):
    from citegrain.llm import stages as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.quality(spark, docs, sf)
    assert kept.columns == docs.columns
    lines = p.lines(spark, kept, sf)
    assert lines.columns == docs.columns and 0 < lines.count() <= kept.count()
    # no pair of five-word similarity 0.8 is left behind line dedup and near copies
    word5 = {r.doc_id: frozenset(zip(*[(r.text or "").lower().split()[k:] for k in range(5)])) for r in lines.collect()}
    near = p.near_copies(spark, lines, sf)
    left = [word5[r.doc_id] for r in near.collect()]
    assert sum(bool(a and b) and like(a, b) >= 0.8 for a, b in combinations(left, 2)) == 0
    groups = near_texts.similar_groups(lines).collect()
    assert sorted(r.doc_id for r in near.collect()) == sorted({r.component_id for r in groups})
    mixed = p.mixture(spark, near, sf)
    assert mixed.columns == docs.columns
    ids = p.encoded(spark, mixed, sf)
    assert ids.where("size(ids) <> n_tokens").count() == 0
    assert ids.count() == mixed.count() == p.run(spark, sf).count()


def test_pipeline_on_odd_rows(spark, sf, odd, none):
    from citegrain.llm import stages as p

    for rows in (odd, none):
        for _, stage in p.STAGES[:-1]:
            made = stage(spark, rows, sf)
            assert made.columns == rows.columns
            # other columns come through unchanged, whatever they are called
            rest = [f"`{c}`" for c in rows.columns if c not in ("text", "n_chars")]
            assert made.select(*rest).subtract(rows.select(*rest)).count() == 0
        p.encoded(spark, rows, sf).collect()


def test_tidy_texts_need_no_splitting_into_words(monkeypatch):
    """Lines of a tidy text get the forms that normal gives, without it; any other white space goes through it."""
    from citegrain.llm import line_dedup

    texts = ["Ein Satz.\n\nΟΔΟΣ\nΑΒΓ İstanbul STRASSE", "", "\n", "one", "x\n" * 3]
    untidy = ["a  b", " a", "a ", "a\n b", "a \nb", "a\tb", "a b", "a\rb\nc", "a b", "­ soft", "a\x1cb\n"]
    want = [[f for line in t.split("\n") if (f := line_dedup.normal(line))] for t in texts + untidy]
    assert [line_dedup.line_table([t])[4] for t in texts + untidy] == want
    assert not any(map(line_dedup.tidy, untidy))
    monkeypatch.setattr(line_dedup, "normal", None)
    at, line, _, _, own = line_dedup.line_table(texts)
    assert own == [f for forms in want[: len(texts)] for f in forms] and line.tolist() == [0, 2, 3, 0, 0, 1, 2] and at.tolist() == [0, 0, 0, 3, 4, 4, 4]


def test_only_known_lines_are_hashed_twice(monkeypatch):
    """Passes that look lines up work out the second hash and the form of those found only."""
    import numpy as np

    texts = ["Eine Zeile\nzwei  Zeilen\n\nEINE zeile", "", "drei\nEine Zeile"]
    at, line, ids, ids2, own = line_table = line_dedup.line_table(texts)
    assert own == ["eine zeile", "zwei zeilen", "eine zeile", "drei", "eine zeile"] and at.tolist() == [0, 0, 0, 2, 2] and line.tolist() == [0, 1, 3, 0, 1]
    plain, seen = xxhash.xxh64_intdigest, []
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x, seed=0: seen.append(seed) or plain(x, seed))
    got = line_dedup.line_table(texts, 1, np.sort(ids[3:4]))
    assert [list(x) for x in got] == [[x[3]] for x in line_table] and seen.count(7) == 1 and seen.count(42) == 5
    assert [len(x) for x in line_dedup.line_table(texts, 1, ids[:0])] == [0] * 5 and seen.count(7) == 1


def test_bands_of_packed_keys(spark):
    """Packed keys give the bands that lists of them do; of those sent along, all that are there and no other."""
    import numpy as np

    rng = random.Random(5)
    rows = [(k, k % 9, [rng.randrange(-(1 << 63), 1 << 63) for _ in range(line_dedup.BANDS)]) for k in range(300)]
    want = sorted((k, n, x) for k, n, keys in rows for x in keys)
    packed = spark.createDataFrame([(k, n, bytearray(np.array(keys, np.int64).tobytes())) for k, n, keys in rows], "id long, size long, keys binary").repartition(3)
    known = np.array(sorted(x for _, _, x in want[::7]))[:, None]
    got = lambda *sent: sorted(map(tuple, line_dedup.banded(packed, *sent).collect()))
    assert got() == want
    assert got(spark.sparkContext.broadcast(known)) == want[::7]
    assert got(spark.sparkContext.broadcast(known[:0])) == []
    assert line_dedup.shared_bands(packed.union(packed)).count() == len(want)
