"""Quality rules, mixing, url filter and importance resampling against plain Python."""

import math
from collections import Counter, defaultdict

import pytest

from citegrain.llm import importance, mixing, quality_rules, url_filter
from citegrain.llm.queries import ORACLE_SQL, op1_quality_rules, op3_mixing


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_counts(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts(odd, docs):
    for df in (odd, docs):
        got = quality_rules.features(df.drop("n_words")).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        for r in got:
            assert tuple(r)[1:] == base_counts(r.text), r.text


def tail(n, k, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))


def test_cutoffs_hold_their_risk(spark):
    # 3000 good documents with a few symbols, 300 bad ones with many; a second stratum with too few labels
    rows = [(i, f"{i:06d}" + "ab" * 50 + "#" * (i % 7 == 0) * (i % 23), "en") for i in range(3000)] + [(10_000 + i, f"{i:06d}" + "ab#" * 30, "en") for i in range(300)] + [(20_000 + i, f"{i:06d}" + "ab#" * 30, "xx") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 10_000)) for r in rows] + [(5, None)], "doc_id long, quality int")
    found = quality_rules.fit_cutoffs(docs, labels).collect()
    assert [(r.stratum, r.rule) for r in found] == [("en", "symbols")]
    r = found[0]
    score = {d: min(200, t.count("#") * 200 // len(t)) for d, t, _ in rows}
    assert r.good_rejected == sum(score[d] >= r.cutoff for d, _, s in rows if s == "en" and d < 10_000)
    assert r.bad_rejected == 300 and r.n_good == 3000
    assert tail(3000, r.good_rejected, quality_rules.RISK / 2) <= quality_rules.DELTA / (2 * 2)
    judged = quality_rules.judge(docs, spark.createDataFrame(found)).select("doc_id", "rejected_by", "base_failed", "kept").collect()
    assert all((not x.rejected_by) == (x.doc_id < 10_000 and score[x.doc_id] < r.cutoff or x.doc_id >= 20_000) for x in judged)
    # beyond the number of literals, thresholds are joined; the result is the same
    before, quality_rules.MOST_LITERALS = quality_rules.MOST_LITERALS, 0
    try:
        again = quality_rules.judge(docs, spark.createDataFrame(found)).select("doc_id", "rejected_by", "base_failed", "kept").collect()
    finally:
        quality_rules.MOST_LITERALS = before
    assert sorted(map(str, judged)) == sorted(map(str, again))


def test_copies_are_one_draw_and_null_is_no_empty_name(spark):
    """Copies of one good text do not certify a cutoff; null and '' are strata of their own."""
    good = [(i, "ab" * 50, "en") for i in range(3000)]
    bad = [(10_000 + i, f"{i:06d}" + "ab#" * 30, "en") for i in range(300)]
    many = [(20_000 + i, f"{i:06d}" + "ab" * 50, None) for i in range(3000)] + [(30_000 + i, f"{i:06d}" + "ab#" * 30, None) for i in range(300)]
    few = [(40_000 + i, f"{i:06d}" + "ab#" * 30, "") for i in range(9)]
    rows = good + bad + many + few
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int("#" not in r[1])) for r in rows], "doc_id long, quality int")
    found = quality_rules.fit_cutoffs(docs, labels)
    assert [(r.stratum, r.rule, r.n_good) for r in found.collect()] == [(None, "symbols", 3000)]
    for literals in (2_000, 0):
        before, quality_rules.MOST_LITERALS = quality_rules.MOST_LITERALS, literals
        try:
            hit = {r.doc_id for r in quality_rules.judge(docs, found).collect() if r.rejected_by}
        finally:
            quality_rules.MOST_LITERALS = before
        assert hit == set(range(30_000, 30_300))


def test_exact_tail(spark):
    from pyspark.sql import functions as F

    cases = [(n, k, p) for n in (1, 30, 2000, 90_000) for k in (0, 1, 7, 40) for p in (0.01, 0.025) if k <= n]
    for n, k, p in cases:
        got = spark.range(1).select(quality_rules._tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
        assert got == pytest.approx(tail(n, k, p), rel=1e-9, abs=1e-300)


def test_rules_equal_their_sql(spark, sf):
    import duckdb

    for t in ("documents", "labels"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = duckdb.sql(ORACLE_SQL["op1_quality_rules"])
    got = op1_quality_rules(spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_columns_come_through_whatever_they_are_called(spark, odd, labels):
    """Every operator that keeps the columns of its input keeps the values of all of them."""
    from citegrain.llm import line_dedup, near_texts

    pages = odd.withColumnRenamed("text", "url").drop("host", "kept")
    made = {
        "judge": (odd, quality_rules.judge(odd, quality_rules.fit_cutoffs(odd, labels)), ("n_words", "kept")),
        "drop_lines": (odd, line_dedup.drop_lines(odd), ("n_lines", "text")),
        "keep_one": (odd, near_texts.keep_one(odd), ()),
        "taken": (odd, mixing.taken(odd), ()),
        "urls": (pages, url_filter.judge(pages), ("host", "path", "rule", "score", "verdict")),
    }
    for name, (rows, out, new) in made.items():
        own = [f"`{c}`" for c in rows.columns if c not in new]
        assert set(rows.columns) <= set(out.columns) | set(new), name
        assert out.select(*own).subtract(rows.select(*own)).count() == 0, name


def test_rules_on_odd_rows(odd, none, labels):
    cutoffs = quality_rules.fit_cutoffs(odd, labels)
    assert quality_rules.judge(odd, cutoffs).count() == odd.count()
    assert quality_rules.judge(none, quality_rules.fit_cutoffs(none, labels.limit(0))).collect() == []


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.discard(s)
        if not free:
            return target


def held(rows):
    """rows: (doc_id, source, size, source_size, target, times)."""
    sizes, taken = Counter(), Counter()
    for _, s, n, _, _, times in rows:
        sizes[s] += n
        taken[s] += n * times
    want = water(sizes)
    for _, s, n, total, target, times in rows:
        assert total == sizes[s] and target == pytest.approx(want[s]) and 0 <= times <= 3
    for s in sizes:  # as near as sums of whole documents come
        own = [n for _, x, n, *_ in rows if x == s and n]
        times = int(want[s] // sizes[s]) if sizes[s] else 0
        budget, sums = round(want[s] - times * sizes[s]), {0}
        for n in own:
            sums |= {x + n for x in sums if x + n <= budget}
        assert taken[s] == times * sizes[s] + max(sums), s


def test_mix_meets_targets(spark, sf, docs, odd, none):
    pick = lambda df: [(r.doc_id, r.source, r["size"], r.source_size, r.target, r.times) for r in mixing.mix(df).collect()]
    rows = pick(docs)
    assert {r[0]: r[2] for r in rows} == {r.doc_id: len(words(r.text)) for r in docs.collect()}
    held(rows)
    assert sorted(rows) == sorted(pick(docs.repartition(7)))
    odd_rows = pick(odd)
    assert len(odd_rows) == odd.count()
    held(odd_rows)
    assert mixing.mix(none).collect() == []
    taken = Counter(r.doc_id for r in mixing.taken(docs).collect())
    assert taken == Counter({r[0]: r[5] for r in rows if r[5]})
    assert op3_mixing(spark, sf).where("taken > 3 * size").count() == 0
    assert mixing.taken(odd).count() == sum(r[5] for r in odd_rows)


def test_slices_keep_the_order(spark, docs):
    """Documents of one length are picked by their hash, however they are sliced."""
    same = spark.createDataFrame([(i, f"{i} b c", "ab"[i % 5 == 0]) for i in range(900)], "doc_id long, text string, source string")
    one = {(r.doc_id, r.times) for r in mixing.mix(same).collect()}
    before, mixing.SLICE = mixing.SLICE, 20
    try:
        assert {(r.doc_id, r.times) for r in mixing.mix(same).collect()} == one
    finally:
        mixing.SLICE = before


def test_equal_sizes_are_taken_alike(spark):
    """Documents that differ in their text only are picked by it, in whatever order they come."""
    rows = [(7, f"{i} b c", "ab"[i % 5 == 0]) for i in range(80)]
    seen = set()
    for k in range(4):
        some = spark.createDataFrame(rows[k * 20 :] + rows[: k * 20], "doc_id long, text string, source string").repartition(k + 1)
        seen.add(tuple(sorted((r.key, r.times) for r in mixing.mix(some).collect())))
    assert len(seen) == 1


def test_fit_holds_few_sums():
    """A very long text among thousands of lengths: memory stays far below a bit set for each part."""
    import tracemalloc

    lengths, counts = [*range(1, 3001), 1_000_000], [3] * 3000 + [1]
    tracemalloc.start()
    took = mixing.fit(lengths, counts, 7_000_003)
    assert sum(a * b for a, b in zip(lengths, took)) == 7_000_003
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()


def test_fit_is_best():
    import random

    rng = random.Random(3)
    for _ in range(300):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 6) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)))
        took = mixing.fit(lengths, counts, budget)
        assert all(0 <= a <= b for a, b in zip(took, counts))
        got, low = sum(a * b for a, b in zip(lengths, took)), [c * budget // max(1, sum(a * b for a, b in zip(lengths, counts))) for c in counts]
        sums = {sum(a * b for a, b in zip(lengths, low))}
        for a, b, t in zip(lengths, counts, low):
            sums = {s + a * n for s in sums for n in range(b - t + 1) if s + a * n <= budget}
        assert got == max(sums)


def test_fit_of_large_budgets():
    """Beyond the exact program's range the greedy pass comes first; the sum still comes within a few words."""
    import random

    rng = random.Random(8)
    for _ in range(5):
        lengths = sorted(rng.sample(range(5, 5000), 300))
        counts = [rng.randint(1, 400) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts))
        budget = rng.randint(total // 10, total)
        took = mixing.fit(lengths, counts, budget)
        assert all(0 <= a <= b for a, b in zip(took, counts)) and budget - sum(a * b for a, b in zip(lengths, took)) <= 5


RULED = [
    ("http://x.net/", "x.net", "/", "net/", "block"),
    ("http://x.net", "x.net", "", None, None),
    ("https://A.Example.NET/en/1?q#f", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://myexample.net/en/1", "myexample.net", "/en/1", "net/", "block"),
    ("ftp://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://example.com/DE/", "example.com", "/DE/", None, None),
    ("a://b.org/fr/x://y", "b.org", "/fr/x://y", "org/fr/", "allow"),
    ("http://example.org?/fr/", "example.org", "", None, None),
    ("no scheme", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://É.org/fr/\nx", "É.org", "/fr/\nx", "org/fr/", "allow"),
]


def test_rules_for_urls(spark):
    pages = spark.createDataFrame([(i, r[0], "x") for i, r in enumerate(RULED)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(RULED)
    for i, (_, host, path, rule, verdict) in enumerate(RULED):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert url_filter.judge(pages.where("false")).collect() == []
    alone = url_filter.judge(pages.where("page_id in (5, 8)")).collect()
    assert [r.verdict for r in alone] == ["allow"] * 2


def test_models_add_up_and_tell_apart(spark):
    """Chances after any context sum to one; held-out urls of unknown hosts are told apart."""
    urls = ["http://x.net/spam/casino%d" % i for i in range(300)]
    counted = Counter(raw[at - k : at + 1] for raw in map(url_filter.grams_of, urls) for at in range(url_filter.ORDER, len(raw)) for k in range(url_filter.ORDER + 1))
    for keep in (None, 60):
        model = url_filter.compiled(dict(counted.most_common(keep)))
        for context in (b"\0\0\0\0", b"sino", b"zzzz", b"ino4"):
            chance = sum(math.exp(url_filter.likelihood(model, context + bytes([b]))) for b in range(256))
            assert chance == pytest.approx(1, abs=1e-6)
    good = [f"http://s{i}.example.net/en/news/{i}.html" for i in range(200)] + [f"http://s{i}.example.org/news/{i}.html" for i in range(100)]
    bad = [f"http://s{i}.net/casino/{i}-win?x=spam" for i in range(200)] + [f"http://s{i}.example.org/casino/{i}-win?x=spam" for i in range(100)]
    pages = spark.createDataFrame(list(enumerate(good + bad)), "page_id long, url string")
    rest = [r for r in url_filter.judge(pages).collect() if r.rule is None]
    assert len(rest) == 200
    assert sum((r.verdict == "block") == ("casino" in r.url) for r in rest) >= 190


def held_hosts(spark, pages):
    from pyspark.sql import functions as F

    return {r.page_id for r in pages.where(url_filter.held_out(url_filter.host_of(F.col("url")))).collect()}


def test_verdicts_by_brute_force(spark):
    """The query against plain models of the same urls and a threshold found by trying all."""
    from citegrain.llm.queries import op8_url_filter

    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    got = {r.page_id: r for r in op8_url_filter(spark, sf).collect()}
    held, url = held_hosts(spark, pages), {r.page_id: r.url for r in pages.collect()}
    assert set(got) == set(url)
    counted = {"allow": Counter(), "block": Counter()}
    for i, r in got.items():
        if r.rule and i not in held:
            raw = url_filter.grams_of(url[i])
            counted[r.verdict].update(raw[at - k : at + 1] for at in range(url_filter.ORDER, len(raw)) for k in range(url_filter.ORDER + 1))
    models = {v: url_filter.compiled(c) for v, c in counted.items()}

    def score(u):
        raw = url_filter.grams_of(u)
        return (url_filter.likelihood(models["allow"], raw) - url_filter.likelihood(models["block"], raw)) / (len(raw) - url_filter.ORDER)

    known = [(math.floor(score(url[i]) * url_filter.BINS), r.verdict) for i, r in got.items() if r.rule and i in held]
    wrong = lambda at: sum(b < at for b, v in known if v == "allow") / sum(v == "allow" for _, v in known) + sum(b >= at for b, v in known if v == "block") / sum(v == "block" for _, v in known)
    tried = {at: wrong(at) for at in range(min(known)[0], max(known)[0] + 2)}
    best = [at for at, w in tried.items() if w <= min(tried.values()) + 1e-12]
    threshold = (best[0] + best[-1]) / 2 / url_filter.BINS
    for i, r in got.items():
        if r.rule is None:
            assert r.score == pytest.approx(score(url[i]), abs=1e-9)
            assert r.verdict == ("block" if r.score < threshold else "allow")


def test_scores_are_those_of_all_grams(spark):
    """More grams of a class than any number that is sent: scores and verdicts are those of the plain models of all counts."""
    import random

    rng = random.Random(8)
    tail = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789-/", k=60))
    urls = [f"http://s{i}.example.net/en/{tail()}" for i in range(2500)] + [f"http://s{i}.net/{tail()}" for i in range(2500)] + [f"http://s{i}.example.org/{tail()}" for i in range(200)]
    urls += [u.replace("example.net/en", "example.org") for u in urls[:20]] + [u.replace(".net", ".org", 1) for u in urls[2500:2520]] + [None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    held = held_hosts(spark, pages)
    counted = {"allow": Counter(), "block": Counter()}
    for i, u in enumerate(urls[:5000]):
        if i not in held:
            raw = url_filter.grams_of(u)
            counted["allow" if i < 2500 else "block"].update(raw[at - k : at + 1] for at in range(url_filter.ORDER, len(raw)) for k in range(url_filter.ORDER + 1))
    assert min(map(len, counted.values())) > 200_000
    models = [url_filter.compiled(c) for c in counted.values()]
    runs = [{r.page_id: r for r in df.collect()} for df in (url_filter.judge(pages), url_filter.judge(pages, head=500))]
    for i, u in enumerate(urls):
        raw = url_filter.grams_of(u)
        want = (url_filter.likelihood(models[0], raw) - url_filter.likelihood(models[1], raw)) / (len(raw) - url_filter.ORDER)
        for got in runs:
            assert got[i].score is None if i < 5000 else got[i].score == pytest.approx(want, abs=1e-9)
    assert runs[0] == runs[1]


def test_importance_prefers_the_target(spark, docs, labels, odd, none):
    found = importance.resample(docs, labels).collect()
    assert len(found) == docs.count()
    quality = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    per = labels.count()
    k = round(len(found) * sum(q == 1 and not t for q, t in quality.values()) / per)
    assert sum(r.kept for r in found) == k
    cut = sorted((r.gumbel_key for r in found), reverse=True)[k - 1]
    assert all(r.kept == (r.gumbel_key >= cut) for r in found)
    odd_found = importance.resample(odd, labels, k=4).collect()
    assert len(odd_found) == odd.count() and sum(r.kept for r in odd_found) == 4
    assert importance.resample(none, labels).collect() == []
    assert all(r.kept and r.log_weight == 0 for r in importance.resample(odd, labels.limit(0)).collect())


def test_importance_weights_by_brute_force(docs, labels):
    """Log weights and noise against counts in plain dictionaries, a document's own n-grams left out."""
    from zlib import crc32

    grams = {}
    for r in docs.collect():
        h = [crc32(w.lower()) for w in (r.text or "").encode().split()]
        mix = lambda x: x * 0x9E3779B97F4A7C15 % (1 << 64)
        grams[r.doc_id] = Counter([mix(x) >> 46 for x in h] + [((mix(x) ^ y) * 0xC2B2AE3D27D4EB4F % (1 << 64)) >> 46 for x, y in zip(h, h[1:])])
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    raw, target = sum(grams.values(), Counter()), sum((g for d, g in grams.items() if d in good), Counter())
    n_raw, n_target = raw.total(), target.total()
    for r in importance.resample(docs, labels).collect():
        own, mine, n = grams[r.doc_id], r.doc_id in good, grams[r.doc_id].total()
        share = (n_target - mine * n) / (n_raw - n)
        want = sum(c * math.log((target[g] - mine * c + importance.PRIOR) / ((raw[g] - c) * share + importance.PRIOR)) for g, c in own.items())
        assert r.log_weight == pytest.approx(want / n * importance.LENGTH if n else 0.0, abs=1e-6)
        assert math.isfinite(r.gumbel_key)


def test_importance_separates_held_out(spark):
    """Ranked by weight, junk of an unseen half goes below good text."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = {r.doc_id: r for r in importance.resample(docs, labels.where("doc_id % 2 = 0")).collect()}
    by = defaultdict(list)
    for r in labels.where("doc_id % 2 = 1").collect():
        by[r.quality].append(found[r.doc_id].log_weight)
    wins = sum(a > b for a in by[1] for b in by[0]) / (len(by[1]) * len(by[0]))
    assert wins > 0.9


def test_top_k_with_ties(spark):
    rows = spark.createDataFrame([(i % 50, float(i % 3)) for i in range(5000)], "doc_id long, key double")
    for k in (0, 1, 1000, 1666, 1667, 2500, 4999, 5000, 6000):
        got = importance.top_k(rows, "key", k).collect()
        assert len(got) == 5000 and sum(r.kept for r in got) == min(k, 5000)
        assert min((r.key for r in got if r.kept), default=9) >= max((r.key for r in got if not r.kept), default=-1)


def test_rows_of_one_text_in_two_sources(spark):
    """taken() takes from each source what mix() says, whatever the order of the rows, and the same rows each time."""
    from collections import Counter

    rows = [(1, "one two three", s, f"{s}{k}") for s in ("x", "y", None) for k in range(5)] + [(k, "other words here", "x", "z") for k in range(40)] + [(None, None, "y", "n")] * 2
    made = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, source string, own string").repartition(3)
        want = Counter()
        for r in mixing.mix(df).collect():
            want[r.doc_id, r.source] += r.times
        out = mixing.taken(df).collect()
        assert Counter((r.doc_id, r.source) for r in out) == +want
        made.append(sorted(map(repr, out)))
    assert made[0] == made[1]
