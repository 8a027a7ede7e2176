"""Spelling variants: each word's near words, counted and ranked without making a pair.

Two words are near if one inserted, deleted or replaced character makes them equal. Words get numbers in the order in which
they are preferred (most frequent first, then by code points), so that the best of some words is the least number, and only
numbers travel.

* Replacements: a word gives out a wildcard key for each position (the text before it and the text after it). The words of a
  key differ at that position only: the key's size less one is how many are near through it, and of its two best words one is
  the best for each member. A key has no more members than the alphabet has letters.
* Insertions and deletions: a word gives out what is left without each of its letters, which meets the vocabulary itself. A
  word found that way is near, and it learns the number and the best of those that lead to it.

Words of more than LITERAL letters give out two rolling hashes of 61 bits instead of the letters, so that a word of any length
costs rows in proportion to its length.
"""

from __future__ import annotations

import re
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, discard, ships_by_value

ships_by_value(__name__)

RUN = "[A-Za-zÀ-ÿ]+"
#: Letters and occurrences of a word at least; how many times as frequent a form has to be.
LETTERS, TIMES, RATIO = 7, 2, 10
#: Letters up to which keys are written out; distinct words that a task holds before it hands out their counts.
LITERAL, HELD = 64, 200_000
#: Stands for the replaced letter, which it can't be.
WILD = "*"
PRIME, BASES = (1 << 61) - 1, (0x1B873593CC9E2D51, 0x0A02BDBF7BB3C0A7)


def thinned(run: str, start: int, every: int) -> str:
    """The run without one letter if the checksum that goes on from start is a multiple of every, else the run."""
    h = crc32(run.encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, every: int | None = None, letters: int = LETTERS, held: int = HELD) -> DataFrame:
    """word, n: how often each word of so many letters at least occurs in all texts; A-Z are lower-cased.

    every: of the distinct runs of a text those lose a letter whose checksum (CRC-32 of doc_id, a colon and the run) is a
    multiple of it: a stated damage, to measure variants with.
    """
    pattern = re.compile(RUN)

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                part = whole.slice(k, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = Counter(pattern.findall(text.encode().lower().decode()))
                    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in own.items():
                        if len(word) < letters:
                            continue
                        if every:
                            word = thinned(word, start, every)
                            if len(word) < letters:
                                continue
                        seen[word] += n
                    if len(seen) > held:
                        yield out()
                        seen = Counter()
        yield out()

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def keys_of(word: str) -> tuple[str, list[str], list[str]]:
    """The word's own key, its wildcard keys (one for each position), and the keys of what is left without a letter, once each."""
    n = len(word)
    # without a letter of a row of equal ones the same is left whichever of them goes
    turns = [k for k in range(n) if not k or word[k] != word[k - 1]]
    if n <= LITERAL:
        return word, [word[:k] + WILD + word[k + 1 :] for k in range(n)], [word[:k] + word[k + 1 :] for k in turns]
    sides = []
    for base in BASES:
        power, before = [1], [0]
        for c in word:
            power.append(power[-1] * base % PRIME)
            before.append((before[-1] * base + ord(c)) % PRIME)
        after = [(before[n] - before[k + 1] * power[n - 1 - k]) % PRIME for k in range(n)]
        wild = [(before[k] * power[n - k] + ord(WILD) * power[n - 1 - k] + after[k]) % PRIME for k in range(n)]
        less = [(before[k] * power[n - 1 - k] + after[k]) % PRIME for k in turns]
        sides.append((before[n], wild, less))
    (a, wild_a, less_a), (b, wild_b, less_b) = sides
    named = lambda mark, size, x, y: f"{mark}{size}:{x:x}:{y:x}"
    less = [word[:k] + word[k + 1 :] for k in turns] if n - 1 <= LITERAL else [named("", n - 1, x, y) for x, y in zip(less_a, less_b)]
    return named("", n, a, b), [named(WILD, f"{n}.{k}", x, y) for k, (x, y) in enumerate(zip(wild_a, wild_b))], less


def keyed(vocabulary: DataFrame) -> DataFrame:
    """key, kind (w: wildcard, d: without a letter, v: the word itself), id of each key of the vocabulary's words."""

    def run(batches):
        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.string(), pa.string(), pa.int64()))], names=["key", "kind", "id"])

        rows: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for id, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, wild, less = keys_of(word)
                rows[0].extend([own, *wild, *less])
                rows[1].extend(["v"] + ["w"] * len(wild) + ["d"] * len(less))
                rows[2].extend([id] * (1 + len(wild) + len(less)))
                if len(rows[0]) > 50_000:
                    yield out()
                    rows = ([], [], [])
        yield out()

    return vocabulary.select("id", "word").mapInArrow(run, "key string, kind string, id long")


def near(vocabulary: DataFrame) -> DataFrame:
    """id, n_near, best (the least id of a near word) of the words that have a near word."""
    group = W.partitionBy("key")
    whole = group.orderBy("id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    of = lambda kind: F.when(F.col("kind") == kind, F.col("id"))
    met = keyed(vocabulary).select(
        "id", "kind", F.count(F.lit(1)).over(whole).alias("size"), F.first("id").over(whole).alias("one"), F.nth_value("id", 2).over(whole).alias("two"),
        F.max(of("v")).over(whole).alias("own"), F.min(of("d")).over(whole).alias("longer"),
    ).where("size > 1")
    n = F.when(F.col("kind") == "d", F.col("own").isNotNull().cast("long")).otherwise(F.col("size") - 1)
    best = F.when(F.col("kind") == "d", F.col("own")).when(F.col("kind") == "v", F.col("longer")).when(F.col("id") == F.col("one"), F.col("two")).otherwise(F.col("one"))
    return met.select("id", n.alias("n"), best.alias("best")).where("n > 0").groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id, root of links id to form: the end of the chain that starts there.

    Pointer doubling: each round follows twice as far. A form is RATIO times as frequent as its word, so chains are short and
    have no rings.
    """
    state = cut(forms.select("id", F.col("form").alias("root")), tidy=False)
    while True:
        up = state.select(F.col("id").alias("_u"), F.col("root").alias("_r"))
        moved = cut(state.join(up, state.root == F.col("_u"), "left").select("id", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), tidy=False)
        discard(state)
        state = moved
        if moved.where("moved").isEmpty():
            return moved.select("id", "root")


def variants(docs: DataFrame, every: int | None = None, letters: int = LETTERS, times: int = TIMES, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root: the words of docs (doc_id, text) with their spelling.

    n_near counts the near words; form is the most frequent of them (ties: the least by code points) if it is ratio times as
    frequent as the word at least, else null; root is where following forms ends, the word itself if it has none. Null texts
    have no words; a null doc_id counts as an empty one in the damage (see word_counts). Repeated rows count again, other
    columns are ignored, words of any length take part, and empty docs give an empty result.
    """
    counted = word_counts(docs, every, letters).where(F.col("n") >= times)
    ranked = cut(counted.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    found = ranked.join(near(ranked), "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")
    other = ranked.select(F.col("id").alias("form"), F.col("word").alias("_form"), F.col("n").alias("_n"))
    fits = F.col("_n") >= F.col("n") * ratio
    spelt = found.join(other, found.best == other.form, "left").select("id", "word", "n", "n_near", *[F.when(fits, F.col(c)).alias(a) for c, a in (("form", "form"), ("_form", "form_word"), ("_n", "form_n"))])
    spelt = cut(spelt)
    ends = roots(spelt.where("form is not null")).join(ranked.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return spelt.join(ends, "id", "left").select("word", "n", "n_near", F.col("form_word").alias("form"), "form_n", F.coalesce("root_word", "word").alias("root"))
