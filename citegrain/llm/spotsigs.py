"""SpotSigs: fingerprints from chains of content words that follow common words. DataFrame functions only.

A text's words (letters and digits, lower-cased) are anchors if they are common words, else content words. For each anchor
the signature is the anchor and the next two content words, hashed to 64 bits; a chain cut off by the text's end stands
with one. The fingerprint is the set of signatures, written as sorted hexadecimal numbers. A text with words but without
any anchor has its content-word sequence as the only signature; a text without words has none.

Similar documents are found among sets of like lengths only: lengths are cut into partitions so wide that a set of Jaccard
similarity t or more lies in its own or the next partition, and an inverted index on each set's rarest signatures, as many
as must include a shared one, gives the candidates, which are checked for length before sets are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, let, text_of

#: Common words of four languages that start a chain.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his in is it not of on or she that the this to was were which will with you "
    "als auf aus das dem den der des die ein eine einer es für ich im in ist mit nicht sich sie sind und von war werden wie zu zum zur "
    "au aux avec ce dans de des du elle en est et il la le les ne nous on ou par pas pour que qui se sont sur un une vous "
    "al como con de del el en es esta este la las los más no o para pero por que se sin sobre su un una y"
).split()


def signatures(text: Column) -> Column:
    """Sorted distinct signatures (long) of a text."""
    anchors = list(dict.fromkeys(ANCHORS))

    def from_tokens(t: Column) -> Column:
        # content words with their places; the gap in front of one holds the anchors of its chain
        content = F.filter(F.transform(t, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: ~x["w"].isin(anchors))
        return let(content, lambda c: chains(t, c))

    def chains(t: Column, c: Column) -> Column:
        def of(x: Column, j: Column) -> Column:
            start = F.when(j == 0, F.lit(0)).otherwise(F.get(c, j - 1)["i"] + 1)
            following = F.coalesce(F.get(c, j + 1)["w"], F.lit(""))
            return F.when(x["i"] > start, F.transform(F.slice(t, start + 1, x["i"] - start), lambda a: F.xxhash64(a, x["w"], following)))

        found = F.flatten(F.filter(F.transform(c, of), lambda x: x.isNotNull()))
        whole = F.when(F.size(t) > 0, F.array(F.xxhash64(F.array_join(t, " ")))).otherwise(F.array().cast("array<bigint>"))
        return let(found, lambda f: F.when(F.size(f) > 0, F.sort_array(F.array_distinct(f))).otherwise(whole))

    return let(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), from_tokens)


def written(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ",")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    every = F.size(a) + F.size(b)
    return F.when(every == 0, F.lit(1.0)).otherwise(both / (every - both))


def partition(size: Column, threshold: float) -> Column:
    """The partition of a set's length: sets of Jaccard ``threshold`` or more are in the same or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / math.log(1 / threshold) + 1e-9)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with sigs (array<long>) and fingerprint (string); columns of these names are replaced. Null text: like an empty one."""
    return docs.drop("sigs", "fingerprint").withColumn("sigs", signatures(text_of())).withColumn("fingerprint", written(F.col("sigs")))


def similar(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id with its class, and class_a, class_b, similarity of all classes at or above the threshold.

    Documents of equal fingerprints are one class, named by the least doc_id; classes are compared, not copies. Sets
    without signatures are a class without links. Empty docs: both are empty.
    """
    sets = fingerprints(docs.select("doc_id", "text"))
    ids = cut(sets.select("doc_id", F.sha2("fingerprint", 256).alias("_h"), "sigs"))
    classes = cut(ids.groupBy("_h").agg(F.min("doc_id").alias("class"), F.first("sigs").alias("sigs")).withColumn("n", F.size("sigs")))
    members = ids.join(classes.select("_h", "class"), "_h").select("doc_id", "class")
    freq = classes.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    by_rarity = W.partitionBy("class").orderBy("f", "sig")
    ranked = classes.select("class", "n", F.explode("sigs").alias("sig")).join(freq, "sig", "left").withColumn("f", F.coalesce("f", F.lit(1))).withColumn("r", F.row_number().over(by_rarity))
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    part = partition(F.col("n"), threshold)
    index = ranked.where((F.col("r") <= prefix) & (F.col("f") > 1)).select("class", "n", "sig", part.alias("part"))
    probe = index.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1))).alias("a")
    # the shorter set (or the lesser class at equal length) looks into its own and the next partition
    long_enough = (F.col("a.n") >= F.col("b.n") * threshold - 1e-9) & ((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.class") < F.col("b.class"))))
    pairs = probe.join(index.alias("b"), ["sig", "part"]).where(long_enough).select(F.col("a.class").alias("class_a"), F.col("b.class").alias("class_b")).distinct()
    one, two = (classes.select(F.col("class").alias(f"class_{x}"), F.col("sigs").alias(f"sigs_{x}")) for x in "ab")
    links = pairs.join(one, "class_a").join(two, "class_b").withColumn("similarity", jaccard(F.col("sigs_a"), F.col("sigs_b")))
    return members, links.where(F.col("similarity") >= threshold - 1e-12).select("class_a", "class_b", "similarity")


#: Ranges of doc_id for each shuffle partition; spark.sql.shuffle.partitions has to follow the size of the texts.
RANGES = 4


def likeness(docs: DataFrame, share: int = 4) -> DataFrame:
    """Each document against an edited self and against its successor in ascending doc_id (the last one's is the first).

    Edited: the last floor(n_chars / share) code points replaced by the first as many (or all) of the successor. Returns
    doc_id, n_chars, edited (the text), fingerprint, edited_fingerprint, near_edited, near_next, the exact
    Jaccard similarity of the signature sets. Null text: like an empty one. Null doc_ids come first; equal ones are ordered by a hash of the text. Empty docs: empty result.

    Texts are shuffled once, by range of doc_id; the first document of a range is also sent to the range before, where
    it is the last one's successor. The bounds are quantiles, as many as there are ranges.
    """
    own = docs.select("doc_id", text_of().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_o"))
    n = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = own.agg(F.min("_o"), F.percentile_approx("_o", [k / n for k in range(1, n)], 100 * n)).first()
    bounds = sorted({found[0], *found[1]} if found[0] is not None else {0})
    # one literal each: all bounds, and every step-th of them to look into first
    step = max(1, math.isqrt(len(bounds)))
    literal = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("_o")))
    coarse = below(literal(bounds[::step])) - 1
    own = own.withColumn("_c", coarse)
    own = own.withColumn("_range", F.col("_c") * step + below(F.slice(literal(bounds), F.col("_c") * step + 1, step)) - 1)
    before = F.pmod(F.col("_range") - 1, F.lit(len(bounds)))
    first = F.element_at(literal(bounds), F.col("_range") + 1) == F.col("_o")
    places = F.when(first, F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("x")), F.struct(before.alias("r"), F.lit(1).alias("x")))).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("x"))))
    dealt = own.select("doc_id", "text", "_o", F.explode(places).alias("_p")).select("doc_id", "text", "_o", F.col("_p.r").alias("_range"), F.col("_p.x").alias("_extra")).repartition("_range")
    signed = dealt.withColumn("sigs", signatures(F.col("text")))
    order = W.partitionBy("_range").orderBy("_extra", "_o", F.xxhash64("text"))
    led = signed.withColumn("_next", F.lead(F.struct("text", "sigs")).over(order)).where("_extra = 0")
    led = led.withColumn("n_chars", F.length("text").cast("long"))
    cut_off = F.floor(F.col("n_chars") / share).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - cut_off).cast("int")), F.substring(F.col("_next.text"), F.lit(1), cut_off))
    led = led.withColumn("edited", edited)
    led = led.withColumn("_e", signatures(F.col("edited")))
    return led.select("doc_id", "n_chars", "edited", written(F.col("sigs")).alias("fingerprint"), written(F.col("_e")).alias("edited_fingerprint"), jaccard(F.col("sigs"), F.col("_e")).alias("near_edited"), jaccard(F.col("sigs"), F.col("_next.sigs")).alias("near_next"))
