"""Titles that are nearly the same, as a join: candidates by an inverted index, then the exact ratio of matching blocks.

For titles of lengths m and n with blocks of k matching characters the ratio is 2k / (m + n). At a ratio of r or more, u = m + n
- 2k characters match nothing, at most (1 - r)(m + n); blocks are at most one more than these, and each break costs no more than
two of the common 3-character grams. So the titles share c = (m + n)(2.5 r - 2) - 2 grams at least, counted with repeats, and
one of them is among the m - 2 - c + 1 rarest of either title. Lengths differ by a factor of r / (2 - r) at most. Where (1 - r)
(m + n) < 2, one character at most is left over, and the titles meet in what is left of them without one of their characters.
"""

from __future__ import annotations

import math
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.terms import normal_title

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: from this ratio on two titles count as the same.
SIMILAR = 0.9


def bare_title(title: Column) -> Column:
    """The normal title without a footnote's digit at its end."""
    return F.regexp_replace(normal_title(title), r"(?<=[a-z])\d$", "")


def ratio(a: Column, b: Column) -> Column:
    """The ratio of matching blocks of two titles."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches):
        from difflib import SequenceMatcher

        for x, y in batches:
            yield pd.Series([1.0 if s == t else SequenceMatcher(None, s, t).ratio() for s, t in zip(x, y)], dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(a, b)


def _keys(titles: DataFrame, least: float) -> DataFrame:
    """t, key: what a title (t, distinct) is looked up by; two titles of the least ratio share a key."""
    short = math.ceil(2 / (1 - least) - 1e-9)  # from this sum of lengths on grams are counted
    n = F.length("t")
    grams = titles.where(n >= 3).select("t", F.posexplode(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(F.col("t"), i, F.lit(3)))).alias("pos", "g"))
    numbered = grams.withColumn("g", F.concat_ws("#", "g", F.row_number().over(W.partitionBy("t", "g").orderBy("pos"))))
    counted = numbered.groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    ranked = numbered.join(counted, "g").withColumn("r", F.row_number().over(W.partitionBy("t").orderBy("f", "g")))
    shared = F.greatest(F.lit(float(short)), n * (2 / (2 - least))) * (2.5 * least - 2) - 2
    prefix = ranked.where(F.col("r") <= n - 2 - F.ceil(shared - 1e-9) + 1).select("t", F.concat(F.lit("g"), "g").alias("key"))
    without = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(F.col("t"), F.lit(1), i - 1), F.substring(F.col("t"), i + 1, n)))
    less = titles.where(n <= short // 2 + 1).select("t", F.explode(F.array_distinct(F.concat(F.array("t"), without))).alias("x"))
    return prefix.unionByName(less.select("t", F.concat(F.lit("d"), "x").alias("key")))


def similar_titles(left: DataFrame, right: DataFrame, least: float = SIMILAR) -> DataFrame:
    """a, b, ratio of the rows of left (a, title) and right (b, title) whose bare titles have this ratio (above 0.8) or more.

    Equal titles are compared once; empty ones and nulls match nothing.
    """
    if not 0.8 < least <= 1:
        raise ValueError("the least ratio has to be above 0.8")
    one, two = left.select("a", bare_title(F.col("title")).alias("t")).where("t <> ''"), right.select("b", bare_title(F.col("title")).alias("u")).where("u <> ''")
    keys = _keys(one.select("t").union(two.select("u")).distinct(), min(least, 1 - 1e-9))
    of_one, of_two = keys.join(one.select("t").distinct(), "t", "left_semi"), keys.join(two.select(F.col("u").alias("t")).distinct(), "t", "left_semi").withColumnRenamed("t", "u")
    m, n = F.length("t"), F.length("u")
    pairs = of_one.join(of_two, "key").where(F.least(m, n) * (2 - least) >= F.greatest(m, n) * least - 1e-9).select("t", "u").distinct()
    same = pairs.withColumn("ratio", ratio(F.col("t"), F.col("u"))).where(F.col("ratio") >= least)
    return same.join(one, "t").join(two, "u").select("a", "b", "ratio")
