"""Stand-ins: citations among orders, terms of orders, texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, for costly work on each: a small file is one row group, so one task, however it is split.

    A scan of more splits than two for each core is left as it is; what is dealt out here is at most two splits a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() <= 2 * cores else df


def citations(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """source, target: for each part the orders that hold it, one after the other by date and key; acyclic by construction.

    Orders that follow each other for several parts do so once; repeated: as often as they do, for what makes edges distinct itself.
    """
    held = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    dated = held.join(orders, held.l_orderkey == orders.o_orderkey)
    order = W.partitionBy("l_partkey").orderBy("o_orderdate", "o_orderkey")
    steps = dated.select(F.lag("o_orderkey").over(order).alias("source"), F.lag("o_orderdate").over(order).alias("day"), F.col("o_orderkey").alias("target"), "o_orderdate")
    # an order that holds a part twice follows itself there
    steps = steps.where("source is not null and not (source = target and day <=> o_orderdate)").select("source", "target")
    return steps if repeated else steps.distinct()


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, place: orders by day, the order in which they can cite each other."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.unix_date(F.col("o_orderdate").cast("date")).alias("place"))


CITES = """SELECT DISTINCT source, target FROM (
  SELECT lag(o) OVER (PARTITION BY p ORDER BY d, o) AS source, o AS target FROM (
    SELECT DISTINCT l_partkey AS p, o_orderkey AS o, o_orderdate AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) WHERE source IS NOT NULL"""


def order_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (order), year, period (0: to 1996, 1: 1997 and 1998, 2: later), term (name of a part on it), distinct."""
    lines, part, orders = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    year = F.year("o_orderdate")
    own = lines.select("l_orderkey", "l_partkey").join(part.select("p_partkey", F.col("p_name").alias("term")), F.col("l_partkey") == F.col("p_partkey"))
    own = own.join(orders.select("o_orderkey", year.alias("year")), F.col("l_orderkey") == F.col("o_orderkey"))
    return own.select(F.col("o_orderkey").alias("doc_id"), "year", F.when(F.col("year") <= 1996, 0).when(F.col("year") <= 1998, 1).otherwise(2).alias("period"), "term").distinct()


TERMS = """SELECT DISTINCT o_orderkey AS doc_id, year(o_orderdate)::INT AS year,
  CASE WHEN year(o_orderdate) <= 1996 THEN 0 WHEN year(o_orderdate) <= 1998 THEN 1 ELSE 2 END AS period, p_name AS term
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey"""
