"""Coordinates of a layered network, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import numbered
from ..tables import cut

#: The page's margins, its width and the distance of layers.
LEFT, TOP, WIDTH, GAP = 60, 60, 1200, 140


def placed(ranked: DataFrame, order: list) -> DataFrame:
    """node, layer, place (from 0 in its layer, by the order), size (of its layer)."""
    rows = numbered(ranked, ["layer", *order])
    per = rows.groupBy("layer").agg(F.min("index").alias("_first"), F.count(F.lit(1)).alias("size"))  # a row for each layer
    return rows.join(F.broadcast(per), "layer").select("node", "layer", (F.col("index") - F.col("_first")).alias("place"), "size")


def layered(nodes: DataFrame, edges: DataFrame | None = None, sweeps: int = 0) -> DataFrame:
    """node, layer, place, x, y: layers from top to bottom, their nodes from left to right.

    nodes: node, layer, weight (such as citations; the greatest comes first, ties by id). With edges (source, target) and
    sweeps, places are taken anew so many times: by the mean of the relative places of a node's neighbours in layers above,
    then of those below, which takes crossings out; a node without such keeps its own.
    """
    at = cut(placed(nodes.withColumn("_w", -F.coalesce("weight", F.lit(0))), ["_w", "node"]))
    for k in range(sweeps):
        spot = at.select(F.col("node").alias("_n"), F.col("layer").alias("_l"), ((F.col("place") + 0.5) / F.col("size")).alias("_s"))
        both = edges.select(F.inline(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("_o")), F.struct(F.col("target").alias("node"), F.col("source").alias("_o")))))
        near = both.join(at.select("node", "layer"), "node").join(spot, F.col("_o") == F.col("_n"))
        near = near.where(F.col("_l") < F.col("layer") if k % 2 == 0 else F.col("_l") > F.col("layer"))
        mean = near.groupBy("node").agg(F.round(F.avg("_s"), 9).alias("_m"))
        ranked = at.join(mean, "node", "left").select("node", "layer", F.coalesce("_m", (F.col("place") + 0.5) / F.col("size")).alias("_m"))
        at = cut(placed(ranked, ["_m", "node"]))
    share = F.when(F.col("size") > 1, F.col("place") / (F.col("size") - 1)).otherwise(0.5)
    return at.select("node", "layer", "place", F.round(LEFT + (WIDTH - 2 * LEFT) * share, 3).alias("x"), (TOP + GAP * F.col("layer")).alias("y"))


def crossings(at: DataFrame, edges: DataFrame) -> int:
    """How many pairs of edges between neighbouring layers cross; for drawings of bounded size."""
    one, two = at.select(F.col("node").alias("source"), F.col("layer").alias("l"), F.col("place").alias("p")), at.select(F.col("node").alias("target"), F.col("layer").alias("m"), F.col("place").alias("q"))
    lines = edges.join(one, "source").join(two, "target").where("m = l + 1").select("l", "p", "q")
    a, b = lines.alias("a"), lines.alias("b")
    return a.join(b, F.expr("a.l = b.l and a.p < b.p and a.q > b.q")).count()
