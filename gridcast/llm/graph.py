"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.store import settle


def _ordered(u, v) -> list:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): root is the smallest node that can be reached.

    Each round points every node at its smallest neighbour, follows the pointers once more and
    contracts the links; the smallest node of a component always points at itself, so it is the
    label that stays.  Links with an end that is null, and links of a node with itself, are left
    out; repeated links count once; without links the result is empty.
    """
    live = settle(links.where("u <> v").select(*_ordered(F.col("u"), F.col("v"))).distinct())
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        ends = live.unionAll(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = ends.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
        near = settle(near.select("node", F.least("node", "low").alias("up")))
        far = near.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hop = settle(near.join(far, "up").select("node", F.col("top").alias("root")))
        rounds.append(hop)
        left = hop.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        right = hop.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        live = live.join(left, "u").join(right, "v").where("ru <> rv")
        live = settle(live.select(*_ordered(F.col("ru"), F.col("rv"))).distinct())
    if not rounds:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = rounds.pop()
    while rounds:
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = rounds.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return settle(out)
