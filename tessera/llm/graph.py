"""Connected components of a link table, by rounds of joins; nothing is gathered on the driver but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import drop_written, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node and component (the least node reachable) of every node in links (a, b).

    Large-star and small-star in turn, until the edges stay the same: first each node's larger neighbours are tied to the least
    of its neighbours, then its smaller ones. In the end each edge leads from a node to its component's least one. Each round
    is written; its joins' keys can be hot, and both sides of them are plain exchanges that skew-join handling splits.
    """
    edges = written(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = written(spark, small, "edges")
        drop_written(spark, edges)
        edges, before, state = new, state, _state(new)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
