"""Connected components by large-star / small-star rounds over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioline.session import discard, written


def _nearest(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour; partial minima come first, so a hub is no hot key."""
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _nearest(both).withColumn("least", F.least("least", "u"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _nearest(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    centres = least.select("u", F.col("least").alias("v"))
    return moved.unionByName(centres).where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("u")
    ).first()
    return tuple(row)


def components(links: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of a link; the component is its smallest node id.

    Links with a null end or with equal ends are no links. Every round is written to the
    shared folder, which cuts the lineage and survives lost executors.
    """
    edges = links.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    edges = written(edges.where("u != v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        last, edges = edges, written(_small_star(_large_star(edges)), "links")
        discard(last)
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
