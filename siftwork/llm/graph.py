"""Connected components of a link table, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, spread_join


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a link; component is the least node reachable. Nulls and loops are ignored.

    Alternating large-star and small-star rounds: each is a minimum per node (summed before the shuffle) joined back to the
    links on the node; a node with very many links is spread over several tasks. Links that are stars already need no round.
    Each round is checkpointed in the shared folder and its links, one row each, don't grow in number. An empty table gives none.
    """
    shared_dir(links.sparkSession)
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    for _ in range(max_rounds):
        # stars: each node has one lower neighbour, which has none itself
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        if ends.groupBy("x").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 1 or (ups = 1 and n > 1)").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # large star: neighbours above a node move to the node's least neighbour
        e = spread_join(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its lower neighbours move to the least of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = spread_join(e, low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
