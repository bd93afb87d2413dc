"""Connected components of a link table, as rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._shared import Workspace, few


def connected_components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, root) for every node that occurs in the links (columns l, r); root is the least node.

    Large-star and small-star rounds: each links a node's neighbours to the
    least of them, until the links are stars.  The work of a round follows the
    number of links; the number of rounds follows the logarithm of the size of
    a component.  Every round is written to the shared folder.
    """
    edges = links.where("l <> r").select(F.greatest("l", "r").alias("u"), F.least("l", "r").alias("v")).distinct()
    rows = links.count()
    edges = space.save(few(edges, rows), f"{name}-0")
    before, turn = None, 0
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node move to its least neighbour; what small star needs is u > v
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        turn += 1
        edges = space.save(few(edges, rows), f"{name}-{turn}")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        space.drop(f"{name}-{turn - 1}")
        if before == now or not now.n:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
