"""Connected components by repeated joins of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.tables import by_shuffle, materialize


def connected_components(links: DataFrame, ids: DataFrame) -> DataFrame:
    """id, component (the smallest id that can be reached) of every id; ``links`` has a, b.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest neighbour, so paths halve and the number of
    rounds grows with the logarithm of the longest path. A node with many links is only aggregated, never gathered. No side is broadcast: links that are few bytes when written can fill the driver.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: u's larger neighbours get u's smallest neighbour.
        large = both.join(by_shuffle(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u's smaller neighbours, and u, get the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(by_shuffle(low), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialize(small.select("e.u", "e.v").where("u <> v").distinct())
        changed = after.join(by_shuffle(edges), ["u", "v"], "left_anti").limit(1).count() or edges.join(by_shuffle(after), ["u", "v"], "left_anti").limit(1).count()
        edges = after
        if not changed:
            break
    return ids.join(by_shuffle(edges), ids["id"] == edges["u"], "left").select("id", F.coalesce("v", "id").alias("component"))
