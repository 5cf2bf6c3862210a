"""Connected components by alternating star contractions, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.runtime import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that can be reached, for every node of `edges` (a, b: long).

    Each round points every larger neighbour of a node at the node's smallest one, then every smaller neighbour, so
    long chains shrink by a factor. Each round is written to the shared folder; a lost executor repeats one round.
    Null ends and self-links are ignored; an empty frame gives an empty one. Groups of any size are only ever
    aggregated by `min`, which combines before the shuffle."""
    links = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    # Each round makes the sum of the larger ends smaller until nothing changes, so this ends.
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        links = written(small, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
