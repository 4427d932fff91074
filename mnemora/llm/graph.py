"""Connected components by alternating stars, over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(links: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """``node, comp``: every node that occurs in ``links`` (a, b: of any type that has an order), and
    the smallest node that links reach from it. Null ends are left out; repeated links count once;
    no links give no rows. ``paths`` gets the folders of what is written.

    Each round hangs the greater neighbours of a node on its smallest one (large star), then the
    smaller ones (small star); the number of rounds grows with the logarithm of the size. A node
    with very many links is joined, never gathered. Links of a node with itself only make it
    occur. A round's edges are written to the shared folder.
    """
    start = links.select("a", "b").filter("a is not null and b is not null")
    edges = stash(start.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", paths)
    nodes = edges
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(down, "u")
        small = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        edges = stash(small, "edges", paths)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == tuple(before):
            break
        before = now
    own = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return own.join(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
