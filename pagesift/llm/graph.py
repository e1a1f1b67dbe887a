"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.plans.scratch import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: for every node of ``links`` the smallest node it reaches.

    Alternates between tying the larger neighbours of a node to its smallest neighbour
    and tying the smaller ones to it, until every node hangs on the smallest of its
    component. The number of rounds grows with the logarithm of the longest chain. Each
    round is written to shared storage, so that a lost executor costs no earlier round.
    Links with a missing end are left out, and those of a node with itself count for nothing.
    """
    edges = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
    edges = edges.filter(f"v > u and {a} is not null and {b} is not null").distinct()
    edges = written(edges, "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m"))
        least = least.select("v", F.least("v", "m").alias("m"))
        larger = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        larger = larger.filter("v > u").distinct()
        least = larger.groupBy("v").agg(F.min("u").alias("m"))
        smaller = larger.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = smaller.union(least.select("v", F.col("m").alias("u"))).filter("v > u").distinct()
        edges = written(edges, "links")
        # A round that changes nothing leaves the same links, and the same sum of their hashes.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("u").alias("node")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
