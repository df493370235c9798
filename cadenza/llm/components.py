"""Connected components of a link table by alternating star contraction.

A round links every node's larger neighbours to its smallest neighbour
(large star), then every node and its smaller neighbours to the smallest
of them (small star). Rounds repeat until nothing changes; the number of
rounds grows with the logarithm of the longest chain. A hub costs no more
than its links: minima are partial aggregates, and the joins back are
plain shuffle joins whose skewed partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import checkpoint


def _state(links: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every linked node; the root is the smallest node
    reachable. ``links`` has bigint columns ``a, b`` in either order."""
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = checkpoint(e.distinct())
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")))
        large = both.join(low, "u").filter("v > u") \
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = checkpoint(large)
        low = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = _state(e)
        if new == state:
            break
        state = new
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
