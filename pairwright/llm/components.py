"""Connected components by alternating star contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (u, v) of longs; root is the least vertex of its component.

    Each round hangs larger neighbours, then smaller ones, on a vertex's least neighbour; the number of rounds grows
    with the logarithm of the longest chain. No vertex's neighbours are gathered: only minima are, then joined back.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written apart, so that the joins deal their rows anew and can split those of a very large star.
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            break
        state = now
    roots = e.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return roots.unionByName(e.select("v").distinct().select("v", F.col("v").alias("root")))
