"""Connected components of an edge table by alternating stars (large star, small star), each round one written table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.storage import Stash


def components(edges: DataFrame, stash: Stash) -> DataFrame:
    """(node, root) of every node of the edges (a, b: long): root is the smallest node of its component.

    Nulls and loops are left out, edges may repeat and have any direction; an empty table gives an empty result. A
    round moves every node nearer to the smallest node around it, so the rounds grow with the logarithm of a
    component's width. Minima are pre-aggregated before they are shuffled and a hub's rows lie in a plain join that
    adaptive execution splits, so no node's edges meet in one task.
    """
    links = stash.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(links)
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        large = stash.put(large)
        first = large.groupBy("a").agg(F.min("b").alias("least"))
        moved = large.join(first, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = stash.put(moved.unionByName(first.select("a", F.col("least").alias("b"))).where("a <> b").distinct())
        stash.drop(links, large)
        links, before, state = small, state, _state(small)
        if before == state:
            break
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(links: DataFrame) -> tuple:
    """Count and order-free fingerprints of the edges, which are distinct. No sum of hashes: that would leave 64 bits."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())
