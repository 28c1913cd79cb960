"""Connected components over a table of links, as rounds of joins.

Large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014) replace every
link until all members of a component point to its smallest member. The smallest neighbour of a node comes from a grouped
minimum, which is combined before the shuffle, and is joined back, so a node with very many links is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: The number of rounds grows with the logarithm of the number of links of the longest chain; more than this is an error, not a result.
MAX_ROUNDS = 40


def _least_neighbour(both: DataFrame) -> DataFrame:
    return both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _settled(pairs: DataFrame) -> bool:
    """Whether all links lead from a node to the smallest of its component: each node has one, and none leads to a node that has one."""
    if not pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return False
    return pairs.select(F.col("b").alias("a")).distinct().join(pairs, "a", "left_semi").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """links (a, b) of identifiers that can be ordered -> (id, component_id), a row for each identifier that has a link to another.

    Nulls and links of an identifier to itself are left out. Repeated links count once.
    """
    pairs = links.filter("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stored(pairs, "links")
    for _ in range(MAX_ROUNDS):
        if _settled(pairs):
            break
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour moves to the smallest of the neighbourhood
        large = both.filter("b > a").join(_least_neighbour(both), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself move to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        pairs = stored(small.filter("a != b").distinct(), "links")
    else:
        if not _settled(pairs):
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
