"""Connected components of links between numbers, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut_lineage

#: Rounds after which the work is given up; a round about halves the longest chain.
MOST_ROUNDS = 60


def _smallest(links: DataFrame) -> DataFrame:
    """a, b, m: each directed link with the smallest of a and its neighbours. Both sides of the join are plain
    exchanges, so that Spark splits the links of a node that has very many."""
    least = cut_lineage(links.groupBy("a").agg(F.min("b").alias("m")))
    return links.join(least, "a").withColumn("m", F.least("a", "m"))


def _state(links: DataFrame) -> tuple[int, int]:
    r = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node that it reaches) of every node of `links` (columns a, b); other nodes are their own.

    Large-star links each node's larger neighbours to its smallest one, small-star the smaller ones; rounds end when
    nothing changes. Links never leave the executors; each round is cut off by a checkpoint.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    links = cut_lineage(links.filter("a != b").select(high, low).distinct())
    state = _state(links)
    if not state[0]:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(MOST_ROUNDS):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = cut_lineage(_smallest(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        joined = _smallest(large)
        small = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        links = cut_lineage(small.distinct())
        new = _state(links)
        if new == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new
    raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
