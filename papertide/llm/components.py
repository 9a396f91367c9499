"""Connected components of a table of links, by alternating star contractions.

Each round replaces the neighbours of a node by links to its least neighbour, first
towards larger nodes, then towards smaller ones.  A round is two aggregations and two
joins against one row a node, so that a hub with very many links is combined before
the shuffle and split in the join.  Rounds are written to the shared folder.  Nothing
is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.llm.shared import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (u, v) of any ordered type -> (node, label), label the least node of the component; single nodes do not occur."""
    now = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(rounds):
        n, tops = now.agg(F.count("*"), F.count_distinct("u")).first()
        if n == tops and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        now = written(_small_star(_large_star(now)), "links")
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
