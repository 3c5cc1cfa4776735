"""Connected components of a link table, without gathering it anywhere.

The least neighbours are written before they are joined: both sides of the join are
then shuffled for it alone, and Spark can split the rows of a hub among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def large_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Joins each node's larger neighbours to its least neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Joins each node and its smaller neighbours to the least of them. Links point down: u > v."""
    least = scratch.cut(links.groupBy("u").agg(F.min("v").alias("m")))
    down = links.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for each node of ``links`` (long columns u and v); root is the least node reachable.

    Alternates the two star steps until each node has one link, to its root.
    Rows per round never exceed the links'; a hub's rows meet its one minimum in
    a join that Spark may split. What a round has written goes when the next one is done.
    Nulls link nothing, loops are dropped, repeated links count once, no links give no rows.
    """
    scratch = Scratch()
    links = scratch.cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        links = scratch.cut(small_star(scratch.cut(large_star(links, scratch).distinct()), scratch).distinct())
        scratch.drop(links)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
