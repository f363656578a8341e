"""Connected components of a table of links, by alternating stars.

A large star links every neighbour that is greater than a node to the node's least neighbour; a
small star links its lesser neighbours and itself. Both are one aggregation and one join on the node, so
a node with very many links is pre-aggregated and its join can be split; links never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first())


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    # dealt out once more, so that the join has an exchange on either side and Spark can split a node with very many links
    joined = both.join(least.repartition("least", "a"), "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the least id that its links reach."""
    now = scratch.table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}_0")
    before = _checksum(now)
    if not before[0]:
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for i in range(1, most_rounds):
        after_table = scratch.table(_star(_star(now, True), False), f"{name}_{i}")
        after = _checksum(after_table)
        scratch.drop(f"{name}_{i - 1}")
        now = after_table
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
