"""Connected components of an edge table by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common
from larkspur.llm.common import join_hot, materialize

#: Edges of a task. Tables of few edges are worked on by few tasks, as a round of many tasks leaves many small files.
TASK_EDGES = 50_000


def connected(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node) of every node of ``edges`` (a, b: bigint, any order, repeats and loops allowed).

    Each round is two shuffles of the edge table, which never grows, and ends in a checkpoint; the rounds grow with the
    logarithm of the largest diameter. A node of very many edges is dealt over several tasks. Nothing but one fingerprint of the table, by which a round without change is known,
    is brought to the driver. Null ends are left out.
    """

    def said(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        if 2 * before[0] <= common.HOT_ROWS:
            return rows.join(least.drop("n"), "a")
        return join_hot(rows, materialize(least), ["a"])

    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    before = said(edges)
    tasks = max(1, -(-before[0] // TASK_EDGES))  # the table never grows
    edges = edges.coalesce(tasks)
    while before[0]:
        # Large star: each node's larger neighbours are linked to its smallest neighbour or itself.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
        large = with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(2 * tasks).distinct()
        # Small star: each node's smaller neighbours, and itself, are linked to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).coalesce(2 * tasks)
        small = with_least(large.coalesce(2 * tasks), least).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(2 * tasks).distinct()
        edges, last = materialize(small.coalesce(tasks)), before
        before = said(edges)
        if before == last:
            break
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
