"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolist.llm.common import materialise


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Point what stands around each node at the least node there.

    both_ways (large star): larger neighbours of u go to the least of u and its neighbours. Otherwise (small star): u and its
    smaller neighbours go to the least of those. Only minima are grouped, so a node with very many links needs no more
    memory than any other; the join that follows can be split where a node is skewed.
    """
    if both_ways:
        out = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = out.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = out.join(least, "u").where("v > u").select("v", "m")
    else:
        out = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = out.groupBy("u").agg(F.min("v").alias("m"))
        moved = out.join(least, "u").select("v", "m").unionAll(least.select(F.col("u").alias("v"), "m"))
    return moved.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each linked node can reach. Nodes without links don't appear.

    edges: columns a and b (long); self links, repeats and either direction are fine; nulls don't link. An empty table gives
    an empty table. Each round is written to the shared folder; rounds grow with the logarithm of the largest component.
    """
    state = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        mark = state.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not mark.n or mark == seen:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(state.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = mark
        state = materialise(_stars(_stars(state, True), False), "stars")
