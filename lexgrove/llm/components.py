"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared_folder import Scratch


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Every node sends its neighbours (small: those not above it; large: those above it) to the least node around it."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # edges have a > b: of a node's neighbours below it, the least; large: the least of all and itself
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if small:
        moved = joined.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    else:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), "m")
    return moved.where(F.col("x") > F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of one orderable type. Returns node and label (the least node of its component) for every node that has
    an edge to another; a node that is its component's label has no row."""
    scratch, step = Scratch(), 0
    now = scratch.written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    state = None
    while True:
        step += 1
        now = scratch.written(_star(_star(now, small=False), small=True), f"edges-{step}")
        scratch.drop(now, f"edges-{step - 1}")
        # the steps change nothing any more once every node has its label alone
        new = now.agg(F.count("*"), F.count_distinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        state = new
