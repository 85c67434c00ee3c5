"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Parts of a node's edges; with adaptive skew joins on top, a node with a third of all edges fills no task
SALTS = 16


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang each node's larger (or not larger) neighbours on the smallest node around."""
    sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # a node's edges meet what is known of it in SALTS parts
    parts = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = (sides.where("b > a") if larger else edges).withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    hung = salted.join(parts, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        hung = hung.unionByName(least.select("a", F.col("m").alias("b")))
    return hung.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) reaches.

    Self-loops and repeated edges do no harm; nodes without an edge are not listed.  All state stays
    in Spark; the loop ends when a round leaves the edges as they are, after about log2(n) rounds.  A node
    with a third of all edges fills no task.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        edges = cut(_star(_star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
