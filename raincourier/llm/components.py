"""Connected components of a link table, by alternating stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourier.sources.scratch import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of long ids to rows (node, comp), comp the smallest id of the
    component; nodes without links are not listed.

    Each round hangs larger neighbours below a node's smallest neighbour, then
    smaller ones; rounds grow with the logarithm of a chain's length. A node's
    neighbours are never gathered, only their minimum, and every round is
    written, so a lost executor costs one round."""
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    while (now := _state(edges)) != before and now[0]:
        before = now
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = written(large, "links")  # now a < b
        least = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
        small = (large.join(least, F.col("b") == F.col("u")).where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
                 .unionAll(least.select(F.col("m").alias("x"), F.col("u").alias("y"))))
        edges = written(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "links")
    hung = edges.groupBy("b").agg(F.min("a").alias("comp")).select(F.col("b").alias("node"), "comp")
    return hung.unionAll(hung.select(F.col("comp").alias("node"), "comp").distinct())
