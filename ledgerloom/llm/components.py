"""Connected components of a graph given by its links, by hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut


def connected(links: DataFrame) -> DataFrame:
    """(id, component) for every end of the links (a, b); the component is its smallest id.

    Every id has a parent, at first itself. In each round an id, and its parent, hook onto the smallest
    grandparent among the id's neighbours, and every id moves up to its grandparent. Trees shrink by a
    constant factor each round, so the rounds grow with the logarithm of the graph. Links and parents stay
    DataFrames; only the count of changed ids comes to the driver. A node with any number of links is
    summed up in parts before its key is shuffled.
    """
    # rows are a few numbers each, so as many partitions as can run at once are enough for any step
    at_once = 2 * links.sparkSession.sparkContext.defaultParallelism
    links = cut(links.filter("a <> b").select("a", "b"))  # whatever makes the links keeps its own partitions
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(at_once).distinct()
    both = cut(both.coalesce(at_once))
    parents = both.groupBy("a").agg(F.min("b").alias("_least")).select(F.col("a").alias("id"), F.least("a", "_least").alias("up"))
    parents = cut(parents.coalesce(at_once))
    while True:
        top = parents.select(F.col("id").alias("_id"), F.col("up").alias("_top"))
        grown = parents.join(top, F.col("up") == F.col("_id")).select("id", "up", F.col("_top").alias("top")).coalesce(at_once)
        near = both.join(grown.select(F.col("id").alias("b"), "top"), "b").coalesce(at_once).groupBy("a").agg(F.min("top").alias("least"))
        offers = grown.join(near.withColumnRenamed("a", "id"), "id").select("id", "up", "top", F.least("top", "least").alias("least"))
        offers = cut(offers.coalesce(at_once))
        hooks = offers.select(F.col("up").alias("id"), "least").unionAll(offers.select("id", "least"))
        best = hooks.groupBy("id").agg(F.min("least").alias("up"))
        moved = offers.select("id", F.col("up").alias("_old")).join(best, "id").select("id", "up", (F.col("up") != F.col("_old")).alias("_moved"))
        moved = cut(moved.coalesce(at_once))
        parents = moved.select("id", "up")
        if moved.filter("_moved").isEmpty():
            return parents.select("id", F.col("up").alias("component"))
