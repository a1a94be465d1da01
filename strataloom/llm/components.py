"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def components(links: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, root) for every node of links (a, b), root the same for all nodes that links join; and work tables.

    Each round points every node at its least neighbour, shortens the pointers twice, and joins the
    links' ends to their roots; links inside a root go. The rounds number about the logarithm of a
    component's size. Only whether links are left comes to the driver.
    """
    current, path = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct(), "links")
    paths, stale = [], [path]
    assigned = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        point = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("r"))
        for _ in range(2):
            far = point.select(F.col("u").alias("r"), F.col("r").alias("far"))
            point = point.join(far, "r", "left").select("u", F.coalesce("far", "r").alias("r"))
        point, path = written(point, "pointers")
        stale.append(path)
        if assigned is None:
            assigned = point.select(F.col("u").alias("node"), F.col("r").alias("root"))
        else:
            assigned = assigned.join(point, assigned.root == point.u, "left").select("node", F.coalesce("r", "root").alias("root"))
        assigned, path = written(assigned, "roots")
        paths.append(path)
        left = point.select("u", F.col("r").alias("ru"))
        right = point.select(F.col("u").alias("v"), F.col("r").alias("rv"))
        moved = current.join(left, "u").join(right, "v").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
        current, path = written(moved.filter("u <> v").distinct(), "links")
        stale.append(path)
        if current.isEmpty():
            break
    remove(links.sparkSession, *stale, *paths[:-1])
    return assigned, paths[-1:]
