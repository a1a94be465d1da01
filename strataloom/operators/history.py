"""Commit graphs: log, ancestors, merge base, change feeds and blame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.work import removed, written

#: Commit rows whose parents the driver follows itself; longer histories are walked by doubling.
DRIVER_COMMITS = 200_000


def ancestors(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(commit_hash, distance) of all that heads (commit_hash) come from, themselves included, by least distance.

    A short history's parents are read once and followed on the driver. A longer one is walked by
    doubling: after k rounds all within 2**k steps are known, and every commit knows its 2**k-th
    ancestor, so the rounds are the logarithm of the depth.
    """
    spark = commits.sparkSession
    links = commits.select("commit_hash", "parent")
    if max(links.limit(DRIVER_COMMITS + 1).count(), heads.limit(DRIVER_COMMITS + 1).count()) <= DRIVER_COMMITS:
        parent = dict(map(tuple, links.collect()))
        found: dict[str, int] = {}
        for (head,) in heads.select("commit_hash").distinct().collect():
            steps = 0
            while head in parent and found.get(head, steps + 1) > steps:
                found[head] = steps
                head, steps = parent[head], steps + 1
        return spark.createDataFrame(list(found.items()), "commit_hash string, distance int")
    here = links.select("commit_hash")
    reach, at_reach = written(heads.select("commit_hash").distinct().join(here, "commit_hash").withColumn("distance", F.lit(0)), "reach")
    jump, at_jump = written(links.join(here.select(F.col("commit_hash").alias("parent")), "parent").select("commit_hash", F.col("parent").alias("to")), "jump")
    step = 1
    while not jump.isEmpty():
        further = reach.join(jump, "commit_hash").select(F.col("to").alias("commit_hash"), (F.col("distance") + step).alias("distance"))
        grown, at_grown = written(reach.unionByName(further).groupBy("commit_hash").agg(F.min("distance").alias("distance")), "reach")
        far, at_far = written(jump.join(jump.select(F.col("commit_hash").alias("to"), F.col("to").alias("far")), "to").select("commit_hash", F.col("far").alias("to")), "jump")
        removed(spark, at_reach, at_jump)
        reach, at_reach, jump, at_jump, step = grown, at_grown, far, at_far, 2 * step
    return reach


def log(commits: DataFrame, head: str) -> DataFrame:
    """The chain of commits (commit_hash, parent, ...) from head to its root, newest first by `distance`."""
    start = commits.sparkSession.createDataFrame([(head,)], "commit_hash string")
    return commits.join(ancestors(commits, start), "commit_hash").orderBy("distance")


def merge_base(commits: DataFrame, a: str, b: str) -> DataFrame:
    """The nearest commit that both a and b come from, as one row or none."""
    x = log(commits, a).select("commit_hash", F.col("distance").alias("from_a"))
    y = log(commits, b).select("commit_hash", F.col("distance").alias("from_b"))
    return x.join(y, "commit_hash").orderBy("from_a", "from_b").limit(1)


def diverged(commits: DataFrame, a: str, b: str) -> DataFrame:
    """Commits of a that aren't b's, and of b that aren't a's, with their side."""
    x, y = log(commits, a).select("commit_hash"), log(commits, b).select("commit_hash")
    side = lambda p, q, name: p.join(q, "commit_hash", "left_anti").select("commit_hash", F.lit(name).alias("side"))
    return side(x, y, "ours").unionByName(side(y, x, "theirs"))


def change_feed(ops: DataFrame, version: str = "version") -> DataFrame:
    """What each version changed of ops (key, value, seq, version): change_type, old_value and new_value.

    One pass: versions of a key are partially aggregated, then compared in a window over the key.
    """
    per = ops.groupBy("key", version).agg(F.max_by(F.struct("value"), "seq").alias("last")).select("key", version, F.col("last.value").alias("new_value"))
    seen = per.withColumn("old_value", F.lag("new_value").over(Window.partitionBy("key").orderBy(version)))
    kind = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "deleted").otherwise("modified")
    return seen.filter(~F.col("old_value").eqNullSafe(F.col("new_value"))).select(version, kind.alias("change_type"), "key", "old_value", "new_value")


def blame(feed: DataFrame, version: str = "version") -> DataFrame:
    """The version that last changed each key that still exists."""
    last = feed.groupBy("key").agg(F.max_by(F.struct("change_type", "new_value"), version).alias("last"), F.max(version).alias(version))
    return last.filter(F.col("last.change_type") != "deleted").select("key", version, F.col("last.new_value").alias("value"))
