"""Garbage, integrity, inspection and statistics of a store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import pair_bytes, u32
from .history import ancestors


def reachable(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """Commits that any head (commit_hash) comes from."""
    return ancestors(commits, heads).select("commit_hash")


def unreachable(commits: DataFrame, heads: DataFrame) -> DataFrame:
    return commits.join(reachable(commits, heads), "commit_hash", "left_anti")


def garbage(objects: DataFrame, live: DataFrame) -> DataFrame:
    """Objects (hash, ...) that no live hash names: the sweep of mark and sweep."""
    return objects.join(live.select("hash").distinct(), "hash", "left_anti")


def leaf_faults(leaf_pairs: DataFrame) -> DataFrame:
    """Leaves whose pairs don't hash to their name."""
    body = F.expr("listagg(body, X'') WITHIN GROUP (ORDER BY key)")
    per = leaf_pairs.withColumn("body", pair_bytes(F.col("key"), F.col("value"))).groupBy("leaf_hash").agg(body.alias("data"), F.count("*").alias("n"))
    found = F.sha2(F.concat(F.lit(b"\x01"), u32(F.col("n")), F.col("data")), 256)
    return per.select("leaf_hash", found.alias("found")).filter("found <> leaf_hash")


def fsck(leaf_pairs: DataFrame, manifest: DataFrame, commits: DataFrame, empty_root: str) -> DataFrame:
    """(fault, hash): corrupt leaves, leaves and parents that are missing, roots without leaves, orphaned leaves."""
    have, named = leaf_pairs.select("leaf_hash").distinct(), manifest.select("leaf_hash").distinct()
    roots = manifest.select(F.col("root_hash")).distinct()
    parents = commits.filter(F.col("parent") != "0" * 64).select(F.col("parent").alias("commit_hash")).distinct()
    row = lambda df, fault, c: df.select(F.lit(fault).alias("fault"), F.col(c).alias("hash"))
    return (
        row(leaf_faults(leaf_pairs), "corrupt_leaf", "leaf_hash")
        .unionByName(row(named.join(have, "leaf_hash", "left_anti"), "missing_leaf", "leaf_hash"))
        .unionByName(row(have.join(named, "leaf_hash", "left_anti"), "orphaned_leaf", "leaf_hash"))
        .unionByName(row(commits.filter(F.col("root_hash") != empty_root).select("root_hash").distinct().join(roots, "root_hash", "left_anti"), "missing_root", "root_hash"))
        .unionByName(row(parents.join(commits.select("commit_hash"), "commit_hash", "left_anti"), "missing_parent", "commit_hash"))
    )


def tree_shape(manifest: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per level: nodes, children and mean fan-out; leaves are level 0."""
    leaves = manifest.agg(F.lit(0).alias("level"), F.count("*").alias("n_nodes"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_children"))
    upper = nodes.groupBy("level").agg(F.count("*").alias("n_nodes"), F.sum("n_children").cast("long").alias("n_children"))
    return leaves.unionByName(upper).withColumn("fan_out", F.col("n_children") / F.col("n_nodes"))


def statistics(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias("key_bytes"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("value_bytes"))
