"""Differences of snapshots, their application, and three-way merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .snapshot import overlaid

ADDED, DELETED, MODIFIED = "added", "deleted", "modified"


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(change_type, key, old_value, new_value) of every key that differs from a to b."""
    x = a.select("key", F.col("value").alias("old_value"), F.lit(True).alias("in_a"))
    y = b.select("key", F.col("value").alias("new_value"), F.lit(True).alias("in_b"))
    kind = F.when(F.col("in_a").isNull(), ADDED).when(F.col("in_b").isNull(), DELETED).otherwise(MODIFIED)
    changed = F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("old_value").eqNullSafe(F.col("new_value"))
    return x.join(y, "key", "full_outer").filter(changed).select(kind.alias("change_type"), "key", "old_value", "new_value")


def counts(changes: DataFrame) -> DataFrame:
    """One row: how many keys were added, deleted and modified; zeros if none."""
    return changes.agg(*(F.count_if(F.col("change_type") == k).alias(k) for k in (ADDED, DELETED, MODIFIED)))


def inverse(changes: DataFrame) -> DataFrame:
    swapped = F.when(F.col("change_type") == ADDED, DELETED).when(F.col("change_type") == DELETED, ADDED).otherwise(F.col("change_type"))
    return changes.select(swapped.alias("change_type"), "key", F.col("new_value").alias("old_value"), F.col("old_value").alias("new_value"))


def applied(a: DataFrame, changes: DataFrame) -> DataFrame:
    """a with changes put on it."""
    return overlaid(a.select("key", "value"), changes.select("key", F.when(F.col("change_type") != DELETED, F.col("new_value")).alias("value")))


def pruned(pairs: DataFrame, leaves_a: DataFrame, leaves_b: DataFrame) -> DataFrame:
    """diff of two stored snapshots that reads only leaves one of them lacks.

    pairs (leaf_hash, key, value) is the shared leaf table; leaves_a and leaves_b name each
    snapshot's leaves. A leaf of both holds the same pairs in both, and keys are unique in a
    snapshot, so it can't hold a change wherever its neighbours are cut.
    """
    a = leaves_a.select("leaf_hash").distinct()
    b = leaves_b.select("leaf_hash").distinct()
    side = lambda own, other: pairs.join(own.join(other, "leaf_hash", "left_anti"), "leaf_hash").select("key", "value")
    return diff(side(a, b), side(b, a))


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(key, base_value, our_value, their_value, outcome, value) of every key of the three snapshots.

    outcome is same, ours, theirs, or a conflict: modify_modify, or delete_modify if one side has
    no value. The value of a conflict, like that of a deletion, is null. Snapshots' values aren't null.
    """
    named = lambda df, name: df.select("key", F.col("value").alias(name))
    all_ = named(base, "base_value").join(named(ours, "our_value"), "key", "full_outer").join(named(theirs, "their_value"), "key", "full_outer")
    b, o, t = (F.col(f"{x}_value") for x in ("base", "our", "their"))
    conflict = F.when(o.isNull() | t.isNull(), "delete_modify").otherwise("modify_modify")
    outcome = F.when(o.eqNullSafe(t), "same").when(b.eqNullSafe(o), "theirs").when(b.eqNullSafe(t), "ours").otherwise(conflict)
    value = F.when(F.col("outcome").isin("same", "ours"), o).when(F.col("outcome") == "theirs", t)
    return all_.withColumn("outcome", outcome).withColumn("value", value)


def merged(outcomes: DataFrame, prefer: str | None = None) -> DataFrame:
    """The merged snapshot; conflicts are left out, or taken from `prefer`: ours or theirs."""
    clash = F.col("outcome").isin("modify_modify", "delete_modify")
    value = F.when(clash, F.col({"ours": "our_value", "theirs": "their_value"}[prefer])).otherwise(F.col("value")) if prefer else F.col("value")
    return outcomes.select("key", value.alias("value")).filter(F.col("value").isNotNull())


def conflicts(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("outcome").isin("modify_modify", "delete_modify"))


CRDT = {"max": F.greatest, "min": F.least, "union": F.array_union}


def crdt_merge(ours: DataFrame, theirs: DataFrame, how: str = "max") -> DataFrame:
    """A merge that can't conflict: the greater or smaller value, or the union of arrays."""
    both = ours.select("key", F.col("value").alias("o")).join(theirs.select("key", F.col("value").alias("t")), "key", "full_outer")
    return both.select("key", F.when(F.col("o").isNull(), F.col("t")).when(F.col("t").isNull(), F.col("o")).otherwise(CRDT[how]("o", "t")).alias("value"))
