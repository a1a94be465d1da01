"""Reads and writes of a snapshot: a DataFrame of (key, value) with unique keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import InvalidKey


def last_write_wins(ops: DataFrame, seq: str = "seq") -> DataFrame:
    """The state after all ops (key, value, seq): each key's value of greatest seq; a null value is a tombstone.

    max_by is aggregated partially, so a hot key sends one row per task.
    """
    last = ops.groupBy("key").agg(F.max_by(F.struct("value"), F.col(seq)).alias("last"))
    return last.select("key", F.col("last.value").alias("value")).filter(F.col("value").isNotNull())


def overlaid(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """base with overlay's rows put, and the keys of its null values deleted; overlay has unique keys."""
    return base.join(overlay.select("key"), "key", "left_anti").unionByName(overlay.filter(F.col("value").isNotNull()))


def deleted(base: DataFrame, keys: DataFrame) -> DataFrame:
    """base without keys; keys that base lacks are no error in bulk."""
    return base.join(keys.select("key").distinct(), "key", "left_anti")


def get(snapshot: DataFrame, key: bytes | str | Column) -> DataFrame:
    """The row of one key; the filter reaches the scan."""
    return snapshot.filter(F.col("key") == (key if isinstance(key, Column) else F.lit(key)))


def range_scan(snapshot: DataFrame, low: bytes | str | None, high: bytes | str | None) -> DataFrame:
    """Keys in [low, high); None leaves a side open."""
    if low is not None:
        snapshot = snapshot.filter(F.col("key") >= F.lit(low))
    return snapshot.filter(F.col("key") < F.lit(high)) if high is not None else snapshot


def after_prefix(prefix: bytes) -> bytes | None:
    """The least key above every key with this prefix; None if there is none."""
    bare = prefix.rstrip(b"\xff")
    return bare[:-1] + bytes([bare[-1] + 1]) if bare else None


def prefix_scan(snapshot: DataFrame, prefix: bytes | str) -> DataFrame:
    """Keys with a prefix, as a range where keys are bytes, so that row groups are skipped."""
    if isinstance(prefix, str):
        return snapshot.filter(F.col("key").startswith(prefix))
    return range_scan(snapshot, prefix, after_prefix(prefix))


def at_versions(changes: DataFrame, versions: DataFrame, version: str = "version") -> DataFrame:
    """Every key's value as of each version asked for: changes (key, value, version) and versions (version).

    versions is a list of numbers asked for, so it is joined as a range condition on aggregated
    changes: one row per (key, version) at most.
    """
    per = changes.groupBy("key", version).agg(F.max_by(F.struct("value"), "seq").alias("last"))
    asked = versions.select(F.col(version).alias("asked"))
    joined = per.join(F.broadcast(asked), F.col(version) <= F.col("asked"))
    return joined.groupBy("asked", "key").agg(F.max_by("last", version).alias("last")).select("asked", "key", F.col("last.value").alias("value")).filter(F.col("value").isNotNull())


def require_keys(pairs: DataFrame) -> DataFrame:
    """pairs, failing the job on a null or empty key."""
    bad = F.col("key").isNull() | (F.octet_length("key") == 0)
    return pairs.withColumn("key", F.when(bad, F.raise_error(F.lit("empty key"))).otherwise(F.col("key")))


def check_key(key: bytes) -> bytes:
    if not isinstance(key, (bytes, bytearray)) or not key:
        raise InvalidKey("a key is one byte or more")
    return bytes(key)
