"""Content addressing: hashes, unique counts, intersections and what a write would store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def count_unique(hashes: DataFrame) -> DataFrame:
    return hashes.agg(F.count_distinct("hash").alias("n_unique"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Hashes that both have, each once."""
    return a.select("hash").intersect(b.select("hash"))


def missing(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The objects of new (hash, ...) that stored lacks, each once."""
    return new.dropDuplicates(["hash"]).join(stored.select("hash"), "hash", "left_anti")


def write_stats(new: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: writes asked for (total), objects that will be stored (actual), and writes saved (deduplicated)."""
    per = new.groupBy("hash").agg(F.count("*").alias("n")).join(stored.select("hash", F.lit(1).alias("there")).distinct(), "hash", "left")
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(F.col("there").isNull()).alias("actual")).withColumn("deduplicated", F.col("total") - F.col("actual"))
