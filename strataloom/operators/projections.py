"""Typed projections of JSON values, stored per root hash."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def typed(snapshot: DataFrame, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """key and the fields of JSON values; strict fails the job on a value that doesn't fit, else fields are null."""
    parsed = F.from_json(F.col("value").cast("string"), schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    return snapshot.select("key", parsed.alias("v")).select("key", "v.*")


@dataclass(frozen=True)
class Projection:
    """fields to index by, computed fields, a filter, and aggregates by the fields."""

    name: str
    schema: str
    fields: list[str]
    where: str | None = None
    computed: dict[str, str] = field(default_factory=dict)
    aggregates: dict[str, str] = field(default_factory=dict)
    prefix: str | None = None

    def of(self, snapshot: DataFrame) -> DataFrame:
        rows = snapshot.filter(F.col("key").cast("string").startswith(self.prefix)) if self.prefix else snapshot
        rows = typed(rows, self.schema)
        for name, expression in self.computed.items():
            rows = rows.withColumn(name, F.expr(expression))
        if self.where:
            rows = rows.filter(self.where)
        if self.aggregates:
            return rows.groupBy(*self.fields).agg(*(F.expr(e).alias(n) for n, e in self.aggregates.items()))
        return rows.select(*self.fields, *self.computed, "key")

    def refreshed(self, old: DataFrame, changes: DataFrame) -> DataFrame:
        """The projection after changes, from the old one: only changed keys are read. Not for aggregates."""
        if self.aggregates:
            raise ValueError("an aggregate is rebuilt, not refreshed")
        new = self.of(changes.filter("change_type <> 'deleted'").select("key", F.col("new_value").alias("value")))
        return old.join(changes.select("key"), "key", "left_anti").unionByName(new)


def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A join projection: every row of left, with what right has for it."""
    return left.join(right, on, "left")


def pending(definitions: DataFrame, built: DataFrame) -> DataFrame:
    """(name, root_hash) of definitions that aren't built yet."""
    return definitions.join(built, ["name", "root_hash"], "left_anti")
