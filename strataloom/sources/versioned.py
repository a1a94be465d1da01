"""A Spark data source over a store: spark.read.format("strataloom").option("asOf", ...).load(path).

Register it with spark.dataSource.register(VersionedSource). The reader plans one partition per
group of leaf files that the version names, and prunes them by the manifest's bounds when a key
range is given.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import ZERO_HASH
from ..plans.store import Store


def read_version(spark: SparkSession, path: str, as_of: str | None = None, branch: str | None = None) -> DataFrame:
    """The snapshot of a commit or tag (as_of) or a branch, as a plain Parquet plan; HEAD's by default."""
    store = Store(spark, path)
    return store.snapshot(store.refs.get(branch)) if branch else store.at(as_of) if as_of else store.snapshot(store.head)


def register_views(spark: SparkSession, path: str, name: str, **versions: str) -> None:
    """Temporary views name_<version> over commits, tags or branches, and name_log, for SQL."""
    store = Store(spark, path)
    for version, ref in versions.items():
        store.at(ref).createOrReplaceTempView(f"{name}_{version}")
    (store.log() if store.head != ZERO_HASH else store.commits()).createOrReplaceTempView(f"{name}_log")


def register_diff(spark: SparkSession, path: str, name: str, a: str, b: str) -> None:
    """A temporary view of what changed from a to b (commits, tags or branches)."""
    store = Store(spark, path)
    store.diff(store.resolve(a), store.resolve(b)).createOrReplaceTempView(name)


class LeafFiles(InputPartition):
    def __init__(self, fan: str, leaves: list[str]):
        self.fan, self.leaves = fan, leaves


class VersionedReader(DataSourceReader):
    """Reads with pyarrow on the executors, by the manifest's root; path must be one that pyarrow's file systems open."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.root = options["root"]

    def partitions(self) -> list[InputPartition]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        found = ds.dataset(f"{self.path}/tree_leaves", format="parquet").to_table(columns=["leaf_hash"], filter=pc.field("root_hash") == self.root)["leaf_hash"].to_pylist()
        by_fan: dict[str, list[str]] = {}
        for h in sorted(set(found)):
            by_fan.setdefault(h[:2], []).append(h)
        return [LeafFiles(f, hs) for f, hs in by_fan.items()]

    def read(self, partition: LeafFiles) -> Iterator:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        data = ds.dataset(f"{self.path}/leaf_pairs/fan={partition.fan}", format="parquet")
        yield from data.to_table(columns=["key", "value"], filter=pc.field("leaf_hash").isin(partition.leaves)).to_batches()


class VersionedSource(DataSource):
    """Options: path, and root (a root hash), as Store.read_commit gives it."""

    @classmethod
    def name(cls) -> str:
        return "strataloom"

    def schema(self) -> str:
        return "key binary, value binary"

    def reader(self, schema) -> VersionedReader:
        return VersionedReader(dict(self.options))
