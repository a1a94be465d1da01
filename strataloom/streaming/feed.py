"""Change feeds as streams: commits publish their changes, subscribers follow them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import Store

CHANGES = "commit_hash string, version int, ts timestamp, change_type string, key binary, old_value binary, new_value binary"


def publish_to(path: str) -> Callable[[Store, DataFrame], None]:
    """A post-commit hook that appends each commit's changes to a folder of Parquet files."""

    def hook(store: Store, changes: DataFrame) -> None:
        ts = store.read_commit(store.head)[3]
        changes.select(F.lit(store.head).alias("commit_hash"), F.lit(store.depth(store.head)).cast("int").alias("version"), F.timestamp_seconds(F.lit(ts)).alias("ts"), "change_type", "key", "old_value", "new_value").write.mode("append").parquet(path)

    return hook


def changes(spark: SparkSession, path: str, prefix: bytes | None = None) -> DataFrame:
    """The stream of published changes, of keys with a prefix if given."""
    stream = spark.readStream.schema(CHANGES).parquet(path)
    return stream.filter(F.startswith("key", F.lit(prefix))) if prefix else stream


def rates(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Changes per window of time and kind; those later than `late` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "change_type").agg(F.count("*").alias("n")).select("window.start", "change_type", "n")


def subscribe(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call handler with each batch of new changes; what was handled survives a restart in checkpoint."""
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).start()


def mirror(stream: DataFrame, target: Store, checkpoint: str, message: str = "mirror") -> StreamingQuery:
    """Apply each batch of changes to another store as one commit; a key's change of the latest version in a batch counts."""

    def handle(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("key").agg(F.max_by(F.struct("change_type", "new_value"), "version").alias("x")).select("key", "x.*")
        target.put_all(last.filter("change_type <> 'deleted'").select("key", F.col("new_value").alias("value")))
        target.delete_all(last.filter("change_type = 'deleted'").select("key"))
        target.commit(f"{message} {number}")

    return subscribe(stream, handle, checkpoint)
