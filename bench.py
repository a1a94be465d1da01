"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataloom import queries as base
from strataloom.operators import diff, history
from strataloom.plans.store import Store

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["kv_scan_orders", "kv_put_lww", "snapshot_at_commit", "time_travel_multi", "diff_orders", "merge_three_way", "commit_change_feed", "blame", "chunk_bounds_customer", "root_hash_customer", "cas_dedup_documents", "projection_agg", "projection_join"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - began, 3)

    def done(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    done(base.QUERIES["kv_scan_orders"](spark, SF))  # starts the JVM's and Python's workers
    for name in HEADLINE:
        timed(name, lambda n=name: done(base.QUERIES[n](spark, SF)))

    binary = base.v1(spark, SF).select(F.col("key").cast("binary"), F.col("value").cast("binary"))
    rows = binary.count()
    with tempfile.TemporaryDirectory() as folder:
        store = Store(spark, f"{folder}/store")
        store.put_all(binary)
        commits: list[str] = []
        timed("commit_all_orders", lambda: commits.append(store.commit("all")))
        timed("cold_snapshot_scan", lambda: done(store.snapshot(commits[0])))
        timed("time_travel_point_lookup", lambda: store.get_at(b"order:0000000042", commits[0]))
        for share, modulus in (("0.01%", 10000), ("1%", 100), ("50%", 2)):
            store.checkout(commits[0])
            store.put_all(store.working().filter(F.crc32("key") % modulus == 0).select("key", F.concat("value", F.lit(b"+")).alias("value")))
            timed(f"commit_{share}_changed", lambda s=share: commits.append(store.commit(s)))
            timed(f"diff_{share}_pruned", lambda: done(store.diff(commits[0], commits[-1])))
            timed(f"diff_{share}_full", lambda: done(diff.diff(store.snapshot(commits[0]), store.snapshot(commits[-1]))))
    chain = spark.createDataFrame([(str(i), str(i - 1)) for i in range(1000)], "commit_hash string, parent string")
    timed("log_1000_commits", lambda: done(history.log(chain, "999")))
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "commit_rows_per_s": round(rows / took["commit_all_orders"]), "sf": SF.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
