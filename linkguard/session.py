"""Session settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings that matter for the joins and streams of this library on any cluster.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(name: str = "linkguard", cpus: str | int | None = None) -> SparkSession:
    """A local session for tests and the bench."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false"))
    for k, v in RECOMMENDED.items():
        b = b.config(k, v)
    return b.getOrCreate()
