"""Session builder with the settings that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE; `conf` keys use double underscores for dots.

    A submitted application keeps its master, the cluster's own number of
    shuffle partitions and its memory; only a session that this process starts
    on its own machine gets settings for that.
    """
    builder = SparkSession.builder.appName(app)
    if master is None and "PYSPARK_GATEWAY_PORT" not in os.environ:  # not started by spark-submit
        master = f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
