"""The session that the operators expect."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where intermediate files go if the session names no spark.checkpoint.dir and runs on this machine alone, as in tests.
LOCAL_FILES = "file:///tmp/pricegrain"

#: While it is set, a query's shuffle files are removed when the query ends.
REMOVES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session: UTC, adaptive execution, as many shuffle partitions as asked for.

    On a cluster, pass no master of your own: spark-submit sets it, and the operators read
    spark.sql.shuffle.partitions and spark.checkpoint.dir from the session they are given.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName("pricegrain")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share, deleted when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(shared or LOCAL_FILES).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def once(df: DataFrame, name: str) -> DataFrame:
    """df as a table in scratch(), for what several later steps read: Spark would compute it anew for each.

    Its shuffle files are removed once it is written; else they stay until the driver happens to collect its garbage.
    """
    path, conf = scratch(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(REMOVES_SHUFFLES, None)
    conf.set(REMOVES_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(REMOVES_SHUFFLES) if before is None else conf.set(REMOVES_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
