"""A stream upserted into a table of versions: a batch that runs again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pricegrain.operators.rows import last_per


def _versions(spark: SparkSession, path: str) -> dict[int, object]:
    """Whole versions in a folder: those whose write was committed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return {}
    found = {}
    for status in files.listStatus(folder):
        at = status.getPath()
        if at.getName().startswith("v=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
            found[int(at.getName()[2:])] = at
    return found


def latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table's newest version; no rows before the first."""
    versions = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v={max(versions)}") if versions else spark.createDataFrame([], schema)


def upsert_batch(path: str, schema: str, keys: list[str], order: list[str], keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: version n is version n - 1, or the last before it, with batch n upserted.

    Of a key the last row by order stays, so a row that comes late replaces no newer one. A batch that is given again,
    after a failure, is written again from the same rows. All but the last `keep` versions before it are deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = {v: p for v, p in _versions(spark, path).items() if v < number}
        before = spark.read.schema(schema).parquet(f"{path}/v={max(earlier)}") if earlier else spark.createDataFrame([], schema)
        last_per(before.unionByName(batch.select(*before.columns)), keys, order).write.mode("overwrite").parquet(f"{path}/v={number}")
        for old in sorted(earlier)[:-keep]:
            earlier[old].getFileSystem(spark._jsc.hadoopConfiguration()).delete(earlier[old], True)

    return write


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], schema: str) -> StreamingQuery:
    """Start a stream of rows into the table at path, until all that is there now is read."""
    write = upsert_batch(path, schema, keys, order)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
