"""Streams read from files, in several batches, against the batch operators."""

import datetime
import random

from pyspark.sql import functions as F

from pricegrain.operators import state
from pricegrain.streaming import prices


def streamed(spark, df, path, make, mode="append"):
    """The rows that a stream over df, in one file for each value of `batch`, gives until all was read."""
    schema = df.drop("batch").schema
    for (batch,) in sorted(df.select("batch").distinct().collect()):
        df.where(F.col("batch") == batch).drop("batch").coalesce(1).write.mode("append").parquet(str(path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    name = f"out{random.randrange(1 << 30)}"
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_daily_lows_of_a_stream(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(b, b % 2, day + datetime.timedelta(hours=13 * b), float(100 - b)) for b in range(6)]
    df = spark.createDataFrame(rows, "batch int, product_id int, ts timestamp, price double")
    got = {(r.product_id, r.day): (r.price, r.offers) for r in streamed(spark, df, tmp_path, prices.daily_lows, "complete")}
    want = {}
    for _, p, ts, price in rows:
        low, n = want.get((p, ts.date()), (price, 0))
        want[p, ts.date()] = (min(low, price), n + 1)
    assert got == want


def test_alerts_of_a_stream(spark, tmp_path):
    tracked = spark.createDataFrame([("u", 1, 50.0, True), ("v", 1, 50.0, False), ("w", 1, None, True), ("x", 2, 10.0, None)], "user_id string, product_id int, target_price double, alert_enabled boolean")
    df = spark.createDataFrame([(0, 1, datetime.datetime(2024, 1, 1), 60.0), (1, 1, datetime.datetime(2024, 1, 2), 50.0), (1, 2, datetime.datetime(2024, 1, 2), 9.0)], "batch int, product_id int, ts timestamp, price double")
    assert sorted((r.user_id, r.price) for r in streamed(spark, df, tmp_path, lambda s: prices.alerts(s, tracked))) == [("u", 50.0), ("x", 9.0)]


def test_quota_of_a_stream_is_that_of_the_batch(spark, tmp_path):
    rng = random.Random(4)
    df = spark.createDataFrame([(i // 20, f"k{rng.randint(0, 2)}", i, rng.randint(-6, 6)) for i in range(80)], "batch int, key string, seq int, units int")
    want = {r.seq: (r.allowed, r.total) for r in state.quota(df.drop("batch"), 9).collect()}
    assert {r.seq: (r.allowed, r.total) for r in streamed(spark, df, tmp_path, lambda s: prices.quota(s, 9))} == want
