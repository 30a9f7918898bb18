"""Queries on the event log: counters, pacing, breakers, pauses, caches and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.operators import state as op
from pricegrain.plans.registering import Queries
from pricegrain.plans.roles import table

Q = Queries("""WITH RECURSIVE ev AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, epoch_us(ts) // 1000000 AS moment, CAST(floor(value) AS BIGINT) % 7 AS units, event_type = 'error' AS failed FROM events)""")


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("moment"),
        (F.floor("value").cast("long") % 7).alias("units"), (F.col("event_type") == "error").alias("failed"),
    )


Q.add("z5_bounded_counter", lambda s, d: op.bounded_counter(_events(s, d).select("key", "seq", (2 * F.col("units") - 6).alias("amount"))), """SELECT key, seq, amount, refused, CAST(total - least(0, min(total) OVER (PARTITION BY key ORDER BY seq)) AS BIGINT) AS total
  FROM (SELECT key, seq, 2 * units - 6 AS amount, abs(2 * units - 6) > 5 AS refused, sum(CASE WHEN abs(2 * units - 6) > 5 THEN 0 ELSE 2 * units - 6 END) OVER (PARTITION BY key ORDER BY seq) AS total FROM ev)""")
_CLAIM = "CASE WHEN units > 0 AND greatest(0, total + units) > 12 THEN {0} ELSE {1} END"
Q.add("z6_quota", lambda s, d: op.quota(_events(s, d).select("key", "seq", (F.col("units") - 2).alias("units")), 12), f""", log AS (
  SELECT key, seq, units - 2 AS units, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM ev
), run AS (
  SELECT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS units, CAST(0 AS BIGINT) AS total, true AS allowed FROM log WHERE n = 1
  UNION ALL
  SELECT key, log.n, log.seq, log.units, {_CLAIM.format("greatest(0, greatest(0, total + log.units) - log.units)", "greatest(0, total + log.units)").replace("(0, total + units)", "(0, total + log.units)").replace("WHEN units", "WHEN log.units")}, {_CLAIM.format("false", "true").replace("(0, total + units)", "(0, total + log.units)").replace("WHEN units", "WHEN log.units")}
  FROM run JOIN log USING (key) WHERE log.n = run.n + 1
)
SELECT key, seq, units, allowed, total FROM run WHERE n > 0""")
Q.add("z9_breaker", lambda s, d: op.breaker(_events(s, d).select("key", "seq", "moment", "failed")), """SELECT key, seq, moment, failed, CAST(failures AS BIGINT) AS failures, CASE failures WHEN 0 THEN 0 WHEN 1 THEN moment + 30 ELSE moment + 300 END AS open_until FROM (
  SELECT *, sum(failed::INT) OVER (PARTITION BY key, run ORDER BY seq) AS failures FROM (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY key ORDER BY seq) AS run FROM ev))""")
_LIVE = "run.until <= log.moment AND NOT log.cached"
Q.add("z10_empty_pauses", lambda s, d: op.empty_pauses(_events(s, d).select("key", "seq", "moment", (F.col("units") < 5).alias("empty"), (F.col("units") == 6).alias("cached"))), f""", log AS (
  SELECT key, seq, moment, units < 5 AS empty, units = 6 AS cached, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM ev
), run AS (
  SELECT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS moment, false AS empty, false AS cached, false AS skipped, 0 AS streak, CAST(0 AS BIGINT) AS until FROM log WHERE n = 1
  UNION ALL
  SELECT key, log.n, log.seq, log.moment, log.empty, log.cached, run.until > log.moment,
    CASE WHEN NOT ({_LIVE}) THEN run.streak WHEN NOT log.empty OR run.streak >= 2 THEN 0 ELSE run.streak + 1 END, CASE WHEN {_LIVE} AND log.empty AND run.streak >= 2 THEN log.moment + 86400 ELSE run.until END
  FROM run JOIN log USING (key) WHERE log.n = run.n + 1
)
SELECT key, seq, moment, empty, cached, skipped, streak, until AS paused_until FROM run WHERE n > 0""")
Q.add("z13_paced", lambda s, d: op.paced(_events(s, d).select("key", "seq", "moment"), 3600), """SELECT key, seq, moment, max(moment - n * 3600) OVER (PARTITION BY key ORDER BY seq) + n * 3600 AS slot FROM (SELECT key, seq, moment, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM ev)""")
Q.add("z2_live_entries", lambda s, d: op.live(_events(s, d).select("key", "seq", F.col("moment").alias("ts"), (F.col("moment") + F.when(F.col("units") > 0, 21600).otherwise(1800)).alias("expires_at")), F.lit(1_706_600_000)), """SELECT key, ts, expires_at FROM (
  SELECT key, moment AS ts, moment + CASE WHEN units > 0 THEN 21600 ELSE 1800 END AS expires_at FROM ev QUALIFY row_number() OVER (PARTITION BY key ORDER BY moment DESC, seq DESC) = 1) WHERE expires_at > 1706600000""")
Q.add("z3_evicted", lambda s, d: op.evicted(_events(s, d).select("key", "seq", F.col("moment").alias("ts")), 300), "SELECT key, seq, moment AS ts FROM ev ORDER BY moment DESC, seq DESC LIMIT 300")


def _ledger(s: SparkSession, d: str) -> DataFrame:
    per = _events(s, d).groupBy("key").agg(F.count("*").alias("calls"), (F.count("*") % 5).alias("since"), F.count_if(F.col("units") == 6).alias("units"))
    remote = per.where("key % 2 = 0").select("key", F.lit(60).cast("long").alias("calls"))
    caps = per.where("key % 3 = 0").select("key", F.lit(70).cast("long").alias("cap"))
    return op.ledger(per.select("key", "calls", "since"), remote, per.where("key % 5 = 0").select("key", "units"), 90, caps)


Q.add("z7_ledger", _ledger, """, l AS (
  SELECT key, count(*) AS calls, count(*) % 5 AS since, count(*) FILTER (units = 6) AS pending, CAST(key AS BIGINT) AS n FROM ev GROUP BY key
), u AS (
  SELECT key, CAST(greatest(calls, CASE WHEN n % 2 = 0 THEN 60 ELSE 0 END + since) + CASE WHEN n % 5 = 0 THEN pending ELSE 0 END AS BIGINT) AS used, CAST(CASE WHEN n % 3 = 0 THEN 70 ELSE 90 END AS BIGINT) AS cap FROM l
)
SELECT key, used, cap, greatest(cap - used, 0) AS remaining, cap - used BETWEEN 1 AND 25 AS low, cap <= used AS exhausted FROM u""")


def _reads(s: SparkSession, d: str) -> DataFrame:
    return _events(s, d).select(F.col("key").alias("host"), "moment", (F.col("seq") % 2 == 0).alias("thorough"), (~F.col("failed")).alias("ok"))


Q.add("z11_blocked_hosts", lambda s, d: op.blocked_hosts(_reads(s, d), F.lit(1_706_600_000)), "SELECT key AS host, max(moment) + 43200 AS until FROM ev WHERE seq % 2 = 0 AND failed GROUP BY key HAVING max(moment) + 43200 > 1706600000")


def _relaxed(s: SparkSession, d: str) -> DataFrame:
    queries = table(s, d, "customer").select(F.col("c_custkey").alias("query_id"), F.array(F.col("c_name"), F.col("c_mktsegment"), F.lit("all")).alias("forms"))
    answered = lambda asked: asked.where(F.col("query_id") % 4 <= F.col("rung")).select("query_id", (F.col("query_id") % 7).alias("hit"))
    return op.relaxed(queries, F.col("forms"), answered)


Q.add("z17_relaxed_queries", _relaxed, "SELECT c_custkey AS query_id, CAST(c_custkey % 4 AS INT) AS rung, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE 'all' END AS terms, c_custkey % 7 AS hit FROM customer WHERE c_custkey % 4 < 3")
