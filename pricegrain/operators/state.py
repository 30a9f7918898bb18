"""State machines over event logs, as windows where the state is a sum and as ordered folds where it is not.

Events have key, seq and ts or moment. A fold takes one key's events in order of seq, from sorted batches:
what is kept of a log is its state, so that a long one needs no memory of its own, and one task's time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KINDS = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}


def folded(events: DataFrame, added: str, start: Callable[[], list], step: Callable[..., tuple], uses: list[str], key: str = "key", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """events with the columns `added`: what step(state, *uses) returns for each, as it changes the key's state in order.

    A null key is a key; an empty log gives an empty result.
    """
    fields = [c.split() for c in added.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = run
        state: list = []
        for batch in batches:
            rows = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *uses)), strict=True):
                if k != at:
                    at, state = k, start()
                rows.append(step(state, *values))
            made = [pa.array([r[i] for r in rows], _KINDS[kind]) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(n for n, _ in fields)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields), added])
    return events.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def bounded_counter(events: DataFrame, step: int = 5) -> DataFrame:
    """events (key, seq, amount) with refused, and total after each: larger steps are refused, the total never falls under 0.

    With S_i the sum of the amounts let through, the total is S_i - min(0, least S_j up to i).
    """
    upto = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    refused = F.abs("amount") > step
    rows = events.withColumn("refused", refused).withColumn("_sum", F.sum(F.when(refused, 0).otherwise(F.col("amount"))).over(upto))
    return rows.select(*events.columns, "refused", (F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto))).cast("long").alias("total"))


def paced(events: DataFrame, delay: int) -> DataFrame:
    """events (key, seq, moment) with the slot of each: its own time or delay after the slot before, whichever is later.

    slot_i = max over j <= i of (moment_j + (i - j) * delay), so a running maximum of moment_j - j * delay gives it.
    """
    upto = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    nth = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    rows = events.withColumn("_n", nth).withColumn("_base", F.max(F.col("moment") - F.col("_n") * delay).over(upto))
    return rows.select(*events.columns, (F.col("_base") + F.col("_n") * delay).alias("slot"))


def breaker(events: DataFrame, first: int = 30, later: int = 300) -> DataFrame:
    """events (key, seq, moment, failed) with failures in a row and until when calls are skipped; a success closes it."""
    by = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum((~F.col("failed")).cast("int")).over(by)
    rows = events.withColumn("_run", run)
    streak = F.sum(F.col("failed").cast("int")).over(Window.partitionBy("key", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    until = F.when(F.col("failures") == 0, 0).otherwise(F.col("moment") + F.when(F.col("failures") == 1, first).otherwise(later))
    return rows.withColumn("failures", streak).select(*events.columns, "failures", until.alias("open_until"))


def empty_pauses(events: DataFrame, limit: int = 3, pause: int = 86_400) -> DataFrame:
    """events (key, seq, moment, empty, cached) with skipped, streak and paused_until (0: not): after limit empty answers in a row calls pause.

    Calls in a pause are not made; cached answers say nothing.
    """

    return folded(events, "skipped boolean, streak int, paused_until long", lambda: [0, 0], pause_step(limit, pause), ["moment", "empty", "cached"])


def pause_step(limit: int, pause: int) -> Callable[..., tuple]:
    """The step of empty_pauses() on a state [streak, until]."""

    def step(state: list, moment: int, empty: bool, cached: bool) -> tuple:
        skipped = moment < state[1]
        if not skipped and not cached:
            state[0] = state[0] + 1 if empty else 0
            if state[0] >= limit:
                state[:] = [0, moment + pause]
        return skipped, state[0], state[1]

    return step


def live(cache: DataFrame, now: Column) -> DataFrame:
    """Of each key the last write, if it has not expired at now."""
    newest = cache.groupBy("key").agg(F.max(F.struct("ts", "seq", "expires_at")).alias("last"))
    return newest.where(F.col("last.expires_at") > now).select("key", F.col("last.ts").alias("ts"), F.col("last.expires_at").alias("expires_at"))


def evicted(cache: DataFrame, most: int) -> DataFrame:
    """The most entries written last; the oldest go first."""
    return cache.orderBy(F.desc("ts"), F.desc("seq")).limit(most)


def quota(events: DataFrame, limit: int, most: int = 5) -> DataFrame:
    """events (key, seq, units) with allowed and total: claims over the limit are handed back and do not count.

    Negative units give back; the total never falls under 0. The counter itself takes no step of more than
    `most`: what it refuses is not counted, and lets the call through. The key holds the period.
    """

    def step(state: list, units: int) -> tuple:
        if abs(units) > most:
            return True, state[0]
        state[0] = max(0, state[0] + units)
        if units > 0 and state[0] > limit:
            state[0] = max(0, state[0] - units)
            return False, state[0]
        return True, state[0]

    return folded(events, "allowed boolean, total long", lambda: [0], step, ["units"])


def ledger(local: DataFrame, remote: DataFrame, pending: DataFrame, cap: int, remote_caps: DataFrame) -> DataFrame:
    """(key, used, cap, remaining, low, exhausted): used is the larger of the local count and the remote one with what came since, and what is pending.

    local (key, calls, since), remote (key, calls), pending (key, units), remote_caps (key, cap).
    """
    rows = local.withColumnRenamed("calls", "mine").join(remote.withColumnRenamed("calls", "theirs"), "key", "left").join(pending.groupBy("key").agg(F.sum("units").alias("pending")), "key", "left").join(remote_caps.withColumnRenamed("cap", "_cap"), "key", "left")
    used = F.greatest(F.col("mine"), F.coalesce("theirs", F.lit(0)) + F.col("since")) + F.coalesce("pending", F.lit(0))
    limit = F.least(F.lit(cap), F.coalesce("_cap", F.lit(cap)))
    shown = rows.select("key", used.cast("long").alias("used"), limit.cast("long").alias("cap"))
    left = F.greatest(F.col("cap") - F.col("used"), F.lit(0))
    return shown.select("*", left.alias("remaining"), low_budget(left), (left == 0).alias("exhausted"))


def budget_report(usage: DataFrame, allowances: DataFrame) -> DataFrame:
    """(period, provider, label, used, cap, remaining, exhausted, low, note) from a table of one column a provider.

    usage: period, and the calls of each provider in a column of its name. allowances: provider, label, cap,
    monthly, and counted, the provider's own count or null. The larger count holds; a provider without an
    allowance has no row, and one not used in a period zero calls.
    """
    providers = [c for c in usage.columns if c != "period"]
    rows = usage.unpivot(["period"], providers, "provider", "calls").join(allowances, "provider")
    used = F.greatest(F.coalesce("calls", F.lit(0)), F.coalesce("counted", F.lit(0))).cast("long")
    note = F.when(F.col("counted").isNotNull(), "Stops before the limit").when(F.col("monthly"), "Starts again each month").otherwise("Given once")
    shown = rows.select("period", "provider", "label", used.alias("used"), F.col("cap").cast("long").alias("cap"), note.alias("note"))
    left = F.greatest(F.col("cap") - F.col("used"), F.lit(0))
    return shown.select("period", "provider", "label", "used", "cap", left.alias("remaining"), (left == 0).alias("exhausted"), low_budget(left), "note")


def low_budget(remaining: Column, few: int = 25) -> Column:
    return ((remaining <= few) & (remaining > 0)).alias("low")


def blocked_hosts(reads: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    """(host, until) of hosts whose last failed thorough read (host, moment, thorough, ok) was less than so many hours ago."""
    last = reads.where("thorough and not ok").groupBy("host").agg((F.max("moment") + hours * 3600).alias("until"))
    return last.where(F.col("until") > now)


def relaxed(queries: DataFrame, rungs: Column, answered: Callable[[DataFrame], DataFrame], most: int = 2) -> DataFrame:
    """(query_id, rung, terms, ...) of the first form of each query with an answer: later forms are asked only where all before had none.

    rungs is the array of forms; answered(asked) returns rows with query_id for (query_id, rung, terms).
    """
    forms = queries.select("query_id", F.posexplode(rungs).alias("rung", "terms")).where(F.col("rung") <= most)
    out, open_ = None, forms
    for rung in range(most + 1):
        asked = open_.where(F.col("rung") == rung)
        found = answered(asked)
        rows = asked.join(found, "query_id")
        out = rows if out is None else out.unionByName(rows)
        open_ = open_.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return out
