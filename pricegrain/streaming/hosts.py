"""Keyed state with timers: hosts that are left alone for a time, and pauses after empty answers.

These need a state store that transformWithState can use:
spark.sql.streaming.stateStore.providerClass = PROVIDER.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pricegrain.operators.state import pause_step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Blocked(StatefulProcessor):
    """State: until when the host is blocked. A timer at that moment opens it, and its state goes."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        failed = [int(m) for part in rows for m in part.loc[part["thorough"] & ~part["ok"], "moment"]]
        if not failed:
            return
        known = self.until.get()[0] if self.until.exists() else None
        until = max(failed) + self.seconds
        if known is None or until > known:
            if known is not None:
                self.handle.deleteTimer(known * 1000)
            self.until.update((until,))
            self.handle.registerTimer(until * 1000)
            yield pd.DataFrame({"host": [key[0]], "until": [until], "blocked": [True]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        until = self.until.get()[0]
        self.until.clear()
        yield pd.DataFrame({"host": [key[0]], "until": [until], "blocked": [False]})

    def close(self) -> None:
        pass


def blocked_hosts(reads: DataFrame, hours: int = 12, late: str = "0 seconds") -> DataFrame:
    """(host, until, blocked): each time that a failed thorough read of a stream (host, ts, moment, thorough, ok) blocks a host for longer, and each time a block ends.

    A block ends when the watermark passes its end; what is kept of a host then is nothing.
    """
    rows = reads.withWatermark("ts", late).groupBy("host")
    return rows.transformWithStateInPandas(_Blocked(hours * 3600), "host string, until long, blocked boolean", "append", "eventTime")


class _Paused(StatefulProcessor):
    """State: empty answers in a row and until when calls pause, kept for so long as none of both can matter."""

    def __init__(self, limit: int, pause: int):
        self.limit, self.pause = limit, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pause", "streak int, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        log = pd.concat(list(rows)).sort_values("seq", kind="stable")
        state = list(self.state.get()) if self.state.exists() else [0, 0]
        step = pause_step(self.limit, self.pause)
        out = [step(state, int(m), bool(e), bool(c)) for m, e, c in zip(log["moment"], log["empty"], log["cached"], strict=True)]
        if state == [0, 0]:
            self.state.clear()
        else:
            self.state.update((int(state[0]), int(state[1])))
        yield log[["key", "seq"]].assign(skipped=[o[0] for o in out], streak=[o[1] for o in out], paused_until=[o[2] for o in out])

    def close(self) -> None:
        pass


def empty_pauses(events: DataFrame, limit: int = 3, pause: int = 86_400) -> DataFrame:
    """(key, seq, skipped, streak, paused_until) of a stream (key, seq, moment, empty, cached), by the rule of operators.state.empty_pauses.

    Within a batch a key's events count in order of seq, and after those of earlier batches.
    """
    rows = events.select("key", F.col("seq").cast("long").alias("seq"), F.col("moment").cast("long").alias("moment"), "empty", "cached").groupBy("key")
    return rows.transformWithStateInPandas(_Paused(limit, pause), "key string, seq long, skipped boolean, streak int, paused_until long", "append", "none")
