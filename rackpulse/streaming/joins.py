"""The tolerance join on live series.

Rows of one host and time slice meet in a state of their own, ordered by time. A BMC row is answered by a timer when the
watermark has passed its reach, since no host row that could still be earlier can come then; host rows that no BMC row
can need any more go. So a state holds rows of one reach behind the watermark, and the next batch's rows, never a whole slice.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rackpulse.functions.parse import micros
from rackpulse.operators.series import SECOND, tolerance_join

OUTPUT = "host string, bmc_t bigint, bmc string, host_t bigint, sample string"
#: State stores that timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows (t, side, tie, payload) that lie in a state as one text; storing each on its own costs far more than its rows do.
_ROWS, _AT_ONCE = "rows string", 4096


def closing_ms(t, reach: int):
    """Millisecond that the watermark must have passed before a BMC row is answered."""
    return -(-(t + reach) // 1000)


def _packed(rows: list) -> list[tuple[str]]:
    return [(json.dumps(rows[i : i + _AT_ONCE]),) for i in range(0, len(rows), _AT_ONCE)]


class Pairing(StatefulProcessor):
    """Rows of one host and slice that wait: BMC rows (side 0) for their answer, host rows (side 1) for BMC rows.

    A state has few rows and states are many, so they are handled as plain rows; a frame for each would cost more than they do.
    """

    def __init__(self, reach: int, shift: int):
        self.reach, self.shift = reach, shift

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _ROWS)
        self.due = handle.getValueState("due", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = last = None
        while held := [(r.t, r.side, r.tie, r.payload) for r in islice(rows, _AT_ONCE)]:
            self.held.appendList(_packed(held))
            bmc = [t for t, side, _, _ in held if side == 0]
            if bmc:
                first = min(bmc) if first is None else min(first, *bmc)
            last = max(t for t, _, _, _ in held) if last is None else max(last, *(t for t, _, _, _ in held))
        if last is not None:
            self._wake(closing_ms(first, self.reach) if first is not None else last // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted((r for (text,) in self.held.get() for r in json.loads(text)), key=lambda r: (r[0], r[2] is None, r[2] or 0))
        host = [r for r in rows if r[1] == 1]
        times, waiting = [r[0] for r in host], []
        for row in rows:
            t, side, _, payload = row
            if side == 1:
                continue
            if closing_ms(t, self.reach) >= passed:
                waiting.append(row)
                continue
            at = bisect_right(times, t)  # the first host row strictly behind
            if at < len(times) and times[at] < t + self.reach:
                yield Row(host=key[0], bmc_t=t + self.shift, bmc=payload, host_t=times[at], sample=host[at][3])
        # Rows that come later are not behind the watermark.
        needed = min(waiting[0][0] if waiting else passed * 1000, passed * 1000)
        behind = host[bisect_right(times, needed):]
        if waiting or behind:
            self.held.put(_packed(waiting + behind))
            self._set(closing_ms(waiting[0][0], self.reach) if waiting else behind[-1][0] // 1000 + 1)
        else:
            self.due.clear()
            self.held.clear()

    def close(self) -> None:
        pass

    def _wake(self, due: int) -> None:
        """One timer for a state, at the earliest time something is due."""
        now = self.due.get()
        if now is None or due < now[0]:
            if now is not None:
                self.handle.deleteTimer(now[0])
            self._set(due)

    def _set(self, due: int) -> None:
        self.due.update((due,))
        self.handle.registerTimer(due)


def _side(df: DataFrame, number: int, t: Column) -> DataFrame:
    tie = F.col("tie").cast("bigint") if "tie" in df.columns else F.lit(0).cast("bigint")
    return df.select(F.col("host").cast("string").alias("host"), t.alias("t"), F.lit(number).alias("side"), tie.alias("tie"), "payload")


def tolerance_join_stream(
    bmc: DataFrame, host: DataFrame, tolerance_us: int = SECOND, drift_us: int = 0,
    slice_seconds: int = 600, lateness_seconds: int = 10,
) -> DataFrame:
    """Pairs of two streams with columns ``host``, ``ts`` and ``payload`` (text); of host rows at one time the least ``tie`` counts.

    A BMC row is answered once the watermark has passed its reach; rows later than the lateness are dropped. Slices
    spread a busy host over tasks; host rows near the start of a slice are also given to the slice before.
    """
    spark = bmc.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATE_STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    reach, shift = 2 * tolerance_us, drift_us + tolerance_us
    slice_us = max(slice_seconds * SECOND, reach)
    start = F.col("t") - F.pmod(F.col("t"), F.lit(slice_us))
    left = _side(bmc, 0, micros("ts") - shift).withColumn("slice", start)
    slices = F.when(F.col("t") - start < reach, F.array(start - slice_us, start)).otherwise(F.array(start))
    right = _side(host, 1, micros("ts")).withColumn("slice", F.explode(slices))
    # A BMC row's place lies behind its own time by the shift.
    delay = lateness_seconds + -(-abs(shift) // SECOND)
    both = left.unionByName(right).withColumn("at", F.timestamp_micros("t")).withWatermark("at", f"{delay} seconds")
    return both.groupBy("host", "slice").transformWithState(Pairing(reach, shift), OUTPUT, "append", "EventTime")


def open_pairs(bmc: DataFrame, host: DataFrame, watermark_us: int, tolerance_us: int = SECOND, drift_us: int = 0) -> DataFrame:
    """Pairs of the BMC rows that a stream with this watermark has not answered, by the batch join over the rows behind it."""
    reach, shift = 2 * tolerance_us, drift_us + tolerance_us
    late = lambda t: (F.floor((t - shift + reach + 999) / 1000) >= watermark_us // 1000)
    left = bmc.withColumn("t", micros("ts")).where(late(F.col("t")))
    right = host.withColumn("t", micros("ts")).where(F.col("t") > watermark_us - reach - 1000)
    row = lambda df: _side(df, 0, F.col("t")).drop("side")
    pairs = tolerance_join(row(left), row(right), ["host"], tolerance_us, drift_us, tie=["tie"])
    return pairs.select(
        "host", F.col("bmc_row.t").alias("bmc_t"), F.col("bmc_row.payload").alias("bmc"),
        F.col("host_row.t").alias("host_t"), F.col("host_row.payload").alias("sample"),
    )


def is_answered(watermark_us: int, tolerance_us: int = SECOND, drift_us: int = 0) -> Column:
    """Whether a stream with this watermark has answered the BMC row of a pair."""
    reach, shift = 2 * tolerance_us, drift_us + tolerance_us
    return F.floor((F.col("bmc_t") - shift + reach + 999) / 1000) < watermark_us // 1000
