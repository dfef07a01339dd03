"""Alerts with a memory: one row when a condition begins to hold and one when it ends.

A condition is looked at every half hour of event time, as if a clock had polled the log. Timers fire once the watermark
has passed a tick, so that all samples before the tick have arrived; between ticks only what later ticks need is kept. Times are
milliseconds since 1970 inside.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions.clock import instant, wall

EVERY, DAY = 30 * 60_000, 24 * 3_600_000
#: measures are whole ten-thousandths in the state
UNIT = 10_000
EVENTS = "alert string, severity string, subject string, event string, at timestamp_ntz"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Polled(StatefulProcessor):
    """Looks at a subject's condition at every tick. ``panes`` sum the samples by half hour until they are no longer needed."""

    alert, severity = "", ""

    def init(self, handle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "pane bigint", "total bigint, n bigint")
        self.sums = handle.getMapState("sums", "month bigint", "total bigint, n bigint")
        self.firing = handle.getValueState("firing", "since bigint")
        self.looked = handle.getValueState("looked", "tick bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[int, tuple[int, int]] = {}
        for row in rows:
            pane = row.ms // EVERY * EVERY
            total, n = new.get(pane, (0, 0))
            new[pane] = total + row.units, n + 1
        for pane, (total, n) in new.items():
            before = self.panes.getValue((pane,)) or (0, 0)
            self.panes.updateValue((pane,), (before[0] + total, before[1] + n))
        if new:
            self.handle.registerTimer(min(new) + EVERY)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        tick, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        if self.looked.exists() and tick <= self.looked.get()[0]:
            return
        maps = [(state, dict((k[0], tuple(v)) for k, v in state.iterator())) for state in (self.panes, self.sums)]
        before, (panes, sums) = [dict(own) for _, own in maps], [own for _, own in maps]
        was = firing = self.firing.exists()
        go_on = True
        while go_on and tick <= now:
            holds = self.look(tick, panes, sums)
            if holds != firing:
                firing = holds
                yield Row(alert=self.alert, severity=self.severity, subject=key[0], event="started" if holds else "ended", ms=tick)
            go_on, tick = bool(panes or sums), tick + EVERY
        self.looked.update((tick - EVERY,))
        if firing != was:
            self.firing.update((tick,)) if firing else self.firing.clear()
        for (state, own), old in zip(maps, before):
            for k in old.keys() - own.keys():
                state.removeKey((k,))
            for k, v in own.items():
                if old.get(k) != v:
                    state.updateValue((k,), v)
        if go_on:
            self.handle.registerTimer(tick)

    def look(self, tick: int, panes: dict, sums: dict) -> bool:
        """Whether the condition holds at the tick; takes away what no later tick needs."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class HighQueue(Polled):
    """The mean queue of a cluster's samples of the last 24 hours, to two places, is above ``limit``."""

    alert, severity = "high_queue", "WARNING"

    def __init__(self, limit: float):
        self.limit = limit

    def look(self, tick, panes, sums):
        for pane in [p for p in panes if p < tick - DAY]:
            del panes[pane]
        total, n = (sum(v[i] for p, v in panes.items() if p < tick) for i in (0, 1))
        return n > 0 and (Decimal(total) * 100 / (n * UNIT)).quantize(Decimal(1), ROUND_HALF_UP) > Decimal(str(self.limit)) * 100


class CostSpike(Polled):
    """Credits of the month so far are above ``factor`` times those of the month before, which has some."""

    alert, severity = "cost_spike", "CRITICAL"

    def __init__(self, factor: float):
        self.factor = factor

    def look(self, tick, panes, sums):
        def month(ms: int) -> int:
            at = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)
            return at.year * 12 + at.month
        here = month(tick)
        for pane in [p for p in panes if p < tick]:
            total, n = sums.get(month(pane), (0, 0))
            added = panes.pop(pane)
            sums[month(pane)] = total + added[0], n + added[1]
        for old in [m for m in sums if m < here - 1]:
            del sums[old]
        now, before = (sums.get(m, (0, 0))[0] for m in (here, here - 1))
        return before > 0 and Decimal(now) > Decimal(before) * Decimal(str(self.factor))


def _events(samples: DataFrame, processor: Polled, lag: str) -> DataFrame:
    """``samples`` has subject, start_time and value (a decimal of at most four places)."""
    timed = samples.where("start_time IS NOT NULL AND value IS NOT NULL").select(
        "subject", instant("start_time").alias("_at"), (F.col("value") * UNIT).cast("bigint").alias("units"))
    timed = timed.withColumn("ms", F.unix_millis("_at")).withWatermark("_at", lag)
    found = timed.groupBy("subject").transformWithState(
        processor, "alert string, severity string, subject string, event string, ms bigint", "Update", "eventTime")
    return found.select("alert", "severity", "subject", "event", wall(F.timestamp_millis("ms")).alias("at"))


def high_queue(load: DataFrame, limit: float = 5.0, lag: str = "3 hours") -> DataFrame:
    """Events of each cluster's queue, from a stream of load samples."""
    own = load.where(F.col("warehouse_name").like("INV_%"))
    return _events(own.select(F.col("warehouse_name").alias("subject"), "start_time", F.col("avg_queued_load").alias("value")), HighQueue(limit), lag)


def cost_spike(metering: DataFrame, factor: float = 1.2, lag: str = "3 hours") -> DataFrame:
    """Events of the monthly cost of all clusters together, from a stream of hourly metering, which is one row an hour and cluster."""
    own = metering.where(F.col("warehouse_name").like("INV_%"))
    value = F.coalesce("credits_used", F.lit(0)) + F.coalesce("credits_used_cloud_services", F.lit(0))
    return _events(own.select(F.lit("all clusters").alias("subject"), "start_time", value.alias("value")), CostSpike(factor), lag)


def with_state_store(run, spark):
    """Calls ``run`` with the state store that these states need, which a query takes from the session when it starts."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        return run()
    finally:
        spark.conf.set(key, before)
