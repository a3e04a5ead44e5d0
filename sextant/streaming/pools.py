"""Keyed state with timers: search pools that live for a while, and runs that count as abandoned after a silence.

Both are processors of transformWithState in event time. State lies in Spark's state store by key, so it is spread like any shuffle, survives lost executors with the query's
checkpoint, and a replayed batch changes nothing. A timer fires once the watermark has passed it; what a key held is then gone from the store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIFETIME_SECONDS, ABANDONED_DAYS = 1800, 14  # fixed values

PAGES = "pool string, ts timestamp, kind string, total int, items array<string>"
STATUSES = "run string, ts timestamp, status string"


def _ms(ts: pd.Timestamp) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class PoolProcessor(StatefulProcessor):
    """Rows (pool, ts, action, items, first, most): 'save' keeps the items, for LIFETIME_SECONDS from then on; 'page' asks for items first ... of `most`.

    Out: a 'page' for each such row, 'expired' instead where the pool is unknown or too old; one 'gone' when a pool's time is over. Reading a pool does not prolong it.
    """

    def __init__(self, lifetime: int = LIFETIME_SECONDS):
        self.lifetime = lifetime * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pool = handle.getValueState("pool", "items string, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        held = self.pool.get() if self.pool.exists() else None
        items, until = (json.loads(held[0]), held[1]) if held else (None, -1)
        before = until
        for r in pd.concat(rows).sort_values(["ts", "action"], ascending=[True, False], kind="stable").itertuples(index=False):
            now = _ms(r.ts)
            if r.action == "save":
                items, until = [str(x) for x in (r.items if r.items is not None else [])], now + self.lifetime
            elif items is None or now >= until:
                out.append((key[0], r.ts, "expired", None, None))
            else:
                first, most = (0 if pd.isna(x) else int(x) for x in (r.first, r.most))
                out.append((key[0], r.ts, "page", len(items), items[max(0, first) : max(0, first) + most]))
        if items is not None and until != before:
            if before >= 0:
                self.handle.deleteTimer(before)
            self.pool.update((json.dumps(items), until))
            self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=["pool", "ts", "kind", "total", "items"]).astype({"total": "Int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.pool.clear()
        yield pd.DataFrame([(key[0], pd.Timestamp(at, unit="ms"), "gone", None, None)], columns=["pool", "ts", "kind", "total", "items"]).astype({"total": "Int32"})

    def close(self) -> None:
        pass


class RunProcessor(StatefulProcessor):
    """Rows (run, ts, event): 'done' ends a run for good, 'paused' holds it, anything else makes it active; ABANDONED_DAYS without an event make an active run abandoned.
    Out: a row for each change of status."""

    def __init__(self, days: int = ABANDONED_DAYS):
        self.silence = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "status string, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, until = self.run.get() if self.run.exists() else (None, -1)
        out, before = [], until
        for r in pd.concat(rows).sort_values("ts", kind="stable").itertuples(index=False):
            new = "done" if status == "done" or r.event == "done" else "paused" if r.event == "paused" else "active"
            until = max(until, _ms(r.ts) + self.silence) if new == "active" else -1
            if new != status:
                out.append((key[0], r.ts, new))
            status = new
        if before >= 0 and before != until:
            self.handle.deleteTimer(before)
        if until >= 0 and before != until:
            self.handle.registerTimer(until)
        self.run.update((status, until))
        yield pd.DataFrame(out, columns=["run", "ts", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.run.update(("abandoned", -1))
        yield pd.DataFrame([(key[0], pd.Timestamp(at, unit="ms"), "abandoned")], columns=["run", "ts", "status"])

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the only one with timers
    return rows.where(f"{key} is not null and ts is not null").withWatermark("ts", late).groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def search_pools(requests: DataFrame, lifetime: int = LIFETIME_SECONDS, late: str = "1 minute") -> DataFrame:
    """requests(pool, ts, action, items, first, most), streaming -> PAGES. Rows without pool or time go."""
    return _run(requests, "pool", PoolProcessor(lifetime), PAGES, late)


def run_statuses(events: DataFrame, days: int = ABANDONED_DAYS, late: str = "1 hour") -> DataFrame:
    """events(run, ts, event), streaming -> STATUSES."""
    return _run(events, "run", RunProcessor(days), STATUSES, late)
