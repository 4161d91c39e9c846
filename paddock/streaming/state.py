"""Keyed state of streams: the highest lap per car, the firing run per rule.

Spark holds one small value per key in its state store (RocksDB, see ``session.SETTINGS``), so a
batch reads nothing that earlier batches wrote and a restart goes on from the last commit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class HighestLap(StatefulProcessor):
    """Rows whose lap exceeds every lap the key had before, in arrival order.

    Of a batch only the first row of each lap number can count, as the later ones find that lap
    reached; so a task holds one row per lap number of a car, however many messages a car sends.
    A key that got no rows for ``idle_ms`` of processing time is dropped by its timer.  Rows of a
    session that come even later count from zero again; ``upsert_laps`` finds those laps stored.
    """

    def __init__(self, order: str, lap: str, idle_ms: int):
        self.order, self.lap, self.idle_ms = order, lap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "highest int, until bigint")

    def _keep(self, highest: int, timers, new: bool) -> None:
        until = timers.getCurrentProcessingTimeInMs() + self.idle_ms
        if new:  # later rows only move ``until``; the timer follows when it fires
            self.handle.registerTimer(until)
        self.seen.update((highest, until))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        if initialState["highest"] is not None:
            self._keep(int(initialState["highest"]), timerValues, True)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.seen.get()
        before = highest = held[0] if held else 0
        first: dict[int, tuple] = {}
        for row in rows:
            lap = row[self.lap]
            if lap is not None and lap > before:
                at = (row[self.order] is None, row[self.order] if row[self.order] is not None else 0, lap)
                if lap not in first or at < first[lap][0]:
                    first[lap] = (at, row)
        out = []
        for _, row in sorted(first.values(), key=lambda r: r[0]):
            if row[self.lap] > highest:
                highest = row[self.lap]
                out.append(row)
        self._keep(highest, timerValues, held is None)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.seen.get()
        if held and held[1] > timerValues.getCurrentProcessingTimeInMs():
            self.handle.registerTimer(held[1])
        else:
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


NEVER = -(2**62)


class FiringRun(StatefulProcessor):
    """Adds ``since`` (``NEVER`` where a window does not fire) to the closed windows of a rule.

    Windows come in order of their start over batches, as the watermark closes them; a batch's are
    sorted here.  State is the last window and the start of its run, so a missing window shows as a
    gap to the next one.  ``slide`` and the column ``at`` are in microseconds.
    """

    def __init__(self, slide: int):
        self.slide = slide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "last bigint, since bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, since = self.run.get() if self.run.exists() else (NEVER, NEVER)
        out = pd.concat(list(rows)).sort_values("at")
        at, firing = out["at"].to_numpy(np.int64), out["firing"].to_numpy(bool)
        fired = np.where(firing, at, NEVER)
        before = np.concatenate([[last], fired[:-1]])
        opens = firing & (before + self.slide < at)
        begin = np.maximum.accumulate(np.concatenate([[since], np.where(opens, at, NEVER)]))[1:]
        self.run.update((int(fired[-1]), int(begin[-1])))
        yield out.assign(since=np.where(firing, begin, NEVER))

    def close(self) -> None:
        pass
