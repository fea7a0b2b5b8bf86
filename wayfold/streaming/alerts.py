"""The alert ladder's hysteresis: one small state per pass, advanced frame by frame.

The same step serves the batch fold (frames of a pass in time order, in batches) and the stream processor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayfold.functions import settings as S
from wayfold.sources.shipping import ship_package

STATE = "level int, entered bigint, up int, up_to int, down int, down_to int, last bigint"
OUT = "pass_id string, t_ns bigint, raw int, release int, level int"


@dataclass
class Ladder:
    """Current level, when it was entered, and the streaks that would raise or lower it."""

    level: int = 0
    entered: int = -1
    up: int = 0
    up_to: int = 0
    down: int = 0
    down_to: int = 0
    last: int = -1

    def step(self, t_ns: int, raw: int, release: int) -> int:
        """The level after one more frame.

        ``FRAMES_UP`` frames in a row above the level raise it to the least of them.  ``FRAMES_DOWN`` in a row
        whose widened level is below lower it to the greatest of these, once it has stood for ``DWELL_S``.
        A frame not later than the last is an error.
        """
        if self.last >= 0 and t_ns <= self.last:
            raise ValueError(f"frame at {t_ns} is not after the one at {self.last}")
        if self.entered < 0:
            self.entered = t_ns
        self.last = t_ns
        target = None
        if raw > self.level:
            self.up_to = min(raw, self.up_to) if self.up else raw
            self.up, self.down = self.up + 1, 0
            if self.up >= S.FRAMES_UP:
                target = self.up_to
        elif release < self.level:
            self.down_to = max(release, self.down_to) if self.down else release
            self.down, self.up = self.down + 1, 0
            if self.down >= S.FRAMES_DOWN and t_ns - self.entered >= round(S.DWELL_S * 1e9):
                target = self.down_to
        else:
            self.up = self.down = 0
        if target is not None:
            self.level, self.entered, self.up, self.down = target, t_ns, 0, 0
        return self.level


def _advance(state: Ladder, frames: pd.DataFrame) -> pd.DataFrame:
    levels = [state.step(int(t), int(a), int(b)) for t, a, b in zip(frames["t_ns"], frames["raw"], frames["release"])]
    return frames[["pass_id", "t_ns", "raw", "release"]].assign(level=levels)


def held_levels(frames: DataFrame) -> DataFrame:
    """Batch: ``pass_id, t_ns, raw, release`` (one frame per instant) with the held ``level``.

    Rows are laid out by pass and sorted by time; each task walks its sorted rows in batches with one state
    at a time, so a pass of any length needs no memory, only order.
    """
    ship_package(frames.sparkSession)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, Ladder()
        for batch in batches:
            for key, part in batch.groupby("pass_id", sort=False):
                if key != now:
                    now, state = key, Ladder()
                yield _advance(state, part)

    laid = frames.select("pass_id", "t_ns", "raw", "release").repartition("pass_id").sortWithinPartitions("pass_id", "t_ns")
    return laid.mapInPandas(walk, OUT)


class AlertProcessor(StatefulProcessor):
    """Stream: the ladder of each pass in the state store.

    All frames of a pass in a micro-batch are put in order first, however they are spread over chunks.
    Frames without an instant, repeated ones, and those not after the last of an earlier batch come out
    marked ``late``, without a level (the batch twin fails on them).
    """

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ladder", STATE, ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        state = Ladder(*self.state.get()) if self.state.exists() else Ladder()
        frames = pd.concat(list(rows), ignore_index=True).sort_values("t_ns", kind="stable")
        late = frames["t_ns"].isna() | (frames["t_ns"] <= state.last) | frames["t_ns"].duplicated()
        if not late.all():
            yield _advance(state, frames[~late]).assign(late=False)
        if late.any():
            left = frames.loc[late, ["pass_id", "t_ns", "raw", "release"]]
            yield left.assign(level=pd.array([pd.NA] * len(left), dtype="Int32"), late=True)
        self.state.update(astuple(state))

    def close(self) -> None:
        pass


def stream_levels(frames: DataFrame, *, keep_ms: int | None = None) -> DataFrame:
    """Streaming frames ``pass_id, t_ns, raw, release`` with the held level and whether they came too ``late`` for
    one; needs the RocksDB state store.  With ``keep_ms`` the state of a pass without frames for so long is dropped."""
    ship_package(frames.sparkSession)
    return frames.groupBy("pass_id").transformWithStateInPandas(AlertProcessor(keep_ms), OUT + ", late boolean", "append", "ProcessingTime" if keep_ms else "none")
