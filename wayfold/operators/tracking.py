"""Tracking of detections over the frames of a pass: Kalman filters and gated assignment.

Passes are spread over tasks; the small state of each is walked in time order by a numpy kernel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wayfold.functions import settings as S
from wayfold.sources.shipping import ship_package

OUT = "pass_id string, t_ns bigint, track bigint, kind string, x double, y double, vx double, vy double, hits int, misses int"
SEEN = np.eye(2, 4)
NOISE = np.eye(2) * S.MEASUREMENT_STD**2


@dataclass
class Track:
    number: int
    kind: str | None
    mean: np.ndarray
    cov: np.ndarray
    t_ns: int
    hits: int = 1
    misses: int = 0

    def predict(self, t_ns: int) -> None:
        """Constant velocity with white acceleration up to ``t_ns``."""
        dt = (t_ns - self.t_ns) / 1e9
        if dt > 0:
            move = np.eye(4) + dt * np.eye(4, k=2)
            push = np.vstack([np.eye(2) * dt * dt / 2, np.eye(2) * dt])
            self.mean, self.cov, self.t_ns = move @ self.mean, move @ self.cov @ move.T + push @ push.T * S.ACCEL_STD**2, t_ns

    def distance(self, z: np.ndarray) -> float:
        r = z - self.mean[:2]
        return float(r @ np.linalg.solve(self.cov[:2, :2] + NOISE, r))

    def correct(self, z: np.ndarray) -> None:
        gain = self.cov @ SEEN.T @ np.linalg.inv(self.cov[:2, :2] + NOISE)
        self.mean = self.mean + gain @ (z - self.mean[:2])
        self.cov = (np.eye(4) - gain @ SEEN) @ self.cov
        self.hits, self.misses = self.hits + 1, 0


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of least total cost, by shortest augmenting paths with potentials."""
    if cost.size == 0:
        return []
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        reach, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, at, low = i, -1, 0.0
        while True:
            way = low + c[row] - u[row] - v
            closer = ~done & (way < reach)
            reach[closer], back[closer] = way[closer], at
            free = np.where(done, np.inf, reach)
            at = int(free.argmin())
            low, done[at] = free[at], True
            if owner[at] < 0:
                break
            row = owner[at]
        for j in np.flatnonzero(done):
            if j != at:
                u[owner[j]] += low - reach[j]
            v[j] -= low - reach[j]
        u[i] += low
        while at >= 0:
            owner[at] = i if back[at] < 0 else owner[back[at]]
            at = back[at]
    return sorted((int(j), int(owner[j])) if flip else (int(owner[j]), int(j)) for j in range(m) if owner[j] >= 0)


@dataclass
class Tracks:
    """The tracks of one pass."""

    live: list[Track] = field(default_factory=list)
    given: int = 0

    def _match(self, tracks: list[Track], found: list[int], zs: np.ndarray, gate: float) -> tuple[list[Track], list[int]]:
        cost = np.array([[t.distance(zs[j]) for j in found] for t in tracks]) if tracks and found else np.zeros((0, 0))
        pairs = [(i, j) for i, j in assign(cost) if cost[i, j] <= gate]
        for i, j in pairs:
            tracks[i].correct(zs[found[j]])
        mine, theirs = {i for i, _ in pairs}, {j for _, j in pairs}
        return [t for i, t in enumerate(tracks) if i not in mine], [d for j, d in enumerate(found) if j not in theirs]

    def step(self, t_ns: int, zs: np.ndarray, scores: np.ndarray, kinds: list) -> None:
        """One frame: confident detections first, then weak ones for the tracks left, then confident ones
        left under a wider gate; what is left of these starts tracks; tracks missed too long end."""
        for t in self.live:
            t.predict(t_ns)
        strong, weak = (list(np.flatnonzero(m)) for m in (scores >= S.HIGH_SCORE, (scores >= S.LOW_SCORE) & (scores < S.HIGH_SCORE)))
        rest, strong = self._match(self.live, strong, zs, S.GATE)
        rest, _ = self._match(rest, weak, zs, S.GATE)
        rest, strong = self._match(rest, strong, zs, S.RECOVER_GATE)
        for t in rest:
            t.misses += 1
        for j in strong:
            cov = np.diag([S.MEASUREMENT_STD**2] * 2 + [S.START_VELOCITY_VAR] * 2)
            self.live.append(Track(self.given, kinds[j], np.array([*zs[j], 0.0, 0.0]), cov, t_ns))
            self.given += 1
        self.live = [t for t in self.live if t.misses <= S.MAX_AGE]


def track(detections: DataFrame) -> DataFrame:
    """``pass_id, t_ns, track, kind, x, y, vx, vy, hits, misses`` of the confirmed tracks after every frame.

    ``detections`` has ``pass_id, t_ns, x, y, score, kind``; rows with a null or non-finite place are passed over.
    Rows are sorted by pass and time and walked in batches: only the live tracks of one pass are held.
    """
    ship_package(detections.sparkSession)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, t_ns, state, frame = None, None, Tracks(), []

        def close() -> list[tuple]:
            if not frame:
                return []
            zs = np.array([[r.x, r.y] for r in frame])
            state.step(int(t_ns), zs, np.array([r.score for r in frame]), [r.kind for r in frame])
            return [(key, int(t_ns), t.number, t.kind, *map(float, t.mean), t.hits, t.misses) for t in state.live if t.hits >= S.MIN_HITS]

        names = [c.split()[0] for c in OUT.split(", ")]
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.pass_id, r.t_ns) != (key, t_ns):
                    out += close()
                    frame = []
                    if r.pass_id != key:
                        state = Tracks()
                    key, t_ns = r.pass_id, r.t_ns
                frame.append(r)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(close(), columns=names)

    laid = detections.filter("abs(x) < 1e9D AND abs(y) < 1e9D AND t_ns IS NOT NULL AND score IS NOT NULL").select("pass_id", "t_ns", "x", "y", "score", "kind")
    return laid.repartition("pass_id").sortWithinPartitions("pass_id", "t_ns", "x", "y").mapInPandas(walk, OUT)
