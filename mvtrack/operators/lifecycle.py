"""The life of a track over frames of hits and misses, as a fold inside each track's group."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

# Fixed values.
CONFIRM, DAMPING, NEW_MISSES, OLD_MISSES, DELTAS = 5, 0.8, 2, 7, 5


@dataclass
class Life:
    """A track's state; velocity is the mean of its last steps from sighting to sighting."""

    state: str = "probationary"
    hits: int = 0
    misses: int = 0
    last: tuple[float, float] | None = None
    ahead: tuple[float, float] | None = None
    steps: deque = field(default_factory=lambda: deque(maxlen=DELTAS))

    def hit(self, u: float, v: float) -> None:
        if self.last is not None:
            self.steps.append((u - self.last[0], v - self.last[1]))
        self.last, self.ahead, self.hits, self.misses = (u, v), None, self.hits + 1, 0
        if self.state == "coasting" or self.hits >= CONFIRM:
            self.state = "confirmed"

    def miss(self) -> None:
        """A confirmed track goes on by its damped velocity, the same each frame; a new one stays where it is."""
        self.hits, self.misses = 0, self.misses + 1
        new = self.state == "probationary"
        if not new:
            self.state = "coasting"
            n = max(1, len(self.steps))
            at = self.ahead or self.last
            self.ahead = tuple(at[i] + DAMPING * sum(s[i] for s in self.steps) / n for i in range(2))
        if self.misses > (NEW_MISSES if new else OLD_MISSES):
            self.state = "dead"


def lives(obs: DataFrame) -> DataFrame:
    """(camera_id, track_id, frame_idx, state, u, v) for each frame from a track's first to its last or its death.

    A frame without a detected row is a miss.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        hits = {int(f): (u, v) for f, u, v, s in zip(part["frame_idx"], part["u"], part["v"], part["status"], strict=True) if s == "detected"}
        life, rows = Life(), []
        for f in range(int(part["frame_idx"].min()), int(part["frame_idx"].max()) + 1):
            if f in hits:
                life.hit(*hits[f])
            else:
                life.miss()
            rows.append((f, life.state, *(life.ahead or life.last or (None, None))))
            if life.state == "dead":
                break
        out = pd.DataFrame(rows, columns=["frame_idx", "state", "u", "v"])
        return out.assign(camera_id=part["camera_id"].iloc[0], track_id=part["track_id"].iloc[0])[["camera_id", "track_id", "frame_idx", "state", "u", "v"]]

    return obs.groupBy("camera_id", "track_id").applyInPandas(run, "camera_id string, track_id long, frame_idx long, state string, u double, v double")
