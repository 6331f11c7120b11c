"""Compute an intermediate result once, and let it go when nothing needs it any more."""

from __future__ import annotations

import weakref
from collections import deque

from pyspark.sql import DataFrame

from fleetgauge.operators.lookup import measured_bytes


class Kept:
    """Results that stay with the executors until ``release``, or until nothing holds this.

    Nothing is written to any folder. The lineage stays: what a lost executor held is
    computed again, and so is all of it after the release.
    """

    #: Results whose holder is gone. They are released at the next safe point: a garbage
    #: collection may come in the middle of a call to Spark.
    _dropped: deque[list[DataFrame]] = deque()

    def __init__(self):
        self._frames: list[DataFrame] = []
        weakref.finalize(self, self._dropped.append, self._frames).atexit = False

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, computed at most once as long as it is kept."""
        release_dropped()
        stored = df.persist()
        self._frames.append(stored)
        return stored

    def settle(self, df: DataFrame) -> tuple[DataFrame, int]:
        """``df``, kept, and its data size, which one job computes and measures."""
        stored = self.keep(df)
        return stored, measured_bytes(stored)

    def release(self) -> None:
        """Let all results go; whoever still uses one computes it anew."""
        _release(self._frames)
        release_dropped()


def _release(frames: list[DataFrame]) -> None:
    while frames:
        frames.pop().unpersist()


def release_dropped() -> None:
    """Let go what was kept for objects that are gone, such as reports that were dropped."""
    while Kept._dropped:
        _release(Kept._dropped.popleft())


def settle(df: DataFrame) -> tuple[DataFrame, int]:
    """Keep ``df`` with the executors, and measure its data size by one job.

    It stays until the caller's ``unpersist``.
    """
    stored = df.persist()
    return stored, measured_bytes(stored)
