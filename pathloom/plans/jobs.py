"""Counts in the background, with a state, progress and a way to cancel."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame

PENDING, RUNNING, COMPLETE, CANCELLED, FAILED = "pending", "running", "complete", "cancelled", "failed"
_PERMITS = threading.BoundedSemaphore(2)


class CountJob:
    """An exact count of a frame; Spark's tasks are interrupted by tag when it is cancelled."""

    def __init__(self, rows: DataFrame):
        if not _PERMITS.acquire(blocking=False):
            raise RuntimeError("too many counts at once")
        self.state, self.count, self.error = PENDING, None, None
        self._rows, self._spark, self._stop = rows, rows.sparkSession, False
        self._tag = f"count-{uuid.uuid4().hex}"
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        try:
            self._spark.addTag(self._tag)
            self.state = RUNNING
            n = self._rows.count()
            self.state, self.count = (CANCELLED, None) if self._stop else (COMPLETE, n)
        except Exception as e:
            self.state, self.error = (CANCELLED, None) if self._stop else (FAILED, str(e)[:256])
        finally:
            _PERMITS.release()

    def progress(self) -> float:
        """The share of the tasks known so far that are done."""
        tracker = self._spark.sparkContext.statusTracker()
        stages = [s for k in tracker.getActiveStageIds() if (s := tracker.getStageInfo(k))]
        total = sum(s.numTasks for s in stages)
        return 1.0 if self.state == COMPLETE else sum(s.numCompletedTasks for s in stages) / total if total else 0.0

    def cancel(self) -> None:
        self._stop = True
        self._spark.interruptTag(self._tag)

    def wait(self, seconds: float | None = None) -> int | None:
        self._thread.join(seconds)
        return self.count
