"""Long work that can be named, watched and stopped."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import Future

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Job:
    """A function run in a thread of its own, its Spark jobs under one group."""

    def __init__(self, spark: SparkSession, name: str, work: Callable):
        self.name, self.group, self._context = name, f"{name}-{uuid.uuid4().hex}", spark.sparkContext
        self._result: Future = Future()
        self._thread = InheritableThread(target=self._run, args=(work,))
        self._thread.start()

    def _run(self, work: Callable) -> None:
        self._context.setJobGroup(self.group, self.name, interruptOnCancel=True)
        try:
            self._result.set_result(work())
        except BaseException as error:  # noqa: BLE001 handed to whoever asks for the result
            self._result.set_exception(error)

    def cancel(self) -> None:
        self._context.cancelJobGroup(self.group)

    def progress(self) -> tuple[int, int]:
        """Tasks done and tasks known so far."""
        tracker, done, known = self._context.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in (tracker.getStageInfo(s) for s in (info.stageIds if info else ())):
                if stage:
                    done, known = done + stage.numCompletedTasks, known + stage.numTasks
        return done, known

    def result(self, timeout: float | None = None):
        return self._result.result(timeout)
