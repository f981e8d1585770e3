"""What a pass tells while it runs and when it is done: tasks done of all, warnings, a report."""

from __future__ import annotations

import contextlib
import json
import logging
import threading
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

log = logging.getLogger("heirloom")

#: Seconds between two looks at what Spark has done.
EVERY = 1.0


def report(step: str, **values) -> dict:
    """Log what a pass did and return it."""
    log.info("[%s] finished %s", step, json.dumps(values, default=str))
    return values


def warn(step: str, n: int, what: str) -> None:
    """Log that ``n`` things, if any, want a person's look."""
    if n:
        log.warning("warning: [%s] %d %s", step, n, what)


def tasks_done(spark: SparkSession) -> tuple[int, int]:
    """Tasks done and tasks in all of the stages that are running now, as Spark's status tracker tells."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s is not None]
    return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)


@contextlib.contextmanager
def watched(spark: SparkSession, step: str, tell: Callable[[str], None] = log.info, every: float = EVERY) -> Iterator[None]:
    """While the block runs, tell ``[step] n/total`` whenever the tasks of the running stages have moved on; one line at its start.

    A thread of the driver looks on; it reads counts that the scheduler has anyway, and no data.
    """
    tell(f"[{step}] started")
    done = threading.Event()

    def look() -> None:
        last = None
        while not done.wait(every):
            now = tasks_done(spark)
            if now[1] and now != last:
                tell(f"[{step}] {now[0]}/{now[1]}")
                last = now

    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
