"""Queries that run beside the caller, with cancellation, and hooks around actions."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("tidewater")


class Background:
    """Runs actions in threads over one shared session; at most ``most`` at once."""

    def __init__(self, spark: SparkSession, most: int = 8):
        self.spark, self._pool = spark, ThreadPoolExecutor(most, thread_name_prefix="tidewater")

    def submit(self, action: Callable[..., Any], *args: Any) -> "Running":
        """Start an action, such as ``query.all().collect`` or ``mapper.create``."""
        tag = f"tidewater-{uuid.uuid4().hex}"

        def run() -> Any:
            context = self.spark.sparkContext
            context.addJobTag(tag)
            context.setInterruptOnCancel(True)
            try:
                return action(*args)
            finally:
                context.removeJobTag(tag)

        return Running(self.spark, tag, self._pool.submit(run))

    def rows(self, frame: DataFrame) -> "Running":
        return self.submit(frame.collect)

    def close(self) -> None:
        self._pool.shutdown(wait=True)

    def __enter__(self) -> "Background":
        return self

    def __exit__(self, *error: Any) -> None:
        self.close()


class Running:
    """An action in progress."""

    def __init__(self, spark: SparkSession, tag: str, future: Future):
        self._spark, self._tag, self.future = spark, tag, future

    def result(self, timeout: float | None = None) -> Any:
        return self.future.result(timeout)

    def cancel(self) -> None:
        """Stop it: before its start, or by interrupting its Spark jobs."""
        if not self.future.cancel():
            self._spark.sparkContext.cancelJobsWithTag(self._tag)


def log_actions(event: str, name: str, seconds: float) -> None:
    """A hook for ``Engine.hook``: logs what the engine itself runs."""
    if event == "begin":
        log.info("%s begins", name)
    else:
        log.log(logging.INFO if event == "end" else logging.ERROR, "%s %s after %.3f s", name, "took its course" if event == "end" else "failed", seconds)


@contextmanager
def logged(name: str, frame: DataFrame | None = None, level: int = logging.INFO):
    """Log an action's begin, plan (at debug) and time."""
    log.log(level, "%s begins", name)
    if frame is not None and log.isEnabledFor(logging.DEBUG):
        log.debug("%s", frame._jdf.queryExecution().simpleString())
    began = time.perf_counter()
    try:
        yield
    except Exception:
        log.exception("%s failed", name)
        raise
    log.log(level, "%s took %.3f s", name, time.perf_counter() - began)
