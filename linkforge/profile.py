"""Wall-clock phases and counters of a run, logged as they end."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("linkforge")


def setup_logging(level: int = logging.INFO) -> None:
    """Log lines with time, level and logger to standard error, once."""
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(handler)
    log.setLevel(level)


class Profile:
    """Seconds per phase (summed where one is entered again) and named counters.

    Spark plans are lazy, so a phase holds the action that runs its plan.
    """

    def __init__(self, clock=time.perf_counter) -> None:
        self._clock = clock
        self.seconds: dict[str, float] = {}
        self.counters: dict[str, int] = {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        start = self._clock()
        try:
            yield
        finally:
            took = self._clock() - start
            self.seconds[name] = self.seconds.get(name, 0.0) + took
            log.info("%s took %.3f s", name, took)

    def count(self, name: str, n: int) -> None:
        self.counters[name] = self.counters.get(name, 0) + n
        log.info("%s: %d", name, self.counters[name])

    def rows(self, spark: SparkSession) -> DataFrame:
        """(kind, name, value) of all phases and counters."""
        own = [("seconds", k, float(v)) for k, v in self.seconds.items()] + [("counter", k, float(v)) for k, v in self.counters.items()]
        return spark.createDataFrame(own, "kind string, name string, value double")
