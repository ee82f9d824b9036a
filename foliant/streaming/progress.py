"""Totals over all streams of a session: pages and regions that came, issues and pages that were closed, and the time it took."""

from __future__ import annotations

import threading
import time

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Progress(StreamingQueryListener):
    """Adds up what batches report as they end. Use: progress = Progress.of(spark), then start queries.

    totals() has each observed metric by observation and name ("pages.n", "issues.n_issues"), batches and seconds since the
    first query began. A batch that runs again after a restart counts once, since its number is known.
    """

    def __init__(self):
        self.lock, self.sums, self.last, self.began = threading.Lock(), {}, {}, None
        self.failed: list[str] = []

    @classmethod
    def of(cls, spark: SparkSession) -> Progress:
        made = cls()
        spark.streams.addListener(made)
        return made

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.began = self.began or time.time()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            if p.batchId <= self.last.get(str(p.id), -1):
                return
            self.last[str(p.id)] = p.batchId
            self.sums["batches"] = self.sums.get("batches", 0) + 1
            for name, row in p.observedMetrics.items():
                for metric, value in row.asDict().items():
                    self.sums[f"{name}.{metric}"] = self.sums.get(f"{name}.{metric}", 0) + (value or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            with self.lock:
                self.failed.append(event.exception)

    def uptime(self) -> float:
        return time.time() - self.began if self.began else 0.0

    def wait(self, query: StreamingQuery, seconds: float = 30) -> None:
        """Until the last batch of a query that has ended is counted, since reports come a little later than results."""
        end, last = time.time() + seconds, query.lastProgress
        while last and self.last.get(str(last.id), -1) < last.batchId and time.time() < end:
            time.sleep(0.05)

    def totals(self) -> dict[str, float]:
        with self.lock:
            return self.sums | {"seconds": self.uptime()}
