"""Roll-up of issues whose pages come as a stream of messages.

A message has journal_id, issue_id, state and, by state, a page: "start" opens an issue; "continue" brings a page; "finish" tells
how many pages to expect; "close" ends it at once. An issue is closed when it has as many pages as expected, or some time
after its finish message, or on close, and gives all its pages then, once. What comes later for it is dropped. There is no
limit to the issues that are open at a time: each is state of its own.

A batch appends the pages it brings to the issue's list, as one entry, and rewrites its head, which has the numbers of its pages: so
a batch asks the state store for a few things of each issue, not of each page. A page that comes again is kept again until
the list holds twice as many as there are numbers. A timer ends an issue after its finish message, and that an issue was closed is
forgotten after REMEMBER seconds by the state's time to live. State is kept by RocksDB, which the session is set to.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from foliant.operators.issues import results

#: States of messages; "tick" does nothing but wake an issue up.
STATES = ("start", "continue", "finish", "close", "tick")
#: Reasons of messages that closed_pages() reports beside the pages.
UNUSED = ("late", "unknown")
#: Seconds after a finish message that pages may still come.
CLOSE_LATENCY = 25.0
#: Seconds that a closed issue is remembered, to drop what comes late.
REMEMBER = 24 * 3600.0

PAGE = ["page_id", "page_number", "page_type", "title", "authors", "refs", "toc"]
MESSAGE = "journal_id string, issue_id string, state string, page_count int, seq bigint, page_id string, page_number int, page_type int, title string, authors string, refs string, toc string"
OUTPUT = "journal_id string, issue_id string, reason string, page_id string, page_number int, page_type int, title string, authors string, refs string, toc string"
#: State of an open issue beside its pages: numbers of the pages it has, entries that are kept of them, pages it is to have, and
#: when its finish message came (0: not yet).
HEAD = "numbers array<int>, kept int, target int, finish double"
#: Pages that one batch brought, a list of each column.
TEXTS = ["title", "authors", "refs", "toc"]
BROUGHT = "page_number array<int>, page_id array<string>, page_type array<int>, " + ", ".join(f"{c} array<string>" for c in TEXTS)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Columns of a message beside its issue, and rows that sessions give.
COLUMNS = [c.split()[0] for c in MESSAGE.split(", ")][2:]
CLOSED = Row(*[c.split()[0] for c in OUTPUT.split(", ")], "first")
#: Messages of an issue that are put in order at a time.
ORDERED = 10000


def _place(message: dict) -> tuple:
    """Where a message stands in its issue; without a seq, last."""
    return "seq" not in message, message.get("seq", 0)


class IssueSession(StatefulProcessor):
    """One issue: its head, its pages as batches brought them, and whether it has been closed."""

    def __init__(self, latency: float, report: bool):
        self.latency, self.report = latency, report

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.pages = handle.getListState("brought", BROUGHT)
        self.closed = handle.getValueState("closed", "reason string", ttlDurationMs=int(REMEMBER * 1000))

    def _kept(self) -> dict[int, tuple]:
        """Pages by number, of one that came again the last."""
        return {page[0]: page for some in self.pages.get() for page in zip(*some, strict=True)}

    def _close(self, key: tuple, reason: str, pages: dict[int, tuple], timed: bool) -> Iterator[Row]:
        self.pages.clear()
        self.head.clear()
        self.closed.update((reason,))
        for at in list(self.handle.listTimers()) if timed else ():
            self.handle.deleteTimer(at)
        for i, (number, page_id, *rest) in enumerate(pages[k] for k in sorted(pages)):
            yield CLOSED(*key, reason, page_id, number, *rest, i == 0)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        done = self.closed.get() is not None
        numbers, kept, target, finish = (None if done else self.head.get()) or ([], 0, -1, 0.0)
        had, timed, again, reason, brought = set(numbers), bool(finish), False, None, {}
        n, unused = len(had), []
        while some := list(islice(rows, ORDERED)):
            for m in sorted((json.loads(row.message) for row in some), key=_place):
                state, page_count, page_number = m.get("state"), m.get("page_count"), m.get("page_number")
                page = (page_number, m.get("page_id"), m.get("page_type"), *(m.get(c) for c in TEXTS))
                if done or reason:
                    unused += [("late", page)] if state != "tick" else []
                    continue
                if state == "continue" and page_number is not None:
                    n += page_number not in had and page_number not in brought
                    brought[page_number] = page
                elif state == "finish":
                    target, finish, again = -1 if page_count is None else page_count, time.time(), True
                elif state == "close":
                    reason = "close"
                elif state not in STATES:
                    unused.append(("unknown", page))
                if n == target:
                    reason = "count"
        if not done and not reason and finish and time.time() > finish + self.latency:
            reason = "timeout"
        if reason:
            yield from self._close(key, reason, (self._kept() if kept else {}) | brought, timed)
        elif not done:
            if brought:
                if kept + len(brought) > 2 * n:
                    brought = self._kept() | brought
                    self.pages.clear()
                    kept = 0
                self.pages.appendValue(tuple(map(list, zip(*brought.values(), strict=True))))
                kept += len(brought)
            self.head.update((sorted(had.union(brought)), kept, target, finish))
            if again:
                self.handle.registerTimer(int((finish + self.latency) * 1000))
        if self.report:
            for why, (number, page_id, *rest) in unused:
                yield CLOSED(*key, why, page_id, number, *rest, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        # a second finish message sets a later time; only the last one's timer ends the issue
        head = self.head.get()
        if head is not None and time.time() >= head[3] + self.latency:
            yield from self._close(key, "timeout", self._kept() if head[1] else {}, True)

    def close(self) -> None:
        pass


def closed(messages: DataFrame, latency: float = CLOSE_LATENCY, report: bool = False) -> DataFrame:
    """closed_pages() with first, true for one page of each issue that closes."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # a message is one text, since Spark turns rows into Python's cell by cell, which costs more than reading JSON
    packed = messages.select("journal_id", "issue_id", F.to_json(F.struct(*COLUMNS)).alias("message"))
    return packed.groupBy("journal_id", "issue_id").transformWithState(IssueSession(latency, report), f"{OUTPUT}, first boolean", "append", "processingTime")


def closed_pages(messages: DataFrame, latency: float = CLOSE_LATENCY, report: bool = False) -> DataFrame:
    """A stream of the pages of issues as they close, from a stream of MESSAGE rows. An issue's pages come in one batch.

    With report, messages that come late or have an unknown state come out too, with that as their reason.
    """
    return closed(messages, latency, report).drop("first")


def write_results(messages: DataFrame, path: str, checkpoint: str, latency: float = CLOSE_LATENCY, **trigger):
    """Start a query that appends each closed issue's result and its pages below path, with the batch roll-up's own code.

    Messages that come late or have an unknown state are written below path/unused. Progress counts issues, as `issues`.
    What the last batch closed lies in path/_closed, which readers of folders pass over.
    """

    def write(rows: DataFrame, epoch: int) -> None:
        # on disk, not cached: cached rows that an executor loses would have the sessions run again, and their issues counted again
        rows.write.mode("overwrite").parquet(f"{path}/_closed")
        rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/_closed")
        rows.where(F.col("reason").isin(*UNUSED)).write.mode("overwrite").parquet(f"{path}/unused/epoch={epoch}")
        pages = rows.where(~F.col("reason").isin(*UNUSED))
        pages.write.mode("overwrite").parquet(f"{path}/pages/epoch={epoch}")
        results(pages.drop("reason")).write.mode("overwrite").parquet(f"{path}/results/epoch={epoch}")

    used = ~F.col("reason").isin(*UNUSED)
    # an issue without any page gives no row and is not counted
    counted = closed(messages, latency, True).observe("issues", F.count_if(used).alias("n_pages"), F.count_if(used & F.col("first")).alias("n_issues"), F.count_if(~used).alias("n_unused"))
    return counted.drop("first").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "1 second"}).start()
