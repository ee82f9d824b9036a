import time

from pyspark.sql import Row

from foliant.operators.issues import results
from foliant.streaming.finisher import MESSAGE, write_results
from foliant.streaming.progress import Progress


def message(issue, state, seq, page=None, count=None, kind=0):
    return ("j", issue, state, count, seq, None if page is None else f"{issue}_{page}", page, None if page is None else kind, "t", "a", f"r{page}", "c")


ROUNDS = [
    [message("a", "start", 0), message("a", "continue", 1, 0, kind=1), message("a", "continue", 2, 1, kind=2), message("b", "continue", 3, 0), message("c", "continue", 4, 0, kind=1), message("c", "odd", 5)],
    [message("a", "finish", 10, count=2), message("b", "finish", 11, count=9), message("c", "close", 12)],
    [message("a", "continue", 20, 7), message("c", "continue", 21, 7)],
]


def run(spark, tmp_path, name, start):
    where = str(tmp_path / name)
    for k, rows in enumerate(ROUNDS):
        spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").json(f"{where}/in")
    query = start(spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).json(f"{where}/in"), where)
    try:
        end = time.time() + 60
        while time.time() < end and len(list((tmp_path / name).rglob("in/part-*"))) and not done(tmp_path / name):
            time.sleep(0.5)
        time.sleep(2)
    finally:
        query.stop()
    return where


def done(where):
    # four pages: two of a, one of b, one of c
    import pyarrow.parquet as pq

    files = [f for f in where.rglob("*.parquet") if "pages" in str(f) and "_temporary" not in str(f)]
    try:
        return sum(pq.read_metadata(f).num_rows for f in files) >= 4
    except Exception:  # a file that is being written
        return False


def test_issues_close_once_for_each_reason(spark, tmp_path):
    start = lambda stream, where: write_results(stream, f"{where}/out", f"{where}/cp", latency=2.0, processingTime="500 milliseconds")
    where = run(spark, tmp_path, "s", start)
    pages = spark.read.parquet(f"{where}/out/pages")
    got = sorted((r.issue_id, r.reason, r.page_number) for r in pages.collect())
    assert got == [("a", "count", 0), ("a", "count", 1), ("b", "timeout", 0), ("c", "close", 0)]
    streamed = {r.issue_id: r.articles for r in spark.read.parquet(f"{where}/out/results").collect()}
    batch = {r.issue_id: r.articles for r in results(pages.drop("reason", "epoch")).collect()}
    assert streamed == batch and [a.refs for a in streamed["a"]] == ["r1"]
    unused = sorted((r.issue_id, r.reason, r.page_number) for r in spark.read.parquet(f"{where}/out/unused").collect())
    assert unused == [("a", "late", 7), ("c", "late", 7), ("c", "unknown", None)]


def start_once(stream, where, latency):
    return write_results(stream, f"{where}/out", f"{where}/cp", latency, availableNow=True)


def test_a_session_goes_on_after_a_restart(spark, tmp_path):
    """Each round is a start of its own from the same checkpoint: pages, timers and closed issues are remembered."""
    progress = Progress.of(spark)
    where = str(tmp_path)
    rounds = [
        [message("a", "continue", 0, 0, kind=1), message("b", "continue", 1, 5), message("b", "continue", 2, 5, kind=2)],  # a page that comes again counts once
        [message("a", "continue", 3, 1), message("b", "finish", 4, count=3), message("a", "finish", 5, count=2)],
        [message("a", "continue", 6, 2), message("b", "continue", 7, 1)],
        [message("b", "tick", 8)],
    ]
    try:
        for k, rows in enumerate(rounds):
            if k == 3:
                time.sleep(3.2)
            spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").json(f"{where}/in")
            spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
            query = start_once(spark.readStream.schema(MESSAGE).json(f"{where}/in"), where, 3.0)
            assert query.awaitTermination(120)
            progress.wait(query)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
        spark.streams.removeListener(progress)
    pages = sorted((r.issue_id, r.reason, r.page_number, r.page_type) for r in spark.read.parquet(f"{where}/out/pages").collect())
    assert pages == [("a", "count", 0, 1), ("a", "count", 1, 0), ("b", "timeout", 1, 0), ("b", "timeout", 5, 2)]
    got = progress.totals()
    assert (got["issues.n_issues"], got["issues.n_pages"], got["issues.n_unused"], got["batches"]) == (2, 4, 1, 4)
    assert got["seconds"] > 3 and not progress.failed


class Kept:
    """A state variable in memory, which counts the calls of all."""

    calls = 0

    def __init__(self):
        self.value = None

    def _call(self, value=None, put=False):
        Kept.calls += 1
        self.value = value if put else self.value
        return self.value

    get = exists = _call
    update = lambda self, value: self._call(value, True)
    clear = lambda self: self._call(None, True)
    appendValue = lambda self, value: self._call([*(self.value or []), value], True)


class Handle:
    getValueState = getListState = lambda self, *a, **k: Kept()
    registerTimer = deleteTimer = lambda self, at: None
    listTimers = lambda self: []


def test_calls_of_the_state_store_do_not_grow_with_pages():
    import json

    from foliant.streaming.finisher import IssueSession

    session, key = IssueSession(60.0, True), ("j", "a")
    session.init(Handle())
    names = [c.split()[0] for c in MESSAGE.split(", ")]
    row = lambda *a, **k: Row(message=json.dumps({c: v for c, v in zip(names, message(*a, **k), strict=True) if v is not None and c not in ("journal_id", "issue_id")}))
    Kept.calls = 0
    assert not list(session.handleInputRows(key, iter([row("a", "continue", 1000 - i, i) for i in range(999)]), None))
    assert Kept.calls <= 5
    for i in range(3000):  # a page that comes again and again takes no more room than the others do
        assert not list(session.handleInputRows(key, iter([row("a", "continue", 2000 + i, 5, kind=i % 4)]), None))
    assert sum(len(some[0]) for some in session.pages.value) <= 2 * 999
    got = list(session.handleInputRows(key, iter([row("a", "continue", 9001, 999), row("a", "finish", 9000, count=1000), row("a", "odd", 9002)]), None))
    assert [r.page_number for r in got] == [*range(1000), None] and [r.reason for r in got] == ["count"] * 1000 + ["late"]
    assert got[5].page_type == 2999 % 4 and [r.first for r in got[:3]] == [True, False, False]


def test_sessions_run_once_though_cached_rows_are_lost(spark, tmp_path, monkeypatch):
    """An executor that goes takes what it has cached along; sessions that run again for it count their issues again."""
    from foliant.streaming import finisher

    def after_loss(pages):
        spark.catalog.clearCache()
        return results(pages)

    monkeypatch.setattr(finisher, "results", after_loss)
    progress = Progress.of(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        rows = [message("a", "continue", 0, 0, kind=1), message("a", "continue", 1, 1), message("a", "finish", 2, count=2), message("a", "odd", 3)]
        spark.createDataFrame(rows, MESSAGE).coalesce(1).write.json(f"{tmp_path}/in")
        query = start_once(spark.readStream.schema(MESSAGE).json(f"{tmp_path}/in"), str(tmp_path), 60.0)
        assert query.awaitTermination(60)
        progress.wait(query)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
        spark.streams.removeListener(progress)
    assert {r.issue_id: len(r.articles) for r in spark.read.parquet(f"{tmp_path}/out/results").collect()} == {"a": 1}
    got = progress.totals()
    assert (got["issues.n_issues"], got["issues.n_pages"], got["issues.n_unused"]) == (1, 2, 1)
