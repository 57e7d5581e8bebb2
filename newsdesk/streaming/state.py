"""Streaming twins of the folds: stage status, provider health, crawl jobs, research and visit sessions.

Each keyed fold waits for the watermark: an event is applied when the watermark has passed its time, in the order of
time and event_id, whatever batch it came in. So the rows are those of the batch fold over the events that were not too late
(an event behind the watermark when it comes is dropped, as Spark's own windows do). A timer in event time wakes
a key when its next events are due and once more ``idle`` after its last one, when the state goes: an event that comes
later than that after the one before starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Calls and events that are looked back on.
WINDOW, EVENTS = 20, 40
KINDS = {"long": int, "boolean": bool, "string": str}


class _InOrder(StatefulProcessor):
    """Holds a key's events back until the watermark has passed them. Subclasses keep what has been folded in value and list
    states of their own and say in ``fold`` what the next events make of it."""

    #: Columns of the events that are kept until they are due, beside ts and event_id.
    kept: tuple[tuple[str, str], ...] = ()

    def __init__(self, idle: str):
        self.idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(["us long", "event_id long", *[f"{c} {kind}" for c, kind in self.kept]]))
        self.last = handle.getValueState("last", "ms long")
        self.folded = handle.getValueState("folded", "us long")
        self.opened(handle)

    def opened(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def fold(self, key: Any, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        """What ``rows`` (us, event_id and the kept columns, in order) make of the state."""
        raise NotImplementedError

    def closed(self) -> None:
        """The key was idle: all its states go."""
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark, late, last = timerValues.getCurrentWatermarkInMs(), 0, 0
        came = []
        for part in rows:
            us = (part["ts"] - pd.Timestamp(0, tz=part["ts"].dt.tz)) // pd.Timedelta(microseconds=1)
            for at, row in zip(us.tolist(), part.itertuples(index=False), strict=True):
                last = max(last, at // 1000)
                # Missing values come as NaN, and whole numbers beside them as floats.
                values = [None if pd.isna(v := getattr(row, c)) else KINDS[kind](v) for c, kind in self.kept]
                came.append((at, int(row.event_id), *values))
        if came:
            self.waiting.appendList(came)
            self.last.update((max(last, self.last.get()[0] if self.last.exists() else 0),))
        yield from self._due(key, mark)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._due(key, timerValues.getCurrentWatermarkInMs())

    def _due(self, key: Any, mark: int) -> Iterator[pd.DataFrame]:
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] <= 1000 * mark]
        left = rows[len(due) :]
        at = 0
        for k, row in enumerate(due):
            # An event that comes after the idle time finds no state, whether its timer has run or not.
            before = due[k - 1][0] if k else self.folded.get()[0] if self.folded.exists() else row[0]
            if row[0] - before > 1000 * self.idle_ms:
                if k > at:
                    yield from self.fold(key, due[at:k])
                self.closed()
                at = k
        if due:
            yield from self.fold(key, due[at:])
            self.folded.update((due[-1][0],))
        if due and left:
            self.waiting.put(left)
        elif due:
            self.waiting.clear()
        end = (self.last.get()[0] if self.last.exists() else 0) + self.idle_ms
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(timer[0] if isinstance(timer, tuple) else timer))
        if left:
            self.handle.registerTimer(max(mark + 1, -(-left[0][0] // 1000)))
        elif end > mark:
            self.handle.registerTimer(end)
        else:
            self.waiting.clear()
            self.last.clear()
            self.folded.clear()
            self.closed()


def _folded(events: DataFrame, key: list[str], fold: _InOrder, out: str, late: str) -> DataFrame:
    kept = [c for c, _ in fold.kept]
    wanted = events.select(*key, "ts", "event_id", *kept).withWatermark("ts", late)
    return wanted.groupBy(*key).transformWithStateInPandas(fold, out, "update", "eventTime")


class _StageStatus(_InOrder):
    kept = (("status", "string"), ("error", "string"))

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.attempts = handle.getValueState("attempts", "attempts int")

    def fold(self, key: Any, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        attempts = self.attempts.get()[0] if self.attempts.exists() else 0
        for _, _, status, _ in rows:
            attempts = 0 if status in ("done", "skipped") else attempts + (status == "failed")
        us, number, status, error = rows[-1]
        self.attempts.update((attempts,))
        failed = status == "failed"
        ts = pd.Timestamp(us, unit="us")
        retry = ts + pd.Timedelta(minutes=min(10 * attempts, 360)) if failed else pd.NaT
        yield pd.DataFrame({
            "article_id": [key[0]], "stage": [key[1]], "event_id": [number], "ts": [ts], "status": [status], "attempts": pd.array([attempts], "int32"),
            "last_error": [error[:500] if failed and error is not None else None], "next_retry_at": [retry],
        })

    def closed(self) -> None:
        self.attempts.clear()


def stage_status(events: DataFrame, late: str = "10 minutes", idle: str = "30 days") -> DataFrame:
    """M1 on a stream of (article_id, stage, status, error, ts, event_id): the status that the events due leave each
    key they touch, as operators.stages.current gives it. An article that has no event for ``idle`` starts anew: by
    then the longest wait before a retry (six hours) is over many times."""
    out = "article_id long, stage string, event_id long, ts timestamp, status string, attempts int, last_error string, next_retry_at timestamp"
    return _folded(events, ["article_id", "stage"], _StageStatus(idle), out, late)


class _ProviderHealth(_InOrder):
    kept = (("state", "string"), ("error", "string"))

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "failures int, error string, success long")
        self.recent = handle.getListState("recent", "ok boolean")

    def fold(self, key: Any, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        failures, error, success = self.now.get() if self.now.exists() else (0, None, None)
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        for us, _, state, told in rows:
            ok = state in ("ok", "slow")
            recent.append(ok)
            failures = 0 if ok else failures + 1
            success = us if ok else success
            # An ok clears the error, a slow one keeps it.
            error = None if state == "ok" else error if ok else (state if told is None else told)
        recent = recent[-WINDOW:]
        self.now.update((failures, error, success))
        self.recent.put([(x,) for x in recent])
        us, number, state, _ = rows[-1]
        yield pd.DataFrame({
            "provider": [key[0]], "event_id": [number], "state": [state], "consecutive_failures": pd.array([failures], "int32"), "last_error": [error],
            "last_success_at": [pd.NaT if success is None else pd.Timestamp(success, unit="us")], "success_rate": [float(int(100 * sum(recent) / len(recent) + 0.5) / 100)],
        })

    def closed(self) -> None:
        self.now.clear()
        self.recent.clear()


def provider_health(calls: DataFrame, late: str = "10 minutes", idle: str = "30 days") -> DataFrame:
    """M2 on a stream of (provider, state, error, ts, event_id): what the calls due leave each provider they touch, as
    operators.health.snapshot gives it: state, failures in a row, last error and success, rate of the last 20."""
    out = "provider string, event_id long, state string, consecutive_failures int, last_error string, last_success_at timestamp, success_rate double"
    return _folded(calls, ["provider"], _ProviderHealth(idle), out, late)


class _Job(_InOrder):
    kept = (("kind", "string"), ("n", "long"), ("ok", "boolean"), ("worker", "string"), ("note", "string"))

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "candidates long, claimed int, succeeded int, failed int, status string")
        self.workers = handle.getMapState("workers", "worker string", "state string, us long")
        self.events = handle.getListState("events", "event_id long, kind string, note string")

    def fold(self, key: Any, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        candidates, claimed, succeeded, failed, status = self.counts.get() if self.counts.exists() else (0, 0, 0, 0, "running")
        events = [tuple(r) for r in self.events.get()] if self.events.exists() else []
        for us, number, kind, n, ok, worker, note in rows:
            if kind == "candidates":
                candidates = n or 0
            claimed += kind == "started"
            succeeded += kind == "finished" and ok is True
            failed += kind == "finished" and ok is False
            status = {"complete": "succeeded", "fail": "failed"}.get(kind, status)
            if worker is not None:
                self.workers.updateValue((worker,), ("working" if kind == "started" else "idle", us))
            events.append((number, kind, note))
        events = events[-EVENTS:]
        self.counts.update((candidates, claimed, succeeded, failed, status))
        self.events.put(events)
        workers = {k[0]: v[0] for k, v in self.workers.iterator()}
        yield pd.DataFrame({
            "job": [key[0]], "event_id": [rows[-1][1]], "candidates": pd.array([candidates], "int32"), "claimed": pd.array([claimed], "int32"), "completed": pd.array([succeeded + failed], "int32"),
            "succeeded": pd.array([succeeded], "int32"), "failed": pd.array([failed], "int32"), "status": [status],
            "workers": [[f"{w}={workers[w]}" for w in sorted(workers)]], "events": [[e[0] for e in events]],
        })

    def closed(self) -> None:
        self.counts.clear()
        self.workers.clear()
        self.events.clear()


def job_progress(events: DataFrame, late: str = "1 minute", idle: str = "1 day") -> DataFrame:
    """M3 on a stream of (job, event_id, ts, kind, n, ok, worker, note): counters and status as
    operators.crawl.job_progress gives them, each worker's state as ``worker=state``, and the ids of the last 40 events. A worker
    works from its ``started`` to its next event. The state holds one row a worker and 40 events."""
    out = "job string, event_id long, candidates int, claimed int, completed int, succeeded int, failed int, status string, workers array<string>, events array<long>"
    return _folded(events, ["job"], _Job(idle), out, late)


class _Session(_InOrder):
    kept = (("kind", "string"), ("url", "string"))

    def __init__(self, idle: str, max_searches: int, max_pages: int, max_ms: int):
        super().__init__(idle)
        self.limits = (max_searches, max_pages, max_ms)

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "start long, searches int, pages int")
        self.urls = handle.getMapState("urls", "url string", "us long")

    def fold(self, key: Any, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        max_searches, max_pages, max_ms = self.limits
        start, searches, pages = self.used.get() if self.used.exists() else (rows[0][0] // 1000, 0, 0)
        out = []
        for us, number, kind, url in rows:
            if us // 1000 - start >= max_ms:
                verdict = "time"
            elif kind == "search":
                verdict = "searches" if searches >= max_searches else "ok"
                searches += verdict == "ok"
            elif url is not None and self.urls.containsKey((url,)):
                verdict = "duplicate"
            else:
                verdict = "pages" if pages >= max_pages else "ok"
                pages += verdict == "ok"
                if verdict == "ok" and url is not None:
                    self.urls.updateValue((url,), (us,))
            out.append((key[0], number, verdict))
        self.used.update((start, searches, pages))
        yield pd.DataFrame(out, columns=["session", "event_id", "verdict"])

    def closed(self) -> None:
        self.used.clear()
        self.urls.clear()


def research_session(events: DataFrame, max_searches: int = 10, max_pages: int = 20, max_ms: int = 300_000, late: str = "1 minute", idle: str = "1 day") -> DataFrame:
    """M4 on a stream of (session, event_id, ts, kind, url): for each search or page that is asked for
    whether it is allowed: ok, duplicate (the page was fetched before), or the budget that is used up
    (time since the session's first event, then the number of searches or pages). Refused ones use
    nothing up. The state holds a session's fetched urls, of which there are at most ``max_pages``."""
    out = "session string, event_id long, verdict string"
    return _folded(events, ["session"], _Session(idle, max_searches, max_pages, max_ms), out, late)


def views_by_window(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """M8, our addition: counts of events by type in tumbling windows; what comes later than ``late`` is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """M8, our addition: sessions that end after ``gap`` without an event."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "n")
