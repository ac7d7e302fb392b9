"""The crawl's queue as a stateful stream: tasks live in the state of their (source, range), claims and outcomes are events.

A source's tasks are dealt into ranges, so that neither its state nor its work is one task's, however many tasks it has. A claim is for a
range: it leases the best ready tasks there. Leases that run out are timers of event time, so they end when the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TASK = "state string, priority int, retries int, next_fetch_at long, locked_until long, locked_by string, created_at long, finished_at long, note string, last_error string"
#: ``kind`` is ``task`` (a task as it is), ``found``, ``claim`` (``most`` tasks for ``seconds``, by ``worker``) or ``outcome``.
EVENTS = (
    f"source string, part int, ts timestamp, at long, kind string, url_norm string, {TASK}, most int, seconds long, worker string, outcome string, detail string"
)
CHANGES = f"source string, part int, url_norm string, seq long, {TASK}"
_FIELDS = [f.split()[0] for f in TASK.split(", ")]
_ORDER = {"task": 0, "found": 1, "outcome": 2, "claim": 3}


class Rules:
    """Waiting times in seconds, as ``crawl.finish`` has them."""

    def __init__(self, recrawl: int = 86400, base: int = 30, cap: int = 3600, max_retries: int = 5):
        self.recrawl, self.base, self.cap, self.max_retries = recrawl, base, cap, max_retries

    def finished(self, task: dict, outcome: str, detail: str, at: int) -> dict:
        done = task | {"locked_until": 0, "locked_by": "", "finished_at": at}
        if outcome != "error":
            told = {"skipped": f"skipped: {detail}", "not_modified": "304 not modified", "alias": f"alias->canonical {detail}"}
            return done | {"state": "done", "next_fetch_at": at + self.recrawl, "note": told.get(outcome, detail)}
        used_up = task["retries"] + 1 >= self.max_retries
        wait = self.cap if used_up else min(self.cap, self.base * 2 ** max(0, min(40, task["retries"])))
        error = (f"max_retries reached: {detail}" if used_up else detail)[:5000]
        return done | {"state": "error", "next_fetch_at": at + wait, "retries": task["retries"] + 1, "last_error": error}


class Queue(StatefulProcessor):
    """The tasks of a range by URL, and the events that change them; puts out each task as a change leaves it."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tasks = handle.getMapState("tasks", "url_norm string", TASK)
        self.seq = handle.getValueState("seq", "seq long")

    def close(self) -> None:
        return None

    def _put(self, url: str, task: dict) -> None:
        self.tasks.updateValue((url,), tuple(task[f] for f in _FIELDS))
        if task["state"] == "fetching":
            self.handle.registerTimer(task["locked_until"] * 1000)

    def _all(self) -> dict[str, dict]:
        return {key[0]: dict(zip(_FIELDS, value, strict=True)) for key, value in self.tasks.iterator()}

    def _get(self, url: str) -> dict | None:
        return dict(zip(_FIELDS, self.tasks.getValue((url,)), strict=True)) if self.tasks.containsKey((url,)) else None

    def _claimed(self, event: dict) -> list[tuple[str, dict]]:
        at = event["at"]
        ready = [
            (-task["priority"], task["next_fetch_at"], task["created_at"], url, task)
            for url, task in self._all().items()
            if task["state"] in ("queued", "error") and task["next_fetch_at"] <= at and task["locked_until"] <= at
        ]
        lease = {"state": "fetching", "locked_until": at + event["seconds"], "locked_by": event["worker"]}
        return [(url, task | lease) for *_, url, task in sorted(ready, key=lambda r: r[:4])[: event["most"]]]

    def _changed(self, event: dict) -> list[tuple[str, dict]]:
        url, kind = event["url_norm"], event["kind"]
        if kind == "claim":
            return self._claimed(event)
        old = self._get(url)
        if kind == "task":
            return [(url, {f: event[f] for f in _FIELDS})]
        if kind == "outcome":
            return [] if old is None else [(url, self.rules.finished(old, event["outcome"], event["detail"] or "", event["at"]))]
        due = event["next_fetch_at"] if event["next_fetch_at"] is not None else event["at"]
        if old is None:
            fresh = {"state": "queued", "retries": 0, "locked_until": 0, "locked_by": "", "created_at": event["at"], "finished_at": None, "note": "", "last_error": ""}
            return [(url, fresh | {"priority": event["priority"] or 0, "next_fetch_at": due})]
        return [(url, old | {"priority": event["priority"] or 0, "next_fetch_at": min(old["next_fetch_at"], due)})]

    def _frame(self, key: tuple, changes: list[tuple[str, dict]]) -> Iterator[pd.DataFrame]:
        if not changes:
            return
        seq = self.seq.get()[0] if self.seq.exists() else 0
        rows = [(*key, url, seq + n, *(task[f] for f in _FIELDS)) for n, (url, task) in enumerate(changes, 1)]
        self.seq.update((seq + len(rows),))
        columns = ["source", "part", "url_norm", "seq", *_FIELDS]
        frame = pd.DataFrame(rows, columns=columns)
        yield frame.astype({"finished_at": "Int64"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = [e for batch in rows for e in batch.astype(object).where(batch.notna(), None).to_dict("records")]
        events.sort(key=lambda e: (e["at"], _ORDER[e["kind"]], e["url_norm"] or ""))
        changes = []
        for event in events:
            done = self._changed(_whole_numbers(event))
            for url, task in done:
                self._put(url, task)
            changes += done
        yield from self._frame(key, changes)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        lost = [(url, t | {"state": "queued", "locked_by": ""}) for url, t in self._all().items() if t["state"] == "fetching" and t["locked_until"] <= now]
        for url, task in lost:
            self._put(url, task)
        yield from self._frame(key, lost)


def _whole_numbers(event: dict) -> dict:
    """Numbers that pandas holds as floats because others of their column are null."""
    return {name: int(v) if isinstance(v, float) else v for name, v in event.items()}


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that the queue needs; afterwards as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def task_changes(events: DataFrame, late: str = "1 minute", rules: Rules | None = None) -> DataFrame:
    """``CHANGES`` of a stream of ``EVENTS``: each change of a task, numbered within its (source, part).

    Events of a batch are taken by their time; those of one time: tasks, finds, outcomes, then claims. An outcome of an unknown
    task is nothing. Events no later than the watermark (``late`` behind the newest; 1970's first second at the start) are
    dropped. The session's state store must be ``ROCKS``.
    """
    keyed = events.withWatermark("ts", late).groupBy("source", "part")
    return keyed.transformWithStateInPandas(Queue(rules or Rules()), CHANGES, "Update", "EventTime")


def write_changes(events: DataFrame, path: str, checkpoint: str, late: str = "1 minute", rules: Rules | None = None) -> StreamingQuery:
    """Adds the changes of each batch below ``path``; a repeated batch overwrites what it wrote."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = task_changes(events, late, rules).writeStream.foreachBatch(add).outputMode("update")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_tasks(changes: DataFrame) -> DataFrame:
    """Each task as its last change left it."""
    last = Window.partitionBy("source", "part", "url_norm").orderBy(F.col("seq").desc())
    return changes.withColumn("place", F.row_number().over(last)).filter("place = 1").drop("place", "seq", "batch")
