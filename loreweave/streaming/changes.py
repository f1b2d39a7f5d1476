"""Structured Streaming jobs: change queue, write suppression, debounce, rate limit, de-duplication.

Each job takes a stream and returns one; state is kept per key, so it is spread
over the cluster. Functions for one key are plain and are tested by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loreweave.functions.text import watched
from loreweave.storage import materialize, shared_dir

#: Retries of a task, life of a write mark, and the request limit with its window.
MAX_RETRIES, WRITE_MARK_MS, LIMIT, WINDOW_MS, DEBOUNCE_MS = 3, 4_000, 120, 1_000, 250


def merge_kind(before: str | None, now: str) -> str:
    """Kind of two changes of one file, one after the other."""
    return "modified" if {before, now} == {"created", "deleted"} else now


def advance(task: dict[str, Any] | None, event: str, at: int) -> dict[str, Any] | None:
    """A file's task after an event: a kind of change, or start, done, failed.

    A change opens a task, is merged into a waiting one, makes a running one run
    again, and revives a failed one while it has retries left. A finished task
    goes away, or waits again if it has to run again. Other events change nothing.
    """
    if event in ("created", "modified", "deleted"):
        if task is None:
            return {"kind": event, "status": "pending", "retries": 0, "again": False, "at": at}
        task = task | {"kind": merge_kind(task["kind"], event), "at": at}
        if task["status"] == "processing":
            task["again"] = True
        elif task["status"] == "failed" and task["retries"] < MAX_RETRIES:
            task["status"] = "pending"
        return task
    if task is None:
        return None
    if event == "start" and task["status"] == "pending":
        return task | {"status": "processing", "at": at}
    if event in ("done", "failed") and task["status"] == "processing":
        if event == "done":
            return task | {"status": "pending", "again": False, "at": at} if task["again"] else None
        retries = task["retries"] + 1
        return task | {"status": "pending" if retries < MAX_RETRIES else "failed", "retries": retries, "again": False, "at": at}
    return task


_TASK = "kind string, status string, retries int, again boolean, at bigint"


def change_queue(events: DataFrame) -> DataFrame:
    """Tasks by file from events (path, at in milliseconds, event): path, kind, status, retries, again, at after each batch.

    Events of one batch are taken in order of time, then name. A task that went away is given with status done.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["kind", "status", "retries", "again", "at"]
        task = dict(zip(names, state.get)) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "event"])
        last = task
        for event, at in zip(rows["event"], rows["at"]):
            task = advance(task, event, int(at))
            last = task or last
        if task is None:
            if state.exists:
                state.remove()
            if last is None:
                return
            last = last | {"status": "done"}
        else:
            state.update(tuple(task[n] for n in names))
        yield pd.DataFrame([{"path": key[0]} | last])

    return events.groupBy("path").applyInPandasWithState(run, f"path string, {_TASK}", _TASK, "update", GroupStateTimeout.NoTimeout)


def without_own_writes(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Changes (path, at, event) that no mark of an own write (event ``mark``) precedes by up to four seconds; marks that the watermark has passed are dropped."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mark = state.get[0] if state.exists else None
        rows = pd.concat(list(frames))
        rows = rows.assign(first=rows["event"] != "mark").sort_values(["at", "first", "event"])
        kept = []
        for event, at in zip(rows["event"], rows["at"]):
            if event == "mark":
                mark = int(at)
            elif mark is None or at - mark > WRITE_MARK_MS:
                kept.append({"path": key[0], "at": int(at), "event": event})
        if mark is not None and mark + WRITE_MARK_MS > state.getCurrentWatermarkMs():
            state.update((mark,))
            state.setTimeoutTimestamp(mark + WRITE_MARK_MS)
        elif state.exists:
            state.remove()
        if kept:
            yield pd.DataFrame(kept)

    timed = events.withColumn("_time", F.timestamp_millis("at")).withWatermark("_time", late).groupBy("path")
    return timed.applyInPandasWithState(run, "path string, at bigint, event string", "mark bigint", "append", GroupStateTimeout.EventTimeTimeout)


def allowed(requests: list[int], at: int, limit: int = LIMIT, window: int = WINDOW_MS) -> tuple[list[int], bool]:
    """The requests let through in the window before ``at`` and whether one more is; refused ones don't count."""
    recent = [t for t in requests if t >= at - window]
    return ([*recent, at], True) if len(recent) < limit else (recent, False)


def rate_limited(requests: DataFrame, limit: int = LIMIT, window: int = WINDOW_MS) -> DataFrame:
    """Requests (client, at in milliseconds, request) with ``passed``; state holds at most ``limit`` times per client."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "request"])
        passed = []
        for at in rows["at"]:
            recent, ok = allowed(recent, int(at), limit, window)
            passed.append(ok)
        state.update((recent,))
        yield rows.assign(client=key[0], passed=passed)[["client", "at", "request", "passed"]]

    return requests.groupBy("client").applyInPandasWithState(run, "client string, at bigint, request bigint, passed boolean", "recent array<bigint>", "append", GroupStateTimeout.NoTimeout)


def gathered(waiting: tuple | None, rows: list[tuple[int, str]], window: int) -> tuple[list[tuple], tuple | None]:
    """The batches that end with these changes (at, event) in order of time, and the one that still waits: began, changes, last.

    A batch holds what comes within the window after its first change; later changes don't prolong it.
    """
    done = []
    for at, event in rows:
        if waiting is not None and at < waiting[0] + window:
            waiting = (waiting[0], waiting[1] + 1, event)
        else:
            done += [waiting] if waiting is not None else []
            waiting = (at, 1, event)
    return done, waiting


def debounced(events: DataFrame, window: int = DEBOUNCE_MS, late: str = "10 seconds") -> DataFrame:
    """Changes (path, ts, event) gathered per file for some milliseconds from the first one on: path, began, changes, last.

    A batch comes out when a later change starts the next one, or when the watermark has passed its end.
    """
    names = ["path", "began", "changes", "last"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, done = (state.get if state.exists else None), []
        if state.hasTimedOut:
            done, waiting = [waiting], None
        else:
            parts = [f[["ts", "event"]] for f in frames]
            rows = pd.concat(parts).sort_values(["ts", "event"])
            ms = rows["ts"].astype("datetime64[ms]").astype("int64")
            done, waiting = gathered(waiting, list(zip(ms.tolist(), rows["event"])), window)
            if waiting is not None and waiting[0] + window <= state.getCurrentWatermarkMs():
                done, waiting = [*done, waiting], None
        if waiting is None:
            if state.exists:
                state.remove()
        else:
            state.update(waiting)
            state.setTimeoutTimestamp(waiting[0] + window)
        if done:
            out = pd.DataFrame([(key[0], *d) for d in done], columns=names)
            out["began"] = pd.to_datetime(out["began"], unit="ms")
            yield out

    timed = events.withWatermark("ts", late).groupBy("path")
    return timed.applyInPandasWithState(run, "path string, began timestamp, changes int, last string", "began bigint, changes int, last string", "append", GroupStateTimeout.EventTimeTimeout)


def handled_once(tasks: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark of ``ts``."""
    return tasks.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def project_changes(events: DataFrame, root: Column, **rules) -> DataFrame:
    """Changes of files (path, ...) below a project's root that a watcher reports: rel, the path below the root, is added; batch or stream.

    Slashes of either kind count; letter case of the root doesn't. ``rules`` are those of ``watched``. Null paths are dropped.
    """
    plain = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/+$", "")
    path, top = plain(F.col("path")), F.concat(plain(root), F.lit("/"))
    below = events.where(F.lower(path).startswith(F.lower(top))).withColumn("rel", F.substring(path, F.length(top) + 1, F.length(path)))
    return below.where(watched(F.col("rel"), **rules))


def rescanned(spark: SparkSession, scan: Callable[[], DataFrame], handle: Callable[[DataFrame, DataFrame], None], every: str = "10 seconds") -> StreamingQuery:
    """A running query that scans the files again and again: ``handle`` gets the listing and the one before, both written to the shared folder."""
    before: list[DataFrame] = []

    def look(_: DataFrame, number: int) -> None:
        now = materialize(scan(), "scan")
        handle(now, before[-1] if before else now.limit(0))
        before[:] = [now]

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(look).trigger(processingTime=every).start()


def counts_by_window(events: DataFrame, window: str, late: str = "1 hour") -> DataFrame:
    """Events (ts, event) per tumbling window and kind."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("began"), "event", "n")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and give what it wrote, as a table in the shared folder.

    In the modes update and complete a batch overwrites nothing: each row has ``batch``, the number of the batch that gave it.
    """
    import uuid

    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/number={number}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).start()
    query.awaitTermination()
    schema = stream.withColumn("batch", F.lit(0)).schema
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/rows")
