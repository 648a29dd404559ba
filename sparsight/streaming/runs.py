"""Runs of streams that a caller can watch, halt and resume: progress, completion and errors with the record they fell on."""

from __future__ import annotations

import re
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Name of the metrics that each batch of a run reports.
METRICS = "records"


class RunFailed(RuntimeError):
    """A batch that couldn't be written: its number, the records that it holds, and the record at fault where that is known."""

    def __init__(self, batch: int, first, last, record, reason: str):
        at = f"record {record}" if record is not None else f"records {first} to {last}"
        super().__init__(f"batch {batch} failed at {at}: {reason}")
        self.batch, self.first, self.last, self.record, self.reason = batch, first, last, record, reason


@dataclass
class Progress:
    """What a run has written since it started: batches, records, and the last record's number."""

    batches: int = 0
    records: int = 0
    last: int | None = None
    seen: list[tuple[int, int, int | None]] = field(default_factory=list)


def required(value: Column, holds: Column, record: Column, what: str) -> Column:
    """value where a condition holds; else the batch fails, and the error names the record."""
    return F.when(holds, value).otherwise(F.raise_error(F.concat(F.lit(f"{what}, record "), record.cast("string"))))


class Run:
    """A stream written batch by batch, each once; a new run with the same checkpoint goes on behind the last batch written.

    write(df, number) writes a batch; a failing one isn't committed, so that the next run begins with it. record names the
    column of record numbers. on_next(progress) is called after each batch that was written, on_complete(progress) at the
    end of a run that read everything or was halted, on_error(failure) at the end of one that failed.
    """

    def __init__(self, stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, record: str = "rec_no",
                 on_next: Callable | None = None, on_complete: Callable | None = None, on_error: Callable | None = None):
        self.stream, self.write, self.checkpoint, self.record = stream, write, checkpoint, record
        self.calls = {"next": on_next, "complete": on_complete, "error": on_error}
        self.progress, self.failure, self.query, self._halted, self._over = Progress(), None, None, False, threading.Event()

    def start(self, available_now: bool = True) -> Run:
        number = F.col(self.record)
        watched = self.stream.observe(METRICS, F.count(F.lit(1)).alias("n"), F.max(number).alias("last"))
        self.listener = _Listener(self)
        self.stream.sparkSession.streams.addListener(self.listener)
        writer = watched.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint)
        self.query = (writer.trigger(availableNow=True) if available_now else writer).start()
        self.listener.started(str(self.query.runId))
        return self

    def _batch(self, rows: DataFrame, number: int) -> None:
        try:
            self.write(rows, number)
        except Exception as e:
            reason = str(e).split("\n")[0]
            at = re.search(r"record (\d+)", str(e))
            # a batch can be read again; only a failing one is
            try:
                first, last = rows.agg(F.min(self.record), F.max(self.record)).first()
            except Exception:  # the record numbers themselves can't be computed
                first = last = None
            self.failure = RunFailed(number, first, last, int(at[1]) if at else None, reason)
            raise

    def halt(self) -> None:
        """Stops the run; a batch that is being written is given up and written anew by the next run."""
        self._halted = True
        self.query.stop()

    def wait(self, seconds: float | None = None) -> Progress:
        """Until the run is over: what it wrote. Raises RunFailed where it failed."""
        try:
            self.query.awaitTermination(seconds)
        except Exception as e:
            if self.failure is None and not self._halted:
                at = re.search(r"record (\d+)", str(e))
                self.failure = RunFailed(self.progress.batches, None, None, int(at[1]) if at else None, str(e).split("\n")[0])
        if not self.query.isActive:
            self._over.wait(30)
            self.stream.sparkSession.streams.removeListener(self.listener)
        if self.failure is not None:
            raise self.failure
        return self.progress

    def _tell(self, what: str, value) -> None:
        if self.calls[what]:
            self.calls[what](value)


class _Listener(StreamingQueryListener):
    """Events of one query: which one is known only when it has started, so earlier events wait."""

    def __init__(self, run: Run):
        self.run, self.id, self.early, self.lock = run, None, [], threading.Lock()

    def started(self, run_id: str) -> None:
        with self.lock:
            self.id = run_id
            early, self.early = self.early, []
        for kind, event in early:
            self._take(kind, event)

    def _take(self, kind: str, event) -> None:
        with self.lock:
            if self.id is None:
                self.early.append((kind, event))
                return
        if str(event.progress.runId if kind == "progress" else event.runId) != self.id:
            return
        run = self.run
        if kind == "progress":
            found = event.progress.observedMetrics.get(METRICS)
            if found is not None and found["n"]:
                p = run.progress
                p.batches, p.records, p.last = p.batches + 1, p.records + found["n"], found["last"] if p.last is None else max(p.last, found["last"] if found["last"] is not None else p.last)
                p.seen.append((event.progress.batchId, found["n"], found["last"]))
                run._tell("next", p)
            return
        if event.exception and not run._halted:
            run._tell("error", run.failure or RunFailed(run.progress.batches, None, None, None, event.exception.split("\n")[0]))
        else:
            run._tell("complete", run.progress)
        run._over.set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._take("progress", event)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._take("terminated", event)
