"""Running one job of a kind at a time, with progress and a time limit."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Jobs:
    """Background jobs, at most one running of each kind, with a status file per kind."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._lock, self._running = threading.Lock(), {}
        os.makedirs(folder, exist_ok=True)

    def _write(self, kind: str, **status: object) -> None:
        path = os.path.join(self.folder, f"{kind}.json")
        with open(path + ".new", "w") as f:
            json.dump(status | {"ts": time.time()}, f)
        os.replace(path + ".new", path)

    def status(self, kind: str) -> dict:
        """The last status of a kind: state idle, running, done or failed."""
        try:
            with open(os.path.join(self.folder, f"{kind}.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return {"state": "idle"}

    def progress(self, kind: str) -> dict:
        """Tasks done and tasks in all of the stages that the running job of a kind has now, {} if none runs."""
        status = self.status(kind)
        if status.get("state") != "running":
            return {}
        tracker = self.spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(status["job"])]
        stages = [tracker.getStageInfo(s) for j in jobs if j for s in j.stageIds]
        now = [s for s in stages if s]
        return {"done": sum(s.numCompletedTasks for s in now), "tasks": sum(s.numTasks for s in now)}

    def run_all(self, kind: str, step: Callable[[], object], report_rows: Callable[[object], dict] | None = None) -> str | None:
        """Start a cluster-wide step, such as vectorize or download written to a table, as the job of a kind; its last status has report_rows of its result."""

        def run(report: Callable[..., None]) -> dict:
            made = step()
            return report_rows(made) if report_rows else {}

        return self.start(kind, run)

    def start(self, kind: str, run: Callable[[Callable[..., None]], object]) -> str | None:
        """Start run in a thread and return its id, or None while a job of the kind is running. run gets a function that reports progress."""
        with self._lock:
            if kind in self._running:
                return None
            job = uuid.uuid4().hex
            thread = threading.Thread(target=self._run, args=(kind, job, run), daemon=True)
            self._running[kind] = thread
        self._write(kind, state="running", job=job)
        thread.start()
        return job

    def _run(self, kind: str, job: str, run: Callable) -> None:
        self.spark.sparkContext.setJobGroup(job, kind, interruptOnCancel=True)
        try:
            last = run(lambda **progress: self._write(kind, state="running", job=job, **progress))
            self._write(kind, state="done", job=job, **(last if isinstance(last, dict) else {}))
        except Exception as e:
            self._write(kind, state="failed", job=job, error=str(e)[:500])
        finally:
            with self._lock:
                self._running.pop(kind, None)

    def wait(self, kind: str, seconds: float | None = None) -> None:
        thread = self._running.get(kind)
        if thread:
            thread.join(seconds)


def within(spark: SparkSession, seconds: float, action: Callable[[], object]) -> object:
    """The result of a Spark action; its jobs are cancelled and TimeoutError raised if it takes longer."""
    group, done = uuid.uuid4().hex, threading.Event()
    timed_out = threading.Event()

    def stop() -> None:
        if not done.wait(seconds):
            timed_out.set()
            # Jobs that start after a cancellation are cancelled by the next.
            spark.sparkContext.cancelJobGroup(group)
            while not done.wait(0.1):
                spark.sparkContext.cancelJobGroup(group)

    spark.sparkContext.setJobGroup(group, "limited", interruptOnCancel=True)
    threading.Thread(target=stop, daemon=True).start()
    try:
        return action()
    except Exception as e:
        if timed_out.is_set():
            raise TimeoutError(f"more than {seconds} s") from e
        raise
    finally:
        done.set()
        spark.sparkContext._jsc.clearJobGroup()
