"""Background jobs and commands that recur."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

Run = Callable[[str, str | None], dict[str, Any]]


@dataclass
class Job:
    command: str
    database: str | None
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "Pending"
    result: dict[str, Any] | None = None
    error: str | None = None

    def summary(self) -> dict[str, Any]:
        return {"job_id": self.id, "command": self.command, "status": self.status, "error": self.error}


class Jobs:
    """Jobs run one after another by `workers` threads; `stop` ends the Spark work of one."""

    def __init__(self, run: Run, workers: int = 2, group: Callable[[str], None] | None = None, stop: Callable[[str], None] | None = None):
        self.run, self.group, self.stop = run, group, stop
        self.pool = ThreadPoolExecutor(workers)
        self.jobs: dict[str, Job] = {}
        self.lock = threading.Lock()

    def submit(self, command: str, database: str | None = None) -> Job:
        job = Job(command, database)
        with self.lock:
            self.jobs[job.id] = job
        self.pool.submit(self._work, job)
        return job

    def _work(self, job: Job) -> None:
        with self.lock:
            if job.status != "Pending":
                return
            job.status = "Running"
        try:
            if self.group:
                self.group(job.id)
            result = self.run(job.command, job.database)
            with self.lock:
                if job.status == "Running":
                    job.status, job.result = "Completed", result
        except Exception as e:  # a job's error is its result
            with self.lock:
                if job.status == "Running":
                    job.status, job.error = "Failed", str(e)[:2000]

    def cancel(self, job_id: str) -> bool:
        """A pending job never starts; of a running one the Spark work is stopped."""
        with self.lock:
            job = self.jobs[job_id]
            running = job.status == "Running"
            if job.status not in ("Pending", "Running"):
                return False
            job.status = "Cancelled"
        if running and self.stop:
            self.stop(job_id)
        return True


@dataclass
class Task:
    name: str
    command: str
    interval: float
    database: str | None
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    next_run: float = 0.0
    runs: int = 0
    last_error: str | None = None

    def summary(self) -> dict[str, Any]:
        return {"id": self.id, "name": self.name, "command": self.command, "interval_secs": self.interval, "runs": self.runs, "last_error": self.last_error}


class Scheduler:
    """Runs each task at once and then every `interval` seconds."""

    def __init__(self, run: Run, tick: float = 1.0):
        self.run, self.tick, self.tasks = run, tick, {}
        self.ended = threading.Event()
        threading.Thread(target=self._loop, daemon=True).start()

    def add(self, name: str, command: str, interval: float, database: str | None = None) -> Task:
        if interval <= 0:
            raise ValueError("interval_secs must be positive")
        task = Task(name, command, interval, database)
        self.tasks[task.id] = task
        return task

    def remove(self, task_id: str) -> bool:
        return self.tasks.pop(task_id, None) is not None

    def _loop(self) -> None:
        while not self.ended.wait(self.tick):
            for task in list(self.tasks.values()):
                if time.monotonic() >= task.next_run:
                    task.next_run = time.monotonic() + task.interval
                    try:
                        self.run(task.command, task.database)
                        task.last_error = None
                    except Exception as e:  # the next run may do better
                        task.last_error = str(e)[:500]
                    task.runs += 1
