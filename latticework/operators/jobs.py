"""Background jobs in three tiers over one session: each runs in its tier's scheduler pool and job group, and can be cancelled.

One worker thread takes the highest tier first.  A job of a higher tier cancels
a running one of a lower tier, which goes back to the head of its queue.
"""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import SparkSession

# Tiers, the most urgent first.
TIERS = ["interactive", "user", "background"]


class Cancelled(Exception):
    """Raised inside a job whose token was cancelled."""


@dataclass(eq=False)
class Job:
    """A named function of (session, job); it reports progress and may ask its token."""

    name: str
    tier: str
    run: Callable[[SparkSession, Job], object]
    state: str = "queued"
    result: object = None
    error: Exception | None = None
    progress: list = field(default_factory=list)
    token: threading.Event = field(default_factory=threading.Event)
    done: threading.Event = field(default_factory=threading.Event)

    def report(self, done: int, total: int, message: str = "") -> None:
        self.check()
        self.progress.append((done, total, message))

    def check(self) -> None:
        if self.token.is_set():
            raise Cancelled(self.name)


class Jobs:
    def __init__(self, spark: SparkSession):
        self.spark, self.queues = spark, {t: deque() for t in TIERS}
        self.changed, self.running, self.open, self.count = threading.Condition(), None, True, 0
        self.thread = InheritableThread(target=self._work, daemon=True)
        self.thread.start()

    def submit(self, name: str, tier: str, run: Callable[[SparkSession, Job], object]) -> Job:
        job = Job(name, tier, run)
        with self.changed:
            self.queues[tier].append(job)
            now = self.running
            if now and TIERS.index(tier) < TIERS.index(now.tier):
                now.state = "preempted"
                self._stop(now)
            self.changed.notify()
        return job

    def cancel(self, job: Job) -> bool:
        """A queued job leaves its queue, a running one is told and its Spark jobs end; False if it was over."""
        with self.changed:
            if job in self.queues[job.tier]:
                self.queues[job.tier].remove(job)
                job.state = "cancelled"
                job.done.set()
                return True
            if job is self.running:
                job.state = "cancelled"
                self._stop(job)
                return True
        return False

    def _stop(self, job: Job) -> None:
        job.token.set()
        self.spark.sparkContext.cancelJobGroup(f"job-{id(job)}")

    def close(self) -> None:
        with self.changed:
            self.open = False
            self.changed.notify()
        self.thread.join()

    def _work(self) -> None:
        context = self.spark.sparkContext
        while True:
            with self.changed:
                while self.open and not any(self.queues.values()):
                    self.changed.wait()
                if not any(self.queues.values()):
                    return
                job = next(q for q in self.queues.values() if q).popleft()
                job.state, self.running = "running", job
                job.token.clear()
            context.setJobGroup(f"job-{id(job)}", job.name, interruptOnCancel=True)
            context.setLocalProperty("spark.scheduler.pool", job.tier)
            error = None
            try:
                result = job.run(self.spark, job)
            except Exception as e:  # a job's own failure is its result
                error = e
            with self.changed:
                self.running = None
                if job.state == "preempted":
                    job.progress.clear()
                    self.queues[job.tier].appendleft(job)
                    continue
                if job.state != "cancelled":
                    job.state, job.error = ("failed", error) if error else ("done", None)
                    job.result = None if error else result
                job.done.set()
