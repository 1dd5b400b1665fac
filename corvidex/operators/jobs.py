"""A queue of sequence searches: identical requests share a job, shorter queries go first."""

from __future__ import annotations

import heapq
import itertools
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .sequence import Parameters, blast

UNKNOWN, QUEUED, RUNNING, ERROR, FINISHED = "unknown", "queued", "running", "error", "finished"


@dataclass
class Job:
    number: int
    db: str
    query: str
    parameters: Parameters
    filter: str | None
    status: str = QUEUED
    error: str | None = None
    hits: list = field(default_factory=list)


class Queue:
    """Runs searches one after the other on a thread of its own; Spark spreads each over the executors.

    ``open_`` gives (doc_nr, seq) of a collection, ``restrict`` the documents (doc_nr) of a boolean query over it.
    A report holds at most the parameters' limit of hits, which is what reaches the driver.
    """

    def __init__(self, open_: Callable[[str], DataFrame], restrict: Callable[[str, str], DataFrame] | None = None):
        self._open, self._restrict = open_, restrict
        self._jobs: dict[int, Job] = {}
        self._same: dict[tuple, int] = {}
        self._heap: list[tuple[int, int]] = []
        self._count = itertools.count(1)
        self._lock = threading.Condition()
        self._thread: threading.Thread | None = None

    def submit(self, db: str, query: str, p: Parameters = Parameters(), filter: str | None = None) -> int:
        """The number of the job for this request."""
        key = (db, query.upper(), p, filter)
        with self._lock:
            if key in self._same and self._jobs[self._same[key]].status != ERROR:
                return self._same[key]
            n = self._same[key] = next(self._count)
            self._jobs[n] = Job(n, db, query.upper(), p, filter)
            heapq.heappush(self._heap, (len(query), n))
            if self._thread is None or not self._thread.is_alive():
                self._thread = threading.Thread(target=self._work, daemon=True)
                self._thread.start()
            return n

    def _work(self) -> None:
        while True:
            with self._lock:
                if not self._heap:
                    self._thread = None
                    return
                job = self._jobs[heapq.heappop(self._heap)[1]]
                job.status = RUNNING
            try:
                only = self._restrict(job.db, job.filter) if job.filter and self._restrict else None
                job.hits = blast(self._open(job.db), job.query, job.parameters, only).collect()
                status = FINISHED
            except Exception as e:  # a failed search is a result of the job, not of the queue
                job.error, status = str(e), ERROR
            with self._lock:
                job.status = status
                self._lock.notify_all()

    def status(self, number: int) -> str:
        return self._jobs[number].status if number in self._jobs else UNKNOWN

    def result(self, number: int, timeout: float | None = None) -> list:
        """The hits, once the job has ended; raises if it failed."""
        with self._lock:
            job = self._jobs[number]
            if not self._lock.wait_for(lambda: job.status in (FINISHED, ERROR), timeout):
                raise TimeoutError(f"job {number} is {job.status}")
        if job.status == ERROR:
            raise RuntimeError(job.error)
        return job.hits
