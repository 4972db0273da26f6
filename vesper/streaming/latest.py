"""Requests of which the latest wins: a later one interrupts the Spark jobs of the earlier, whose result is refused."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from ..sources.store import Store, Superseded


@dataclass
class Request:
    """What a running request can ask and do: whether it is still the latest, and its one write."""

    latest: Latest
    generation: int
    tag: str

    def current(self) -> bool:
        return self.latest.generation == self.generation

    def check(self) -> None:
        """For loops of the caller's own, between files: raises Superseded once a later request has come."""
        if not self.current():
            raise Superseded(f"request {self.generation} was followed by another")

    def commit(self, store: Store, changes: DataFrame, now: int) -> DataFrame:
        """store.upsert(), refused if a later request comes before the new version has its name."""
        self.check()
        return store.upsert(changes, now, guard=self.current)


@dataclass
class Latest:
    """Runs one request at a time of those that matter: submit() interrupts the one before.

    Jobs of a request carry a tag of their own and are cancelled by it; tasks end between records, as encoders take files one batch after another,
    and what they made is dropped with their job. An interrupted or superseded request's future has Superseded as its exception, whatever its
    jobs raised when they were cancelled. A request that has committed before the next one came stays committed.
    """

    spark: SparkSession
    generation: int = 0
    _tag: str | None = None
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def submit(self, work: Callable[[Request], object]) -> Future:
        with self._lock:
            self.cancel()
            self.generation += 1
            request = Request(self, self.generation, f"vesper-{uuid.uuid4().hex}")
            self._tag = request.tag
        future: Future = Future()

        def run() -> None:
            sc = self.spark.sparkContext
            sc.addJobTag(request.tag)
            try:
                request.check()
                future.set_result(work(request))
            except BaseException as e:
                future.set_exception(e if request.current() or isinstance(e, Superseded) else Superseded(f"request {request.generation} was interrupted"))
            finally:
                sc.removeJobTag(request.tag)

        InheritableThread(target=run, daemon=True).start()
        return future

    def cancel(self) -> None:
        """Interrupts the running request, if any; the next submit() does so by itself."""
        if self._tag:
            self.generation += 1
            self.spark.sparkContext.cancelJobsWithTag(self._tag)
            self._tag = None
