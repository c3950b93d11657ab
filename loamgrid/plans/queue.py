"""D08, ST3: sources that wait for a sync, a few at a time."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame

from .engine import Engine


class SourceQueue:
    """Syncs requested sources in the order of their requests, at most ``width`` at a time.

    A source that waits or runs is not taken twice. Each sync is a thread of its own whose jobs go to a
    scheduler pool of its own, so with ``spark.scheduler.mode`` FAIR a large source does not hold up small
    ones. Each touches only its own source, so syncs that end in any order all count. A sync
    that fails leaves its source's state at error, and the others go on.
    """

    def __init__(self, engine: Engine, listing: Callable[[str], DataFrame], width: int = 3):
        self.engine, self.listing, self.width = engine, listing, width
        self.states: dict[str, str] = {}
        self.errors: dict[str, str] = {}
        self._waiting: deque[str] = deque()
        self._running: dict[str, InheritableThread] = {}
        self._lock = threading.Condition()

    def request(self, source: str) -> bool:
        """False where the source waits or runs already."""
        with self._lock:
            if source in self._running or source in self._waiting:
                return False
            self._waiting.append(source)
            self.states[source] = "queued"
            self._start()
            return True

    def request_due(self, schedule: str = "daily") -> list[str]:
        """What an hourly timer calls: requests every source that is due."""
        return [r.id for r in self.engine.due(schedule).select("id").orderBy("id").collect() if self.request(r.id)]

    def _start(self) -> None:
        while self._waiting and len(self._running) < self.width:
            source = self._waiting.popleft()
            self.states[source] = "indexing"
            thread = InheritableThread(target=self._sync, args=(source,), daemon=True)
            self._running[source] = thread
            thread.start()

    def _sync(self, source: str) -> None:
        state = "ready"
        try:
            self.engine.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"source-{source}")
            self.engine.sync(self.listing(source), only=[source])
            self.errors.pop(source, None)
        except Exception as e:  # noqa: BLE001 - the error is the source's state
            state = "error"
            self.errors[source] = f"{type(e).__name__}: {e}"
        with self._lock:
            self.states[source] = state
            del self._running[source]
            self._start()
            self._lock.notify_all()

    def wait(self, seconds: float | None = None) -> bool:
        """Until nothing waits or runs; false if that takes longer than ``seconds``."""
        with self._lock:
            return self._lock.wait_for(lambda: not self._running and not self._waiting, seconds)
