"""ST4, A21: the progress of each source as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: ``kind`` is started (``files`` in all, ``tokens`` and ``done`` so far), file (``tokens`` of one more) or completed; ``at`` is when.
EVENTS = "data_source_id string, seq long, kind string, files long, done long, tokens long, at timestamp"
STATE = StructType([StructField("files", LongType()), StructField("done", LongType()), StructField("tokens", LongType()), StructField("seq", LongType())])
PROGRESS = StructType([StructField("data_source_id", StringType()), StructField("seq", LongType()), StructField("state", StringType()), *STATE.fields[:3]])


class SourceProgress(StatefulProcessor):
    """One value a source: files in all, files done and tokens. It starts and ends with a run.

    Events of a batch count in their order (``seq``); one at or below the last that counted is a repeat
    and changes nothing. Events of a file without a run are ignored. A run that is silent for ``quiet``,
    by the events' own time, is given up: its state goes, and one row says so.
    """

    def __init__(self, quiet: timedelta = timedelta(hours=24)):
        self.quiet = int(quiet.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        now, out = self.run.get() if self.run.exists() else None, []
        for e in events.itertuples(index=False):
            if e.kind == "started" and (now is None or e.seq > now[3]):
                now = (int(e.files), 0 if pd.isna(e.done) else int(e.done), 0 if pd.isna(e.tokens) else int(e.tokens), int(e.seq))
            elif now is None or e.seq <= now[3]:
                continue
            elif e.kind == "file":
                now = (now[0], now[1] + 1, now[2] + (0 if pd.isna(e.tokens) else int(e.tokens)), int(e.seq))
            out.append((key[0], int(e.seq), "completed" if e.kind == "completed" else "running", *now[:3]))
            if e.kind == "completed":
                now = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if now is None:
            self.run.clear()
        else:
            self.run.update(now)
            self.handle.registerTimer(int(events["at"].max().timestamp() * 1000) + self.quiet)
        yield pd.DataFrame(out, columns=PROGRESS.names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.run.exists():
            files, done, tokens, seq = self.run.get()
            self.run.clear()
            yield pd.DataFrame([(key[0], seq, "given up", files, done, tokens)], columns=PROGRESS.names)

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, quiet: timedelta = timedelta(hours=24), late: str = "1 hour") -> DataFrame:
    """One row for each event that counts (``EVENTS``): the source's progress after it. Events later than ``late`` are left out.

    A restart from the checkpoint goes on from the stored state. Needs the RocksDB state store, which the
    session names (``spark.sql.streaming.stateStore.providerClass``).
    """
    keyed = events.withWatermark("at", late).groupBy("data_source_id")
    return keyed.transformWithStateInPandas(SourceProgress(quiet), PROGRESS, "Append", "EventTime")


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
