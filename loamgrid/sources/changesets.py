"""S04, S08, ST1, ST5: change sets as a source of Spark: batch reads between two commits, and a stream whose offsets are commits.

A folder holds one listing for each commit, ``<number>.json``: lines of ``file_path``, ``sha`` and, for the
content, ``path``. The rows between two commits are the files that were added, modified or deleted
(content null) from the one to the other, which is what ``Engine.sync(whole=False)`` and ``index_feed`` take.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "data_source_id string, file_path string, content string, size long, commit long, change string, error string"


@dataclass
class Files(InputPartition):
    """Some files of one commit, as triples of path, kind of change and where the content lies."""

    commit: int
    files: list[tuple[str, str, str | None]]


class _Commits:
    def __init__(self, options: dict[str, str]):
        self.root, self.source = options["path"].removeprefix("file://"), options.get("source", "")
        self.each, self.tries, self.wait = int(options.get("filesPerPartition", "100")), int(options.get("tries", "3")), float(options.get("wait", "0.2"))

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in os.listdir(self.root) if n.endswith(".json") and n[:-5].isdigit())

    def listing(self, number: int) -> dict[str, dict]:
        """The files of a commit; none before the first."""
        if number == 0:
            return {}
        with open(f"{self.root}/{number}.json", encoding="utf-8") as f:
            return {r["file_path"]: r for r in map(json.loads, f)}

    def changes(self, start: int, end: int) -> list[Files]:
        """Partitions of the files that differ between two commits, each with its state at the later one."""
        old, new = self.listing(start), self.listing(end)
        moved = [(p, "deleted", None) for p in old.keys() - new.keys()]
        moved += [(p, "added" if p not in old else "modified", r["path"]) for p, r in new.items() if p not in old or old[p]["sha"] != r["sha"]]
        moved.sort()
        return [Files(end, moved[i : i + self.each]) for i in range(0, len(moved), self.each)]

    def rows(self, part: Files) -> Iterator[tuple]:
        """Contents are read by the tasks. A file that stays unreadable is a row with its error, and no other file is lost."""
        for path, change, where in part.files:
            content = error = None
            for n in range(self.tries if where is not None else 0):
                try:
                    with open(os.path.join(self.root, where), encoding="utf-8", errors="replace") as f:
                        content, error = f.read(), None
                    break
                except OSError as e:
                    error = f"{type(e).__name__}: {e.strerror}"
                    if n + 1 < self.tries:
                        time.sleep(self.wait * 2**n)
            size = None if content is None else len(content.encode())
            yield self.source, path, content, size, part.commit, change, error


class _Reader(_Commits, DataSourceReader):
    """All changes from commit ``start`` (default: none) to ``end`` (default: the last)."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.start, self.end = int(options.get("start", "0")), options.get("end")

    def partitions(self) -> list[Files]:
        end = int(self.end) if self.end else max(self.numbers(), default=0)
        return self.changes(self.start, end) or [Files(end, [])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)


class _StreamReader(_Commits, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"commit": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"commit": max(self.numbers(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.changes(start["commit"], end["commit"]) or [Files(end["commit"], [])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class ChangeSets(DataSource):
    """Format ``change_sets``; options ``path``, ``source``, ``filesPerPartition``, ``tries``, ``wait``, and ``start`` and ``end`` of a batch."""

    @classmethod
    def name(cls) -> str:
        return "change_sets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(ChangeSets)
    return spark
