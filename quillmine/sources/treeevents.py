"""spark.readStream.format("treeevents"): changes of directory trees as a stream.

Each poll lists the trees and compares sizes and times with the listing before:
what is new, different or gone is a create, write or remove event. Listings and
events are kept in a journal folder, one file a poll that found something, so an
offset is the number of a file, and a batch that runs again reads the same
events. The trees and the journal must be mounted where the driver runs.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "root string, path string, operation string, time timestamp, size long"


def listing(roots: list[str], pruned: frozenset[str]) -> dict[str, list]:
    """root, size and time in nanoseconds of each file, by its path."""
    out = {}
    for root in roots:
        for folder, dirs, names in os.walk(root):
            dirs[:] = [d for d in dirs if d not in pruned]
            for name in names:
                path = os.path.join(folder, name)
                try:
                    stat = os.stat(path)
                except OSError:  # gone since it was listed
                    continue
                out[path] = [root, stat.st_size, stat.st_mtime_ns]
    return out


def difference(old: dict[str, list], new: dict[str, list], now: float) -> list[list]:
    """(root, path, operation, time, size) of what changed."""
    out = [[new[p][0], p, "create" if p not in old else "write", new[p][2] / 1e9, new[p][1]] for p in new if old.get(p) != new[p]]
    out += [[old[p][0], p, "remove", now, 0] for p in old if p not in new]
    return sorted(out, key=lambda e: (e[3], e[1]))


class TreeEventsReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        from ..streaming.watch import EXCLUDED_DIRS

        self.roots = [os.path.abspath(r) for r in options["path"].split(",") if r]
        self.journal = options["journal"].removeprefix("file://")
        self.fresh = str(options.get("existing", "true")).lower() == "true"
        self.pruned = frozenset(EXCLUDED_DIRS)
        os.makedirs(self.journal, exist_ok=True)

    def _file(self, n: int) -> str:
        return os.path.join(self.journal, f"{n:012d}.json")

    def _held(self, n: int) -> dict:
        if not os.path.exists(self._file(n)):
            return {"listing": {} if self.fresh else listing(self.roots, self.pruned), "events": []}
        with open(self._file(n)) as f:
            return json.load(f)

    def _keep(self, n: int, held: dict) -> None:
        with open(self._file(n) + ".tmp", "w") as f:
            json.dump(held, f)
        os.replace(self._file(n) + ".tmp", self._file(n))

    def initialOffset(self) -> dict:
        if not os.path.exists(self._file(0)):
            self._keep(0, self._held(0))
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = start["n"]
        if os.path.exists(self._file(n + 1)):  # found before, but not yet a batch
            return self.readBetweenOffsets(start, {"n": n + 1}), {"n": n + 1}
        old, new = self._held(n)["listing"], listing(self.roots, self.pruned)
        found = difference(old, new, datetime.now(timezone.utc).timestamp())
        if not found:
            return iter(()), start
        self._keep(n + 1, {"listing": new, "events": found})
        return self.readBetweenOffsets(start, {"n": n + 1}), {"n": n + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = [e for n in range(start["n"] + 1, end["n"] + 1) for e in self._held(n)["events"]]
        return iter([(r, p, op, datetime.fromtimestamp(t, tz=timezone.utc), size) for r, p, op, t, size in rows])

    def commit(self, end: dict) -> None:
        """Files before the last batch are not read again."""
        n = end["n"] - 2
        while n > 0 and os.path.exists(self._file(n)):
            os.remove(self._file(n))
            n -= 1


class TreeEvents(DataSource):
    """Options: path (comma-separated roots), journal (a folder), existing (whether
    files that are there at the start are events)."""

    @classmethod
    def name(cls) -> str:
        return "treeevents"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> TreeEventsReader:
        return TreeEventsReader(dict(self.options))


def tree_events(spark: SparkSession, *roots: str, journal: str, existing: bool = True) -> DataFrame:
    spark.dataSource.register(TreeEvents)
    return spark.readStream.format("treeevents").options(path=",".join(roots), journal=journal, existing=str(existing)).load()
