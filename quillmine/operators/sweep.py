"""What is around what in a file: one walk over its spans in order, with those that
are open on a stack, instead of a join of all spans with all.

Rows are dealt by file and sorted by place, so a task walks over its files one after
the other and holds no more than the spans that are open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROWS = 10_000


class Open:
    """The open spans of a file, by rising start: (start, end, id)."""

    def __init__(self):
        self.spans: list[tuple[int, int, str]] = []
        #: whether a span ends behind one that began before it, so that they cross
        self.crossed = False

    def reach(self, start: int) -> None:
        """Forget spans that end before start."""
        spans = self.spans
        if self.crossed:
            spans[:] = [s for s in spans if s[1] >= start]
            self.crossed = any(b[1] > a[1] for a, b in zip(spans, spans[1:]))
        else:
            while spans and spans[-1][1] < start:
                spans.pop()

    def add(self, start: int, end: int, id: str) -> None:
        """Of equal spans the smallest id counts; it comes first."""
        if self.spans:
            last = self.spans[-1]
            if last[:2] == (start, end):
                return
            self.crossed |= end > last[1]
        self.spans.append((start, end, id))

    def innermost(self, start: int, end: int, same: bool) -> str | None:
        """The id of the shortest span around a place, of equally long ones the
        smallest; same: spans that are just the place count too."""
        best: tuple[int, str] | None = None
        for s, e, id in reversed(self.spans):
            if best is not None and (not self.crossed or end - s > best[0]):
                break
            if e >= end and (same or (s, e) != (start, end)) and (best is None or (e - s, id) < best):
                best = (e - s, id)
        return best[1] if best else None


def enclosing(opens: DataFrame, asks: DataFrame, same: bool = False) -> DataFrame:
    """asks(file, start, end, key) with the id of the innermost of opens(file, start,
    end, id) around each, in a column `around`; null where there is none. Lines count
    whole, and a span that does not end has no inside and is in none. key may be of any type."""
    kind = asks.schema["key"].dataType
    none = F.lit(None).cast(kind)
    rows = opens.select("file", "start", "end", F.lit(0).alias("ask"), F.col("id"), none.alias("key")).unionByName(asks.select("file", "start", "end", F.lit(1).alias("ask"), F.lit(None).cast("string").alias("id"), "key"))
    rows = rows.where("ask = 1 or start is not null and end is not null")
    rows = rows.repartition("file").sortWithinPartitions("file", "start", F.desc("end"), "ask", "id")
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("key", kind), T.StructField("around", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = None, Open()
        for batch in batches:
            files, starts, ends, asked, ids = (c.to_pylist() for c in batch.columns[:5])
            at, around = [], []
            for i in range(batch.num_rows):
                if files[i] != file:
                    file, held = files[i], Open()
                known = starts[i] is not None and ends[i] is not None
                if known:
                    held.reach(starts[i])
                if asked[i]:
                    at.append(i)
                    around.append(held.innermost(starts[i], ends[i], same) if known else None)
                elif ends[i] >= starts[i]:
                    held.add(starts[i], ends[i], ids[i])
            picked = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(5).take(picked), pa.array(around, pa.string())], names=["file", "key", "around"])

    return rows.mapInArrow(run, schema)
