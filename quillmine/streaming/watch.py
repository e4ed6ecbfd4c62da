"""File events to index updates with Structured Streaming.

Events of a root that follow each other within the quiet time are one batch: a
session window, closed once the watermark passes it. A batch's events are
reduced to one operation per path and applied to the index: removals first,
then the written files are indexed anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.window import Window

EVENTS = "root string, path string, operation string, time timestamp, size long"
OPERATIONS = ("create", "write", "remove", "rename")
#: Directories whose events do not count.
EXCLUDED_DIRS = (".git", ".svn", ".hg", "node_modules", "vendor", "target", "build", "dist", "__pycache__", ".idea", ".vscode")


def event_source(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_batch: int = 50, form: str = "json") -> DataFrame:
    """Events that are written into a folder as files."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)


def wanted(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    from ..operators.filters import index_file_filter

    inside = F.exists(F.split(path, "/"), lambda x: x.isin(*EXCLUDED_DIRS))
    return index_file_filter(path, include, exclude) & ~inside


def mapped_events(events: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Known operations on files that are wanted."""
    op = F.lower("operation")
    return events.withColumn("operation", op).where(op.isin(*OPERATIONS) & wanted(F.col("path"), include, exclude))


def debounced(events: DataFrame, quiet: str = "500 milliseconds", late: str = "2 seconds") -> DataFrame:
    """root, start, end, events: sessions without a gap of more than the quiet time."""
    row = F.struct("time", "path", "operation", "size")
    stream = events.withWatermark("time", late) if events.isStreaming else events
    by = stream.groupBy("root", F.session_window("time", quiet).alias("w")).agg(F.sort_array(F.collect_list(row)).alias("events"))
    return by.select("root", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def session_counts(events: DataFrame, quiet: str = "500 milliseconds") -> DataFrame:
    """root, start, end, n: debounced(), without its events in one row."""
    by = events.groupBy("root", F.session_window("time", quiet).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return by.select("root", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def capped_batches(events: DataFrame, size: int = 50, quiet_ms: int = 500) -> DataFrame:
    """root, n, events: flushed when `size` events are held or nothing came for
    the quiet time, whichever is first. Held events are state."""
    state = "held array<struct<time:timestamp,path:string,operation:string,size:bigint>>"
    out = "root string, n int, events array<struct<time:timestamp,path:string,operation:string,size:bigint>>"

    def flush(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        waiting = list(held.get[0]) if held.exists else []
        if not held.hasTimedOut:
            for batch in batches:
                waiting += [dict(zip(("time", "path", "operation", "size"), r)) for r in batch[["time", "path", "operation", "size"]].itertuples(index=False)]
        full = len(waiting) - len(waiting) % size
        done = [waiting[a : a + size] for a in range(0, full, size)]
        waiting = waiting[full:]
        if held.hasTimedOut and waiting:
            done, waiting = [*done, waiting], []
        if waiting:
            held.update((waiting,))
            held.setTimeoutDuration(quiet_ms)
        elif held.exists:
            held.remove()
        for some in done:
            yield pd.DataFrame({"root": [key[0]], "n": [len(some)], "events": [some]})

    return events.groupBy("root").applyInPandasWithState(flush, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def last_operations(events: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Per path whether it is removed or written last; a rename removes the old name."""
    kind = F.when(F.col("operation").isin("remove", "rename"), "remove").otherwise("write")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("time"), F.when(kind == "write", 0).otherwise(1)))
    return events.withColumn("action", kind).withColumn("_n", place).where("_n = 1").select(*keys, "action")


def apply_batch(store, files_of: Callable[[list[str]], DataFrame], batch: DataFrame) -> None:
    """Bring the index up to date with one batch of events, in one version however
    many paths it names."""
    ops = last_operations(batch).select("path", "action").collect()  # a batch is as large as its trigger lets it be
    written = sorted(r.path for r in ops if r.action == "write")
    if not store.version():
        if written:
            store.build(files_of(written))
        return
    if ops:
        gone = store.spark.createDataFrame([(r.path,) for r in ops], "path string")
        none = store.spark.createDataFrame([], "path string, content string, mtime timestamp")
        store.update(files_of(written) if written else none, gone)


def watch(events: DataFrame, store, files_of: Callable[[list[str]], DataFrame], checkpoint: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), on_batch: Callable | None = None, once: bool = False) -> StreamingQuery:
    """Apply a stream of events to the index as it comes; stop() ends it, and what
    it has not applied is taken up by the next start on the same checkpoint."""

    def each(batch: DataFrame, epoch: int) -> None:
        rows = batch.persist()
        try:
            if not rows.isEmpty():
                apply_batch(store, files_of, rows)
                if on_batch:
                    on_batch(rows, epoch)
        finally:
            rows.unpersist()

    writer = mapped_events(events, include, exclude).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()


class TreeWatcher:
    """Keeps an index up to date with directory trees. Roots may come and go: the
    stream is then begun anew, and takes up what it had not applied."""

    def __init__(self, spark: SparkSession, store, files_of: Callable[[list[str]], DataFrame], folder: str, roots: tuple[str, ...] = (), **options):
        self.spark, self.store, self.files_of, self.folder, self.roots, self.options = spark, store, files_of, folder.rstrip("/"), list(roots), options
        self.query: StreamingQuery | None = None
        self.runs = 0

    def start(self) -> None:
        if self.query is None and self.roots:
            from ..sources.treeevents import tree_events

            self.runs += 1
            # roots are part of what an offset means: other roots begin with a listing of their own
            place = f"{self.folder}/run-{self.runs}"
            events = tree_events(self.spark, *self.roots, journal=f"{place}/journal")
            self.query = watch(events, self.store, self.files_of, f"{place}/checkpoint", **self.options)

    def flush(self) -> None:
        """Wait until all that happened is applied."""
        if self.query is not None:
            self.query.processAllAvailable()

    def stop(self, flush: bool = True) -> None:
        if self.query is not None:
            if flush:
                self.flush()
            self.query.stop()
            self.query = None

    def add(self, root: str) -> None:
        self._changed([*self.roots, *([] if root in self.roots else [root])])

    def remove(self, root: str) -> None:
        self._changed([r for r in self.roots if r != root])

    def _changed(self, roots: list[str]) -> None:
        running = self.query is not None
        self.stop()
        self.roots = roots
        if running:
            self.start()

    def stats(self) -> dict:
        held = watch_stats(self.query) if self.query is not None else {"batches": 0, "rows": 0, "active": False}
        return held | {"roots": len(self.roots), "runs": self.runs}


def watch_stats(query: StreamingQuery) -> dict:
    p = query.lastProgress
    return {"batches": p["batchId"] + 1 if p else 0, "rows": p["numInputRows"] if p else 0, "active": query.isActive}


def capped_sessions(events: DataFrame, quiet_seconds: float, size: int) -> DataFrame:
    """The batches of a recorded stream: sessions, cut after every `size` events.
    root, start, n."""
    order = ["time", *(["event_id"] if "event_id" in events.columns else [])]
    by_root = Window.partitionBy("root").orderBy(*order)
    gap = F.unix_micros("time") - F.unix_micros(F.lag("time").over(by_root))
    fresh = F.when(gap <= quiet_seconds * 1_000_000, 0).otherwise(1)
    at = events.withColumn("_fresh", fresh).withColumn("_session", F.sum("_fresh").over(by_root.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("root", "_session").orderBy(*order))
    parts = at.withColumn("_part", F.floor((place - 1) / size))
    return parts.groupBy("root", "_session", "_part").agg(F.min("time").alias("start"), F.count(F.lit(1)).alias("n")).select("root", "start", "n")
