"""Queries on the index and the searches that combine it with text."""

from __future__ import annotations

import hashlib
import threading
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dialect import java_pattern
from ..operators.filters import name_matches, path_filters, symbol_filter
from ..operators.grep import GrepOptions, grep
from ..operators.refs import call_graph, distinct_places
from ..operators.symbols import TYPE_KINDS, kind_alias
from .errors import SearchTimeout

_SORTABLE = {"name": "name", "type": "type", "file_path": "file_path", "line": "start_line"}


@dataclass(frozen=True)
class SearchQuery:
    by: str = "name"  # name, type, tag or pattern
    text: str = ""
    filters: tuple[tuple[str, str, str], ...] = ()  # (field, operator, value)
    sort: str | None = None
    descending: bool = False
    limit: int | None = None
    offset: int = 0

    def key(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()


def search_symbols(symbols: DataFrame, q: SearchQuery) -> DataFrame:
    """Filter, then sort, then offset, then limit."""
    value = q.text.lower()
    access = {
        "name": F.lower("name") == value,
        "type": F.lower(F.coalesce("type", "kind")) == value,
        "tag": F.exists("tags", lambda t: F.lower(t) == value),
        "pattern": F.contains(F.lower("name"), F.lit(value)),
    }
    if q.by not in access:
        raise ValueError(f"unknown access {q.by!r}")
    out = symbols.where(reduce(lambda a, b: a & b, (symbol_filter(*f) for f in q.filters), access[q.by]))
    if q.sort in _SORTABLE:
        col = F.col(_SORTABLE[q.sort])
        out = out.orderBy(col.desc() if q.descending else col.asc(), "id")
    elif q.limit is not None or q.offset:
        out = out.orderBy("id")
    out = out.offset(q.offset) if q.offset else out
    return out if q.limit is None else out.limit(q.limit)


def named(pattern: str, match: str = "auto", case_sensitive: bool = False) -> Column:
    """Whether a column `name` is what is looked for. match: exact, contains, regex; auto
    takes regex if the pattern has signs of one, else exact."""
    if match == "auto":
        match = "regex" if any(c in pattern for c in "*.+?[](){}|^$\\") else "exact"
    if match == "regex":
        return F.col("name").rlike(java_pattern(f"^(?:{pattern})$", ignore_case=not case_sensitive))
    return name_matches(F.col("name"), pattern, case_sensitive, whole_word=match == "exact")


def find_symbols(symbols: DataFrame, pattern: str, match: str = "auto", case_sensitive: bool = False, kinds: tuple[str, ...] = (), **paths) -> DataFrame:
    """Symbols by name, as named() takes it."""
    hit = named(pattern, match, case_sensitive)
    if kinds:
        hit &= F.col("kind").isin(*map(kind_alias, kinds))
    out = symbols.where(hit)
    return out.where(path_filters(out, "file_path", **paths)) if paths else out


def find_types(symbols: DataFrame, pattern: str, **options) -> DataFrame:
    return find_symbols(symbols, pattern, **options).where(F.col("kind").isin(*TYPE_KINDS))


def find_references(symbols: DataFrame, refs: DataFrame, pattern: str, limit: int | None = None, **options) -> DataFrame:
    """The places of the symbols that are looked for. References to other names are left
    out by name first, where tokens and symbols are read."""
    wanted = find_symbols(symbols, pattern, **options).select(F.col("id").alias("symbol_id"))
    refs = refs.where(named(pattern, **{k: v for k, v in options.items() if k in ("match", "case_sensitive")}))
    out = distinct_places(refs.join(wanted.hint("merge"), "symbol_id", "left_semi"))
    return out if limit is None else out.orderBy("file_path", "line", "col").limit(limit)


def find_definitions(symbols: DataFrame, pattern: str, **options) -> DataFrame:
    """Exact names and those that hold the pattern, each once. Who has the exact name holds
    it too, so the symbols are made and read once."""
    return find_symbols(symbols, pattern, match="contains", **options).dropDuplicates(["id"])


def find_calls(symbols: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    return call_graph(symbols, refs, name)


def by_place(symbols: DataFrame) -> DataFrame:
    """Symbols as they stand in their files."""
    return symbols.orderBy("file_path", "start_line", "start_col", "name")


def symbol_results(symbols: DataFrame) -> DataFrame:
    """Symbols in the form of matches, with what is known of them as a map."""
    info = F.map_filter(
        F.create_map(
            F.lit("name"), F.col("name"), F.lit("kind"), F.col("kind"), F.lit("type"), F.col("type"), F.lit("signature"), F.col("signature"),
            F.lit("doc"), F.col("doc_string"), F.lit("modifiers"), F.nullif(F.concat_ws(",", "modifiers"), F.lit("")), F.lit("id"), F.col("id"),
        ),
        lambda _, v: v.isNotNull(),
    )
    return symbols.select(F.col("file_path").alias("path"), F.col("start_line").alias("line_no"), F.col("start_col").alias("col_start"), F.col("name").alias("match"), info.alias("metadata"))


def hybrid(matches: DataFrame, symbols: DataFrame) -> DataFrame:
    """Text matches and symbols, one row for each place; a symbol goes first."""
    text = matches.select("path", "line_no", "col_start", "match").withColumns({"metadata": F.create_map().cast("map<string,string>"), "origin": F.lit("text"), "rank": F.lit(1)})
    meaning = symbol_results(symbols).withColumns({"origin": F.lit("symbol"), "rank": F.lit(0)})
    both = meaning.unionByName(text)
    first = F.row_number().over(Window.partitionBy("path", "line_no", "col_start").orderBy("rank", "match"))
    return both.withColumn("_n", first).where("_n = 1").drop("_n", "rank")


def hybrid_stats(parts: DataFrame) -> DataFrame:
    """One row for several searches, parts(files, bytes, matches, seconds): the files
    and bytes of the largest, as both saw the same, and the sum of the matches and
    of the time."""
    return parts.agg(F.max("files").alias("files"), F.max("bytes").alias("bytes"), F.sum("matches").alias("matches"), F.sum("seconds").alias("seconds"))


@dataclass
class Latencies:
    """How often operations ran and how long they took."""

    held: dict[str, list[float]] = field(default_factory=dict)

    def timed(self, name: str, work):
        began = time.perf_counter()
        try:
            return work()
        finally:
            self.held.setdefault(name, []).append(time.perf_counter() - began)

    def averages(self) -> dict[str, tuple[int, float]]:
        """Calls and mean seconds by operation."""
        return {name: (len(took), sum(took) / len(took)) for name, took in self.held.items()}


@dataclass
class QueryCache:
    """Results that were persisted, by query and index version, for a while."""

    seconds: float = 1800.0
    most: int = 1000
    _held: dict = field(default_factory=dict)

    def get(self, key: tuple, make) -> DataFrame:
        now = time.time()
        for k in [k for k, (_, until) in self._held.items() if until <= now]:
            self._held.pop(k)[0].unpersist()
        if key not in self._held:
            while len(self._held) >= self.most:
                self._held.pop(next(iter(self._held)))[0].unpersist()
            self._held[key] = (make().persist(), now + self.seconds)
        return self._held[key][0]

    def clear(self) -> None:
        for df, _ in self._held.values():
            df.unpersist()
        self._held.clear()


class Engine:
    """regex, semantic and hybrid searches over files and an index."""

    def __init__(self, spark: SparkSession, files: DataFrame, store=None, cache: QueryCache | None = None):
        self.spark, self.files, self.store, self.cache = spark, files, store, cache or QueryCache()
        self.latencies = Latencies()

    def search(self, mode: str, pattern: str, **options) -> DataFrame:
        return self.latencies.timed(f"plan {mode}", lambda: self._search(mode, pattern, **options))

    def _search(self, mode: str, pattern: str, **options) -> DataFrame:
        if mode == "regex":
            return grep(self.files, GrepOptions(pattern, **options))
        symbols = self.store.table("symbols")
        if mode == "semantic":
            q = SearchQuery("pattern", pattern, **options)
            return self.cache.get((q.key(), self.store.version()), lambda: search_symbols(symbols, q))
        if mode == "hybrid":
            return hybrid(grep(self.files, GrepOptions(pattern, **options)), find_symbols(symbols, pattern))
        raise ValueError(f"unknown mode {mode!r}")

    def collect(self, df: DataFrame, timeout: float = 30.0) -> list:
        """The rows, or SearchTimeout once the time is up and the job cancelled."""
        tag = f"search-{id(df)}-{time.time_ns()}"
        self.spark.addTag(tag)
        late = threading.Event()

        def stop():
            late.set()
            self.spark.interruptTag(tag)

        timer = threading.Timer(timeout, stop)
        timer.start()
        try:
            return self.latencies.timed("collect", df.collect)
        except Exception as e:
            if late.is_set():
                raise SearchTimeout(f"no result within {timeout:g} s") from e
            raise
        finally:
            timer.cancel()
            self.spark.removeTag(tag)

    def progress(self) -> list[dict]:
        """Stages that run now, with their tasks."""
        tracker = self.spark.sparkContext.statusTracker()
        held = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
        return [{"stage": s.stageId, "name": s.name, "tasks": s.numTasks, "done": s.numCompletedTasks, "failed": s.numFailedTasks} for s in held if s]

    def stream(self, df: DataFrame):
        """Rows as partitions end, a partition at a time on the driver."""
        return df.toLocalIterator(prefetchPartitions=True)
