"""Search files(path, content) for a pattern."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import java_pattern, may_match_empty, required_literal
from .filters import path_filters
from .lines import explode_lines, first_per_file, first_span, line_spans, lines_of, spans


@dataclass(frozen=True)
class GrepOptions:
    pattern: str
    literal: bool = False
    ignore_case: bool = False
    word: bool = False
    whole_line: bool = False
    multiline: bool = False  # ^ and $ also match at line ends inside a line-wise search
    dot_all: bool = False
    across_lines: bool = False  # match over the whole file
    invert: bool = False
    only_matching: bool = False
    one_per_line: bool = False  # the first match of a line only
    replacement: str | None = None
    before: int = 0
    after: int = 0
    max_count: int | None = None  # rows per file
    max_filesize: int | None = None
    binary_as_text: bool = False
    binary_check: str = "nul"
    drop_last_empty: bool = False
    absolute_offset: bool = False
    types: tuple[str, ...] = ()
    not_types: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    not_globs: tuple[str, ...] = ()
    hidden: bool = True
    max_depth: int | None = None
    context: int | None = field(default=None)

    def __post_init__(self):
        if not self.pattern:
            raise ValueError("a pattern is needed")
        for name in ("before", "after", "max_count", "max_filesize", "max_depth", "context"):
            if (getattr(self, name) or 0) < 0:
                raise ValueError(f"{name} must not be negative")

    def java(self) -> str:
        return java_pattern(
            self.pattern, literal=self.literal, ignore_case=self.ignore_case, word=self.word, whole_line=self.whole_line, multiline=self.multiline or self.across_lines, dot_all=self.dot_all
        )

    def around(self) -> tuple[int, int]:
        return (self.context, self.context) if self.context else (self.before, self.after)


def line_matches(line: Column, o: GrepOptions) -> Column:
    """Whether a line matches; cheap text tests go first where they are sure."""
    if o.literal and not (o.ignore_case or o.word or o.whole_line):
        return F.contains(line, F.lit(o.pattern))
    found = line.rlike(o.java())
    literal = o.pattern if o.literal else required_literal(o.pattern)
    return found if o.ignore_case or not literal else F.contains(line, F.lit(literal)) & found


def held_by_files(o: GrepOptions) -> str | None:
    """A text that a file with a match has, so that others need not be cut into lines."""
    literal = None if o.invert or o.ignore_case else o.pattern if o.literal else required_literal(o.pattern)
    return literal if literal and not re.search(r"[\r\n]", literal) else None


def match_spans(text: Column, o: GrepOptions) -> Column:
    return spans(text, o.java(), may_match_empty(o.pattern, o.literal))


def select_files(files: DataFrame, o: GrepOptions) -> DataFrame:
    """The files that are searched at all."""
    files = files.where(path_filters(files, types=o.types, not_types=o.not_types, globs=o.globs, not_globs=o.not_globs, hidden=o.hidden, max_depth=o.max_depth))
    if o.max_filesize is not None:
        files = files.where(F.octet_length("content") <= o.max_filesize)
    if not o.binary_as_text and o.binary_check:
        from .filters import is_binary

        files = files.where(~is_binary(F.col("content"), o.binary_check))
    if dict(files.dtypes)["content"] == "binary":
        files = files.withColumn("content", F.decode("content", "UTF-8"))
    return files


def grep(files: DataFrame, o: GrepOptions) -> DataFrame:
    """path, line_no, col_start, col_end, match, line, before, after (and
    absolute_offset): a row per match, byte columns from 1, the end exclusive."""
    files = select_files(files.select("path", "content"), o)
    if o.across_lines:
        return _grep_files(files, o)
    if literal := held_by_files(o):
        files = files.where(F.contains("content", F.lit(literal)))
    before, after = o.around()

    def wanted(line: Column) -> Column:
        return ~line_matches(line, o) if o.invert else line_matches(line, o)

    if before or after or o.absolute_offset:
        rows = lines_of(files, wanted, before, after, o.absolute_offset, o.drop_last_empty)
    else:
        empty = F.array().cast("array<string>")
        rows = explode_lines(files, drop_last_empty=o.drop_last_empty).where(wanted(F.col("line"))).withColumns({"before": empty, "after": empty})
    if o.invert:
        rows = rows.withColumns({"col_start": F.lit(1), "col_end": F.octet_length("line") + 1, "match": F.col("line")})
    else:
        if not o.one_per_line:
            rows = rows.withColumn("m", F.explode(match_spans(F.col("line"), o)))
        elif may_match_empty(o.pattern, o.literal):
            rows = rows.withColumn("m", F.element_at(match_spans(F.col("line"), o), 1))
        else:
            rows = rows.withColumn("m", first_span(F.col("line"), o.java()))
        rows = rows.withColumns({"col_start": F.col("m.start") + 1, "col_end": F.col("m.end") + 1, "match": F.col("m.match")})
    if o.replacement is not None:
        new = F.regexp_replace(F.col("match") if o.only_matching else F.col("line"), o.java(), o.replacement)
        rows = rows.withColumn("match" if o.only_matching else "line", new)
    if o.max_count is not None:
        rows = first_per_file(rows, o.max_count, order=("line_no", "col_start"))
    out = ["path", F.col("line_no").cast("int").alias("line_no"), F.col("col_start").cast("int").alias("col_start"), F.col("col_end").cast("int").alias("col_end"), "match", "line", "before", "after"]
    if o.absolute_offset:
        out.append((F.col("line_offset") + F.col("col_start") - 1).cast("long").alias("absolute_offset"))
    return rows.select(*out)


def _grep_files(files: DataFrame, o: GrepOptions) -> DataFrame:
    """Matches over whole files: start and end line and column of each."""
    if o.invert:
        return files.where(~F.col("content").rlike(o.java())).select("path")
    before, after = o.around()
    held = files.where(F.col("content").rlike(o.java())).select("path", "content", F.split("content", "\n", -1).alias("ls"))
    ls = F.col("ls")

    def row(m: Column) -> Column:
        """All of a match, so that neither the content nor its lines leave the file's row."""
        low = F.greatest(m["line_no"] - before, F.lit(1))
        last = F.regexp_replace(m["match"], r"\n\z", "")
        return F.struct(
            m["line_no"].alias("line_no"), m["end_line"].alias("end_line"), m["col_start"].alias("col_start"), m["col_end"].alias("col_end"),
            (m["match"] if o.replacement is None else F.regexp_replace(last, o.java(), o.replacement)).alias("match"),
            F.array_join(F.slice(ls, m["line_no"], m["end_line"] - m["line_no"] + 1), "\n").alias("line"),
            F.slice(ls, low, m["line_no"] - low).alias("before"),
            (F.slice(ls, m["end_line"] + 1, F.lit(after)) if after else F.array().cast("array<string>")).alias("after"),
        )

    found = line_spans(F.col("content"), o.java(), may_match_empty(o.pattern, o.literal))
    rows = held.select("path", F.transform(found, row).alias("rows")).select("path", F.explode("rows").alias("r")).select("path", "r.*")
    if o.max_count is not None:
        rows = first_per_file(rows, o.max_count, order=("line_no", "col_start"))
    return rows.select("path", "line_no", "end_line", "col_start", "col_end", "match", "line", "before", "after")


def count_matches(files: DataFrame, o: GrepOptions, zero: bool = True) -> DataFrame:
    """path, lines that match, occurrences; one pass without shuffling lines: the
    counts are made inside the file's row."""
    files = select_files(files.select("path", "content"), o)
    lines, empty = F.split("content", "\n", -1), may_match_empty(o.pattern, o.literal)

    def times(line: Column) -> Column:
        # of empty matches not every one that the engine finds counts
        return F.size(match_spans(line, o) if empty else F.regexp_extract_all(line, F.lit(o.java()), F.lit(0)))

    none = F.lit(0).cast("long")
    if o.invert:
        counts = F.size(F.filter(lines, lambda line: ~line_matches(line, o))).cast("long"), none
        out = files.select("path", counts[0].alias("lines"), counts[1].alias("occurrences"))
    else:
        # a line meets the pattern once; what has no match but an empty one is a line that matches too
        each = files.select("path", F.transform(lines, lambda line: F.struct(times(line).alias("n"), line_matches(line, o).alias("hit")) if empty else times(line)).alias("each"))
        hit = F.size(F.filter("each", lambda x: x["hit"] if empty else x > 0)).cast("long")
        total = F.aggregate("each", none, lambda n, x: n + (x["n"] if empty else x))
        out = each.select("path", hit.alias("lines"), total.alias("occurrences"))
    return out if zero else out.where("lines > 0")


def files_with_matches(files: DataFrame, o: GrepOptions, without: bool = False) -> DataFrame:
    """Paths of files with a matching line, or without any."""
    files = select_files(files.select("path", "content"), o)
    found = F.exists(F.split("content", "\n", -1), lambda line: ~line_matches(line, o) if o.invert else line_matches(line, o))
    return files.where(~found if without else found).select("path").distinct()


def search_stats(matches: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, bytes, files_matched, lines_matched, matches."""
    scanned = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"))
    found = matches.groupBy("path", "line_no").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("n"))
    found = found.agg(F.count(F.lit(1)).alias("files_matched"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines_matched"), F.coalesce(F.sum("n"), F.lit(0)).alias("matches"))
    return scanned.crossJoin(found)  # a row and a row


def with_options(o: GrepOptions, **changes) -> GrepOptions:
    return replace(o, **changes)
