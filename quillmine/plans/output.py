"""Results as text, JSON messages, JSON lines, counts and file lists.

Each writer is a DataFrame with one text column ``value`` and the columns it is
ordered by, ready for ``write.text`` or a console.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terminal colours.
COLORS = {"path": "\x1b[35m", "line": "\x1b[32m", "match": "\x1b[1m\x1b[31m", "reset": "\x1b[0m"}


def group_by_file(matches: DataFrame) -> DataFrame:
    """path, matches in line order."""
    row = F.struct(*(c for c in ("line_no", "col_start", "col_end", "match", "line") if c in matches.columns))
    return matches.groupBy("path").agg(F.sort_array(F.collect_list(row)).alias("matches"))


def per_line(matches: DataFrame) -> DataFrame:
    """A row per line with its submatches(text, start, end), bytes from 0."""
    sub = F.struct((F.col("col_start") - 1).alias("start"), (F.col("col_end") - 1).alias("end"), F.col("match").alias("text"))
    offset = [F.min(F.col("absolute_offset") - F.col("col_start") + 1).alias("absolute_offset")] if "absolute_offset" in matches.columns else [F.lit(0).cast("long").alias("absolute_offset")]
    return matches.groupBy("path", "line_no", "line").agg(F.array_sort(F.collect_set(sub)).alias("submatches"), *offset)


def highlighted(line: Column, submatches: Column, color: str = COLORS["match"]) -> Column:
    """The line with its byte spans coloured."""
    raw = F.encode(line, "UTF-8")

    def cut(a: Column, b: Column) -> Column:
        return F.decode(F.substring(raw, a + 1, b - a), "UTF-8")

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    done = F.aggregate(
        submatches, start, lambda s, m: F.struct(F.concat(s["text"], cut(s["at"], m["start"]), F.lit(color), cut(m["start"], m["end"]), F.lit(COLORS["reset"])).alias("text"), m["end"].cast("int").alias("at"))
    )
    return F.concat(done["text"], cut(done["at"], F.octet_length(line)))


def text_output(matches: DataFrame, heading: bool = False, line_numbers: bool = True, filename: bool = True, color: bool = False, only_matching: bool = False, path_separator: str = "/", null: bool = False) -> DataFrame:
    """path:line:text per matching line with context lines path-line-text around."""
    path = F.col("path") if path_separator == "/" else F.translate("path", "/", path_separator)
    shown = F.concat(F.lit(COLORS["path"]), path, F.lit(COLORS["reset"])) if color else path
    end = "\x00" if null else None

    def row(number: Column, text: Column, mark: str) -> Column:
        parts = []
        if filename and not heading:
            parts += [shown, F.lit(end or mark)]
        if line_numbers:
            parts += [number.cast("string"), F.lit(mark)]
        return F.concat(*parts, text)

    if only_matching:
        out = matches.select("path", "line_no", F.col("col_start").alias("order"), row(F.col("line_no"), F.col("match"), ":").alias("value"))
    else:
        lines = per_line(matches)
        text = highlighted(F.col("line"), F.col("submatches")) if color else F.col("line")
        out = lines.select("path", "line_no", F.lit(0).alias("order"), row(F.col("line_no"), text, ":").alias("value"))
        if "before" in matches.columns:
            around = matches.select("path", "line_no", "before", "after").dropDuplicates(["path", "line_no"])
            before = around.select("path", "line_no", F.posexplode("before").alias("k", "text"), F.size("before").alias("n"))
            before = before.select("path", (F.col("line_no") - F.col("n") + F.col("k")).alias("line_no"), F.lit(0).alias("order"), row(F.col("line_no") - F.col("n") + F.col("k"), F.col("text"), "-").alias("value"))
            after = around.select("path", "line_no", F.posexplode("after").alias("k", "text"))
            after = after.select("path", (F.col("line_no") + F.col("k") + 1).alias("line_no"), F.lit(0).alias("order"), row(F.col("line_no") + F.col("k") + 1, F.col("text"), "-").alias("value"))
            context = before.unionByName(after).dropDuplicates(["path", "line_no"]).join(out.select("path", "line_no"), ["path", "line_no"], "left_anti")
            out = out.unionByName(context)
    if heading:
        heads = out.groupBy("path").agg(F.lit(0).alias("line_no")).select("path", "line_no", F.lit(-1).alias("order"), shown.alias("value"))
        out = out.unionByName(heads)
    return out.orderBy("path", "line_no", "order")


def count_output(matches: DataFrame, filename: bool | None = None) -> DataFrame:
    """path:count; the name only if asked for or if there are several files."""
    counts = matches.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    if filename is None:
        filename = counts.limit(2).count() > 1
    value = F.concat_ws(":", "path", F.col("n").cast("string")) if filename else F.col("n").cast("string")
    return counts.select("path", value.alias("value")).orderBy("path")


def files_output(matches: DataFrame) -> DataFrame:
    return matches.select("path").distinct().select("path", F.col("path").alias("value")).orderBy("path")


def _text(col: Column) -> Column:
    return F.struct(col.alias("text"))


def _context_messages(matches: DataFrame) -> DataFrame:
    """context messages of the lines around matches that hold none themselves."""
    around = matches.select("path", "line_no", "before", "after").dropDuplicates(["path", "line_no"])
    before = around.select("path", F.col("line_no").alias("at"), F.posexplode("before").alias("k", "text"), F.size("before").alias("n"))
    after = around.select("path", F.col("line_no").alias("at"), F.posexplode("after").alias("k", "text"))
    rows = before.select("path", (F.col("at") - F.col("n") + F.col("k")).alias("line_no"), "text").unionByName(after.select("path", (F.col("at") + F.col("k") + 1).alias("line_no"), "text"))
    rows = rows.groupBy("path", "line_no").agg(F.min("text").alias("text")).join(around.select("path", "line_no"), ["path", "line_no"], "left_anti")
    data = F.struct(_text(F.col("path")).alias("path"), _text(F.concat("text", F.lit("\n"))).alias("lines"), F.col("line_no").alias("line_number"), F.array().cast("array<string>").alias("submatches"))
    return rows.select("path", F.lit(1).alias("step"), "line_no", F.to_json(F.struct(F.lit("context").alias("type"), data.alias("data"))).alias("value"))


def json_messages(matches: DataFrame, elapsed: float = 0.0, searched: int | None = None, bytes_searched: int = 0, context: bool = True) -> DataFrame:
    """begin, match, context and end messages of each file and a summary, in order, as
    the common line-oriented search format has them."""
    lines = per_line(matches)
    subs = F.transform("submatches", lambda s: F.struct(_text(s["text"]).alias("match"), s["start"].alias("start"), s["end"].alias("end")))
    data = F.struct(_text(F.col("path")).alias("path"), _text(F.concat(F.col("line"), F.lit("\n"))).alias("lines"), F.col("line_no").alias("line_number"), "absolute_offset", subs.alias("submatches"))
    match = lines.select("path", F.lit(1).alias("step"), "line_no", F.to_json(F.struct(F.lit("match").alias("type"), data.alias("data"))).alias("value"))
    per_file = lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size("submatches")).alias("n"))
    begin = per_file.select("path", F.lit(0).alias("step"), F.lit(0).alias("line_no"), F.to_json(F.struct(F.lit("begin").alias("type"), F.struct(_text(F.col("path")).alias("path")).alias("data"))).alias("value"))
    stats = F.struct(F.lit(1).alias("searches"), F.lit(1).alias("searches_with_match"), F.col("lines").alias("matched_lines"), F.col("n").alias("matches"))
    end_data = F.struct(_text(F.col("path")).alias("path"), F.lit(None).cast("long").alias("binary_offset"), stats.alias("stats"))
    end = per_file.select("path", F.lit(2).alias("step"), F.lit(0).alias("line_no"), F.to_json(F.struct(F.lit("end").alias("type"), end_data.alias("data")), {"ignoreNullFields": "false"}).alias("value"))
    took = F.struct(F.lit(int(elapsed)).alias("secs"), F.lit(int(elapsed % 1 * 1e9)).alias("nanos"), F.lit(f"{elapsed:.6f}s").alias("human"))
    total = per_file.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    all_stats = F.struct(
        (F.col("files") if searched is None else F.lit(searched)).alias("searches"), F.col("files").alias("searches_with_match"), F.lit(bytes_searched).alias("bytes_searched"),
        F.col("lines").alias("matched_lines"), F.col("n").alias("matches"),
    )
    summary = total.select(
        F.lit("\U0010ffff").alias("path"), F.lit(3).alias("step"), F.lit(0).alias("line_no"),
        F.to_json(F.struct(F.lit("summary").alias("type"), F.struct(took.alias("elapsed_total"), all_stats.alias("stats")).alias("data"))).alias("value"),
    )
    if context and {"before", "after"} <= set(matches.columns):
        match = match.unionByName(_context_messages(matches))
    return begin.unionByName(match).unionByName(end).unionByName(summary).orderBy("path", "step", "line_no")


def json_lines(matches: DataFrame) -> DataFrame:
    """A flat object per match, with what is known of the symbol if anything is."""
    fields = [c for c in ("path", "line_no", "col_start", "col_end", "match", "line", "before", "after", "absolute_offset", "metadata", "origin") if c in matches.columns]
    return matches.select("path", "line_no", "col_start", F.to_json(F.struct(*fields)).alias("value")).orderBy("path", "line_no", "col_start")


def semantic_messages(matches: DataFrame, symbols: DataFrame) -> DataFrame:
    """Match messages with the symbol that begins at the match, where one does;
    the field is left out where none does."""
    known = symbols.select(
        F.col("file_path").alias("path"), F.col("start_line").alias("line_no"), F.struct("name", "kind", "type", "signature", "scope", F.col("doc_string").alias("doc"), "modifiers").alias("semantic")
    )
    one = known.groupBy("path", "line_no").agg(F.min("semantic").alias("semantic"))
    rows = matches.join(one, ["path", "line_no"], "left")
    data = F.struct(_text(F.col("path")).alias("path"), _text(F.col("line")).alias("lines"), F.col("line_no").alias("line_number"), "col_start", "col_end", "semantic")
    return rows.select("path", "line_no", "col_start", F.to_json(F.struct(F.lit("match").alias("type"), data.alias("data"))).alias("value")).orderBy("path", "line_no", "col_start")


def json_lines_summary(matches: DataFrame) -> DataFrame:
    ext = F.regexp_extract("path", r"\.[^./]*\z", 0)
    by = matches.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.to_json(F.struct(F.sum("n").alias("matches"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("ext", "n")))).alias("extensions"))).alias("value"))


def json_counts(matches: DataFrame) -> DataFrame:
    n = matches.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return n.select("path", F.to_json(F.struct(F.lit("match").alias("type"), F.struct(_text(F.col("path")).alias("path"), F.col("n").alias("count")).alias("data"))).alias("value")).orderBy("path")


def json_files(matches: DataFrame) -> DataFrame:
    p = matches.select("path").distinct()
    return p.select("path", F.to_json(F.struct(F.lit("match").alias("type"), F.struct(_text(F.col("path")).alias("path")).alias("data"))).alias("value")).orderBy("path")


def invalid_messages(values: DataFrame) -> DataFrame:
    """Of values(value), those that are no message of the format."""
    m = F.from_json("value", "type string, data struct<path:struct<text:string>, lines:struct<text:string>, line_number:long, submatches:array<struct<start:int,end:int>>, stats:map<string,string>>")
    kind, data = m["type"], m["data"]
    path = data["path"]["text"].isNotNull()
    fine = (
        F.when(kind == "begin", path)
        .when(kind == "match", path & data["lines"]["text"].isNotNull() & data["line_number"].isNotNull() & data["submatches"].isNotNull())
        .when(kind == "end", path & data["stats"].isNotNull())
        .when(kind == "context", path)
        .when(kind == "summary", data["stats"].isNotNull())
        .otherwise(False)
    )
    return values.where(~F.coalesce(fine, F.lit(False)))


def library_text(results: DataFrame, line_numbers: bool = True, heading: bool = True) -> DataFrame:
    """A line per result as the library prints it: place, text or match and, where a
    symbol is known from metadata or from its own columns, its kind and name."""

    def known(field: str) -> Column:
        own = [F.col(field)] if field in results.columns else []
        return F.coalesce(*own, *([F.element_at("metadata", field)] if "metadata" in results.columns else []), F.lit(None).cast("string"))

    text = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("line", "match") if c in results.columns), F.lit(""))
    number = F.concat(F.col("line_no").cast("string"), F.lit(":")) if line_numbers else F.lit("")
    col = F.when(F.col("col_start") > 0, F.concat(F.col("col_start").cast("string"), F.lit(":"))).otherwise("")
    path = F.lit("") if heading else F.concat("path", F.lit(":"))
    symbol = F.when(known("name").isNotNull(), F.concat(F.lit(" ["), F.coalesce(known("kind"), F.lit("")), F.lit(": "), known("name"), F.lit("]"))).otherwise("")
    out = results.select("path", "line_no", "col_start", F.lit(1).alias("step"), F.concat(path, number, col, text, symbol).alias("value"))
    if heading:
        heads = results.select("path").distinct().select("path", F.lit(0).alias("line_no"), F.lit(0).alias("col_start"), F.lit(0).alias("step"), F.concat(F.lit("\n"), "path").alias("value"))
        out = out.unionByName(heads)
    return out.orderBy("path", "step", "line_no", "col_start")


def library_json(results: DataFrame) -> DataFrame:
    """A match message per result, with what is known of its symbol."""
    extra = [c for c in ("name", "kind", "type", "scope", "metadata") if c in results.columns]
    sub = F.struct(_text(F.col("match")).alias("match"), (F.col("col_start") - 1).alias("start"), (F.col("col_start") - 1 + F.octet_length("match")).alias("end"))
    line = F.col("line") if "line" in results.columns else F.col("match")
    data = F.struct(_text(F.col("path")).alias("path"), _text(line).alias("lines"), F.col("line_no").alias("line_number"), F.array(sub).alias("submatches"), *extra)
    return results.select("path", "line_no", "col_start", F.to_json(F.struct(F.lit("match").alias("type"), data.alias("data"))).alias("value")).orderBy("path", "line_no", "col_start")


def stats_text(stats: DataFrame) -> DataFrame:
    """The one row of search statistics as lines of text."""
    names = [c for c in stats.columns]
    lines = F.array(F.lit("Search statistics:"), *(F.concat(F.lit(f"  {n.replace('_', ' ')}: "), F.col(n).cast("string")) for n in names))
    return stats.select(F.posexplode(lines).alias("k", "value")).orderBy("k").select("value")


def stats_json(stats: DataFrame) -> DataFrame:
    return stats.select(F.to_json(F.struct(F.lit("stats").alias("type"), F.struct(*stats.columns).alias("data"))).alias("value"))


WRITERS = {"library": library_text, "library-json": library_json, "text": text_output, "json": json_messages, "jsonl": json_lines, "count": count_output, "files": files_output, "json-count": json_counts, "json-files": json_files}


def render(matches: DataFrame, form: str = "text", **options) -> DataFrame:
    if form not in WRITERS:
        raise ValueError(f"unknown format {form!r}")
    return WRITERS[form](matches, **options)
