"""Files to lines, lines to matches: exploding with byte positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def split_lines(content: Column, drop_last_empty: bool = False) -> Column:
    """The lines of a text. With drop_last_empty a final newline ends the last
    line and carriage returns before newlines go; else it begins an empty one."""
    if not drop_last_empty:
        return F.split(content, "\n", -1)
    return F.split(F.regexp_replace(F.regexp_replace(content, r"\r(?=\n|\z)", ""), r"\n\z", ""), "\n", -1)


def explode_lines(files: DataFrame, content: str = "content", drop_last_empty: bool = False) -> DataFrame:
    """A row per line with line_no from 1; the other columns stay."""
    keep = [c for c in files.columns if c != content]
    if drop_last_empty:
        files = files.where(F.length(content) > 0)
    at = files.select(*keep, F.posexplode(split_lines(F.col(content), drop_last_empty)).alias("pos", "line"))
    return at.withColumn("line_no", (F.col("pos") + 1).cast("int")).drop("pos")


#: Items of an array that are walked over before the output is joined.
BLOCK = 64
#: Numbers that are summed up before their text joins the others'.
SUMS = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used: expressions
    inside of lambdas are not shared otherwise."""
    return F.element_at(F.transform(F.array(value), use), 1)


def walked(items: Column, state: dict[str, Column], kind: str, step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """The array of what step(state, item) puts out beside the next state. Blocks of
    items are walked over on their own, so that a long output is not copied at each
    item; kind: the SQL type of what is put out."""
    none = F.array().cast(f"array<{kind}>")

    def one(done: Column, item: Column) -> Column:
        after, out = step(done, item)
        return F.struct(*(c.alias(n) for n, c in after.items()), F.concat(done["out"], F.array(out)).alias("out"))

    def block(done: Column, some: Column) -> Column:
        held = F.struct(*(done[n].alias(n) for n in state), none.alias("out"))
        return bound(F.aggregate(some, held, one), lambda w: F.struct(*(w[n].alias(n) for n in state), F.concat(done["out"], F.array(w["out"])).alias("out")))

    def walk(items: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))
        start = F.struct(*(c.alias(n) for n, c in state.items()), F.array().cast(f"array<array<{kind}>>").alias("out"))
        short = F.aggregate(items, F.struct(*(c.alias(n) for n, c in state.items()), none.alias("out")), one, lambda done: done["out"])
        return F.when(F.size(items) <= BLOCK, short).otherwise(F.flatten(F.aggregate(blocks, start, block, lambda done: done["out"])))

    return bound(items, walk)


#: Marks that are put around matches: characters that no text is to have, several
#: of them, and others for texts that do have them.
_MARKS = (("\ufdd0\ufdd2\ufdd0", "\ufdd0\ufdd3\ufdd0"), ("\ufdd1\ufdd4\ufdd1", "\ufdd1\ufdd5\ufdd1"))


def match_pairs(text: Column, pattern: str, may_be_empty: bool = False) -> Column:
    """array<struct<match, before>>: all matches, each with the text between it and
    the one before, without a UDF. split() leaves the texts between, but loses places
    where nothing is matched: there the matches are marked in the text instead."""
    if not may_be_empty:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        between = F.split(text, pattern, -1)
        return bound(found, lambda found: F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("match"), b.alias("before"))))

    # no match begins between the two halves of a character outside the first plane
    whole = rf"(?![\x{{DC00}}-\x{{DFFF}}])(?:{pattern})"

    def marked(a: str, b: str) -> Column:
        def pairs(pieces: Column) -> Column:
            return F.zip_with(
                F.slice(pieces, 2, F.size(pieces)), F.slice(pieces, 1, F.size(pieces) - 1),
                lambda m, before: F.struct(F.substring_index(m, b, 1).alias("match"), F.substring_index(before, b, -1).alias("before")),
            )

        return bound(F.split(F.regexp_replace(text, whole, f"{a}$0{b}"), a, -1), pairs)

    (a, b), others = _MARKS
    return F.when(~F.contains(text, F.lit(a)) & ~F.contains(text, F.lit(b)), marked(a, b)).otherwise(marked(*others))


def prefix_sums(sizes: Column) -> Column:
    """array<bigint>: the sum of the items before each. The sums are put together as a
    text, which grows at little cost, and in blocks, so that long arrays do too."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def one(done: Column, size: Column) -> Column:
        return F.struct((done["at"] + size).alias("at"), F.concat(done["out"], done["at"].cast("string"), F.lit(" ")).alias("out"))

    def block(done: Column, some: Column) -> Column:
        walk = F.aggregate(some, F.struct(done["at"].alias("at"), F.lit("").alias("out")), one)
        return bound(walk, lambda w: F.struct(w["at"].alias("at"), F.concat(done["out"], w["out"]).alias("out")))

    def walk(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / SUMS).cast("int")), lambda k: F.slice(items, k * SUMS + 1, SUMS))
        text = F.when(F.size(items) <= SUMS, F.aggregate(items, zero, one, lambda done: done["out"])).otherwise(F.aggregate(blocks, zero, block, lambda done: done["out"]))
        return F.slice(F.split(text, " "), 1, F.size(items)).cast("array<bigint>")

    return bound(sizes, walk)


def _placed(pairs: Column) -> Column:
    """array<struct<match, start, end, abuts>> of pairs with the text before each; abuts:
    an empty match at the end of the one before."""

    def place(pairs: Column) -> Column:
        before = prefix_sums(F.transform(pairs, lambda p: (F.octet_length(p["before"]) + F.octet_length(p["match"])).cast("long")))

        def one(p: Column, at: Column) -> Column:
            start = (at + F.octet_length(p["before"])).cast("int")
            abuts = (p["match"] == "") & (p["before"] == "") & (at > 0)
            return F.struct(p["match"].alias("match"), start.alias("start"), (start + F.octet_length(p["match"])).alias("end"), abuts.alias("abuts"))

        return F.zip_with(pairs, before, one)

    return bound(pairs, place)


def spans(text: Column, pattern: str, may_be_empty: bool = False) -> Column:
    """array<struct<match, start, end>> of all matches in bytes from 0. An empty match
    at the end of the one before does not count."""
    out = _placed(match_pairs(text, pattern, may_be_empty))
    out = F.filter(out, lambda m: ~m["abuts"]) if may_be_empty else out
    return F.transform(out, lambda m: F.struct(m["match"].alias("match"), m["start"].alias("start"), m["end"].alias("end")))


def line_spans(text: Column, pattern: str, may_be_empty: bool = False) -> Column:
    """array<struct<match, line_no, end_line, col_start, col_end>> of all matches in a
    text of several lines: lines and byte columns from 1, the end exclusive."""

    def breaks(part: Column) -> Column:
        return F.size(F.split(part, "\n", -1)) - 1

    def located(held: Column) -> Column:
        def one(m: Column, line: Column) -> Column:
            end_line = line + breaks(m["match"])
            return F.struct(
                m["match"].alias("match"), line.alias("line_no"), end_line.alias("end_line"), (m["start"] - F.element_at(held["starts"], line) + 1).cast("int").alias("col_start"),
                (m["end"] - F.element_at(held["starts"], end_line) + 1).cast("int").alias("col_end"), m["abuts"].alias("abuts"),
            )

        # the line of a match: line breaks before it, and in the text between it and the one before
        before = prefix_sums(F.transform(held["pairs"], lambda p: (breaks(p["before"]) + breaks(p["match"])).cast("long")))
        lines = F.zip_with(held["pairs"], before, lambda p, n: (n + breaks(p["before"]) + 1).cast("int"))
        return F.zip_with(_placed(held["pairs"]), lines, one)

    starts = prefix_sums(F.transform(F.split(text, "\n", -1), lambda line: (F.octet_length(line) + 1).cast("long")))
    out = bound(F.struct(match_pairs(text, pattern, may_be_empty).alias("pairs"), starts.alias("starts")), located)
    return F.filter(out, lambda m: ~m["abuts"]) if may_be_empty else out


def first_span(text: Column, pattern: str) -> Column:
    """The first of spans(), without looking for more."""
    start = F.octet_length(F.element_at(F.split(text, pattern, 2), 1))
    match = F.regexp_extract(text, pattern, 0)
    return F.struct(match.alias("match"), start.alias("start"), (start + F.octet_length(match)).alias("end"))


def lines_of(files: DataFrame, wanted: Callable[[Column], Column], before: int = 0, after: int = 0, offset: bool = False, drop_last_empty: bool = False) -> DataFrame:
    """path, line_no, line, before, after (and line_offset, the bytes of the file
    before it) of the wanted lines of files(path, content). Neighbours are cut out of
    the file's own array, so no other line leaves its row and nothing is shuffled."""
    if drop_last_empty:
        files = files.where(F.length("content") > 0)
    held = files.select("path", split_lines(F.col("content"), drop_last_empty).alias("ls"))
    if offset:
        held = held.withColumn("starts", prefix_sums(F.transform("ls", lambda line: (F.octet_length(line) + 1).cast("long"))))
    ls = F.col("ls")

    def row(i: Column) -> Column:
        low = F.greatest(i - before, F.lit(1))
        none = F.array().cast("array<string>")
        return F.struct(
            i.alias("line_no"), F.element_at(ls, i).alias("line"),
            (F.slice(ls, low, i - low) if before else none).alias("before"),
            (F.slice(ls, i + 1, F.lit(after)) if after else none).alias("after"),
            (F.element_at("starts", i) if offset else F.lit(None).cast("long")).alias("line_offset"),
        )

    hits = F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: wanted(F.element_at(ls, i)))
    rows = held.select("path", F.transform(hits, row).alias("rows")).select("path", F.explode("rows").alias("r")).select("path", "r.*")
    return rows if offset else rows.drop("line_offset")


def first_per_file(matches: DataFrame, n: int, key: str = "path", order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """At most n rows of each file, in file order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return matches.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")
