"""Symbols of source files: extraction, modifiers, documentation and scopes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clean_doc, symbol_id
from .lines import explode_lines, split_lines, walked
from .sweep import enclosing

#: Kinds of symbols that open a scope, and the scope's kind.
SCOPE_KINDS = {
    "function": "function", "method": "method", "class": "class", "struct": "struct", "interface": "interface", "enum": "enum", "namespace": "namespace", "module": "module",
    "package": "package", "trait": "interface",
}
#: Other names of kinds in queries.
KIND_ALIASES = {
    "func": "function", "function": "function", "method": "method", "class": "class", "struct": "struct", "interface": "interface", "type": "type", "enum": "enum", "var": "variable",
    "variable": "variable", "const": "constant", "constant": "constant", "field": "field", "param": "parameter", "parameter": "parameter", "prop": "property", "property": "property",
    "import": "import", "package": "package", "module": "module", "namespace": "namespace",
}
TYPE_KINDS = ("type", "struct", "interface", "enum", "class")

_RULES: dict[str, list[tuple[str, str]]] = {
    "go": [
        ("method", r"^func\s+\([^)]*\)\s+(\w+)\s*[\[(]"),
        ("function", r"^func\s+(\w+)\s*[\[(]"),
        ("struct", r"^type\s+(\w+)\s+struct\b"),
        ("interface", r"^type\s+(\w+)\s+interface\b"),
        ("type", r"^type\s+(\w+)\s+[^\s]"),
        ("variable", r"^var\s+(\w+)"),
        ("constant", r"^const\s+(\w+)"),
    ],
    "python": [("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)")],
    "javascript": [("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+([\w$]+)")],
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)"), ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)")],
    "c": [("struct", r"^(?:typedef\s+)?struct\s+(\w+)"), ("function", r"^[A-Za-z_][\w\s*]*[\s*](\w+)\s*\([^;]*$")],
    "java": [("class", r"^\s*(?:public\s+|abstract\s+|final\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)")],
}
_RULES["typescript"] = [
    ("interface", r"^\s*(?:export\s+)?interface\s+([\w$]+)"),
    ("type", r"^\s*(?:export\s+)?type\s+([\w$]+)"),
    *_RULES["javascript"],
]
_RULES["cpp"] = [("class", r"^\s*class\s+(\w+)"), *_RULES["c"]]


def line_rule(language: Column, line: Column) -> Column:
    """struct<kind, name> of the declaration that a line begins, by rules that
    are plain regular expressions; null if none."""
    out = F.lit(None).cast("struct<kind:string,name:string>")
    for lang, rules in _RULES.items():
        own = F.lit(None).cast("struct<kind:string,name:string>")
        for kind, pattern in reversed(rules):
            own = F.when(line.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, pattern, 1).alias("name"))).otherwise(own)
        out = F.when(language == lang, own).otherwise(out)
    return out


def line_symbols(files: DataFrame) -> DataFrame:
    """files(path, language, content) -> path, language, kind, name, line, col:
    without Python and without a shuffle."""
    lines = explode_lines(files.select("path", "language", "content"))
    # a generator's output is not put in place of its name, so the rules meet a line once
    found = lines.withColumn("d", F.explode(F.array(line_rule(F.col("language"), F.col("line"))))).where("d is not null")
    before = F.regexp_extract(F.col("line"), r"^(\s*)", 1)
    return found.select("path", "language", "d.kind", "d.name", F.col("line_no").alias("line"), (F.octet_length(before) + 1).alias("col"))


_SYMBOL = "path string, language string, name string, kind string, type string, start_line int, start_col int, end_line int, end_col int, signature string, doc_string string, scope string, properties map<string,string>"
#: Rows that are handed on at once, and times that a file is tried.
ROWS, ATTEMPTS = 10_000, 3


def _patiently(work: Callable[[], list], pause: float = 0.1) -> tuple[list, str | None]:
    """What work() returns, and why it failed. What may pass, a lack of memory or a
    failing disk, is tried up to ATTEMPTS times."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return work(), None
        except (MemoryError, OSError) as e:
            error = f"{type(e).__name__}: {e}"
            if attempt < ATTEMPTS:
                time.sleep(pause * attempt)
        except Exception as e:  # a parser may be anyone's
            return [], f"{type(e).__name__}: {e}"
    return [], error


def _arrow_rows(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    arrow = pa.schema([(f.name, pa.map_(pa.string(), pa.string()) if f.name == "properties" else pa.int32() if f.dataType == T.IntegerType() else pa.string()) for f in schema.fields])
    while some := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), arrow)], schema=arrow)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def modifiers(language: Column, name: Column) -> Column:
    """Visibility by naming: go by the first letter's case, python and scripts by
    underscores; rust counts as private unless marked."""
    first = F.substring(name, 1, 1)
    python = (
        F.when(F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__")), "magic")
        .when(F.startswith(name, F.lit("__")), "private")
        .when(F.startswith(name, F.lit("_")), "protected")
        .otherwise("public")
    )
    script = F.when(F.startswith(name, F.lit("_")), "private").otherwise("public")
    go = F.when(F.upper(first) == first, "public").otherwise("private")
    one = F.when(language == "go", go).when(language == "python", python).when(language.isin("javascript", "typescript"), script).when(language == "rust", F.lit("private"))
    return F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


def parsed_symbols(files: DataFrame, details: bool = False, parsers: dict[str, Callable[[str], list[tuple]]] | None = None, errors: bool = True) -> DataFrame:
    """The symbols table, and in a column `error`, in rows of their own with a place,
    which files failed and, with errors, what does not parse; a file at a time in Arrow
    batches, without a shuffle."""
    schema = T._parse_datatype_string(f"{_SYMBOL}, error string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions.scanners import described
        from ..functions.scanners import syntax_errors as found_errors

        def rows() -> Iterator[tuple]:
            for path, language, content in _files(batches):
                own = (parsers or {}).get(language)
                found, failed = _patiently(lambda: described(content, language, details, own))
                for row in found:
                    yield (path, language, *row, None)
                wrong = [(1, 1, failed)] if failed else _patiently(lambda: found_errors(content, language))[0] if errors and not own else []
                for line, col, message in wrong:
                    yield (path, language, None, None, None, line, col, None, None, None, None, None, None, message)

        yield from _arrow_rows(rows(), schema)

    found = files.select("path", "language", "content").mapInArrow(run, schema)
    visible = modifiers(F.col("language"), F.col("name"))
    tags = F.when(F.array_contains(visible, "public"), F.array(F.lit("exported"))).otherwise(F.array().cast("array<string>"))
    return found.select(
        symbol_id(F.col("path"), F.col("start_line"), F.col("start_col"), F.col("kind"), F.col("name")).alias("id"),
        "name", "kind", "type", "language", F.col("path").alias("file_path"), "start_line", "end_line", "start_col", "end_col", "signature", clean_doc(F.col("doc_string")).alias("doc_string"),
        "scope", visible.alias("modifiers"), tags.alias("tags"), "properties", F.current_timestamp().alias("last_updated"), "error",
    )


def symbols_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is null").drop("error")


def extract_symbols(files: DataFrame, details: bool = False, parsers: dict[str, Callable[[str], list[tuple]]] | None = None) -> DataFrame:
    """files(path, language, content) -> the symbols table. details: methods, fields,
    imports, variables and constants too, where the plain declarations leave them out.
    parsers: functions for further languages, or in place of the own ones, from a source
    to (name, kind, start_line, start_col, end_line, end_col, signature, doc, type). A
    file that fails has no symbols; parsed_symbols() has a row that says why."""
    return symbols_of(parsed_symbols(files, details, parsers, errors=False))


def syntax_errors(files: DataFrame, parsers: dict[str, Callable[[str], list[tuple]]] | None = None) -> DataFrame:
    """path, line, col, message of what does not parse."""
    wrong = parsed_symbols(files, parsers=parsers).where("error is not null")
    return wrong.select(F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.col("start_col").alias("col"), F.col("error").alias("message"))


def documented_lines(files: DataFrame, wanted: Callable[[Column], Column]) -> DataFrame:
    """path, line_no, line, comment, doc of the wanted lines of code of files(path,
    content). comment: the // comment on the line directly above; doc: all // comments
    above, over blank lines, up to the line of code before, joined by spaces. The
    lines are walked over inside the file's row: nothing is sorted or shuffled."""

    def step(done: Column, line: Column) -> tuple[dict[str, Column], Column]:
        text = F.trim(line)
        comment = F.when(F.startswith(text, F.lit("//")), F.trim(F.regexp_replace(text, r"^//", "")))
        none = F.array().cast("array<string>")
        held = F.when(comment.isNotNull(), F.concat(done["held"], F.array(comment))).when(text == "", done["held"]).otherwise(none)
        after = {"n": done["n"] + 1, "held": held, "above": comment}
        return after, F.struct(done["n"].alias("line_no"), line.alias("line"), done["above"].alias("comment"), F.nullif(F.array_join(done["held"], " "), F.lit("")).alias("doc"))

    state = {"n": F.lit(1), "held": F.array().cast("array<string>"), "above": F.lit(None).cast("string")}
    rows = walked(split_lines(F.col("content")), state, "struct<line_no:int,line:string,comment:string,doc:string>", step)
    rows = F.filter(rows, lambda r: wanted(r["line"]))
    return files.select("path", rows.alias("rows")).select("path", F.explode("rows").alias("r")).select("path", "r.*")


def scopes(symbols: DataFrame) -> DataFrame:
    """id, parent_id (null at the top), scope_kind: the innermost symbol of the
    same file that opens a scope around it; of equally long ones the smallest id. One
    walk over each file's symbols in order."""
    kinds = F.element_at(F.create_map(*(F.lit(x) for kv in SCOPE_KINDS.items() for x in kv)), F.col("kind"))
    place = (F.col("file_path").alias("file"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    outer = symbols.where(F.col("kind").isin(*SCOPE_KINDS)).select(*place, "id")
    found = enclosing(outer, symbols.select(*place, F.struct("id", kinds.alias("scope_kind")).alias("key")))
    return found.select("key.id", "key.scope_kind", F.col("around").alias("parent_id"))


def kind_alias(name: str) -> str:
    return KIND_ALIASES.get(name.lower(), name.lower())


def language_features(spark: SparkSession) -> DataFrame:
    """language, kind, by_line, by_span: what each language's symbols can be, by
    line rules and by the table function."""
    from ..functions.scanners import DETAILS
    from ..functions.scanners import _RULES as spans

    by_span = {lang: {k for k, *_ in (*rules, *DETAILS.get(lang, ()))} for lang, rules in spans.items()} | {"python": {"function", "class", "import", "variable"}}
    rows = []
    for lang in sorted({*_RULES, *by_span}):
        line = {k for k, _ in _RULES.get(lang, ())}
        rows += [(lang, k, k in line, k in by_span.get(lang, set())) for k in sorted(line | by_span.get(lang, set()))]
    return spark.createDataFrame(rows, "language string, kind string, by_line boolean, by_span boolean")
