"""Predicates on paths, contents and symbols, as Columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import glob_pattern

#: The file extensions behind each type name.
TYPE_EXTENSIONS = {
    "go": (".go",),
    "py": (".py",),
    "python": (".py",),
    "js": (".js",),
    "javascript": (".js",),
    "ts": (".ts", ".tsx"),
    "typescript": (".ts", ".tsx"),
    "rs": (".rs",),
    "rust": (".rs",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cxx", ".cc", ".hpp"),
    "cxx": (".cpp", ".cxx", ".cc", ".hpp"),
    "java": (".java",),
}
#: Directories that source collection never enters.
PRUNED_DIRS = (".git", "node_modules", "target", "__pycache__")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*\z", 0)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)


def extension(path: Column) -> Column:
    """From the last dot of the name on; empty if there is none."""
    return F.regexp_extract(basename(path), r"\.[^.]*\z", 0)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def has_type(path: Column, types: Iterable[str]) -> Column:
    """Unknown type names match nothing."""
    known = sorted({e for t in types for e in TYPE_EXTENSIONS.get(t, ())})
    return F.lower(extension(path)).isin(known) if known else F.lit(False)


def ends_with_type(path: Column, endings: Iterable[str]) -> Column:
    """The looser test: the lower-cased extension ends with one of the strings."""
    out = F.lit(False)
    for e in endings:
        out |= F.endswith(F.lower(extension(path)), F.lit(e.lower()))
    return out


def matches_glob(path: Column, globs: Iterable[str], full_path: bool = False) -> Column:
    """Whether the file name, or with full_path also the whole path, fits a glob."""
    out = F.lit(False)
    for g in globs:
        java = glob_pattern(g)
        out |= basename(path).rlike(java)
        if full_path:
            out |= path.rlike(java)
            if g.endswith("/*"):  # a directory's glob holds for all below it
                out |= F.contains(F.concat(F.lit("/"), path), F.lit(f"/{g[:-1]}"))
    return out


def is_hidden(rel_path: Column) -> Column:
    """A component of the relative path begins with a dot."""
    return F.exists(F.split(rel_path, "/"), lambda x: F.startswith(x, F.lit(".")) & ~x.isin(".", ".."))


def path_filters(
    files: DataFrame,
    path: str = "path",
    types: Iterable[str] = (),
    not_types: Iterable[str] = (),
    globs: Iterable[str] = (),
    not_globs: Iterable[str] = (),
    hidden: bool = True,
    max_depth: int | None = None,
) -> Column:
    col, keep = F.col(path), F.lit(True)
    if types:
        keep &= has_type(col, types)
    if not_types:
        keep &= ~has_type(col, not_types)
    if globs:
        keep &= matches_glob(col, globs)
    if not_globs:
        keep &= ~matches_glob(col, not_globs)
    if not hidden:
        keep &= ~is_hidden(col)
    if max_depth is not None:
        keep &= depth(col) <= max_depth
    return keep


def index_file_filter(path: Column, include: Iterable[str], exclude: Iterable[str]) -> Column:
    """Exclusion first, then inclusion; both by name or by path."""
    return ~matches_glob(path, exclude, True) & (matches_glob(path, include, True) if include else F.lit(True))


def size_between(size: Column, low: int | None = None, high: int | None = None) -> Column:
    keep = F.lit(True)
    if low is not None:
        keep &= size >= low
    if high is not None:
        keep &= size <= high
    return keep


def _bytes(content: Column) -> Column:
    return content.cast("binary")


_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def is_binary(content: Column, check: str = "nul") -> Column:
    """nul: a zero byte in the first 8192. strict: in the first 512 a zero byte or
    a control character other than tab, newline and return, or invalid UTF-8.
    utf8: a zero byte in the first 8192, or invalid UTF-8. ratio: in the first 512
    a zero byte, three control characters in a row, or over 30 % of them."""
    raw = _bytes(content)
    zero = F.lit(b"\x00")

    def has_zero(n: int) -> Column:
        return F.position(zero, F.substring(raw, 1, n)) > 0

    if check == "nul":
        return has_zero(8192)
    if check == "utf8":
        return has_zero(8192) | ~F.is_valid_utf8(raw.cast("string"))
    head = F.decode(F.substring(raw, 1, 512), "ISO-8859-1")
    if check == "strict":
        return head.rlike(_CONTROL) | ~F.is_valid_utf8(raw.cast("string"))
    if check == "ratio":
        controls = F.regexp_count(head, F.lit(_CONTROL))
        return has_zero(512) | head.rlike(_CONTROL + "{3}") | (controls > 0.3 * F.length(head))
    raise ValueError(f"unknown check {check!r}")


_FIELDS = {"name", "type", "kind", "file_path"}


def symbol_filter(field: str, op: str, value: str) -> Column:
    """One condition on a stored symbol: equals keeps the case, contains and
    startswith ignore it; an unknown field passes all, an unknown operator none."""
    if field not in _FIELDS:
        return F.lit(True)
    col = F.coalesce(F.col(field), F.lit(""))
    if op == "equals":
        return col == value
    if op == "contains":
        return F.contains(F.lower(col), F.lit(value.lower()))
    if op == "startswith":
        return F.startswith(F.lower(col), F.lit(value.lower()))
    return F.lit(False)


def name_matches(name: Column, pattern: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    a, b = (name, pattern) if case_sensitive else (F.lower(name), pattern.lower())
    return a == b if whole_word else F.contains(a, F.lit(b))


def walk_stats(files: DataFrame, kept: Column) -> DataFrame:
    """One row for files(path, size, error) as a walk found them: files found, those
    that a filter left out, directories, errors, and the bytes of what is kept."""
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    taken = F.coalesce(kept, F.lit(False)) & F.col("error").isNull()
    return files.agg(
        F.count(F.lit(1)).alias("found"), F.count_if(taken).alias("kept"), F.count_if(~taken & F.col("error").isNull()).alias("filtered"), F.count("error").alias("errors"),
        F.count_distinct(parent).alias("directories"), F.coalesce(F.sum(F.when(taken, F.col("size"))), F.lit(0)).cast("long").alias("bytes"),
    )
