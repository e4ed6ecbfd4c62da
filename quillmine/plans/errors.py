"""Errors of a search: types, classification, policy and summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SearchError(Exception):
    kind = "unknown"

    def __init__(self, message: str, path: str | None = None, line: int | None = None, operation: str | None = None):
        super().__init__(message)
        self.path, self.line, self.operation = path, line, operation

    def __str__(self) -> str:
        place = f"{self.path}:{self.line}" if self.line else self.path or ""
        return ": ".join(x for x in (self.kind, place, super().__str__()) if x)


class InvalidPattern(SearchError):
    kind = "invalid_pattern"


class FileAccessError(SearchError):
    kind = "file_access"


class BinaryFileError(SearchError):
    kind = "binary_file"


class FileTooLarge(SearchError):
    kind = "file_too_large"


class ParseFailure(SearchError):
    kind = "parse"


class SearchTimeout(SearchError):
    kind = "timeout"


class TooManyFailures(SearchError):
    kind = "too_many_failures"


#: Parts of messages that tell an error's kind.
_SIGNS = (
    ("permission denied", "permission_denied"), ("no such file", "file_not_found"), ("not found", "file_not_found"), ("too large", "file_too_large"), ("binary", "binary_file"),
    ("timeout", "timeout"), ("timed out", "timeout"), ("deadline", "timeout"), ("cancel", "cancelled"), ("syntax", "parse"), ("parse", "parse"), ("regexp", "invalid_pattern"), ("pattern", "invalid_pattern"),
)
#: What to do about each kind; the others skip the file.
RECOVERY = {"timeout": "retry", "cancelled": "abort", "invalid_pattern": "abort", "too_many_failures": "abort", "directory_access": "skip_directory"}


def error_kind(message: Column) -> Column:
    out = F.lit("unknown")
    for sign, kind in reversed(_SIGNS):
        out = F.when(F.contains(F.lower(message), F.lit(sign)), kind).otherwise(out)
    return out


def recovery(kind: Column) -> Column:
    out = F.lit("skip_file")
    for k, action in RECOVERY.items():
        out = F.when(kind == k, action).otherwise(out)
    return out


def error_summary(errors: DataFrame) -> DataFrame:
    """type, n: errors by type."""
    return errors.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def error_details(errors: DataFrame, limit: int = 10) -> DataFrame:
    return errors.orderBy("type", "file_path", "line").limit(limit)


@dataclass(frozen=True)
class ErrorPolicy:
    """Which files a search passes over, and how many errors it shows."""

    skip_binary: bool = True
    max_bytes: int | None = None
    most: int = 1000

    def apply(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The files(path, content, error) to be searched, and the errors of the rest:
        type, message, file_path, what to do."""
        from ..operators.filters import is_binary

        reason = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
        if self.max_bytes is not None:
            reason = F.coalesce(reason, F.when(F.octet_length("content") > self.max_bytes, F.concat(F.lit("file too large: "), F.octet_length("content").cast("string"))))
        if self.skip_binary:
            reason = F.coalesce(reason, F.when(is_binary(F.col("content"), "nul"), "binary file"))
        marked = files.withColumn("reason", reason)
        bad = marked.where("reason is not null").select(error_kind(F.col("reason")).alias("type"), F.col("reason").alias("message"), F.col("path").alias("file_path"))
        return marked.where("reason is null").drop("reason"), bad.withColumn("action", recovery(F.col("type"))).orderBy("file_path").limit(self.most)


def wrapped(error: Exception, path: str | None = None, operation: str | None = None) -> SearchError:
    """An error as one of the search's own, by the signs in its message."""
    if isinstance(error, SearchError):
        return error
    low = str(error).lower()
    kind = next((k for sign, k in _SIGNS if sign in low), "unknown")
    own = {c.kind: c for c in SearchError.__subclasses__()}
    made = own.get({"permission_denied": "file_access", "file_not_found": "file_access"}.get(kind, kind), SearchError)(str(error), path, operation=operation)
    made.kind = kind
    return made


def abort_if_failing(files: DataFrame, share: float = 0.5) -> None:
    """Raise if more than this share of files(error) failed."""
    row = files.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad")).first()
    if row.n and row.bad > share * row.n:
        raise TooManyFailures(f"{row.bad} of {row.n} files failed")
