"""Small scalar functions over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of sizes, each 1024 times the one before.
_UNITS = ("KB", "MB", "GB", "TB", "PB", "EB")


def sha256_hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def human_bytes(size: Column, units: tuple[str, ...] = _UNITS) -> Column:
    """512 B, 1.5 KB, ...; the last of the units takes all larger sizes. What lies in the
    middle goes to the even digit, as printf has it: 1.25 KB are 1.2 KB, where Java's
    format would make them 1.3."""
    out = F.format_string("%d B", size.cast("long"))
    for n, unit in enumerate(units, 1):
        out = F.when(size >= 1024**n, F.format_string(f"%.1f {unit}", F.bround(size.cast("double") / 1024**n, 1))).otherwise(out)
    return out


def duration_struct(seconds: Column) -> Column:
    nanos = F.round((seconds - F.floor(seconds)) * 1_000_000_000).cast("long")
    return F.struct(F.floor(seconds).cast("long").alias("secs"), nanos.alias("nanos"), F.format_string("%.6fs", seconds.cast("double")).alias("human"))


def symbol_id(path: Column, line: Column, col: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"), col.cast("string"), kind, name)


def store_key(kind: str, *parts: Column) -> Column:
    """The key strings of the stored records: hashed paths and ids, lower-cased names."""
    if kind == "sym":
        return F.concat_ws(":", F.lit("sym"), sha256_hex(parts[0]), parts[1])
    if kind in ("file", "query"):
        return F.concat_ws(":", F.lit(kind), sha256_hex(parts[0]))
    if kind == "ref":
        return F.concat_ws(":", F.lit("ref"), sha256_hex(parts[0]), sha256_hex(parts[1]), parts[2].cast("string"))
    if kind in ("name", "type", "tag"):
        return F.concat_ws(":", F.lit(kind), F.lower(parts[0]))
    raise ValueError(f"unknown record {kind!r}")


def clean_doc(text: Column) -> Column:
    """A comment without its markers."""
    out = F.btrim(text, F.lit(" \t\n\r\v\f"))
    for marks in ("/*", '"', "'"):
        out = F.btrim(out, F.lit(marks))
    return out
