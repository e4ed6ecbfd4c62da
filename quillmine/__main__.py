"""Command line: search a tree, or keep an index of one."""

from __future__ import annotations

import argparse
import json
import re
import sys

from .plans.config import settings


def size_of(text: str) -> int:
    m = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", text.strip().lower())
    if not m:
        raise argparse.ArgumentTypeError(f"not a size: {text}")
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmine", description=__doc__)
    p.add_argument("pattern", nargs="?")
    p.add_argument("paths", nargs="*", default=["."])
    for flags, name in (
        ("-i --ignore-case", "ignore_case"), ("-c --count", "count"), ("-l --files-with-matches", "files"), ("--files-without-match", "files_without"), ("-o --only-matching", "only_matching"),
        ("-w --word-regexp", "word"), ("-x --line-regexp", "whole_line"), ("-F --fixed-strings", "literal"), ("-U --multiline", "across_lines"), ("--multiline-dotall", "dot_all"),
        ("-v --invert-match", "invert"), ("--hidden", "hidden"), ("-q --quiet", "quiet"), ("-a --text", "binary_as_text"), ("--json", "json"), ("--jsonl", "jsonl"), ("--no-heading", "no_heading"),
        ("-0 --null", "null"), ("--no-ignore", "no_ignore"), ("--symbols", "symbols"), ("--refs", "refs"), ("--types", "types_mode"), ("--call-graph", "call_graph"), ("--no-index", "no_index"),
        ("--rebuild-index", "rebuild_index"), ("--details", "details"), ("--index-status", "index_status"), ("--index-clear", "index_clear"), ("-n --line-number", "line_number"), ("-H --with-filename", "with_filename"),
    ):
        p.add_argument(*flags.split(), dest=name, action="store_true", default=None)
    for flags, name, kind in (
        ("-A --after-context", "after", int), ("-B --before-context", "before", int), ("-C --context", "context", int), ("-m --max-count", "max_count", int), ("--max-depth", "max_depth", int),
        ("--max-filesize", "max_filesize", size_of), ("-j --threads", "threads", int), ("-r --replace", "replacement", str), ("--color", "color", str), ("--path-separator", "path_separator", str),
        ("--index-path", "index_path", str), ("--config", "config", str),
    ):
        p.add_argument(*flags.split(), dest=name, type=kind)
    for flags, name in (("-t --type", "types"), ("-T --type-not", "not_types"), ("-g --glob", "globs"), ("--iglob", "not_globs")):
        p.add_argument(*flags.split(), dest=name, action="append")
    return p


def check(o: dict) -> None:
    modes = [m for m in ("symbols", "refs", "types_mode", "call_graph") if o.get(m)]
    if len(modes) > 1:
        raise ValueError("only one of --symbols, --refs, --types and --call-graph")
    if modes and (o.get("literal") or o.get("replacement") is not None):
        raise ValueError("-F and -r are for text searches")
    for name in ("before", "after", "context", "max_count", "max_depth", "max_filesize", "threads"):
        if (o.get(name) or 0) < 0:
            raise ValueError(f"--{name.replace('_', '-')} must not be negative")
    if len(forms := [f for f in ("count", "files", "files_without", "json", "jsonl") if o.get(f)]) > 1:
        raise ValueError("only one form of output, not " + " and ".join(forms))
    if modes and (o.get("invert") or o.get("across_lines")):
        raise ValueError("-v and -U are for text searches")
    if not o.get("pattern") and not (o.get("index_status") or o.get("index_clear") or o.get("rebuild_index")):
        raise ValueError("a pattern is needed")


def main(argv: list[str] | None = None, spark=None) -> int:
    flags = vars(parser().parse_args(argv))
    o = settings(flags, flags.get("config") or ".quillmine")
    try:
        check(o)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators.filters import path_filters
    from .operators.grep import GrepOptions, files_with_matches, grep
    from .plans.index import IndexStore, status
    from .plans.output import render
    from .plans.search import find_calls, find_references, find_symbols, find_types
    from .functions.shipping import ship
    from .sources.codetree import read_tree

    own = spark is None
    if own:
        spark = SparkSession.builder.master(f"local[{o.get('threads') or '*'}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    try:
        tree = read_tree(spark, *o["paths"], hidden=bool(o.get("hidden")), respect_ignore=not o.get("no_ignore"), **({"max_depth": o["max_depth"]} if o.get("max_depth") is not None else {}))
        modes = ("symbols", "refs", "types_mode", "call_graph", "index_status", "index_clear", "rebuild_index")
        if any(o.get(m) for m in modes) and not o.get("no_index"):
            store = IndexStore(spark, o.get("index_path") or f"{o['paths'][0]}/.quillmine-index")
            if o.get("index_clear"):
                store.clear()
                return 0
            if o.get("rebuild_index") or not store.version():
                done = store.rebuild(tree, details=bool(o.get("details")), workers=o.get("threads") or None)
                if not o.get("pattern"):
                    print(json.dumps(done))
                    return 0
            if o.get("index_status"):
                totals, languages, latest = status(store.table("file_meta"))
                print(json.dumps({"totals": totals.first().asDict(), "languages": [r.asDict() for r in languages.collect()], "latest": [r.path for r in latest.collect()]}, default=str))
                return 0
            symbols, refs = store.table("symbols"), store.table("refs")
            if o.get("refs"):
                out = find_references(symbols, refs, o["pattern"])
            elif o.get("call_graph"):
                out = find_calls(symbols, refs, o["pattern"])
            else:
                out = (find_types if o.get("types_mode") else find_symbols)(symbols, o["pattern"])
            out = out.where(path_filters(out, "file_path", types=o.get("types") or (), not_types=o.get("not_types") or (), globs=o.get("globs") or (), not_globs=o.get("not_globs") or ()))
            n = 0
            for r in out.orderBy("file_path").toLocalIterator():
                n += 1
                print(json.dumps(r.asDict(), default=str))
            return 0 if n else 1
        names = ("literal", "ignore_case", "word", "whole_line", "across_lines", "dot_all", "invert", "only_matching", "replacement", "before", "after", "context", "max_count", "max_filesize", "binary_as_text")
        options = GrepOptions(o["pattern"], **{k: o[k] for k in names if o.get(k) is not None}, **{k: tuple(o[k]) for k in ("types", "not_types", "globs", "not_globs") if o.get(k)})
        files = tree.where(F.col("error").isNull())
        if o.get("files_without"):
            out = files_with_matches(files, options, without=True).select(F.col("path").alias("value")).orderBy("value")
        else:
            matches = grep(files, options).persist()
            form = "count" if o.get("count") else "files" if o.get("files") else "json" if o.get("json") else "jsonl" if o.get("jsonl") else "text"
            extra = {"color": o.get("color") == "always", "heading": not o.get("no_heading"), "only_matching": bool(o.get("only_matching")), "null": bool(o.get("null")), "path_separator": o.get("path_separator") or "/"}
            out = render(matches, form, **(extra if form == "text" and not options.across_lines else {}))
        n = 0
        for row in out.toLocalIterator():
            n += 1
            if not o.get("quiet"):
                print(row.value)
        if not n and not any(o.get(f) for f in ("quiet", "count", "files", "files_without", "json", "jsonl")):
            print("No matches found", file=sys.stderr)
        return 0 if n else 1
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
