"""spark.read.format("codetree"): a directory tree as a table of files.

Spark's own binaryFile source skips names that begin with a dot or underscore,
which source trees are full of. This one lists directories on the driver,
prunes by the options and by pushed filters before anything is read, and deals
files into partitions of about equal bytes; executors read the contents. The
tree must be mounted where executors run; other stores go through Spark's
readers into the same columns.
"""

from __future__ import annotations

import fnmatch
import heapq
import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, rel_path string, name string, ext string, size long, mtime timestamp, is_symlink boolean, depth int, content binary, error string"


def _flag(options, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() in ("true", "1", "yes")


class FileBatch(InputPartition):
    def __init__(self, files: list[tuple]):
        self.files = files


class CodeTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.exts: set[str] | None = None
        self.sizes: list[tuple[type, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Extensions and sizes are known before a file is opened."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ext",):
                self.exts = {f.value} if self.exts is None else self.exts & {f.value}
            elif isinstance(f, In) and f.attribute == ("ext",):
                self.exts = set(f.value) if self.exts is None else self.exts & set(f.value)
            elif isinstance(f, LessThan | LessThanOrEqual | GreaterThanOrEqual) and f.attribute == ("size",):
                self.sizes.append((type(f), f.value))
            else:
                yield f

    def _fits(self, size: int) -> bool:
        tests = {LessThan: size.__lt__, LessThanOrEqual: size.__le__, GreaterThanOrEqual: size.__ge__}
        return all(tests[kind](value) for kind, value in self.sizes)

    def _walk(self, root: str) -> Iterator[tuple]:
        from ..operators.filters import PRUNED_DIRS
        from ..operators.ignore import load_rules, matches_rule

        hidden, follow = _flag(self.options, "hidden", False), _flag(self.options, "followsymlinks", False)
        prune = set(PRUNED_DIRS) if _flag(self.options, "prune", False) else set()
        deepest = int(self.options["maxdepth"]) if "maxdepth" in self.options else None
        largest = int(self.options["maxfilesize"]) if "maxfilesize" in self.options else None
        globs = [g for g in self.options.get("glob", "").split(",") if g]
        rules = load_rules(root, self.options.get("globalignore")) if _flag(self.options, "respectignore", False) and os.path.isdir(root) else []

        def ignored(rel: str, is_dir: bool) -> bool:
            out = False
            for r in rules:
                if matches_rule(r, rel, is_dir):
                    out = not r.negate
            return out

        def entry(path: str, rel: str) -> Iterator[tuple]:
            link, error, size, mtime = os.path.islink(path), None, 0, 0.0
            try:
                stat = os.stat(path) if follow or not link else os.lstat(path)
                size, mtime = stat.st_size, stat.st_mtime
            except OSError as e:
                error = str(e)
            name = os.path.basename(path)
            ext = os.path.splitext(name)[1] if not name.startswith(".") or "." in name[1:] else name
            if link and not follow:
                return
            if (largest is not None and size > largest) or (globs and not any(fnmatch.fnmatchcase(name, g) for g in globs)):
                return
            if (self.exts is not None and ext not in self.exts) or not self._fits(size):
                return
            yield (path, rel, name, ext, size, mtime, link, rel.count("/"), error)

        if os.path.isfile(root):
            yield from entry(root, os.path.basename(root))
            return
        unread: list[OSError] = []
        for folder, dirs, names in os.walk(root, followlinks=follow, onerror=unread.append):
            rel = os.path.relpath(folder, root).replace(os.sep, "/")
            rel = "" if rel == "." else rel + "/"
            level = rel.count("/")
            dirs[:] = sorted(d for d in dirs if (hidden or not d.startswith(".")) and d not in prune and (deepest is None or level < deepest) and not ignored(rel + d, True))
            for name in sorted(names):
                if (hidden or not name.startswith(".")) and not ignored(rel + name, False):
                    yield from entry(os.path.join(folder, name), rel + name)
        for e in unread:  # a directory that cannot be listed is a row with its error
            rel = os.path.relpath(e.filename, root).replace(os.sep, "/")
            yield (e.filename, rel, os.path.basename(e.filename), "", 0, 0.0, False, rel.count("/"), str(e))

    def partitions(self) -> list[FileBatch]:
        roots = [r for r in self.options["path"].split(",") if r]
        files = [f for r in roots for f in self._walk(os.path.abspath(r))]
        n = int(self.options.get("numpartitions", 8))
        # largest first onto the lightest partition
        batches = [FileBatch([]) for _ in range(max(1, min(n, len(files))))]
        lightest = [(0, k) for k in range(len(batches))]
        for f in sorted(files, key=lambda f: (-f[4], f[0])):
            weight, k = lightest[0]
            batches[k].files.append(f)
            heapq.heapreplace(lightest, (weight + f[4] + 4096, k))
        return batches

    def read(self, partition: FileBatch) -> Iterator[tuple]:
        for path, rel, name, ext, size, mtime, link, depth, error in partition.files:
            content = None
            if error is None:
                try:
                    with open(path, "rb") as f:
                        content = f.read()
                except OSError as e:
                    error = str(e)
            if error is not None and _flag(self.options, "failfast", False):
                raise OSError(f"{path}: {error}")
            yield (path, rel, name, ext, size, datetime.fromtimestamp(mtime, tz=timezone.utc), link, depth, content, error)


class CodeTree(DataSource):
    """Options: path (comma-separated roots), hidden, followSymlinks, maxDepth,
    maxFileSize, glob (comma-separated), respectIgnore, globalIgnore, prune,
    numPartitions, failFast (the first error ends the read)."""

    @classmethod
    def name(cls) -> str:
        return "codetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CodeTreeReader:
        return CodeTreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CodeTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_tree(spark: SparkSession, *roots: str, **options):
    register(spark)
    return spark.read.format("codetree").options(path=",".join(roots), **{k.replace("_", ""): str(v) for k, v in options.items()}).load()
