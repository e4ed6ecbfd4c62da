"""Tree events, watching, settings, filters, policies and registered parsers."""

import os

import pytest
from pyspark.sql import functions as F


def test_tree_events_replay(tmp_path):
    from quillmine.sources.treeevents import TreeEventsReader

    code = tmp_path / "code"
    code.mkdir()
    (code / "a.go").write_text("package a")
    (code / "node_modules").mkdir()
    (code / "node_modules" / "x.js").write_text("x")
    reader = TreeEventsReader({"path": str(code), "journal": str(tmp_path / "j")})
    start = reader.initialOffset()
    rows, one = reader.read(start)
    assert [(os.path.basename(r[1]), r[2], r[4]) for r in rows] == [("a.go", "create", 9)]
    assert list(reader.read(one)[0]) == [] and reader.read(one)[1] == one
    (code / "a.go").write_text("package b and more")
    (code / "b.go").write_text("package b")
    rows, two = reader.read(one)
    assert sorted((os.path.basename(r[1]), r[2]) for r in rows) == [("a.go", "write"), ("b.go", "create")]
    (code / "a.go").unlink()
    again = TreeEventsReader({"path": str(code), "journal": str(tmp_path / "j")})
    assert len(list(again.read(one)[0])) == 2 and again.read(one)[1] == two
    assert [(os.path.basename(r[1]), r[2]) for r in again.read(two)[0]] == [("a.go", "remove")]
    assert len(list(again.readBetweenOffsets(start, two))) == 3


def test_watching_a_tree(spark, tmp_path):
    from quillmine.plans.index import IndexStore
    from quillmine.streaming.watch import TreeWatcher

    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir(), two.mkdir()
    (one / "a.go").write_text("package a\n\nfunc Alpha() {}\n")
    (two / "b.go").write_text("package b\n\nfunc Beta() { Alpha() }\n")

    def files_of(paths):
        rows = [(p, open(p).read()) for p in paths if os.path.exists(p)]
        return spark.createDataFrame(rows, "path string, content string").withColumn("mtime", F.current_timestamp())

    store = IndexStore(spark, f"file://{tmp_path}/index")
    watcher = TreeWatcher(spark, store, files_of, str(tmp_path / "state"), (str(one),))
    watcher.start()
    watcher.flush()
    assert [r.name for r in store.table("symbols").collect()] == ["Alpha"]
    watcher.add(str(two))
    watcher.flush()
    assert {r.name for r in store.table("symbols").collect()} == {"Alpha", "Beta"}
    (one / "a.go").write_text("package a\n\n// moved\nfunc Alpha() {}\n")
    watcher.flush()
    calls = store.table("refs").where("kind = 'call' and name = 'Alpha'").collect()
    assert len(calls) == 1 and ":4:" in calls[0].symbol_id
    (two / "b.go").unlink()
    watcher.stop()
    assert [r.name for r in store.table("symbols").collect()] == ["Alpha"] and watcher.stats()["runs"] == 2


def test_nested_settings(tmp_path):
    from quillmine.plans.config import read_config

    at = tmp_path / "c"
    at.write_text("ignore-case: true\nsearch:\n  max-count: 3\n  types:\n    - go\n    - py\n  deep:\n    name: x # here\nglobs:\n- '*.go'\nlast: [1, two]\n")
    assert read_config(at) == {"ignore_case": True, "search_max_count": 3, "search_types": ["go", "py"], "search_deep_name": "x", "globs": ["*.go"], "last": [1, "two"]}


def test_filters_and_policies(spark):
    from quillmine.operators.languages import FILTERS, FileFilter
    from quillmine.plans.errors import ErrorPolicy, FileAccessError, wrapped

    rows = [("a.go", b"x" * 10), (".h/b.go", b"x"), ("c.py", b"x" * 50), ("d.md", b"# t"), ("e.go", b"a\x00b")]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")

    def paths(f):
        return sorted(r.path for r in f.apply(files).collect())

    assert paths(FILTERS["code"]) == ["a.go", "c.py"] and paths(FILTERS["text"]) == ["d.md"] and len(paths(FILTERS["all"])) == 5
    assert paths(FileFilter(extensions=(".go",), hidden=True)) == [".h/b.go", "a.go"] and paths(FileFilter(not_languages=("Go",), max_bytes=20)) == ["d.md"]
    good, bad = ErrorPolicy(max_bytes=20).apply(files.withColumn("error", F.when(F.col("path") == "d.md", "permission denied")))
    assert sorted(r.path for r in good.collect()) == [".h/b.go", "a.go"]
    assert [(r.file_path, r.type, r.action) for r in bad.collect()] == [("c.py", "file_too_large", "skip_file"), ("d.md", "permission_denied", "skip_file"), ("e.go", "binary_file", "skip_file")]
    made = wrapped(OSError("open x: permission denied"), "x")
    assert isinstance(made, FileAccessError) and made.kind == "permission_denied" and wrapped(made) is made


def test_registered_parsers(spark):
    from concurrent.futures import ThreadPoolExecutor

    from quillmine.functions.scanners import described, described_later
    from quillmine.operators.symbols import extract_symbols

    def lisp(source):
        return [(line.split()[1], "function", n, 1, n, len(line), line, None, None) for n, line in enumerate(source.split("\n"), 1) if line.startswith("(defun ")]

    files = spark.createDataFrame([("a.lisp", "lisp", "(defun one ())\n\n(defun two ())"), ("b.go", "go", "func A() {}")], "path string, language string, content string")
    assert sorted(r.name for r in extract_symbols(files, parsers={"lisp": lisp}).collect()) == ["A", "one", "two"]
    assert [r.name for r in extract_symbols(files).collect()] == ["A"]
    with ThreadPoolExecutor(1) as pool:
        assert described_later(pool, "func A() {}", "go").result() == described("func A() {}", "go")


@pytest.mark.parametrize("flags", [["x", "--after-context=-1"], ["x", "--json", "-c"], ["x", "--symbols", "-v"], ["x", "--refs", "--types"], []])
def test_flags_that_do_not_go(flags, tmp_path, monkeypatch, capsys):
    from quillmine.__main__ import main

    monkeypatch.chdir(tmp_path)
    assert main(flags) == 2 and "error:" in capsys.readouterr().err


def test_errors_of_a_tree(spark, tmp_path):
    from quillmine.sources.codetree import read_tree

    (tmp_path / "a.go").write_text("x")
    os.symlink(tmp_path / "nowhere", tmp_path / "b.go")
    rows = read_tree(spark, str(tmp_path), follow_symlinks=True).collect()
    assert sorted((r.name, r.error is None) for r in rows) == [("a.go", True), ("b.go", False)]
    with pytest.raises(Exception, match="b.go"):
        read_tree(spark, str(tmp_path), follow_symlinks=True, fail_fast=True).collect()
