"""Incremental against rebuilt indexes, empty matches, details and formats."""

import json
import re

import pytest
from pyspark.sql import functions as F

A = "package a\n\nfunc Alpha() int {\n\treturn 1\n}\n\nfunc Gone() {}\n"
B = "package a\n\nfunc Beta() int {\n\treturn Alpha() + Later()\n}\n"
C = "function gamma(x) {\n  return Alpha(x) + delta;\n}\n"


def frame(spark, files, stamp="2024-01-01"):
    return spark.createDataFrame([(p, c, None) for p, c in files.items()], "path string, content string, mtime timestamp").withColumn("mtime", F.lit(stamp).cast("timestamp"))


def held(store):
    """What the index says, without the times."""
    symbols = store.table("symbols").drop("last_updated", "properties")
    out = {"symbols": symbols, "refs": store.table("refs"), "meta": store.table("file_meta").drop("indexed_at", "mtime"), "tokens": store.table("tokens"), "lines": store.table("lines")}
    return {k: sorted(map(str, df.select(sorted(df.columns)).collect())) for k, df in out.items()}


def test_incremental_is_a_rebuild(spark, tmp_path):
    from quillmine.plans.index import IndexStore

    steps = [
        {"a.go": A, "b.go": B, "c.js": C},
        {"a.go": "// moved\n" + A, "b.go": B, "c.js": C},  # a line above: ids change, references from b.go stay
        {"a.go": "// moved\n" + A, "b.go": B, "c.js": C, "d.go": "package a\n\nfunc Later() int { return 2 }\nvar delta = 3\n"},  # names that others used before
        {"b.go": B, "c.js": C, "d.go": "package a\n\nfunc Later() int { return 2 }\nvar delta = 3\n"},  # a.go is removed
        {"b.go": B, "c.js": C, "d.go": "package a\n\nfunc Later() int { return 2 }\nvar delta = 3\n"},  # nothing changes
    ]
    store = IndexStore(spark, f"file://{tmp_path}/inc")
    for n, files in enumerate(steps):
        versions = store.version()
        done = store.build(frame(spark, files, f"2024-01-0{n + 1}" if n < 4 else "2024-01-04"), incremental=True)
        assert store.version() == versions + 1 and done["found"] == len(files)
        fresh = IndexStore(spark, f"file://{tmp_path}/full{n}")
        fresh.build(frame(spark, files))
        assert held(store) == held(fresh), n
    assert done["processed"] == 0
    assert not [p for p in (tmp_path / "inc").rglob("*") if p.name in ("found", "gone", "fresh", "changes", "wanted")]


def test_a_batch_of_events_is_one_version(spark, tmp_path):
    from quillmine.plans.index import IndexStore
    from quillmine.streaming.watch import apply_batch

    now = {"a.go": A, "b.go": B, "c.js": C}
    store = IndexStore(spark, f"file://{tmp_path}/live")
    store.build(frame(spark, now))
    now["a.go"] = "// moved\n" + A
    del now["c.js"]
    events = spark.createDataFrame([("r", "a.go", "write", 1), ("r", "c.js", "write", 1), ("r", "c.js", "remove", 2)], "root string, path string, operation string, t int").withColumn("time", F.timestamp_seconds("t"))
    apply_batch(store, lambda paths: frame(spark, {p: now[p] for p in paths}), events)
    assert store.version() == 2
    fresh = IndexStore(spark, f"file://{tmp_path}/fresh")
    fresh.build(frame(spark, now))
    assert held(store) == held(fresh)
    apply_batch(store, lambda paths: frame(spark, {}), events.limit(0))
    assert store.version() == 2


def test_writers_and_point_reads(spark, tmp_path):
    from quillmine.plans.errors import TooManyFailures
    from quillmine.plans.index import IndexStore, WriteConflict, posting_rows

    store = IndexStore(spark, f"file://{tmp_path}/x")
    store.build(frame(spark, {"a.go": A, "b.go": B}))
    slow = store._begin()
    store.delete_file("b.go")
    with pytest.raises(WriteConflict):
        store._publish(*slow)
    assert store.version() == 2 and store.has("file_meta", path="a.go") and not store.has("file_meta", path="b.go")
    assert [r.name for r in store.symbols_in_file("a.go").collect()] == ["Alpha", "Gone"]
    assert {r.kind for r in store.references_in_file("a.go").collect()} == {"definition"}
    assert store.stats()["tables"]["symbols"]["rows"] == 2
    assert posting_rows(store.table("symbols")).where("field = 'name'").count() == 2
    new = store.table("refs").limit(1).withColumn("kind", F.lit("call"))
    store.put("refs", new, ("symbol_id", "file_path", "line", "col"))
    assert store.table("refs").count() == 2 and store.has("refs", kind="call")
    assert store.compact() == store.version() and held(store)["symbols"]
    bad = frame(spark, {"a.go": A, "b.go": B, "c.js": C}).withColumn("error", F.when(F.col("path") != "a.go", "permission denied"))
    with pytest.raises(TooManyFailures):
        store.build(bad)
    done = store.build(bad.withColumn("error", F.when(F.col("path") == "a.go", "permission denied")))
    assert (done["errors"], done["processed"]) == (1, 2)


def go_source(i):
    return f'package p{i}\n\nimport "fmt"\n\nfunc Handle{i}(x int) int {{\n\treturn Helper{i}(x) + Handle{(i + 1) % 600}(x)\n}}\n\nfunc Helper{i}(x int) int {{\n\treturn x\n}}\n'


def test_one_changed_file_costs_its_buckets(spark, tmp_path):
    from quillmine.plans.index import IndexStore

    now = {f"d{i % 7}/f{i}.go": go_source(i) for i in range(600)}
    store = IndexStore(spark, f"file://{tmp_path}/part")
    store.build(frame(spark, now))
    before = store.size()
    now["d3/f3.go"] = "// moved\n" + now["d3/f3.go"]
    store.build(frame(spark, now), incremental=True)
    assert store.size() - before < 0.05 * before
    places = json.loads(store._read_text(f"{store.folder}/current-2"))
    assert sum(at.startswith("v2-") for at in places["symbols"]["buckets"].values()) == 1 and sum(at.startswith("v2-") for at in places["refs"]["buckets"].values()) <= 2
    fresh = IndexStore(spark, f"file://{tmp_path}/whole")
    fresh.build(frame(spark, now))
    assert held(store) == held(fresh)
    got = store.get("symbols", file_path="d3/f3.go")
    assert got.count() == 2 and len(got.inputFiles()) == 1  # a bucket, however many there are
    symbol = store.get("symbols", name="Helper9").first().id
    store.delete_symbol(symbol)
    assert not store.has("symbols", id=symbol) and not store.has("refs", symbol_id=symbol) and store.table("symbols").count() == 1199
    n = store.table("symbols").count()
    assert store.vacuum() > 0 and store.table("symbols").count() == n and store.table("refs").count() > 0


def test_details_parsers_and_errors_in_a_build(spark, tmp_path):
    from quillmine.plans.index import IndexStore

    files = {"a.go": 'package a\n\nimport "fmt"\n\ntype Box struct {\n\tsize int\n}\n', "b.py": "def f(:\n", "c.rs": "fn open() {\n", "d.java": "class D {}", "e.js": "class A {\n  run(x) { return x; }\n}\n"}

    def parse(source):
        if "D" in source:
            raise KeyError("no grammar")
        return []

    store = IndexStore(spark, f"file://{tmp_path}/d")
    done = store.build(frame(spark, files), details=True, parsers={"java": parse}, workers=2)
    assert {(r.name, r.kind) for r in store.table("symbols").collect()} >= {("fmt", "import"), ("size", "field"), ("run", "method"), ("A", "class")}
    wrong = {r.file_path: (r.line, r.message) for r in store.table("errors").collect()}
    assert set(wrong) == {"b.py", "c.rs", "d.java"} and wrong["d.java"][1].startswith("KeyError") and wrong["c.rs"] == (1, "unclosed {") and done["parse_errors"] == 3
    store.update(frame(spark, {"b.py": "def f(): pass\n"}), spark.createDataFrame([("b.py",), ("c.rs",)], "path string"), details=True)
    assert {r.file_path for r in store.table("errors").collect()} == {"d.java"}


def go_matches(pattern, text):
    """Matches as the reference engine counts them: an empty one at the end of another does not."""
    out, last = [], -1
    for m in re.finditer(pattern, text):
        if m[0] or m.start() != last:
            out.append((len(text[: m.start()].encode()) + 1, m[0]))
        last = m.end()
    return out


@pytest.mark.parametrize("pattern, python", [("a*", "a*"), ("[[:alpha:]]*", "[a-zA-Z]*"), (r"\pL*", r"[^\W\d_]*"), (r"\w*", r"(?a:\w*)"), ("(?:x|)", "(?:x|)"), ("$", r"\Z"), (r"(?:ab)?c?", "(?:ab)?c?")])
def test_patterns_that_match_nothing(spark, pattern, python):
    from quillmine.operators.grep import GrepOptions, count_matches, grep

    texts = {"a": "été abc", "b": "baac 😀x\n\nzz", "c": "", "d": "\ufdd0\ufdd2\ufdd0 a\ufdd0", "e": "aab" * 700}
    files = spark.createDataFrame(list(texts.items()), "path string, content string")
    got = {}
    for r in grep(files, GrepOptions(pattern)).collect():
        got.setdefault((r.path, r.line_no), []).append((r.col_start, r.match))
    want = {(p, n): go_matches(python, line) for p, t in texts.items() for n, line in enumerate(t.split("\n"), 1)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    counts = {r.path: r.occurrences for r in count_matches(files, GrepOptions(pattern)).collect()}
    assert counts == {p: sum(len(want[p, n]) for n in range(1, t.count("\n") + 2)) for p, t in texts.items()}


def test_long_lines_and_context(spark):
    from quillmine.operators.grep import GrepOptions, grep

    files = spark.createDataFrame([("a", "x" + "é;" * 3000 + "\n1\n2 é\n3\n4"), ("b", "é")], "path string, content string")
    rows = grep(files, GrepOptions("é", before=1, after=2, absolute_offset=True)).orderBy("path", "line_no", "col_start").collect()
    assert len(rows) == 3002 and [r.col_start for r in rows[:3000]] == [2 + 3 * k for k in range(3000)]
    assert (rows[3000].line_no, rows[3000].before, rows[3000].after, rows[3000].absolute_offset) == (3, ["1"], ["3", "4"], 9001 + 1 + 2 + 2)
    over = grep(files, GrepOptions(r";\n1\n2", across_lines=True, after=1)).collect()
    assert [(r.line_no, r.end_line, r.col_start, r.col_end, r.after) for r in over] == [(1, 3, 9001, 2, ["3"])]


def test_repeated_paths_keep_their_verdict(spark, monkeypatch):
    from quillmine.operators import ignore

    paths = spark.createDataFrame([("a.log", 1), ("a.log", 1), ("b.txt", 2)], "path string, n int")
    rules = ignore.rules_frame(spark, ignore.parse_rules("*.log\n"))
    for few in (256, 0):
        monkeypatch.setattr(ignore, "FEW_RULES", few)
        got = ignore.mark_ignored(paths, rules)
        assert sorted((r.path, r.n, r.ignored) for r in got.collect()) == [("a.log", 1, True), ("a.log", 1, True), ("b.txt", 2, False)]


DETAILED = {
    "javascript": ("import x from './lib';\nconst MAX = 3;\nlet low = 1;\nconst add = (a, b) => a + b;\nclass Box {\n  size = 1;\n  static make(n) {\n    if (n) { return 1; }\n  }\n  get width() { return this.size; }\n}\n",
                   {("./lib", "import"), ("MAX", "constant"), ("low", "variable"), ("add", "function"), ("Box", "class"), ("size", "field"), ("make", "method"), ("width", "method")}),
    "typescript": ("namespace N {\n}\nclass Box {\n  private size: number = 1;\n  public grow(by: number): void {\n    this.size += by;\n  }\n}\n", {("N", "module"), ("Box", "class"), ("size", "field"), ("grow", "method")}),
    "rust": ("use std::fmt;\nconst MAX: u8 = 3;\nstruct P {\n}\nimpl P {\n  fn new() -> P { P {} }\n}\nmod inner {\n}\n", {("std::fmt", "import"), ("MAX", "constant"), ("P", "struct"), ("P", "impl"), ("new", "function"), ("inner", "module")}),
    "go": ('package a\n\nimport "fmt"\n\ntype Box struct {\n\tsize int\n}\n', {("fmt", "import"), ("Box", "struct"), ("size", "field")}),
    "python": ("import os\nfrom a.b import c\nMAX = 1\nlow: int = 2\nclass A:\n    def run(self):\n        pass\n", {("os", "import"), ("a.b.c", "import"), ("MAX", "constant"), ("low", "variable"), ("A", "class"), ("run", "function")}),
}


@pytest.mark.parametrize("language", sorted(DETAILED))
def test_details_of_languages(spark, language):
    from quillmine.operators.symbols import extract_symbols

    source, want = DETAILED[language]
    files = spark.createDataFrame([("f", language, source), ("g", language, None), ("h", None, source)], "path string, language string, content string")
    rows = extract_symbols(files, details=True).collect()
    assert {(r.name, r.kind) for r in rows} == want
    scopes = {r.name: r.scope for r in rows}
    inside = {"javascript": "make", "typescript": "grow", "rust": "new", "python": "run"}.get(language)
    assert inside is None or scopes[inside] in ("Box", "P", "A")


def test_formats_of_the_library(spark):
    from quillmine.operators.filters import walk_stats
    from quillmine.operators.grep import GrepOptions, grep, search_stats
    from quillmine.operators.symbols import extract_symbols
    from quillmine.plans.output import invalid_messages, json_messages, library_json, library_text, stats_json, stats_text
    from quillmine.plans.search import hybrid_stats, symbol_results

    files = spark.createDataFrame([("a.go", "go", A)], "path string, language string, content string")
    symbols = symbol_results(extract_symbols(files))
    assert [r.value for r in library_text(symbols).collect()] == ["\na.go", "3:1:Alpha [function: Alpha]", "7:1:Gone [function: Gone]"]
    assert json.loads(library_json(symbols).first().value)["data"]["metadata"]["kind"] == "function"
    matches = grep(files, GrepOptions("return", literal=True, context=1))
    messages = [json.loads(r.value) for r in json_messages(matches).collect()]
    assert [m["type"] for m in messages] == ["begin", "context", "match", "context", "end", "summary"]
    assert invalid_messages(json_messages(matches)).count() == 0
    stats = search_stats(matches, files)
    assert [r.value for r in stats_text(stats).collect()][1] == "  files: 1" and json.loads(stats_json(stats).first().value)["data"]["matches"] == 1
    both = hybrid_stats(spark.createDataFrame([(3, 10, 2, 0.5), (3, 12, 4, 0.25)], "files int, bytes int, matches int, seconds double")).first()
    assert (both.files, both.bytes, both.matches, both.seconds) == (3, 12, 6, 0.75)
    walk = spark.createDataFrame([("a/b.go", 5, None), ("a/c.txt", 7, None), ("d/e", 0, "permission denied")], "path string, size long, error string")
    got = walk_stats(walk, F.col("path").endswith(".go")).first()
    assert (got.found, got.kept, got.filtered, got.errors, got.directories, got.bytes) == (3, 1, 1, 1, 2, 5)
