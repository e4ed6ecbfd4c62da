import pytest
from pyspark.sql import functions as F

from quillmine.functions.scanners import declarations, syntax_errors
from quillmine.operators.refs import call_edges, call_graph, calls, one_per_line, reachable, references, valid_references
from quillmine.operators.symbols import extract_symbols, line_symbols, scopes
from quillmine.plans.index import IndexStore, changes, postings, status
from quillmine.plans.search import QueryCache, SearchQuery, find_definitions, find_references, find_symbols, find_types, hybrid, search_symbols

GO = """package main

// Greet says hello
// to one
func Greet(name string) string {
	s := "func Fake() { }" // func Other() {
	return s + helper(name)
}

type User struct {
	Name string
}

type Store interface {
	Get() User
}

var (
	a = 1
	b = 2
)

const Max = 3

func (u *User) Hello() string {
	return Greet(u.Name)
}

func helper(x string) string { return x }
"""
PY = "class A:\n    def run(self):\n        return make(1)\n\n\ndef make(n):\n    \"\"\"Doc.\"\"\"\n    return n\n\n\ndef _low():\n    pass\n"
JS = "function outer(q) {\n  function inner(z) {\n    return `}`;\n  }\n  return inner(q);\n}\nclass Box {\n}\n"
TS = "interface Shape {\n  x: number;\n}\ntype Id = string;\nexport class Circle {\n}\nfunction area(s: Shape): number {\n  return 1;\n}\n"
RS = "pub struct Point {\n  x: i32,\n}\nimpl Point {\n  pub fn new() -> Point {\n    Point { x: 0 }\n  }\n}\n"


@pytest.fixture(scope="module")
def code(spark):
    rows = [("m.go", "go", GO), ("p.py", "python", PY), ("j.js", "javascript", JS), ("t.ts", "typescript", TS), ("r.rs", "rust", RS), ("bad.py", "python", "def x(:\n  pass\n"), ("n.txt", None, "text"), ("e.go", "go", "")]
    return spark.createDataFrame(rows, "path string, language string, content string")


def test_go_spans():
    got = {(d[0], d[1]): d[2:6] for d in declarations(GO, "go")}
    assert got["Greet", "function"][:3] == (5, 1, 8) and got["Hello", "method"][0] == 25
    assert {("User", "struct"), ("Store", "interface"), ("a", "variable"), ("b", "variable"), ("Max", "constant"), ("helper", "function")} <= set(got)
    assert not {n for n, _ in got} & {"Fake", "Other"}
    assert [d[7] for d in declarations(GO, "go") if d[0] == "Greet"] == ["Greet says hello to one"]


def test_other_languages():
    assert {(d[0], d[1]) for d in declarations(PY, "python")} == {("A", "class"), ("run", "function"), ("make", "function"), ("_low", "function")}
    assert [(d[0], d[2], d[4]) for d in declarations(JS, "javascript")] == [("outer", 1, 6), ("inner", 2, 4), ("Box", 7, 8)]
    assert {(d[0], d[1]) for d in declarations(TS, "typescript")} == {("Shape", "interface"), ("Id", "type"), ("Circle", "class"), ("area", "function")}
    assert {(d[0], d[1]) for d in declarations(RS, "rust")} == {("Point", "struct"), ("new", "function")}
    assert declarations(None, "go") == [] and declarations("x", None) == []
    assert syntax_errors("def x(:\n", "python") and syntax_errors("f(]", "go") and not syntax_errors(GO, "go")


def test_symbol_table(code):
    s = extract_symbols(code).persist()
    assert s.where("name = 'Greet'").first().modifiers == ["public"]
    assert s.where("name = '_low'").first().modifiers == ["protected"]
    assert s.where("file_path = 'bad.py'").count() == 1
    parents = {r.id.split(":")[-1]: r.parent_id for r in scopes(s).collect()}
    assert parents["inner"].endswith(":outer") and parents["run"].endswith(":A") and parents["outer"] is None
    lines = {(r.path, r.name) for r in line_symbols(code).collect()}
    assert {("m.go", "Greet"), ("t.ts", "Shape"), ("r.rs", "new"), ("p.py", "run")} <= lines


def test_references_and_calls(code, spark):
    s = extract_symbols(code)
    r = references(s, code.select("path", "content")).persist()
    greet = {(x.line, x.kind) for x in r.where("name = 'Greet'").collect()}
    assert (5, "definition") in greet and (26, "call") in greet and (3, "reference") in greet
    assert one_per_line(r).count() <= r.count()
    e = call_edges(s, code)
    assert e.where("src_id like '%:Hello' and dst_id like '%:Greet'").count() == 1
    assert e.where("src_id like '%:outer' and dst_id like '%:inner'").count() == 1
    assert {x.role for x in call_graph(s, r, "greet").collect()} == {"definition", "call"}
    start = s.where("name = 'Hello'").select("id")
    assert {x.id.split(":")[-1]: x.hops for x in reachable(e, start).collect()} == {"Hello": 0, "Greet": 1, "helper": 2}
    assert calls(code).where("callee = 'make'").count() == 1
    bad = spark.createDataFrame([("", 1, 1, "f", ""), ("x", 0, 1, "f", ""), ("x", 3, 1, "", None)], "symbol_id string, line int, col int, file_path string, kind string")
    assert valid_references(bad, "d").collect()[0].file_path == "d"


def test_queries(code):
    s = extract_symbols(code).persist()
    assert search_symbols(s, SearchQuery("name", "greet")).count() == 1
    assert search_symbols(s, SearchQuery("type", "struct")).count() == 2
    assert search_symbols(s, SearchQuery("tag", "exported", (("name", "contains", "gre"),))).count() == 1
    page = search_symbols(s, SearchQuery("pattern", "e", sort="name", descending=True, limit=2, offset=1)).collect()
    names = sorted((r.name for r in s.collect() if "e" in r.name.lower()), reverse=True)
    assert [r.name for r in page] == names[1:3]
    assert find_symbols(s, "H.*").count() == 2 and find_types(s, "User").count() == 1
    assert find_definitions(s, "inner").count() == 1
    refs = references(s, code.select("path", "content"))
    assert find_references(s, refs, "helper", limit=1).count() == 1
    cache = QueryCache(seconds=60)
    a = cache.get(("q", 1), lambda: s)
    assert cache.get(("q", 1), lambda: None) is a
    assert postings(s).where("field = 'name' and key = 'point'").first().ids[0].startswith("r.rs")


def test_hybrid(code):
    from quillmine.operators.grep import GrepOptions, grep

    s = extract_symbols(code)
    m = grep(code.select("path", "content"), GrepOptions("outer"))
    rows = hybrid(m, find_symbols(s, "outer")).collect()
    assert {r.origin for r in rows} == {"symbol", "text"} or len(rows) >= 1


def test_semantic_messages_and_features(code, spark):
    import json

    from quillmine.operators.grep import GrepOptions, grep
    from quillmine.operators.symbols import language_features
    from quillmine.plans.output import semantic_messages

    rows = [json.loads(r.value)["data"] for r in semantic_messages(grep(code.select("path", "content"), GrepOptions("Greet", one_per_line=True)), extract_symbols(code)).collect()]
    assert [r.get("semantic", {}).get("kind") for r in rows if r["line_number"] == 5] == ["function"]
    assert any("semantic" not in r for r in rows)
    features = language_features(spark)
    assert features.where("language = 'go' and by_line and by_span").count() == 7 and features.where("kind = 'enum'").count() >= 2


def test_index_life(code, spark, tmp_path):
    files = code.select("path", F.col("content"), F.to_timestamp(F.lit("2024-01-01")).alias("mtime"))
    store = IndexStore(spark, f"file://{tmp_path}/ix")
    first = store.build(files)
    assert first["processed"] == 7 and store.table("file_meta").count() == 7
    n = store.table("symbols").count()
    again = store.build(files, incremental=True)
    assert again["processed"] == 0 and store.table("symbols").count() == n
    more = files.where("path <> 'r.rs'").unionByName(spark.createDataFrame([("new.go", "package x\nfunc Brand() {}\n")], "path string, content string").withColumn("mtime", F.to_timestamp(F.lit("2024-02-01"))))
    third = store.build(more, incremental=True)
    assert third["processed"] == 1
    names = {r.name for r in store.table("symbols").collect()}
    assert "Brand" in names and "Point" not in names
    diff = {r.path: r.status for r in changes(files, store.table("file_meta")).collect()}
    assert diff["r.rs"] == "new" and diff["new.go"] == "removed" and diff["m.go"] == "same"
    store.delete_file("new.go")
    assert store.table("symbols").where("name = 'Brand'").count() == 0
    totals, languages, latest = status(store.table("file_meta"))
    assert totals.first().files == 6 and languages.count() >= 3 and latest.count() == 6
    store.backup(f"file://{tmp_path}/copy")
    other = IndexStore(spark, f"file://{tmp_path}/ix2")
    other.restore(f"file://{tmp_path}/copy")
    assert other.table("symbols").count() == store.table("symbols").count()
    assert store.vacuum() > 0 and store.table("symbols").count() > 0
    store.compact()
    store.clear()
    assert store.version() == 0


def test_command_line(spark, tmp_path, capsys):
    from quillmine.__main__ import main, size_of

    (tmp_path / "m.go").write_text(GO)
    assert size_of("10K") == 10240
    assert main(["helper", str(tmp_path)], spark=spark) == 0
    assert "return s + helper(name)" in capsys.readouterr().out
    assert main(["nowhere_at_all", str(tmp_path), "-q"], spark=spark) == 1
    assert main(["-F", "--symbols", "x", str(tmp_path)], spark=spark) == 2
    assert main(["--symbols", "Greet", str(tmp_path), "--index-path", f"{tmp_path}/ix"], spark=spark) == 0
    assert '"name": "Greet"' in capsys.readouterr().out
    assert main(["--json", "User", str(tmp_path)], spark=spark) == 0
    assert '"type":"begin"' in capsys.readouterr().out


def test_reachable_goes_to_the_end(spark):
    from quillmine.operators.refs import reachable

    ring = spark.createDataFrame([(f"f{i}", f"f{(i + 1) % 25}") for i in range(25)], "src_id string, dst_id string")
    start = spark.createDataFrame([("f3",)], "id string")
    assert {(r.id, r.hops) for r in reachable(ring, start).collect()} == {(f"f{(3 + i) % 25}", i) for i in range(25)}
    assert reachable(ring, start, max_hops=6).count() == 7
    with pytest.raises(RuntimeError):
        reachable(ring, start, safety=10)
