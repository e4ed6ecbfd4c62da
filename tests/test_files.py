import pytest
from pyspark.sql import functions as F

from quillmine.operators import filters as fl
from quillmine.operators.ignore import RuleError, is_ignored, load_rules, mark_ignored, matches_rule, parse_rule, parse_rules, preset, rule_stats, rules_frame
from quillmine.operators.languages import FileTypes, Language, include_files


@pytest.mark.parametrize(
    "text, negate, dir_only, anchored",
    [("*.txt", 0, 0, 0), ("!important.txt", 1, 0, 0), ("temp/", 0, 1, 0), ("/root/file", 0, 0, 1), ("dir/subdir/", 0, 1, 1), ("**/*.go", 0, 0, 0)],
)
def test_parse(text, negate, dir_only, anchored):
    r = parse_rule(text)
    assert (r.negate, r.dir_only, r.anchored) == (bool(negate), bool(dir_only), bool(anchored))


def test_comments_are_no_rules():
    with pytest.raises(RuleError):
        parse_rule("#comment")


#: Patterns and paths of ignore rules with their verdicts.
MATCHES = [
    ("*.txt", "file.txt", 0, 1), ("*.txt", "file.go", 0, 0), ("temp", "temp", 0, 1), ("temp", "temp", 1, 1), ("temp", "temp/file.txt", 0, 1), ("temp/", "temp", 1, 1), ("temp/", "temp", 0, 0),
    ("/root", "root", 0, 1), ("/root", "subdir/root", 0, 0), ("dir/file", "dir/file", 0, 1), ("dir/file", "other/dir/file", 0, 0), ("**/*.go", "main.go", 0, 1), ("**/*.go", "deep/nested/src/main.go", 0, 1),
    ("src/**", "src/file.txt", 0, 1), ("src/**", "src/deep/file.txt", 0, 1), ("*.[ch]", "file.c", 0, 1), ("*.[ch]", "file.h", 0, 1), ("*.[ch]", "file.go", 0, 0),
]


@pytest.mark.parametrize("rule, path, is_dir, want", MATCHES)
def test_matches(rule, path, is_dir, want):
    assert matches_rule(parse_rule(rule), path, bool(is_dir)) == bool(want)


#: An ignore file, and the verdicts on paths.
FILE = "# Test\n*.tmp\nbuild/\n!important.tmp\nsrc/**/*.test\n!build/keep/\n!build/keep/**\n"
VERDICTS = [
    ("file.tmp", False, True), ("important.tmp", False, False), ("build", True, True), ("build/output", False, True), ("src", True, False), ("src/file.go", False, False),
    ("src/deep/file.test", False, True), ("regular.txt", False, False), ("build/keep", True, False), ("build/keep/file.txt", False, False),
]


def test_last_match_wins(spark):
    rules = parse_rules(FILE)
    paths = spark.createDataFrame(VERDICTS, "path string, is_dir boolean, want boolean")
    assert paths.where(is_ignored(F.col("path"), F.col("is_dir"), rules) != F.col("want")).count() == 0
    marked = mark_ignored(paths, rules_frame(spark, rules), is_dir="is_dir")
    assert marked.count() == len(VERDICTS) and marked.where("ignored <> want").count() == 0
    assert rule_stats(rules_frame(spark, rules)).first().negated == 3


def test_rule_files(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".gitignore").write_text("*.log\n")
    (tmp_path / "sub" / ".gitignore").write_text("!keep.log\n/only\n")
    rules = load_rules(str(tmp_path), parents=False)

    def verdict(path):
        out = False
        for r in rules:
            out = (not r.negate) if matches_rule(r, path, False) else out
        return out

    assert verdict("a.log") and not verdict("sub/keep.log") and verdict("sub/only") and not verdict("only") and verdict("sub/x.log")
    assert len(preset("rust")) == 4


def test_languages(spark):
    rows = [
        ("main.go", "", "Go"), ("script.py", "", "Python"), ("index.js", "", "JavaScript"), ("component.tsx", "", "TypeScript"), ("styles.css", "", "CSS"), ("data.json", "", "JSON"), ("README.md", "", "Markdown"),
        ("unknown.xyz", "", None), ("python_script", "#!/usr/bin/env python3", "Python"), ("bash_script", "#!/bin/bash", "Shell"), ("node_script", "#!/usr/bin/env node", "JavaScript"),
        ("ruby_script", "#!/usr/bin/ruby", "Ruby"), ("php_script", "#!/usr/bin/php", "PHP"), ("no_shebang", "echo", None), ("a/.github/workflows/x.yml", "", "YAML"), ("x/Dockerfile", "", "Docker"),
    ]
    df = spark.createDataFrame(rows, "path string, head string, want string")
    got = df.withColumn("got", FileTypes().detect(F.col("path"), F.col("head"))["language"])
    assert [r for r in got.collect() if r.got != r.want] == []
    types = FileTypes()
    types.add(Language("Odd", (".xyz",)))
    assert include_files(df, types, include=("Odd",)).count() == 1
    assert types.frame(spark).count() == 22


def test_binary(spark):
    rows = [(b"Hello, world!", 0, 0), (b"Hello\x00", 1, 1), (b"Hello\nWorld\t!", 0, 0), (b"\x01\x02\x03\x04\x05", 1, 1), (b"", 0, 0), (b"Text\x01\x02\x03more text", 1, 1), (b"\xff\xfe", 0, 1), (b"abc\x01b", 0, 1)]
    df = spark.createDataFrame([(bytearray(b), bool(r), bool(s)) for b, r, s in rows], "b binary, ratio boolean, strict boolean")
    assert df.where(fl.is_binary(F.col("b"), "ratio") != F.col("ratio")).count() == 0
    assert df.where(fl.is_binary(F.col("b"), "strict") != F.col("strict")).count() == 0


def test_paths(spark):
    df = spark.createDataFrame([("a/b.go",), ("a/.h/c.py",), ("vendor/x/y.go",), ("d.test.go",)], "path string")
    assert df.where(fl.has_type(F.col("path"), ["go"])).count() == 3
    assert df.where(fl.is_hidden(F.col("path"))).count() == 1
    assert {r.path for r in df.where(fl.index_file_filter(F.col("path"), ["*.go"], ["vendor/*", "*.test.go"])).collect()} == {"a/b.go"}


def test_tree_source(spark, tmp_path):
    from quillmine.sources.codetree import read_tree

    for name in ("__init__.py", "sub/_p.py", ".dot.py", "m.go", ".hid/q.go", "sub/deep/x.go", "big.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x" * (5000 if name == "big.txt" else 3))
    (tmp_path / ".gitignore").write_text("_p.py\n")

    def names(**options):
        return {r.rel_path for r in read_tree(spark, str(tmp_path), **options).select("rel_path").collect()}

    assert names() == {"__init__.py", "sub/_p.py", "m.go", "sub/deep/x.go", "big.txt"}
    assert {".dot.py", ".hid/q.go"} <= names(hidden=True)
    assert "sub/_p.py" not in names(respect_ignore=True)
    assert names(max_depth=0) == {"__init__.py", "m.go", "big.txt"}
    assert names(glob="*.go") == {"m.go", "sub/deep/x.go"}
    tree = read_tree(spark, str(tmp_path))
    assert tree.where("ext = '.go' and size < 10").count() == 2
    assert tree.where("name = 'm.go'").first().content == b"xxx"
