"""Look-ups by trigrams find what a scan finds, and read less."""

import random
import re

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "pattern, texts",
    [("hello", ["hello"]), ("hel+o wor", ["hel", "o wor"]), ("abc?def", ["ab", "def"]), (r"a\.bcd", ["a.bcd"]), (r"foo\w+bar", ["foo", "bar"]), ("foo(x|y)bar", ["foo", "bar"]), ("foo|bar", []), ("(?i)foo", []),
     ("a[]b]cde", ["a", "cde"]), ("a[^]]cde", ["a", "cde"]), (r"x{2,3}yzw", ["yzw"]), (r"\Qa|b\Ec", ["a|bc"]), (r"\Qa|b\E+c", []), (r"\x{41}bcd", ["bcd"]), (r"\pLbcd", ["bcd"]), (r"\p{Greek}bcd", ["bcd"]), (r"(?:ab)cd(e)*fgh", ["cd", "fgh"]),
     ("^start.*end$", ["start", "end"]), ("a{", ["a"]), ("*a", []), (r"[[:alpha:]]bcd", ["bcd"]), ("abc*?def", ["ab", "def"])],
)
def test_required_texts(pattern, texts):
    from quillmine.operators.trigrams import required_texts

    got = required_texts(pattern)
    assert [t for t in got if len(t) > 2] == [t for t in texts if len(t) > 2]


def test_every_match_has_the_required_texts():
    from quillmine.operators.trigrams import required_texts

    rng = random.Random(3)
    parts = ["a", "b", "abc", "x+", "y?", "z*", "[ab]", "[^a]", "(ab)", "(a|b)", "(?:bc)+", ".", r"\.", r"\w", "a{2}", "^", "$", "c"]
    texts = ["".join(rng.choices("abcxyz.", k=12)) for _ in range(400)]
    hits = 0
    for _ in range(800):
        pattern = "".join(rng.choices(parts, k=rng.randrange(1, 7)))
        need = required_texts(pattern)
        for text in texts[:60]:
            if m := re.search(pattern, text):
                hits += 1
                assert all(t in m[0] for t in need), (pattern, text, need)
    assert hits > 500


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    words = ["%s%s" % (rng.choice("abcdefgh") * 2, "".join(rng.choices("klmnopqrstuv", k=4))) for _ in range(300)]
    rows = [(f"f{i}", "\n".join(" ".join(rng.choices(words, k=6)) for _ in range(8))) for i in range(400)] + [("e", ""), ("n", None), ("s", "ab"), ("u", "Straße ſtop KELVIN K"), ("u", "twice"), ("c", "one\ntwo")]
    return spark.createDataFrame(rows, "path string, content string").cache(), words


def test_the_same_rows_as_a_scan(spark, corpus):
    from quillmine.operators.grep import GrepOptions, grep
    from quillmine.operators.trigrams import candidates, gram_rows, indexed_grep, required_grams

    files, words = corpus
    rows = gram_rows(files).cache()
    for o in (GrepOptions(words[0], literal=True), GrepOptions(words[1][2:], literal=True, ignore_case=True), GrepOptions(words[2] + r" \w+ \w*" + words[3][:1]), GrepOptions("kelvin", ignore_case=True), GrepOptions("stop", ignore_case=True),
              GrepOptions("STRASSE|twice"), GrepOptions("ab"), GrepOptions(words[4], invert=True), GrepOptions("one\ntwo", literal=True, across_lines=True), GrepOptions("ße", literal=True), GrepOptions(words[5], word=True, before=1)):
        got, want = (sorted(map(str, df.collect())) for df in (indexed_grep(files, rows, o), grep(files, o)))
        assert got == want, o
    o = GrepOptions(words[0], literal=True)
    assert 0 < candidates(rows, required_grams(o)).count() < 0.3 * files.count()


def test_lists_of_an_index(spark, tmp_path):
    from quillmine.operators.grep import GrepOptions, grep
    from quillmine.plans.index import IndexStore

    def frame(files):
        return spark.createDataFrame([(p, c, None) for p, c in files.items()], "path string, content string, mtime timestamp").withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))

    now = {f"f{i}.go": f"package a\n\nfunc Handle{i:03d}() int {{\n\treturn Other{i % 7}()\n}}\n" for i in range(200)}
    store = IndexStore(spark, f"file://{tmp_path}/t")
    store.build(frame(now), trigrams=True)
    assert sorted(r.name for r in store.names("NDLE01").collect()) == [f"Handle01{i}" for i in range(10)]
    assert [r.name for r in store.names("e199").collect()] == ["Handle199"] and store.names("zzz").count() == 0 and store.names("h").count() == 200
    now["f3.go"] = "package a\n\nfunc Brandnew() {}\n"
    store.build(frame(now), incremental=True)
    assert [r.name for r in store.names("brandnew").collect()] == ["Brandnew"] and store.names("handle003").count() == 0
    o = GrepOptions("Brandnew", literal=True)
    assert sorted(map(str, store.grep(frame(now), o).collect())) == sorted(map(str, grep(frame(now), o).collect()))
    plan = store.names("ndle01")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan or "gram#" in plan
