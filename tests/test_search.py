import pytest
from pyspark.sql import functions as F

from quillmine.operators.grep import GrepOptions, count_matches, files_with_matches, grep
from quillmine.plans import output as out


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("a.txt", "one\ntwo test\nthree\nfour\nfive"),
        ("b.txt", "Test é test\nnothing\n"),
        ("c.log", "start\ntest\npattern\nend"),
        ("d.bin", "test\x00x"),
        ("e.txt", ""),
    ]
    return spark.createDataFrame(rows, "path string, content string")


def places(df):
    return sorted((r.path, r.line_no, r.col_start, r.col_end, r.match) for r in df.collect())


def test_matches_have_byte_columns(files):
    assert places(grep(files, GrepOptions("test"))) == [("a.txt", 2, 5, 9, "test"), ("b.txt", 1, 9, 13, "test"), ("c.log", 2, 1, 5, "test")]


def test_case_and_limits(files):
    got = places(grep(files, GrepOptions("test", ignore_case=True, max_count=1)))
    assert [g[0] for g in got] == ["a.txt", "b.txt", "c.log"]
    assert grep(files, GrepOptions("test", binary_as_text=True)).where("path = 'd.bin'").count() == 1
    assert places(grep(files, GrepOptions("test", globs=("*.log",)))) == [("c.log", 2, 1, 5, "test")]


def test_context_and_invert(files):
    row = grep(files, GrepOptions("two", context=2)).first()
    assert row.before == ["one"] and row.after == ["three", "four"]
    assert grep(files, GrepOptions("test", invert=True)).where("path = 'c.log'").count() == 3


def test_empty_matches_fall_back(files):
    got = places(grep(files.where("path = 'a.txt'"), GrepOptions("x*")))
    assert ("a.txt", 1, 1, 1, "") in got


def test_across_lines(files):
    row = grep(files, GrepOptions("test.*pattern", across_lines=True, dot_all=True)).where("path = 'c.log'").first()
    assert (row.line_no, row.end_line, row.col_start, row.col_end) == (2, 3, 1, 8) and "\n" in row.match


def test_counts_and_file_lists(files):
    got = {r.path: (r.lines, r.occurrences) for r in count_matches(files, GrepOptions("test")).collect()}
    assert got == {"a.txt": (1, 1), "b.txt": (1, 1), "c.log": (1, 1), "e.txt": (0, 0)}
    assert {r.path for r in files_with_matches(files, GrepOptions("test"), without=True).collect()} == {"e.txt"}


def test_offsets(files):
    row = grep(files, GrepOptions("three", absolute_offset=True)).first()
    assert row.absolute_offset == len("one\ntwo test\n")


def test_replacement(files):
    assert grep(files, GrepOptions("(t)wo", replacement="$1oo")).first().line == "too test"


def test_bad_options():
    with pytest.raises(ValueError):
        GrepOptions("")
    with pytest.raises(ValueError):
        GrepOptions("a", before=-1)


def test_output(files):
    m = grep(files, GrepOptions("test", context=1, absolute_offset=True)).persist()
    text = [r.value for r in out.text_output(m).collect()]
    assert "a.txt:2:two test" in text and "a.txt-1-one" in text
    coloured = [r.value for r in out.text_output(m, color=True, filename=False).where("path = 'b.txt'").collect()]
    assert "1:Test é \x1b[1m\x1b[31mtest\x1b[0m" in coloured
    messages = out.json_messages(m)
    assert out.invalid_messages(messages).count() == 0
    assert out.invalid_messages(messages.sparkSession.createDataFrame([('{"type":"match","data":{}}',), ("nonsense",)], "value string")).count() == 2
    kinds = [r[0] for r in messages.select(F.get_json_object("value", "$.type")).collect()]
    assert kinds[0] == "begin" and kinds[-1] == "summary" and kinds.count("match") == 3
    assert [r.value for r in out.count_output(m).collect()] == ["a.txt:1", "b.txt:1", "c.log:1"]
    assert out.json_lines(m).count() == 3 and out.json_lines_summary(m).count() == 1
