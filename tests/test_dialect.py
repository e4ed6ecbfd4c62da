import re

import pytest

from quillmine.functions.dialect import PatternError, glob_pattern, java_pattern, may_match_empty, quote, required_literal


@pytest.mark.parametrize("bad", [r"a(?=b)", r"(?<!a)b", r"(a)\1", r"(?>a)", r"a\C", "(a", "[a", r"a\Z", "a*+"])
def test_unsupported(bad):
    with pytest.raises(PatternError):
        java_pattern(bad)


CASES = [
    (r"\bla\b", "éla la", 2), (r"a$", "a\r", 0), (r"a.c", "a\rc", 1), (r"[[:alpha:]]+", "ab1c", 2), (r"(?P<x_y>a)b", "ab", 1), (r"[a&&b]", "&", 1), (r"\sx", "\x0bx", 0),
    (r"É", "é", 0), (r"(?i)É", "é", 1), (r"\Qa.b\E", "a.b axb", 1), (r"[^]a]", "b", 1), (r"\x{e9}", "é", 1), (r"(?s:a.b)", "a\nb", 1), (r"\p{Greek}", "α", 1), (r"x{2}", "xx", 1),
]


def test_meaning_on_the_jvm(spark):
    from pyspark.sql import functions as F

    for pattern, text, n in CASES:
        df = spark.createDataFrame([(text,)], "t string")
        got = df.select(F.size(F.regexp_extract_all("t", F.lit(java_pattern(pattern)), F.lit(0)))).first()[0]
        assert got == n, (pattern, text, got)


def test_options(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("foobar",), ("bar",), ("a.b",), ("axb",), ("ÉTÉ",)], "t string")

    def hits(p, **o):
        return {r.t for r in df.where(F.col("t").rlike(java_pattern(p, **o))).collect()}

    assert hits("foo|bar", word=True) == {"bar"}
    assert hits("foo|bar", whole_line=True) == {"bar"}
    assert hits("a.b", literal=True) == {"a.b"}
    assert hits("été", ignore_case=True) == {"ÉTÉ"}


def test_multiline_anchors(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a\nb\n",)], "t string")
    n = df.select(F.size(F.regexp_extract_all("t", F.lit(java_pattern("^[ab]$", multiline=True)), F.lit(0)))).first()[0]
    assert n == 2


def test_helpers():
    assert may_match_empty("a*") and may_match_empty("a|") and not may_match_empty("ab+") and not may_match_empty(r"\p{L}+x")
    assert required_literal("abc.def$") in ("abc", "def") and required_literal("a|b") is None

    def fits(glob, name):
        return re.match(glob_pattern(glob).replace(r"\z", r"\Z"), name) is not None

    assert fits("*.g?", "x.go") and not fits("*.g?", "d/x.go") and not fits("*.g?", "x.goo")
    assert fits("[^a]b", "cb") and not fits("[^a]b", "ab") and fits("[!a]b", "cb") and fits("a\\*", "a*")
    assert re.fullmatch(quote("a.b*c"), "a.b*c")
