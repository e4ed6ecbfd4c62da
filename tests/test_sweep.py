"""Enclosing spans against comparing all with all, and in linear time."""

import random
import time

import pytest
from pyspark.sql import functions as F


def around(spans, start, end, same):
    fit = [(e - s, i) for s, e, i in spans if s <= start and e >= end and (same or (s, e) != (start, end))]
    return min(fit)[1] if fit else None


def swept(spans, asks, same):
    from quillmine.operators.sweep import Open

    held, got = Open(), {}
    for s, e, ask, i in sorted([(s, -e, 0, i) for s, e, i in spans] + [(s, -e, 1, i) for s, e, i in asks]):
        held.reach(s)
        if ask:
            got[i] = held.innermost(s, -e, same)
        elif -e >= s:
            held.add(s, -e, i)
    return got


@pytest.mark.parametrize("same", [False, True])
def test_spans_of_any_kind(same):
    rng = random.Random(4)
    for n in range(300):
        width = rng.choice((6, 30, 200))
        spans = [(a, a + rng.choice((0, 1, rng.randrange(width))), f"s{i}") for i, a in enumerate(rng.choices(range(width), k=rng.randrange(0, 25)))]
        asks = [(s, e, f"a{i}") for i, (s, e, _) in enumerate(spans)] + [(a, a + rng.randrange(0, 4), f"b{i}") for i, a in enumerate(rng.choices(range(width), k=15))]
        assert swept(spans, asks, same) == {i: around(spans, s, e, same) for s, e, i in asks}, n


def test_a_hundred_thousand_symbols_of_a_file(spark):
    from quillmine.operators.refs import call_edges
    from quillmine.operators.symbols import scopes

    n = 100_000
    rows = spark.range(n).select(
        F.concat(F.lit("m"), "id").alias("id"), F.lit("method").alias("kind"), F.concat(F.lit("f"), "id").alias("name"), F.lit("a.java").alias("file_path"), (2 + 3 * F.col("id")).cast("int").alias("start_line"), (4 + 3 * F.col("id")).cast("int").alias("end_line")
    )
    rows = rows.unionByName(spark.createDataFrame([("c", "class", "C", "a.java", 1, 3 * n + 2)], rows.schema))
    scopes(rows.limit(10)).count()
    began = time.monotonic()
    got = scopes(rows).groupBy("parent_id").count().collect()
    assert {r.parent_id: r["count"] for r in got} == {"c": n, None: 1} and time.monotonic() - began < 40
    code = spark.createDataFrame([("a.java", "java", "class C {\n" + "".join(f"void f{i}() {{\n  f{i + 1}(x);\n}}\n" for i in range(20_000)) + "}")], "path string, language string, content string")
    edges = call_edges(rows.where("id <> 'c'"), code)
    assert edges.where("src_id = dst_id").count() == 20_000 and edges.where("src_id <> dst_id").count() == 20_000


def test_scopes_of_awkward_symbols(spark):
    from quillmine.operators.symbols import scopes

    rows = [("a", "class", 1, 9), ("b", "function", 1, 9), ("c", "method", 2, 3), ("d", "field", 2, 3), ("e", "class", 3, 12), ("f", "variable", 8, 9), ("g", "function", 5, None), ("h", "variable", 20, 20)]
    frame = spark.createDataFrame([(i, k, "x.go", s, e) for i, k, s, e in rows], "id string, kind string, file_path string, start_line int, end_line int")
    got = {r.id: r.parent_id for r in scopes(frame).collect()}
    whole = [(s, e, i) for i, k, s, e in rows if k in ("class", "function", "method") and e]
    assert got == {i: around(whole, s, e, False) if e else None for i, _, s, e in rows}
    assert scopes(frame.limit(0)).count() == 0
