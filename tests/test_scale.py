"""What showed only on larger tables: units of sizes, names with many definitions, plans without broadcasts."""

import re

from pyspark.sql import functions as F


def test_sizes_round_to_even_and_the_last_unit_takes_the_rest(spark):
    from quillmine.functions.scalars import human_bytes

    sizes = [0, 1023, 1280, 1792, 1331, 1024 * 1024 - 1, 5 << 29, (5 << 29) + (1 << 18)]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    got = [tuple(r) for r in df.select(human_bytes(F.col("n")), human_bytes(F.col("n"), ("KB", "MB"))).collect()]
    small = ["0 B", "1023 B", "1.2 KB", "1.8 KB", "1.3 KB", "1024.0 KB"]
    assert got == [*zip(small, small), ("2.5 GB", "2560.0 MB"), ("2.5 GB", "2560.2 MB")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_symbols_of_a_name_are_dealt_out_and_none_are_lost(spark):
    from quillmine.operators.refs import by_name, references, resolved, token_occurrences
    from quillmine.operators.symbols import extract_symbols

    code = spark.createDataFrame([(f"d/f{i}.py", "python", f"class C{i}:\n    def run(self):\n        return run(C{(i + 1) % 40})\n") for i in range(40)], "path string, language string, content string")
    symbols = extract_symbols(code).persist()
    whole = sorted(map(tuple, resolved(symbols, token_occurrences(code), block=None).collect()))
    assert len(whole) == 40 * 80 + 40 * 2
    assert sorted(map(tuple, resolved(symbols, token_occurrences(code), block=7).collect())) == whole
    held = by_name(token_occurrences(code), symbols.select(F.col("name").alias("token"), "id"), "token", 7)
    assert held.groupBy("token", "path", "line", "col", "id").count().where("count > 1").isEmpty() and held.count() == len(whole)
    assert sorted(map(tuple, references(symbols, code).drop("context").collect())) == whole


def test_references_and_edges_broadcast_no_symbols(spark):
    from quillmine.plans import catalog

    for name in ("refs_cross_file", "refs_places", "refs_in_file", "refs_one_per_line", "refs_dedup", "find_references_query", "call_edges_query", "call_graph_one_hop"):
        text = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        # only the few names with blocks of symbols are broadcast, and no build is for nothing else
        assert text.count("SortMergeJoin") >= 1, name
        assert all("blocks" in line or "LeftOuter" in line for line in text.splitlines() if "BroadcastHashJoin" in line), name


def test_an_index_stores_no_product_of_names(spark, tmp_path):
    from quillmine.plans.index import IndexStore

    def files(n):
        rows = [(f"d/f{i}.py", f"class C{i}:\n    def run(self):\n        return 1\n") for i in range(n)]
        return spark.createDataFrame(rows, "path string, content string").withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))

    store = IndexStore(spark, f"file://{tmp_path}/x")
    done = store.build(files(60))
    assert done["references"] == 60 * 60 + 60 == store.table("refs").count()
    assert not list(tmp_path.rglob("refs/_bucket=*"))  # 60 files name 60 symbols each: they are joined, not written
    assert store.build(files(40), incremental=True)["references"] == 40 * 40 + 40
    assert {tuple(r) for r in store.reference_counts().groupBy("symbol_kind").agg(F.sum("refs")).collect()} == {("function", 1600), ("class", 40)}
    other = store.table("refs").where("name = 'run' and file_path = 'd/f3.py'").limit(1).withColumn("kind", F.lit("odd"))
    store.put("refs", other, ("symbol_id", "file_path", "line", "col"))
    assert store.table("refs").count() == 1640 and store.has("refs", kind="odd")
    assert store.reference_counts().agg(F.sum("refs")).first()[0] == 1640
    store.delete_file("d/f3.py")
    assert store.table("refs").count() == 39 * 39 + 39 and not store.has("refs", kind="odd")


def test_code_of_many_keys_is_many_tasks_and_extracted_once(spark, tmp_path):
    from pathlib import Path

    from quillmine.plans import catalog

    for name in ("nation", "region", "part", "supplier"):
        (tmp_path / f"{name}.parquet").symlink_to(Path("/root/testdata/sf0.001") / f"{name}.parquet")
    n = spark.read.parquet(f"{tmp_path}/part.parquet").count()
    files, catalog.FILES = catalog.FILES, -(-n // 7)
    try:
        assert catalog.code_files(spark, str(tmp_path)).where("path like 'js/%'").groupBy(F.spark_partition_id()).count().count() > 1
        text = plan(catalog.find_definitions_query(spark, str(tmp_path)))
    finally:
        catalog.FILES = files
    assert text.count("MapInArrow") == 1


def test_places_without_context_read_no_lines_again(spark):
    from quillmine.operators.refs import references
    from quillmine.operators.symbols import extract_symbols
    from quillmine.plans import catalog

    for name in ("call_graph_one_hop", "find_references_query"):
        assert plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")).count("posexplode(split(content") == 1, name
    code = catalog.code_files(spark, "/root/testdata/sf0.001")
    symbols = extract_symbols(code).persist()
    for same in (False, True):
        assert sorted(map(tuple, references(symbols, code, same, context=False).collect())) == sorted(map(tuple, references(symbols, code, same).drop("context").collect()))


def test_line_rules_meet_a_line_once(spark):
    from quillmine.operators.symbols import _RULES
    from quillmine.plans import catalog

    text = plan(catalog.symbol_defs(spark, "/root/testdata/sf0.001"))
    assert text.count("RLIKE(line") == sum(map(len, _RULES.values()))


def test_names_are_looked_up_in_symbols_that_were_made_once(spark):
    from quillmine.plans import catalog

    assert "RLIKE" not in plan(catalog.names_by_trigrams(spark, "/root/testdata/sf0.001"))


def test_files_are_parsed_once_for_symbols_and_errors(monkeypatch):
    import ast

    from quillmine.functions import scanners

    asked = []
    parse = ast.parse
    monkeypatch.setattr(ast, "parse", lambda s: asked.append(s) or parse(s))
    for source, errors in (("def once_a(x):\n    return x\n", []), ("def once_b(:\n", [(1, 12, "invalid syntax")])):
        assert [f[0] for f in scanners.described(source, "python", True)] == [source[4:10]]
        assert scanners.syntax_errors(source, "python") == errors
    assert len(asked) == 2
    assert scanners.syntax_errors("function once_c() {\n", "javascript") == [(1, 19, "unclosed {")]


def test_filters_on_files_stay_behind_the_dealing_out(spark, monkeypatch):
    from quillmine.plans import catalog

    monkeypatch.setattr(catalog, "FILES", 50)
    for files in (catalog.app_files, catalog.code_files):
        found = files(spark, "/root/testdata/sf0.001").where("path like '%1.py' and length(content) > 3")
        text = plan(found)  # a filter that was moved before an exchange would run in its one task
        assert "ExistingRDD" in text and "Exchange" not in text
        assert found.count() > 0


def test_the_total_of_references_is_the_sum_of_their_counts(spark, tmp_path):
    from quillmine.plans import catalog
    from quillmine.plans.index import IndexStore

    store = IndexStore(spark, f"file://{tmp_path}/x")
    done = store.build(catalog.code_files(spark, "/root/testdata/sf0.001").withColumn("mtime", F.lit("2024-01-01").cast("timestamp")))
    assert done["references"] == store.reference_total() == store.reference_counts().agg(F.sum("refs")).first()[0] > 0


def test_tokens_are_counted_without_a_shuffle_of_files(spark):
    from quillmine.operators.refs import token_counts

    files = spark.createDataFrame([("a", "x y x\n$z x"), ("b", "y"), ("c", ""), ("d", "--")], "path string, content string")
    counts = token_counts(files)
    assert sorted(map(tuple, counts.collect())) == [("$z", 1, 1), ("x", 3, 1), ("y", 2, 2)]
    dealt = [line for line in plan(counts).splitlines() if "Exchange" in line]
    assert dealt and all("hashpartitioning(token" in line and "path" not in line for line in dealt)
    again = token_counts(files.union(files.where("path = 'a'")))  # a path of two rows is still one file
    assert sorted(map(tuple, again.collect())) == [("$z", 2, 1), ("x", 6, 1), ("y", 3, 2)]


def test_callers_by_name_are_no_product_of_calls_and_definitions(spark, monkeypatch):
    from quillmine.operators import refs
    from quillmine.plans import catalog

    def product(*_):
        raise AssertionError("calls meet all definitions of their names")

    monkeypatch.setattr(refs, "by_name", product)
    got = {tuple(r) for r in catalog.callers_of(spark, "/root/testdata/sf0.001").where("callee in ('Handle3', 'helper3')").collect()}
    assert got == {("Handle3", 2), ("helper3", 1)}


def test_a_hop_shuffles_what_is_new_and_not_the_edges(spark, monkeypatch):
    from quillmine.operators import refs

    plans, cut = [], refs.cut
    monkeypatch.setattr(refs, "cut", lambda df: plans.append(plan(df)) or cut(df))
    edges = spark.createDataFrame([(f"f{i}", f"f{(i + 1) % 20}") for i in range(20)], "src_id string, dst_id string")
    found = refs.reachable(edges, spark.createDataFrame([("f3",)], "id string"))
    assert {tuple(r) for r in found.collect()} == {(f"f{(3 + i) % 20}", i) for i in range(20)}
    # the first hop may deal them out as start's ids are
    assert len(plans) > 20 and sum(bool(re.search(r"hashpartitioning\(src_id#\d+, \d+\), ENSURE_REQUIREMENTS", p)) for p in plans) <= 1


def test_a_product_of_places_and_symbols_is_many_tasks(spark):
    from quillmine.operators.refs import by_name

    places = spark.createDataFrame([("run" if i % 5 else f"f{i}", f"d/f{i % 70}.py", i) for i in range(350)], "token string, path string, line int")
    named = spark.createDataFrame([("run" if i % 9 else f"f{i}", f"id{i}") for i in range(90)], "token string, id string").persist()
    met = by_name(places, named, "token", 2)
    want = sorted(map(tuple, by_name(places, named, "token", None).collect()))
    assert len(want) >= 280 * 80 and sorted(map(tuple, met.collect())) == want
    tasks = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    # the bytes that come in are few, so Spark alone would make it one task
    assert len(tasks) >= 40 and max(tasks) < 0.1 * len(want)


def test_lines_with_a_symbol_need_no_columns_and_symbols_are_made_once(spark):
    from quillmine.operators.symbols import _RULES
    from quillmine.plans import catalog

    text = plan(catalog.refs_one_per_line(spark, "/root/testdata/sf0.001"))
    assert "octet_length" not in text and text.count("RLIKE") < sum(map(len, _RULES.values()))


def test_places_read_symbols_that_were_made_once(spark):
    from quillmine.operators.symbols import _RULES
    from quillmine.plans import catalog

    assert plan(catalog.refs_places(spark, "/root/testdata/sf0.001")).count("RLIKE") < sum(map(len, _RULES.values()))
