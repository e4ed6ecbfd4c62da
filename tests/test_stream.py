import time

from pyspark.sql import functions as F

from quillmine.plans.index import IndexStore
from quillmine.streaming.watch import capped_batches, debounced, event_source, last_operations, mapped_events, watch


def events(spark, rows):
    return spark.createDataFrame(rows, "root string, path string, operation string, time string, size long").withColumn("time", F.to_timestamp("time"))


ROWS = [("r", "a.go", "create", "2024-01-01 00:00:00.0", 1), ("r", "a.go", "write", "2024-01-01 00:00:00.3", 1), ("r", "b.go", "write", "2024-01-01 00:00:00.8", 1), ("r", "a.go", "remove", "2024-01-01 00:00:05.0", 1)]


def test_sessions_and_last_operation(spark):
    e = events(spark, ROWS)
    assert sorted(len(r.events) for r in debounced(e).collect()) == [1, 3]
    assert {r.path: r.action for r in last_operations(e).collect()} == {"a.go": "remove", "b.go": "write"}
    odd = events(spark, [("r", "node_modules/x.go", "write", "2024-01-01", 1), ("r", "x.go", "chmod", "2024-01-01", 1), ("r", "y.go", "WRITE", "2024-01-01", 1)])
    assert [r.path for r in mapped_events(odd).collect()] == ["y.go"]


def test_watch_updates_the_index(spark, tmp_path):
    folder, code = tmp_path / "events", tmp_path / "code"
    folder.mkdir()
    code.mkdir()
    (code / "a.go").write_text("package a\nfunc Alpha() {}\n")
    (code / "b.go").write_text("package a\nfunc Beta() {}\n")
    store = IndexStore(spark, f"file://{tmp_path}/ix")

    def files_of(paths):
        rows = [(p, (code / p).read_text()) for p in paths]
        return spark.createDataFrame(rows, "path string, content string").withColumn("mtime", F.current_timestamp())

    def run(name, rows):
        events(spark, rows).coalesce(1).write.json(f"{tmp_path}/{name}")
        for f in (tmp_path / name).glob("*.json"):
            f.rename(folder / f"{name}.json")
        watch(event_source(spark, str(folder)), store, files_of, f"{tmp_path}/cp", once=True).awaitTermination(60)

    run("one", ROWS[:3])
    assert {r.name for r in store.table("symbols").collect()} == {"Alpha", "Beta"}
    (code / "b.go").write_text("package a\nfunc Gamma() {}\n")
    run("two", [("r", "a.go", "remove", "2024-01-01 00:01:00", 1), ("r", "b.go", "write", "2024-01-01 00:01:01", 1)])
    assert {r.name for r in store.table("symbols").collect()} == {"Gamma"}


def test_capped_batches(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [("r", f"{i}.go", "write", f"2024-01-01 00:00:{i % 60:02d}", 1) for i in range(120)]
    events(spark, rows).coalesce(1).write.json(str(folder))
    stream = capped_batches(event_source(spark, str(folder)), size=50)
    q = stream.writeStream.format("memory").queryName("capped").outputMode("append").trigger(processingTime="200 milliseconds").start()
    until = time.time() + 90
    while spark.table("capped").count() < 2 and time.time() < until:
        time.sleep(0.5)
    got = sorted(r.n for r in spark.table("capped").collect())
    q.stop()
    assert got[-2:] == [50, 50]
