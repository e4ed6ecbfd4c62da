"""What several of the training-data operators share: the folder that all
executors see, written intermediate tables, and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_folder: dict[str, str] = {}
_app_folders: set[str] = set()
#: Links from which a node's neighbours can be too many for one task.
HUB_LINKS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by the driver and all executors: spark.checkpoint.dir.

    Only where that is unset, in local mode, a temporary folder takes its place;
    on a cluster a missing setting is an error, as a machine's own folder would
    not be seen by the other machines.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "at" not in _own_folder:
        _own_folder["at"] = tempfile.mkdtemp(prefix="quillmine-")
        atexit.register(shutil.rmtree, _own_folder["at"], True)
    return f"file://{_own_folder['at']}"


def new_path(spark: SparkSession, label: str) -> str:
    """A new name in the application's folder, which goes when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/quillmine/{spark.sparkContext.applicationId}"
    if folder not in _app_folders:
        at, store = _file_system(spark, folder)
        store.mkdirs(at)
        store.deleteOnExit(at)
        _app_folders.add(folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: For rows of some megabytes each: a reader holds a row group whole, and Parquet would else
#: look at the size of one after 100 rows only.
LARGE_ROWS = {"parquet.block.row.count.limit": "1"}


def written(spark: SparkSession, df: DataFrame, label: str, slim: bool = False, compression: str = "snappy", large_rows: bool = False) -> DataFrame:
    """df as a table in the shared folder: it is computed once, its lineage ends
    there, and a lost executor costs no more than reading it again. slim: a few
    numbers a row, so that an eighth of the usual files will do. large_rows: some
    megabytes a row, so that each is a row group."""
    path = new_path(spark, label)
    df = df.coalesce(max(8, shuffle_partitions(spark) // 8)) if slim else df
    df.write.options(**LARGE_ROWS if large_rows else {}).option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillmine_path = path
    return out


def dropped(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_quillmine_path", None)
        if path:
            remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    at, store = _file_system(spark, path)
    store.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, by way of Spark's file systems."""
    at, store = _file_system(spark, path)
    out = store.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def component_labels(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id on an edge (a, b) of longs; component is the
    smallest id that it reaches.

    Alternating large-star and small-star steps: both are a min() per node and a
    join, so a hub is pre-aggregated and no neighbour list is ever built. Where
    there are enough links for a hub to matter, the minima are a written table:
    both sides of the join are then plain shuffles, which adaptive execution
    splits where a hub makes one of them skewed. Links stay distributed; the
    driver sees a count and a checksum per round.
    """
    minima: list[DataFrame] = []

    def joined(links: DataFrame, low: DataFrame, many: bool) -> DataFrame:
        if many:
            low = written(spark, low, "links-low", slim=True)
            minima.append(low)
        return links.join(low, "a")

    def settle(df: DataFrame) -> tuple[DataFrame, tuple]:
        out = written(spark, df.where("a <> b").distinct(), "links", slim=True)
        row = out.agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("a", "b")).alias("x"),
            F.sum((F.xxhash64("a", "b") % 1000003).cast("long")).alias("s"),
        ).first()
        return out, (row.n, row.x, row.s)

    now, mark = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = joined(both, low, mark[0] > HUB_LINKS).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = joined(large, low, mark[0] > HUB_LINKS)
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
        new, new_mark = settle(small)
        dropped(spark, now, *minima)
        minima.clear()
        same, now, mark = new_mark == mark, new, new_mark
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    give_back(spark)
    labels = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores until no column has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of so many rows at most: ten thousand,
    Spark's default, can be some hundred megabytes of them at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def give_back(spark: SparkSession | None = None) -> None:
    """Memory that this process no longer uses returns to the system; the collector
    and Arrow would keep it. spark: the driver's JVM collects too, and with what is
    gone there Spark drops broadcasts and shuffles that nothing refers to."""
    if spark is not None:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def lean(fn):
    """fn for mapInArrow, after which a worker gives memory back: workers live on, and
    what one stage held would add up with the next."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def appended(docs: DataFrame, inputs: list[str], fields: list[tuple[str, str, pa.DataType]], fn) -> DataFrame:
    """docs with new columns, made a batch at a time by fn(*arrays of the input
    columns), which returns an array for each of fields (name, SQL type, Arrow
    type). The other columns pass through as they are, but those with the name of
    a new one, which takes their place; nothing is shuffled."""
    new = {name.lower() for name, _, _ in fields}
    bounded_batches(docs.sparkSession)
    n, at = len(docs.columns), [docs.columns.index(c) for c in inputs]
    rows = docs.toDF(*(f"c{i}" for i in range(n)))
    names = [*rows.columns, *(f"y{i}" for i in range(len(fields)))]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(f"y{i}", T._parse_datatype_string(kind)) for i, (_, kind, _) in enumerate(fields))])
    kinds = [kind for _, _, kind in fields]

    def run(batches):
        for batch in batches:
            made = fn(*(batch.column(i) for i in at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, kind) for x, kind in zip(made, kinds))], names=names)

    out = rows.mapInArrow(lean(run), schema)
    back = [F.col(c).alias(name) for c, name in zip(rows.columns, docs.columns) if name.lower() not in new]
    return out.select(*back, *(F.col(f"y{i}").alias(name) for i, (name, _, _) in enumerate(fields)))
