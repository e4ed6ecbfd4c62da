"""Best-fit packing of documents into sequences of a fixed token capacity.

Each document is tokenised once; what is over the capacity is cut into pieces
of exactly the capacity. Pieces over half of it open a sequence each, as no two
of them fit together. The others are placed in bulk-synchronous rounds:

* pieces and gaps are sorted by size, largest first, gaps before pieces of the
  same size; a piece takes the last gap before it that no earlier piece took,
  its best fit. That is bracket matching: with gaps as opening and pieces as
  closing brackets, partners are neighbours on the same nesting level;
* levels come from ranks within a size plus prefix sums over the sizes (of
  which there are no more than the capacity), so nothing is swept by one task.
  Ranks are taken within salted parts of a size, and a level holds two rows for
  each size at most, so a size that a third of all pieces have is no hot spot;
* gaps shrink by what they took, pieces over the largest gap open new
  sequences, and the next round begins. A gap that could take several of the
  largest pieces counts as several.

Cases: null or empty text is one token, the end id; long texts are tokenised in
parts and cut into pieces whole; documents with the same id are packed each; among
pieces, and gaps, of one size any order is a best fit; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, dropped, lean, written
from .tokens import text_groups, token_ids, with_end

_PIECE = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32. uid differs in each row, but
    is another in each run of a task: write the result before using it."""

    def cut(batches):
        lib = token_ids(tokenizer)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_groups(texts):
                ids, limits = with_end(lib.encode(texts[a:b]), end_id, np.dtype("<u4"))
                size = np.diff(limits)
                pieces = -(-size // capacity)
                doc = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                at, raw = 4 * (limits[doc] + start), memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(at.tolist(), (at + 4 * length).tolist())]
                names = batch.column(0).slice(a, b - a).take(pa.array(doc))
                columns = [np.arange(uid, uid + len(doc)), names, piece, start, length, crc]
                uid += len(doc)
                yield pa.RecordBatch.from_arrays([c if f.name == "doc_id" else pa.array(c, f.type) for c, f in zip(columns, _PIECE)], schema=_PIECE)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(cut), "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")


def _histogram(df: DataFrame, col: str) -> dict[int, int]:
    """Rows by size: no more entries than the capacity."""
    return {r[0]: r[1] for r in df.groupBy(col).count().collect()}


def best_fit(spark: SparkSession, pieces: DataFrame, capacity: int, part_rows: int = 500_000) -> DataFrame:
    """pieces(uid, length) -> uid, sequence_id, round, slot: the order of a
    sequence's pieces is that of (round, slot). The rows of a size are ranked in up to
    16 parts, and in more where these would have over part_rows rows."""

    def parts(rows: int) -> int:
        return 1 + max(min(rows // 500, 15), rows // part_rows)

    whole = pieces.where(F.col("length") > capacity // 2)
    placed = [whole.select("uid", "length", F.col("uid").alias("sequence_id"), F.lit(0).alias("round"), F.lit(0).alias("slot"))]
    todo = pieces.where(F.col("length") <= capacity // 2).select("uid", "length")
    left = _histogram(todo, "length")
    least = min(left, default=0)
    gaps = whole.select(F.col("uid").alias("bin"), (F.lit(capacity) - F.col("length")).cast("long").alias("gap")).where(F.col("gap") >= max(1, least))
    room = _histogram(gaps, "gap")
    old: list[DataFrame] = []

    def files(rows: int) -> int:
        """For so many slim rows; late rounds have few."""
        return -(-rows // 200_000) or 1

    opened, round_no = 0, 0
    while left:
        round_no += 1
        top, most = max(left), max(room, default=0)
        if over := [s for s in left if s > most]:
            new = -(-sum(s * left[s] for s in over) // capacity)
            fresh = spark.range(opened + 1, opened + new + 1).select((-F.col("id")).alias("bin"), F.lit(capacity).cast("long").alias("gap"))
            gaps, opened = gaps.unionByName(fresh), opened + new
            room[capacity] = room.get(capacity, 0) + new
        n_gaps = sum(room.values())
        per_bin = 1 + sum(left.values()) // n_gaps
        k = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / F.lit(top)), F.lit(per_bin))).cast("int")
        slots = gaps.withColumn("k", k).select("bin", "gap", "k", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("slot"))
        slots = slots.withColumn("size", F.when(F.col("slot") < F.col("k"), F.lit(top)).otherwise(F.col("gap") - (F.col("k") - 1) * top).cast("long"))
        events = slots.select("size", F.lit(0).alias("kind"), F.col("bin").alias("who"), "slot", "gap").unionByName(
            todo.select(F.col("length").cast("long").alias("size"), F.lit(1).alias("kind"), F.col("uid").alias("who"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("gap"))
        )
        offered: dict[int, int] = {}
        for g, n in room.items():
            slots_here = max(1, min(g // top, per_bin))
            if slots_here > 1:
                offered[top] = offered.get(top, 0) + n * (slots_here - 1)
            last = g - (slots_here - 1) * top
            offered[last] = offered.get(last, 0) + n
        base, level = [], 0
        for s in sorted({*offered, *left}, reverse=True):
            base.append((s, level, level + offered.get(s, 0), parts(offered.get(s, 0)), parts(left.get(s, 0))))
            level += offered.get(s, 0) - left.get(s, 0)
        bases = F.broadcast(spark.createDataFrame(base, "size long, low long, high long, gap_parts long, piece_parts long"))  # a row per size: no more than the capacity
        events = events.join(bases, "size")
        salts = F.when(F.col("kind") == 0, F.col("gap_parts")).otherwise(F.col("piece_parts"))
        events = events.withColumn("salt", F.pmod(F.xxhash64("who", "slot"), salts).cast("int")).drop("gap_parts", "piece_parts")
        part = events.groupBy("size", "kind", "salt").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("size", "kind").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        part = part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        rank = F.row_number().over(Window.partitionBy("size", "kind", "salt").orderBy("who", "slot"))
        # part: 32 rows for a size at most, and one for each part_rows rows
        events = events.withColumn("rank", rank).join(F.broadcast(part), ["size", "kind", "salt"])
        at = F.when(F.col("kind") == 0, F.col("low") + F.col("before") + F.col("rank")).otherwise(F.col("high") - F.col("before") - F.col("rank") + 1)
        line = Window.partitionBy("level").orderBy(F.col("size").desc(), "kind")
        seen = events.select(at.alias("level"), "size", "kind", "who", "slot", "gap").select(
            "kind", "who", "slot", "gap", "size",
            F.lag("kind").over(line).alias("prev_kind"), F.lag("who").over(line).alias("prev"), F.lag("slot").over(line).alias("prev_slot"),
            F.lead("kind").over(line).alias("next_kind"), F.lead("size").over(line).alias("next_size"),
        )
        seen = written(spark, seen.coalesce(files(sum(left.values()) + sum(offered.values()))), "packing-round")
        hit = (F.col("kind") == 1) & (F.col("prev_kind") == 0)
        placed.append(
            seen.where(hit).select(F.col("who").alias("uid"), F.col("size").alias("length"), F.col("prev").alias("sequence_id"), F.lit(round_no).alias("round"), F.col("prev_slot").alias("slot"))
        )
        todo = seen.where((F.col("kind") == 1) & ~F.coalesce(F.col("prev_kind") == 0, F.lit(False))).select(F.col("who").alias("uid"), F.col("size").alias("length"))
        left = _histogram(todo, "length")
        took = F.when(F.col("next_kind") == 1, F.col("next_size")).otherwise(0)
        gaps = seen.where("kind = 0").groupBy(F.col("who").alias("bin")).agg((F.max("gap") - F.sum(took)).alias("gap")).where(F.col("gap") >= max(1, min(left, default=1)))
        if left:
            gaps = written(spark, gaps.coalesce(files(n_gaps)), "packing-gaps")
            old.append(gaps)
            room = _histogram(gaps, "gap")
    dropped(spark, *old)
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(spark, token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "packing-pieces")
    where = best_fit(spark, pieces, capacity)
    inside = Window.partitionBy("sequence_id").orderBy("round", "slot").rowsBetween(Window.unboundedPreceding, -1)
    where = where.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop("length", "round", "slot")
    return pieces.join(where, "uid").drop("uid")
