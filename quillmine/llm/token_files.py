"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

``write_token_files`` range-partitions the documents by id; each partition
becomes one shard of three files: ``.bin`` (ids, 16 bits where the vocabulary
fits, else 32, little-endian), ``.idx`` (uint64: where each document starts in
the shard, and the end) and ``.doc`` (int64 document ids). A shard's place in
the whole corpus is the prefix sum of the sizes of the shards before it, kept
in the manifest, which is stored beside the shards as ``manifest.json``.
``read_token_files`` maps the files and cuts documents out.

A task that runs twice writes under another name, and only names in the
manifest count, so lost executors leave stray files at worst.

Cases: null text counts as empty; an empty document holds the end id alone; a
null id sorts first and reads back as null; rows with the same id are all kept,
in the order of their text's hash, and may be in several shards; long texts are
tokenised in parts and written whole; an empty table gives a manifest without
shards; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean, new_path, read_text, remove_path, shuffle_partitions, write_text
from .sharedfs import open_array, open_output
from .tokens import text_groups, token_ids, with_end

#: Stands for a null id in a .doc file.
_NO_ID = -(1 << 63)
#: Documents, and ids, that are read at once.
READ_DOCS, READ_IDS = 4096, 1 << 22


@dataclass(frozen=True)
class Shard:
    uri: str
    n_docs: int
    n_tokens: int
    first_token: int
    first_doc: int


@dataclass(frozen=True)
class Manifest:
    dtype: str
    folder: str
    shards: tuple[Shard, ...]


def read_manifest(spark: SparkSession, folder: str) -> Manifest:
    """That of the token files in a folder, written by whatever driver."""
    held = json.loads(read_text(spark, f"{folder}/manifest.json"))
    return Manifest(held["dtype"], folder, tuple(Shard(**x | {"uri": f"{folder}/{x['uri']}"}) for x in held["shards"]))


def _store(spark: SparkSession, manifest: Manifest) -> None:
    """Shards are named relative to the folder, so that it can be moved."""
    shards = [asdict(x) | {"uri": x.uri.rsplit("/", 1)[1]} for x in manifest.shards]
    write_text(spark, f"{manifest.folder}/manifest.json", json.dumps({"dtype": manifest.dtype, "shards": shards}))


def write_token_files(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
) -> Manifest:
    bounded_batches(spark)
    folder = folder or new_path(spark, "token-files")
    dtype = token_ids(tokenizer).dtype.str
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def write(batches):
        lib = token_ids(tokenizer)
        uri, n_docs, at, first, files = f"{folder}/{uuid.uuid4().hex}", 0, 0, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            if not files:
                files = [open_output(f"{uri}.{x}") for x in ("bin", "idx", "doc")]
                first = batch.slice(0, 1).to_pylist()[0]
            names = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype("<i8")
            texts = batch.column(2).to_pylist()
            for a, b in text_groups(texts):
                ids, limits = with_end(lib.encode(texts[a:b]), end_id, lib.dtype)
                files[0].write(ids.tobytes())
                files[1].write((at + limits[:-1]).astype("<u8").tobytes())
                files[2].write(names[a:b].tobytes())
                at += len(ids)
            n_docs += batch.num_rows
        if files:
            files[1].write(np.array([at], dtype="<u8").tobytes())
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri], "first": [first["id"]], "salt": [first["salt"]], "n_docs": [n_docs], "n_tokens": [at]}, schema=_SHARD)

    # rows without an id, or with the same one, are dealt by their text
    rows = rows.withColumn("salt", F.xxhash64("text")).select("id", "salt", "text")
    dealt = rows.repartitionByRange(shards or shuffle_partitions(spark), "id", "salt").sortWithinPartitions("id", "salt", "text")
    made = dealt.mapInArrow(lean(write), "uri string, first long, salt long, n_docs long, n_tokens long").collect()  # a row per shard
    made.sort(key=lambda r: (r.first is not None, r.first or 0, r.salt))
    out, tokens, seen = [], 0, 0
    for r in made:
        out.append(Shard(r.uri, r.n_docs, r.n_tokens, tokens, seen))
        tokens, seen = tokens + r.n_tokens, seen + r.n_docs
    manifest = Manifest(dtype, folder, tuple(out))
    _store(spark, manifest)
    return manifest


def remove_token_files(spark: SparkSession, manifest: Manifest) -> None:
    remove_path(spark, manifest.folder)


_SHARD = pa.schema([("uri", pa.string()), ("first", pa.int64()), ("salt", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def read_token_files(spark: SparkSession, manifest: Manifest, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; its
    ids as 32-bit binary if asked for."""
    dtype, shards = np.dtype(manifest.dtype), manifest.shards
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                s = shards[k]
                ids = open_array(f"{s.uri}.bin", dtype)
                starts = open_array(f"{s.uri}.idx", np.dtype("<u8"))
                names = open_array(f"{s.uri}.doc", np.dtype("<i8"))
                a = 0
                while a < s.n_docs:
                    edge = np.asarray(starts[a : min(a + READ_DOCS, s.n_docs) + 1]).astype(np.int64)
                    # as many of these documents as READ_IDS allows, one at least
                    b = a + max(1, int(np.searchsorted(edge, edge[0] + READ_IDS, "right")) - 1)
                    edge = edge[: b - a + 1]
                    wide = np.asarray(ids[int(edge[0]) : int(edge[-1])]).astype("<u4")
                    raw, at = memoryview(wide).cast("B"), (4 * (edge - edge[0])).tolist()
                    doc = np.asarray(names[a:b])
                    cols = {
                        "doc_id": pa.array(doc, pa.int64(), mask=doc == _NO_ID),
                        "start": pa.array(s.first_token + edge[:-1]),
                        "n_tokens": pa.array(np.diff(edge)),
                        "ids_crc32": pa.array([zlib.crc32(raw[x:y]) for x, y in zip(at, at[1:])], pa.int64()),
                    }
                    if with_ids:
                        cols["ids"] = pa.array([raw[x:y] for x, y in zip(at, at[1:])], pa.binary())
                    yield pa.RecordBatch.from_pydict(cols)
                    a = b

    n = max(1, len(shards))
    return spark.range(0, len(shards), 1, n).mapInArrow(read, schema)
