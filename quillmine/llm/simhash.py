"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into segments of 22, 21 and 21. Two fingerprints
with four or fewer differing bits either agree in a whole segment, or have
errors in all three, and then exactly one error in at least two of them. For the
second case each segment, padded to 23 bits, is decoded to its codeword of the
perfect binary Golay code, which lies within three bits; the word next to it
decodes to one of at most six codewords, those its own neighbours decode to. So
each fingerprint is stored under its own codeword pair for each two segments,
and looks up all pairs of codewords of its neighbours; candidates are verified
by the count of differing bits.

Keys of 21 to 24 bits are shared by chance once there are many fingerprints. From
``LONG_KEYS_FROM`` of them on, keys take in what is known of the other segments:
beside a whole segment one of the other two has at most two errors, and beside
two with one error each the third has at most two. Words at most two bits apart
have a word between them, one bit from both, so they share one of the codewords
that their neighbours decode to. Both sets of keys find the same links.

Equal fingerprints are one row from the start. Of each key's fingerprints only
links to the smallest are made first, by a minimum that is summed up before the
shuffle; the components of these need no links inside, so the join that finds
the rest makes rows only between components, and a dense group of near copies
costs no more rows than it has members. Both sides of that join are plain
shuffles, which adaptive execution splits where a key makes one of them skewed.

Cases: null text counts as empty; texts without words have fingerprint zero,
linked like any other; texts of any length are hashed whole; repeated rows keep
their rows; a null id counts as larger than any other, so it names a component
only of rows without ids; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, component_labels, dropped, lean, unused, written

SEGMENTS = ((0, 22), (22, 21), (43, 21))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Fixed value: the generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101
#: Fingerprints from which keys are long.
LONG_KEYS_FROM = 1 << 27


def fingerprint(text: str | None, words: int, seed: int) -> int:
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    n = max(1, len(found) - words + 1)
    if n == 1:
        return xxh64_intdigest(line, seed)
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    end = np.cumsum(size) - 1
    start = (end - size + 1)[:n].tolist()
    end = end[words - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 65536):
        h = np.array([xxh64_intdigest(line[s:e], seed) for s, e in zip(start[a : a + 65536], end[a : a + 65536])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def hashed(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(hashed), "doc_id long, fp long")


def _remainders() -> np.ndarray:
    out = []
    for bit in range(23):
        x = 1 << bit
        for k in range(bit, 10, -1):
            if x >> k & 1:
                x ^= GOLAY << (k - 11)
        out.append(x)
    return np.array(out, dtype=np.int32)


_REM = _remainders()
_tables: dict[str, np.ndarray] = {}


def _error_of() -> np.ndarray:
    """The error pattern of at most three bits for each of the 2048 remainders."""
    if "error" not in _tables:
        at = np.zeros(2048, dtype=np.int32)
        for i in range(23):
            at[_REM[i]] = 1 << i
            for j in range(i):
                at[_REM[i] ^ _REM[j]] = 1 << i | 1 << j
                for k in range(j):
                    at[_REM[i] ^ _REM[j] ^ _REM[k]] = 1 << i | 1 << j | 1 << k
        _tables["error"] = at
    return _tables["error"]


def codeword_index(word: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within three bits of a 23-bit word."""
    rem = np.zeros(word.shape, dtype=np.int32)
    for bit in range(23):
        rem ^= ((word >> bit) & 1).astype(np.int32) * _REM[bit]
    return ((word ^ _error_of()[rem]) >> 11).astype(np.int64)


def near_codewords(word: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the codeword indices of it and of all words one bit away, and
    which of them are new in their row."""
    around = np.concatenate([word[:, None], word[:, None] ^ (1 << np.arange(bits, dtype=np.int64))[None, :]], axis=1)
    codes = np.sort(codeword_index(around), axis=1)
    new = np.ones(codes.shape, dtype=bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    return codes, new


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [((u >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]


_PAIRS = ((0, 1), (0, 2), (1, 2))


def _near(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """near_codewords() of each segment, of which at most six differ."""
    out = []
    for s, (_, size) in zip(_segments(fp), SEGMENTS):
        codes, new = near_codewords(s, size)
        order = np.argsort(~new, axis=1, kind="stable")[:, :6]
        out.append((np.take_along_axis(codes, order, 1), np.take_along_axis(new, order, 1)))
    return out


def _all_of(tag: int, *parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all ways to take one of each part's codewords."""
    key, ok = np.full((len(parts[0][0]), 1), tag, dtype=np.int64), np.ones((len(parts[0][0]), 1), dtype=bool)
    for codes, new in parts:
        key = ((key[:, :, None] << 12) | codes[:, None, :]).reshape(len(key), -1)
        ok = (ok[:, :, None] & new[:, None, :]).reshape(len(key), -1)
    return np.nonzero(ok)[0], key[ok]


def _whole(fp: np.ndarray, long: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) by a whole segment; long: with the near codewords of another."""
    seg = _segments(fp)
    if not long:
        return np.tile(np.arange(len(fp)), 3), np.concatenate([(k << 24) | s for k, s in enumerate(seg)])
    near, rows, keys = _near(fp), [], []
    for k in range(3):
        for other in range(3):
            if other != k:
                row, code = _all_of(0, near[other])
                rows.append(row)
                keys.append((8 + 3 * k + other) << 48 | seg[k][row] << 12 | code)
    return np.concatenate(rows), np.concatenate(keys)


def _own(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return codeword_index(word)[:, None], np.ones((len(word), 1), dtype=bool)


def _by_codewords(pairs: list, near: list, long: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) by the codewords of each two segments; long: and near ones of the third."""
    out = []
    for k, (a, b) in enumerate(_PAIRS):
        out.append(_all_of((24 + k) << 12, pairs[a], pairs[b], near[3 - a - b]) if long else _all_of(3 + k, pairs[a], pairs[b]))
    return np.concatenate([r for r, _ in out]), np.concatenate([x for _, x in out])


def stored_keys(fp: np.ndarray, long: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): three whole segments and three codeword pairs each."""
    row, key = _whole(fp, long)
    rows, keys = _by_codewords([_own(s) for s in _segments(fp)], _near(fp) if long else [], long)
    return np.concatenate([row, rows]), np.concatenate([key, keys])


def looked_up_keys(fp: np.ndarray, long: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) that find every stored fingerprint with four or fewer bits differing."""
    row, key = _whole(fp, long)
    near = _near(fp)
    rows, keys = _by_codewords(near, near, long)
    return np.concatenate([row, rows]), np.concatenate([key, keys])


def _keyed(nodes: DataFrame, keys_of, long: bool) -> DataFrame:
    """key, fp, c for nodes(fp, c)."""

    def out(batches):
        for batch in batches:
            fp, c = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for a in range(0, len(fp), 2048):
                row, key = keys_of(np.ascontiguousarray(fp[a : a + 2048]), long)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[a : a + 2048][row]), pa.array(c[a : a + 2048][row])], names=["key", "fp", "c"])

    return nodes.select("fp", "c").mapInArrow(lean(out), "key long, fp long, c long")


def link_components(spark: SparkSession, fps: DataFrame, max_bits: int = 4, long_keys_from: int = LONG_KEYS_FROM) -> DataFrame:
    """fps(doc_id, fp) -> doc_id, fp, component_id, the smallest doc_id that is
    reached over fingerprints with max_bits or fewer differing bits."""
    if max_bits > 4:
        raise ValueError("three segments reach four bits")
    nodes = written(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("head")), "simhash-nodes", slim=True)
    long = nodes.count() >= long_keys_from
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("m")))
    stored = _keyed(nodes.withColumn("c", F.col("fp")), stored_keys, long)
    least = stored.groupBy("key").agg(F.min("fp").alias("m"), F.max("fp").alias("most")).where("m <> most").select("key", "m")
    least = written(spark, least, "simhash-least", slim=True)
    star = stored.join(least, "key")
    star = component_labels(spark, star.where((F.col("fp") != F.col("m")) & (apart <= max_bits)).select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct())
    first = nodes.join(star.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "head", F.coalesce("component", "fp").alias("c"))
    first = written(spark, first, "simhash-first", slim=True)
    at = _keyed(first, stored_keys, long).select("key", F.col("fp").alias("m"), F.col("c").alias("d"))
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.m"))) <= max_bits
    found = _keyed(first, looked_up_keys, long).alias("x").join(at.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.d")) & near)
    rest = component_labels(spark, found.select(F.col("x.c").alias("a"), F.col("y.d").alias("b")).distinct())
    final = first.join(rest.withColumnRenamed("id", "c"), "c", "left").select("fp", "head", F.coalesce("component", "c").alias("c"))
    heads = final.groupBy("c").agg(F.min("head").alias("component_id"))
    named = written(spark, final.join(heads, "c").select("fp", "component_id"), "simhash-final", slim=True)
    dropped(spark, first, least, nodes)
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 4, seed: int = 42, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id."""
    fps = written(spark, fingerprints(docs, words, seed, id_col, text_col), "simhash-fps")
    linked = link_components(spark, fps, max_bits)
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_near_copies(spark: SparkSession, docs: DataFrame, words: int = 4, seed: int = 42, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component. A row is known by its id and the hash of
    its text, so missing and repeated ids touch no other row; rows equal in both
    are one."""
    keyed = fingerprints(docs.select(F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("text")), words, seed, "tkey", "text")
    # equal texts have equal fingerprints
    prints = written(spark, keyed.select(F.col("doc_id").alias("tkey"), "fp").distinct(), "simhash-texts", slim=True)
    linked = link_components(spark, prints.select(F.col("fp").alias("doc_id"), "fp").distinct(), max_bits)
    components = prints.join(linked.select("fp", F.col("component_id").alias("c")), "fp").select("tkey", "c")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tkey")).groupBy("id", "tkey").count()
    rows = written(spark, rows.join(components, "tkey"), "simhash-rows", slim=True)
    firsts = rows.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "tkey")).alias("first"))
    ranked = rows.join(firsts, "c").withColumn("stays", F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tkey") == F.col("first.tkey")))
    ranked = written(spark, ranked.select("id", "tkey", "count", "stays").where("not stays or count > 1"), "simhash-ranked", slim=True)

    def matched(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        same = F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("o.id")) & (F.xxhash64(f"d.{text_col}") == F.col("o.tkey"))
        return rows.alias("d").join(some.select("id", "tkey").alias("o"), same, how)

    repeats = ranked.where("stays")
    if repeats.isEmpty():
        return matched(docs, ranked, "left_anti")
    one, two = unused(docs.columns, "id", "tkey")
    again = matched(docs, repeats, "left_semi").withColumns({one: F.col(id_col).cast("long"), two: F.xxhash64(text_col)}).dropDuplicates([one, two]).select(docs.columns)
    return matched(docs, ranked, "left_anti").unionByName(again)
