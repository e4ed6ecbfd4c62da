"""Line deduplication with a segment-partition edit join.

Two lines are one line if they differ by no more edits than one for every
``chars_per_edit`` characters of the shorter, and ``max_edits`` at most; so short
lines must be equal. Classes are transitive. The first line of a class, by
document id and line number, stays. Blank lines are no lines and always stay.

The edit join cuts a line into one segment more than it may have edits. Whoever
is within these has one of them unharmed, so each line is stored under its own
segments, and looks up those of its substrings that could be a segment of a
line of its own length or up to so many characters shorter; the places are those
where both the part before and the part after can still be aligned. Keys are
hashes of (length, segment, substring). Keys that two different lines share
propose them; texts of these lines alone are fetched, and banded bit-parallel
edit distance decides. Within a key, lines that are linked already are not
compared again and links form a forest, so groups of near copies give no more
links than lines; keys of many lines are cut into blocks that different tasks
compare. Keys that a sample of the lines shows to be hot are dealt to all tasks
from the start; that changes where rows go, not which.

Cases: null text counts as empty; white space around a line does not count; of
equal ids the one with the smaller text hash comes first; of rows equal in both,
one keeps its lines and the others lose them; lines of any length take part,
whole; an empty table gives no rows; other columns are kept, but those named like
the two counts, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, bounded_batches, component_labels, dropped, lean, shuffle_partitions, written
from .tokens import text_groups

#: Lines of a key that one task compares with each other.
BLOCK = 1024
#: Places of the bit map that spares fetching texts that no key proposes.
MAP_BITS = 22
#: One of so many lines is sampled to find hot keys, and rows of a key that a task holds.
SAMPLE, HELD = 64, 1_000_000
_BASE = 0xD1342543DE82EF95
_up = np.ones(1, np.uint64)
_down = np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        size = max(n, 1 << 20)
        one = np.ones(1, np.uint64)
        _up = np.concatenate([one, np.cumprod(np.full(size, _BASE, np.uint64))])
        _down = np.concatenate([one, np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))])
    return _up, _down


def _mixed(h: np.ndarray, tag: np.ndarray | int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185) + np.asarray(tag, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def probes(max_edits: int) -> list[tuple[int, int, int, bool]]:
    """(length missing, segment, shift, stored) of all substrings looked up: the
    shift from the segment's place leaves no more edits before it than segments,
    and after it no more than are left over."""
    out = []
    for less in range(max_edits + 1):
        for segment in range(max_edits + 1):
            before, after = segment, max_edits - segment
            for shift in range(max(-before, less - after), min(before, less + after) + 1):
                out.append((less, segment, shift, less == 0 and shift == 0))
    return out


def segment_keys(lines: list[str], max_edits: int, chars_per_edit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, stored) of every substring of the lines that probes() names for
    the edits that a line of the length looked for may have."""
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    begin = np.cumsum(size) - size
    up, down = _power(len(code) + 1)
    total = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=total[1:])
    which, keys, stored = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, bool)]
    for edits, less, segment, shift, own in ((e, *p) for e in range(1, max_edits + 1) for p in probes(e)):
        length = size - less
        a = length * segment // (edits + 1)
        b = length * (segment + 1) // (edits + 1)
        a, b = a + shift, b + shift
        ok = (length > edits) & (np.minimum(length // chars_per_edit, max_edits) == edits) & (a >= 0) & (b <= size)
        at = np.flatnonzero(ok)
        x, y = begin[at] + a[at], begin[at] + b[at]
        which.append(at)
        keys.append(_mixed((total[y] - total[x]) * down[x], (length[at] * 16 + segment).astype(np.uint64)))
        stored.append(np.full(len(at), own))
    return np.concatenate(which), np.concatenate(keys).view(np.int64), np.concatenate(stored)


def _same_start(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def within(a: str, b: str, max_edits: int) -> bool:
    """Whether a becomes b with max_edits edits: for each number of edits a band
    of 2 * max_edits + 1 diagonals is one machine word, moved on a row at a time."""
    if abs(len(a) - len(b)) > max_edits:
        return False
    n = _same_start(a, b)
    a, b = a[n:], b[n:]
    if n := _same_start(a[::-1], b[::-1]):
        a, b = a[:-n], b[:-n]
    if max(len(a), len(b)) <= max_edits:
        return True
    if not a or not b:
        return False
    k, full = max_edits, (1 << 2 * max_edits + 1) - 1
    peq: dict[str, int] = {}
    for j, c in enumerate(b):  # bit j + k: the band of row i is at bits i and up
        peq[c] = peq.get(c, 0) | 1 << (j + k)
    # bit d of rows[e]: diagonal d - k is reached with e edits
    rows = [0] * (k + 1)
    for e in range(k + 1):
        rows[e] = ((1 << e + 1) - 1) << k & full
    for i, c in enumerate(a):
        match = peq.get(c, 0) >> i & full
        new = [rows[0] & match]
        for e in range(1, k + 1):
            new.append((rows[e] & match | rows[e - 1] | rows[e - 1] >> 1 | new[e - 1] << 1) & full)
        rows = new
        if not rows[k]:
            return False
    last = len(b) - len(a) + k
    return 0 <= last <= 2 * k and bool(rows[k] >> last & 1)


def _letters(lines: list[str]) -> np.ndarray:
    out = np.zeros((len(lines), 64), dtype=np.int16)
    for i, line in enumerate(lines):
        out[i] = np.bincount(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4") & 63, minlength=64)
    return out


def linked_in_key(ids: list[int], texts: list[str], sides: list[int], max_edits: int, chars_per_edit: int) -> list[tuple[int, int]]:
    """A forest of links between the lines of a key; sides as dealt by blocks."""
    n = len(ids)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    two = len(set(sides)) > 1
    counts = _letters(texts) if n > 8 else None
    out = []
    for i in range(n - 1):
        if counts is not None:  # an edit changes two letter counts at most
            near = (np.flatnonzero(np.abs(counts[i + 1 :] - counts[i]).sum(axis=1) <= 2 * max_edits) + i + 1).tolist()
        else:
            near = range(i + 1, n)
        for j in near:
            if ids[i] == ids[j] or two and sides[i] == sides[j]:
                continue
            x, y = find(i), find(j)
            if x != y and within(texts[i], texts[j], min(max_edits, min(len(texts[i]), len(texts[j])) // chars_per_edit)):
                root[x] = y
                out.append((ids[i], ids[j]))
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("dkey"), text.alias("text"))


def _line_table(rows: DataFrame) -> DataFrame:
    """doc_id, dkey, line_no, h1, h2 of every line that is not blank."""

    def cut(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            docs, dkeys, texts = (c.to_pylist() for c in batch.columns)
            for a, b in text_groups(texts):
                doc, dkey, no, raw = [], [], [], []
                for d, k, t in zip(docs[a:b], dkeys[a:b], texts[a:b]):
                    for n, line in enumerate(t.split("\n")):
                        line = line.strip()
                        if line:
                            doc.append(d)
                            dkey.append(k)
                            no.append(n)
                            raw.append(xxh3_128_digest(line.encode("utf-8", "surrogatepass")))
                if raw:
                    h = np.frombuffer(b"".join(raw), dtype="<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, pa.int64()), pa.array(dkey, pa.int64()), pa.array(no, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())],
                        names=["doc_id", "dkey", "line_no", "h1", "h2"],
                    )

    return rows.mapInArrow(lean(cut), "doc_id long, dkey long, line_no long, h1 long, h2 long")


def _fresh_lines(batches, least: int, skip_seen: int = 100_000):
    """Groups (h1, line) of lines of at least so many characters, without most of
    those met before."""
    from xxhash import xxh3_128_digest

    seen: set[int] = set()
    for batch in batches:
        for a, b in text_groups(texts := batch.column(0).to_pylist()):
            ids, lines = [], []
            for text in texts[a:b]:
                for line in text.split("\n"):
                    line = line.strip()
                    if len(line) >= least:
                        h = int.from_bytes(xxh3_128_digest(line.encode("utf-8", "surrogatepass"))[:8], "little", signed=True)
                        if h not in seen:
                            seen.add(h)
                            ids.append(h)
                            lines.append(line)
            if len(seen) > skip_seen:
                seen.clear()
            yield np.array(ids, dtype=np.int64), lines


def _hot_keys(spark: SparkSession, rows: DataFrame, max_edits: int, chars_per_edit: int) -> list[int]:
    """Keys that would fill much of a task, by a sample of the lines: four for each
    task at most."""

    def sampled(batches):
        for ids, lines in _fresh_lines(batches, chars_per_edit):
            some = np.flatnonzero(ids & (SAMPLE - 1) == 0).tolist()
            if some:
                _, key, _ = segment_keys([lines[i] for i in some], max_edits, chars_per_edit)
                yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])

    most = 4 * shuffle_partitions(spark)
    found = rows.select("text").mapInArrow(lean(sampled), "key long").groupBy("key").count().where(F.col("count") >= SAMPLE)
    return [r.key for r in found.orderBy(F.col("count").desc(), "key").limit(most).collect()]


def _shared_keys(spark: SparkSession, rows: DataFrame, max_edits: int, chars_per_edit: int) -> DataFrame:
    """key, h1 of the keys that several lines have, one of them as its own segment,
    and of a few others."""
    hot = _hot_keys(spark, rows, max_edits, chars_per_edit)

    def keyed(batches):
        for ids, lines in _fresh_lines(batches, chars_per_edit):
            if lines:
                which, key, stored = segment_keys(lines, max_edits, chars_per_edit)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[which]), pa.array(stored)], names=["key", "h1", "stored"])

    def shared(batches):
        held: list[np.ndarray] = []  # the last key's rows, as more may follow
        known = set(hot)  # keys whose every row is passed on
        for batch in batches:
            key, h1, stored = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if held:
                key, h1, stored = (np.concatenate([x, y]) for x, y in zip(held, (key, h1, stored)))
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield _several(key[:cut], h1[:cut], stored[:cut], known)
            held = [key[cut:], h1[cut:], stored[cut:]]
            if len(held[0]) > HELD:  # passed on as they come, whatever else the key has
                known.add(int(key[-1]))
                yield _several(*held, known)
                held = [x[-1:] for x in held]
        if held:
            yield _several(*held, known)

    text = rows.select("text").mapInArrow(lean(keyed), "key long, h1 long, stored boolean")
    to = F.when(F.col("key").isin(hot), F.xxhash64("key", "h1")).otherwise(F.col("key")) if hot else F.col("key")
    dealt = text.repartition(to).sortWithinPartitions("key", "h1")
    return written(spark, dealt.mapInArrow(lean(shared), "key long, h1 long"), "line-keys")


def _several(key: np.ndarray, h1: np.ndarray, stored: np.ndarray, known: set[int]) -> pa.RecordBatch:
    """The rows, sorted by key and line, of keys that are known or have two lines
    and one of them as its own; each line once a key."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    own = np.logical_or.reduceat(stored, first)
    size = np.diff(np.append(first, len(key)))
    many = h1[first] != h1[np.append(first[1:], len(key)) - 1]
    keep = own & many
    if known:
        keep |= np.isin(key[first], np.fromiter(known, np.int64, len(known)))
    keep = np.repeat(keep, size)
    keep[1:] &= (key[1:] != key[:-1]) | (h1[1:] != h1[:-1])
    return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(h1[keep])], names=["key", "h1"])


def _texts(spark: SparkSession, rows: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """h1, text of the wanted lines and a few more."""
    places = 1 << MAP_BITS
    found = wanted.select(F.col("h1").bitwiseAND(F.lit(places - 1)).cast("int").alias("at")).distinct().toArrow().column(0)  # no more than the map has places
    bits = np.zeros(places, dtype=bool)
    bits[found.to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def fetch(batches):
        bits = np.unpackbits(shared.value).astype(bool)
        for ids, lines in _fresh_lines(batches, least):
            at = np.flatnonzero(bits[ids & (places - 1)]).tolist() if lines else []
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([lines[i] for i in at], pa.string())], names=["h1", "text"])

    return rows.select("text").mapInArrow(lean(fetch), "h1 long, text string").groupBy("h1").agg(F.min("text").alias("text"))


def line_links(spark: SparkSession, rows: DataFrame, max_edits: int, chars_per_edit: int) -> DataFrame:
    """(a, b): links between lines, by h1, that connect all that are near."""
    shared = _shared_keys(spark, rows, max_edits, chars_per_edit)
    texts = _texts(spark, rows, shared, chars_per_edit)
    many = shared.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = shared.join(many, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("h1"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.select("key", "h1", "side", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    part = F.greatest("side", "other") * F.col("blocks") + F.least("side", "other")
    dealt = dealt.select("key", part.alias("part"), "h1", "side").join(texts, "h1")

    def compare(batches):
        at, ids, lines, sides = None, [], [], []

        def done():
            links = linked_in_key(ids, lines, sides, max_edits, chars_per_edit) if len(ids) > 1 else []
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for key, part, h1, side, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, part) != at:
                    yield from done()
                    at, ids, lines, sides = (key, part), [], [], []
                ids.append(h1)
                lines.append(text)
                sides.append(side)
        yield from done()

    dealt = dealt.select("key", "part", "h1", "side", "text").repartition("key", "part").sortWithinPartitions("key", "part", "h1")
    out = written(spark, dealt.mapInArrow(lean(compare), "a long, b long").distinct(), "line-links", slim=True)
    dropped(spark, shared)
    return out


def kept_lines(spark: SparkSession, rows: DataFrame, max_edits: int, chars_per_edit: int) -> DataFrame:
    """doc_id, dkey, kept: the numbers of the lines that are the first of their class."""
    labels = component_labels(spark, line_links(spark, rows, max_edits, chars_per_edit))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "dkey", "line_no")).alias("first")
    lines = _line_table(rows).groupBy("h1", "h2").agg(first)
    lines = lines.join(labels.withColumnRenamed("id", "h1"), "h1", "left")
    lines = lines.groupBy(F.coalesce("component", "h1").alias("c1"), F.when(F.col("component").isNull(), F.col("h2")).otherwise(0).alias("c2")).agg(F.min("first").alias("first"))
    return lines.groupBy("first.doc_id", "first.dkey").agg(F.collect_list("first.line_no").alias("kept"))


def _same(a: str, b: str):
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.dkey") == F.col(f"{b}.dkey"))


def _marked(spark: SparkSession, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs(.., id, dkey) with once: whether the row is the first of those equal in both."""
    again = rows.groupBy("doc_id", "dkey").count().where("count > 1").select("doc_id", "dkey")
    again = written(spark, again, "line-repeats", slim=True)
    once = docs.withColumn("once", F.lit(True))
    if again.isEmpty():
        return once
    # the rows are written with a number, so that the number is one of them
    some = written(spark, docs.alias("s").join(again.alias("r"), _same("s", "r"), "left_semi").withColumn("number", F.monotonically_increasing_id()), "line-repeated")
    first = some.groupBy(F.col("id").alias("doc_id"), "dkey").agg(F.min("number").alias("first"))
    some = some.alias("s").join(first.alias("f"), _same("s", "f")).select("s.*", (F.col("s.number") == F.col("f.first")).alias("once")).drop("number")
    return once.alias("s").join(again.alias("r"), _same("s", "r"), "left_anti").unionByName(some)


def dedup_lines(
    spark: SparkSession,
    docs: DataFrame,
    max_edits: int = 2,
    chars_per_edit: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    counts: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """docs with the text rid of repeated lines, and the counts of its lines and of
    those removed."""
    bounded_batches(spark)
    rows = _rows(docs, id_col, text_col)
    kept = kept_lines(spark, rows, max_edits, chars_per_edit)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    slim = docs.toDF(*names).withColumn("id", F.col(names[docs.columns.index(id_col)]).cast("long"))
    slim = _marked(spark, slim.withColumn("dkey", F.xxhash64(F.coalesce(F.col(text), F.lit("")))), rows)
    joined = slim.alias("s").join(kept.alias("k"), _same("s", "k"), "left").select(*(f"s.{n}" for n in names), F.when(F.col("s.once"), F.col("k.kept")).alias("kept"))

    def rebuild(texts, kept):
        out = [(None, 0, 0)] * len(texts)
        for i, (text, keep) in enumerate(zip(texts.to_pylist(), kept.to_pylist())):
            if text is not None:
                keep = set(keep or ())
                lines = text.split("\n")
                left = [line for k, line in enumerate(lines) if k in keep or not line.strip()]
                out[i] = ("\n".join(left), len(lines), len(lines) - len(left))
        return list(zip(*out)) or [[], [], []]

    fields = [("left", "string", pa.string()), ("n0", "long", pa.int64()), ("n1", "long", pa.int64())]
    done = appended(joined, [text, "kept"], fields, rebuild)
    new = {c.lower() for c in counts}
    back = [F.col("left" if c == text_col else n).alias(c) for n, c in zip(names, docs.columns) if c.lower() not in new]
    return done.select(*back, F.col("n0").alias(counts[0]), F.col("n1").alias(counts[1]))
