"""Block-Max WAND against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    """[(item number, rank, doc_id, score)]; docs, items: texts with ids."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, (_, text) in enumerate(items):
        scored = []
        for (i, c), size in zip(counts, sizes):
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * size * n // total)))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def in_segments(docs, items, k=10):
    from quillmine.llm import blockmax, postings

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t and t.encode() for _, t in docs], pa.binary())], names=["i", "t"])
    made = [postings.Segment.of(s.to_pylist()[0]) for s in postings.segments([batch])]
    asked = blockmax.Asked([(t or "").encode() for _, t in items])
    n, total, df = sum(int((s.arrays["lengths"] > 0).sum()) for s in made), sum(int(s.arrays["lengths"].sum()) for s in made), np.zeros(len(asked.names), int)
    for s in made:
        at = s.find(asked.names, asked.hashes)
        df[at >= 0] += s.arrays["frequency"][at[at >= 0]]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) if x else 0 for x in df])
    best, blocks, unpacked = [blockmax.Best(k) for _ in items], 0, 0
    for s in made:
        seen = blockmax.search_segment(s, asked, weights, best, n, total)
        blocks += int((s.arrays["first_block"][seen.known + 1] - s.arrays["first_block"][seen.known]).sum())
        unpacked += sum(r.unpacked() for r in seen.held.values())
    return [(item, r, i, score) for item, top in enumerate(best) for r, (score, i) in enumerate(top.rows, 1)], len(made), blocks, unpacked


def corpus(seed, n=700, words=400):
    rng = random.Random(seed)
    names = ["w%d" % i for i in range(words)] + ["été", "Ä", "日本", "naïve", "x1"]
    weights = [1 / (i + 1) for i in range(len(names))]
    docs = [(i, rng.choice([" ", "-", ", ", "\n"]).join(rng.choices(names, weights, k=rng.choice((0, 1, 5, 40, 200))))) for i in range(n)]
    items = [(j, " ".join(rng.choices(names, k=rng.choice((1, 3, 12, 40))))) for j in range(30)]
    return docs, items


@pytest.mark.parametrize("block, window, size", [(128, 4096, 8 << 20), (4, 32, 20_000), (2, 7, 3_000), (1, 4096, 50_000)])
def test_the_same_as_scoring_all(monkeypatch, block, window, size):
    from quillmine.llm import blockmax, postings

    docs, items = corpus(block + window)
    docs += [(900 + i, docs[i % 9][1]) for i in range(60)] + [(5, docs[7][1]), (None, docs[3][1]), (2000, None), (2001, ""), (2002, "--- !")]
    items += [(99, None), (98, ""), (97, "W1 w1 W1 ÉTÉ été w2"), (96, "nowhere to be found")]
    for module in (blockmax, postings):
        monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(blockmax, "WINDOW", window)
    monkeypatch.setattr(postings, "SEGMENT_BYTES", size)
    monkeypatch.setattr(postings, "PIECE", size // 5)
    got, made, _, _ = in_segments(docs, items)
    assert got == plain(docs, items) and (made > 1) == (size < 1 << 20)


def test_blocks_below_the_threshold_stay_packed(monkeypatch):
    from quillmine.llm import blockmax, postings

    for module in (blockmax, postings):
        monkeypatch.setattr(module, "BLOCK", 8)
    monkeypatch.setattr(blockmax, "WINDOW", 256)
    docs = [(i, "common " * (i % 5 + 1) + f"other{i % 11} " * 9) for i in range(4000)]
    for i in range(0, 4000, 300):
        docs[i] = (i, "rare scarce seldom common")
    items = [(0, "rare scarce seldom common")]
    got, _, blocks, unpacked = in_segments(docs, items)
    assert got == plain(docs, items) and unpacked < 0.2 * blocks


def test_terms_that_share_a_hash(monkeypatch):
    from quillmine.llm import postings, words

    docs, items = corpus(3, n=150)
    real = words.words_of
    monkeypatch.setattr(postings, "words_of", lambda raw: (*real(raw)[:2], real(raw)[2] % np.uint64(7)))
    assert in_segments(docs, items)[0] == plain(docs, items)


def test_packed_numbers_come_back():
    from quillmine.llm.postings import packed_numbers, unpacked_numbers

    x = np.array([0, 1, 127, 128, 300, 16383, 16384, 1 << 21, (1 << 31) - 1, 5])
    raw, ends = packed_numbers(x)
    assert unpacked_numbers(raw).tolist() == x.tolist() and len(raw) == ends[-1]
    assert unpacked_numbers(packed_numbers(np.empty(0, int))[0]).tolist() == []


def test_over_tables(spark):
    from quillmine.llm.blockmax import build_index, ranked_search, search

    docs, items = corpus(11, n=300)
    docs += [(1, docs[1][1]), (None, docs[3][1]), (2000, None), (3000, "Zürich " * 400_000 + "w3")]  # some MB of one text
    items += [(None, "w5 w9"), (7, "w11 w12"), (8, None)]
    frame = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in docs], "doc_id long, text string, score long, rank string, item_id int").repartition(6)
    asks = spark.createDataFrame([(j, t, 3) for j, t in [*items, items[2]]], "item_id long, text string, doc_id int")
    want = sorted((str(items[j][0]), r, s) for j, r, _, s in plain(docs, items))
    got = ranked_search(spark, frame, asks).collect()
    assert sorted((str(r.item_id), r["rank"], r.score) for r in got) == want
    by_item = {(items[j][0], r): i for j, r, i, _ in plain(docs, items) if items[j][0] not in (7, None)}
    assert {(r.item_id, r["rank"]): r.doc_id for r in got if r.item_id not in (7, None)} == by_item
    index = build_index(spark, frame)
    two = search(spark, index, asks.where("item_id = 2"), k=3).collect()
    assert sorted((r["rank"], r.doc_id) for r in two) == sorted((r, i) for (j, r), i in by_item.items() if j == 2 and r <= 3)
    assert ranked_search(spark, frame.limit(0), asks).count() == ranked_search(spark, frame.where("doc_id = 2000"), asks).count() == ranked_search(spark, frame, asks.limit(0)).count() == 0


def test_a_row_group_of_the_index_is_one_segment(spark):
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from quillmine.llm import blockmax

    docs = spark.range(5, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 450_000).alias("text"))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blockmax.build_index(spark, docs).inputFiles()]
    # a reader holds a row group whole, and all segments of a task were one
    assert [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)] == [1] * 5
    asks = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert [(r["rank"], r.doc_id) for r in blockmax.ranked_search(spark, docs, asks).orderBy("rank").collect()] == [(i + 1, i) for i in range(5)]
