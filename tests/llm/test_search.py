"""Nearest neighbours, contamination and licenses against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def exact(rows, asks, k):
    """(query row, [(score, id)]) by brute force; rows: (id, vector), each once."""
    out = {}
    for qi, q in rows:
        if asks(qi):
            near = sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), i) for i, v in rows if i != qi)
            out.setdefault(qi, []).append(near[:k])
    return out


def found(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    return {q: sorted(x) for q, x in out.items()}


@pytest.mark.parametrize("shortlist, least", [(30, 0.9), (100, 0.99)])
def test_recall_with_a_short_shortlist(spark, shortlist, least):
    from quillmine.llm.ann import nearest

    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = found(nearest(spark, frame, F.col("vec_id") % 100 == 0, shortlist=shortlist, block_queries=16))
    want = exact(rows, lambda i: i % 100 == 0, 10)
    assert set(got) == set(want) and all([r for r, *_ in got[q]] == list(range(1, 11)) for q in got)
    hits = sum(len({v for *_, v in got[q]} & {i for _, i in want[q][0]}) for q in want)
    assert hits >= least * 10 * len(want)
    for q in got:
        assert all(abs(s - np.sqrt(((x[v] - x[q]) ** 2).sum())) < 1e-12 for _, s, v in got[q])


def test_codes_decide_the_shortlist(spark, monkeypatch):
    """With codes that say nothing, little is found: the test above is no accident."""
    from quillmine.llm import ann

    monkeypatch.setattr(ann.Quantizer, "encode", lambda self, x: (np.random.default_rng(len(x)).integers(0, 256, (len(x), len(self.books))), np.ones(len(x), np.float32)))
    x = np.random.default_rng(4).normal(size=(3000, 8))
    quantizer = ann.Quantizer(np.random.default_rng(1).normal(size=(4, 256, 8)).astype(np.float32), 4)
    codes, norms = quantizer.encode(x)
    held = np.full((20, 30), np.inf, np.float32), np.full((20, 30), -1, np.int64)
    _, number = ann.best_codes(quantizer, codes, norms, x[:20].astype(np.float32), held, 0, 30)
    near = [np.argsort(((x - v) ** 2).sum(axis=1))[1:11] for v in x[:20]]
    assert sum(len(set(a) & set(b)) for a, b in zip(number, near)) < 0.2 * 200


def test_repeated_equal_and_odd_vectors(spark):
    from quillmine.llm.ann import nearest

    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(10, [9.0] * 6), (1000, x[5].tolist()), (20, x[7].tolist())]  # ids that stand for two vectors
    rows += [(2000 + i, [0.5, 0.5, 0.5, 0.5, 0.5, -0.5]) for i in range(500)]  # many copies
    rows += [(3000, [1e25] * 6), (3001, [1e25, 1e25, 1e25, 1e25, 1e25, 2e25]), (3002, [1e-30] * 6)]
    odd = [(None, [1.0] * 6), (4000, None), (4001, [0.0] * 6), (4002, [float("inf")] * 6), (4003, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (4004, [1.0] * 5), (4005, [])]
    data = [(i, v, i, "c") for i, v in rows + odd + rows[:50]]  # and repeated rows
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, rank long, codes string")
    got = found(nearest(spark, frame, F.col("vec_id") % 10 == 0, k=10, shortlist=120))
    want = exact(rows, lambda i: i % 10 == 0, 10)
    assert set(got) == set(want)
    for q, lists in want.items():
        found_ids = [v for *_, v in got[q]]
        assert len(found_ids) == 10 * len(lists)
        if q != 3000:
            assert sorted(found_ids) == sorted(i for near in lists for _, i in near), q
    assert [v for *_, v in got[2000]] == list(range(2001, 2011))
    assert got[3000][0][2] == 3001
    few = found(nearest(spark, frame.where("vec_id in (10, 20)"), F.lit(True), k=10))
    assert [len(x) for x in few.values()] == [4, 4]
    assert nearest(spark, frame.where("vec_id > 3999"), F.lit(True)).count() == 0
    assert nearest(spark, frame, F.lit(False)).count() == 0


def fits(item, text):
    """The least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return min(row)


def test_contamination_against_brute_force(spark):
    from quillmine.llm.decontaminate import find_contamination

    rng = random.Random(12)
    words = ["w%d" % i for i in range(900)]
    items = [(i, rng.choices(words, k=rng.choice((1, 2, 4, 5, 7, 8, 9, 11, 13, 16, 20, 27, 35, 50)))) for i in range(60)]
    texts = []
    for d in range(150):
        text = rng.choices(words, k=rng.randrange(0, 90))
        for _ in range(rng.randrange(0, 3)):
            _, item = rng.choice(items)
            planted = [[w] for w in item]
            for at in rng.sample(range(len(item)), min(len(item), rng.randrange(0, len(item) // 4 + 1))):
                planted[at] = rng.choice([[rng.choice(words)], [], [item[at], rng.choice(words)], [rng.choice(words), item[at]]])
            if len(item) > 3 and rng.random() < 0.2:  # two words change places
                planted[1], planted[2] = planted[2], planted[1]
            at = rng.randrange(0, len(text) + 1)
            text[at:at] = sum(planted, [])
        texts.append((d, text))
    want = {(d, i): n for d, t in texts for i, item in items if (n := fits(item, t)) <= int(0.2 * len(item))}
    frame = spark.createDataFrame([(d, " ".join(t), d) for d, t in texts], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edit_distance for r in find_contamination(spark, frame, bench, 0.2).collect()}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) > 100
    assert sum(got[x] == want[x] for x in got) >= 0.99 * len(got)


def test_blocks_of_items_are_bounded(spark, monkeypatch):
    from quillmine.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    bench = spark.createDataFrame([(i, f"item number {i} of the benchmark {i} {i * i}") for i in range(9)] + [(20, "long " * 100)], "item_id long, text string")
    blocks = list(decontaminate._blocks(bench, 0.2, 0.99, 1000, "item_id", "text"))
    assert sum(len(b.ids) for b in blocks) == 10 and len(blocks) >= 5
    docs = spark.createDataFrame([(i, f"see item number {i} of the benchmark {i} {i * i} there", True) for i in range(0, 18, 2)], "doc_id long, text string, leaks boolean")
    clean = decontaminate.without_contaminated(spark, docs, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [10, 12, 14, 16] and clean.columns == docs.columns


def test_license_notices_many_long_repeated(spark):
    from quillmine.llm.licenses import TEMPLATES, scan_group, make_index, scan_licenses

    notice = TEMPLATES["Apache-2.0-header"]
    text = ("intro words here " * 20_000) + notice + " Released under the MIT License. " * 300
    rows = [(1, text, "x"), (1, text, "x"), (2, notice + " " + notice, "y")]
    got = scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert len([r for r in got if r.doc_id == 1]) == 2 * 301 and len([r for r in got if r.doc_id == 2]) == 2
    index = make_index(TEMPLATES)
    for *_, first, words, _, _ in (found := scan_group(index, [text], 0.8)):
        assert words > 0
    places = sorted((f[3], f[3] + f[4]) for f in found)
    assert all(a[1] <= b[0] for a, b in zip(places, places[1:]))
