"""Lines, fingerprints, toxicity and the pipeline on awkward input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_short_lines_and_repeated_rows(spark):
    from quillmine.llm.line_dedup import dedup_lines

    near = ["a line of thirty characters, x", "a line of thirty characters, y"]
    rows = [(1, near[0] + "\nyes\n\n  yes", 0), (2, near[1] + "\nno", 1), (3, "yes\nown", 2), (3, "yes\nown", 3), (3, "yes\nown", 3), (None, "own\nalone", 4), (None, "own\nalone", 4), (4, "nineteen letters a!", 5), (5, "nineteen letters b!", 6)]
    got = dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, n_lines long"), counts=("n", "gone"))
    assert got.columns == ["doc_id", "text", "n_lines", "n", "gone"]
    kept = sorted((r.doc_id or 0, r.text, r.n, r.gone) for r in got.collect())
    want = [(1, near[0] + "\nyes\n", 4, 1), (2, "no", 2, 1), *[(3, "", 2, 2)] * 3, (0, "own\nalone", 2, 0), (0, "", 2, 2), (4, "nineteen letters a!", 1, 0), (5, "nineteen letters b!", 1, 0)]
    assert kept == sorted(want)
    assert sum("own" in r.text for r in got.collect()) == 1
    assert dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, n_lines long")).columns == ["doc_id", "text", "n_lines", "n_removed"]


def test_no_row_of_a_key_is_lost():
    from quillmine.llm.line_dedup import _several

    key = np.array([1, 1, 2, 3, 3, 3, 4, 4], np.int64)
    h1 = np.array([5, 6, 7, 8, 8, 9, 1, 2], np.int64)
    own = np.array([1, 0, 1, 0, 1, 0, 0, 0], bool)
    assert _several(key, h1, own, set()).to_pydict() == {"key": [1, 1, 3, 3], "h1": [5, 6, 8, 9]}
    assert _several(key, h1, own, {4, 2}).to_pydict()["key"] == [1, 1, 2, 3, 3, 4, 4]


@pytest.mark.parametrize("held, sample", [(3, 64), (1_000_000, 1)])
def test_hot_keys(spark, monkeypatch, held, sample):
    """A key that a task does not hold at once, and one that is dealt to all tasks."""
    from quillmine.llm import line_dedup

    monkeypatch.setattr(line_dedup, "HELD", held)
    monkeypatch.setattr(line_dedup, "SAMPLE", sample)
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    rng = random.Random(1)
    stem = "the quick brown fox jumps over the lazy dog and then some more words "
    tails = ["".join(rng.choice("abcdefghij") for _ in range(12)) for _ in range(80)]
    rows = [(i, stem + t) for i, t in enumerate(tails)] + [(200 + i, stem + t[:5] + "z" + t[6:]) for i, t in enumerate(tails)]
    done = line_dedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in done.where("n_removed = 0").collect()) == list(range(80))


def components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(fps))}


def test_long_keys_find_the_same_links(spark):
    from quillmine.llm.simhash import link_components, looked_up_keys, stored_keys

    rng = random.Random(7)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 5)))
        fp = np.array([a, b], np.uint64).view(np.int64)
        for long in (False, True):
            (row, key), (row2, key2) = stored_keys(fp, long), looked_up_keys(fp, long)
            assert set(key[row == 0]) & set(key2[row2 == 1]) and set(key[row == 1]) & set(key2[row2 == 0])
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 6))) for b in base for _ in range(10)]
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    got = link_components(spark, spark.createDataFrame(signed, "doc_id long, fp long"), long_keys_from=0).collect()
    assert {r.doc_id: r.component_id for r in got} == components(fps)


def test_hubs_by_way_of_written_minima(spark, monkeypatch):
    from quillmine.llm import common

    monkeypatch.setattr(common, "HUB_LINKS", 0)
    edges = [(i, i + 1) for i in range(30)] + [(1000, 2000 + i) for i in range(50)] + [(5000, i) for i in range(4000, 4050)]
    got = {r.id: r.component for r in common.component_labels(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[2000 + i] == 1000 for i in range(50)) and got[5000] == got[4049] == 4000


def plain_scores(model, texts):
    """The network word by word, without numpy's tricks."""
    from quillmine.llm.toxicity import BITS, WIDTHS, codes
    from quillmine.llm.words import words_of_texts

    out = []
    for text in texts:
        *_, h, _ = words_of_texts([text])
        rows = [(int(c) >> (32 - BITS), int(c) & (1 << BITS) - 1) for c in codes(h)]
        emb = [model.tables[0][a].astype(float) + model.tables[1][b] for a, b in rows] + [np.zeros(model.tables[0].shape[1])] * (max(WIDTHS) - 1)
        pooled = []
        for w, f, bias in zip(WIDTHS, model.filters, model.bias):
            for j in range(f.shape[2]):
                best = 0.0
                for at in range(len(emb)):
                    best = max(best, sum(float(emb[at + k] @ f[k][:, j]) for k in range(w) if at + k < len(emb)) + float(bias[j]))
                pooled.append(best)
        z = float(np.dot(pooled, model.out)) + model.out_bias
        out.append(1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -30, 30))))
    return out


def test_toxicity_against_plain_loops(spark):
    from quillmine.llm.toxicity import fit_toxicity, score_toxicity

    rng = random.Random(3)
    words = ["w%d" % i for i in range(80)]
    rows = [(i, " ".join(rng.choices(words, k=12) + ["vile"] * (i % 5 == 0)), "en") for i in range(400)]
    marks = [(i, int(i % 5 == 0)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks + marks[:9] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = fit_toxicity(spark, frame.unionByName(frame.limit(20)), labels, max_rows=200, max_words=2000)
    texts = [t for _, t, _ in rows[:30]] + ["", None, "  ", "vile", "VILE w1!", "x " * 500]
    odd = spark.createDataFrame([(i, t, "en", 0.5, True) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score double, held_out boolean")
    got = {r.doc_id: r.score for r in score_toxicity(spark, odd, model).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], plain_scores(model, texts), atol=1e-4)
    assert got[33] > got[30]


def awkward(spark, repeats=1):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(12)]
    rows = [(i, t, rng.choice(("en", "de", None)), "s", len(t)) for i, t in enumerate(texts)]
    rows += [(50, None, "en", "s", None), (51, "", None, None, 0), (52, " \n ", "en", "s", 3), (None, "no id here at all", "en", "s", 0), (None, "another without id", "fr", "s", 0), (53, "long " * 50_000, "en", "s", 0)]
    rows += rows[:3] + [(60, texts[4], "en", "t", 0)]
    data = [(*r, 1.5, True, "a", "b", 7, "x", 3) for r in rows * repeats]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, threshold boolean, n_removed string, leaks string, id long, tkey string, uid int")


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "simhash", "decontamination", "packing"])
def test_stages_on_awkward_tables(spark, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    docs = awkward(spark)
    for table in (docs, docs.limit(0)):
        got = stage(spark, table, SF)
        rows = got.collect()
        if name != "packing":
            assert got.columns == docs.columns
            extra = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
            assert all(tuple(r[c] for c in extra) == (1.5, True, "a", "b", 7, "x", 3) for r in rows)
        assert bool(rows) == (table is docs)


def test_stages_against_brute_force(spark):
    """Which documents the deterministic stages keep, by plain Python."""
    import corpus_pipeline

    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in docs.collect()]

    lines = corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    first, texts = set(), {}
    for i in order:
        if rows[i][1] is not None:
            kept = []
            for x in rows[i][1].split("\n"):
                if not x.strip() or x.strip() not in first:
                    kept.append(x)
                    first.add(x.strip())
            texts[i] = "\n".join(kept)
    want = [(rows[i][0], texts.get(i)) for i in order if i not in texts or texts[i] == rows[i][1] or texts[i].strip()]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in lines)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines)

    from quillmine.llm.simhash import fingerprint

    distinct = sorted({r[:2] for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    groups = components([fingerprint(t, 4, 42) for _, t in distinct])
    want = {}
    for i, g in groups.items():
        want.setdefault(g, distinct[i])
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, SF).collect()
    assert len(got) == len(want) and {r.doc_id for r in got if r.doc_id is not None} == {i for i, _ in want.values() if i is not None}
