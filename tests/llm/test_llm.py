"""Operators against brute force, on small inputs and awkward ones."""

import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = "word_bpe_49k.json"
BYTE = "byte_bpe_50k.json"


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@pytest.fixture(scope="module")
def docs(spark):
    """Real rows, and nulls, empties, long texts, repeats, clashing columns."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()
    data = [(r.doc_id, r.text, r.lang, "x", 0) for r in rows]
    data += [(1000, None, "en", None, 1), (1001, "", None, "y", 1), (1002, " \n\t ", "en", "y", 1), (1003, "one two", "en", "y", 1), (1004, "a " * 30000, "en", "y", 1), (1003, "one two", "en", "y", 1), (1005, "x<|endoftext|>y é 日本", "zz", "y", 1)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, uid string, key long")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def tokens(name, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(name)).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_files_round_trip(spark, docs, none):
    from quillmine.llm.token_files import read_token_files, write_token_files

    got = read_token_files(spark, write_token_files(spark, docs, path(WORD), 2), with_ids=True).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in docs.collect())
    at, texts = 0, {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text)
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path(WORD))
    for r in got:
        ids = [*lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    assert read_token_files(spark, write_token_files(spark, none, path(WORD), 2)).count() == 0


def test_token_counts(docs, none):
    from quillmine.llm.token_counts import count_tokens
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path(BYTE))
    want = sorted((r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = count_tokens(docs, path(BYTE), 1024).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert count_tokens(none, path(BYTE), 1024).count() == 0


def test_packing_is_whole_and_tight(spark, docs, none):
    from quillmine.llm.packing import pack

    rows = pack(spark, docs, path(WORD), 0, 2048).toPandas()
    want = {}
    for r in docs.collect():
        ids = [*tokens(WORD, r.text), 0]
        for k in range(0, len(ids), 2048):
            want.setdefault((r.doc_id, k // 2048), []).append((k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])))
    got = {}
    for r in rows.itertuples():
        got.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length).tolist() == g.offset.tolist() and g.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 2048) + 2
    assert pack(spark, none, path(WORD), 0, 2048).count() == 0


def test_best_fit_of_equal_and_tiny_pieces(spark):
    from quillmine.llm.packing import best_fit

    sizes = [700] * 300 + [3] * 500 + [1500] * 20 + [2048] * 3
    pieces = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    got = best_fit(spark, pieces, 2048).toPandas()
    assert sorted(got.uid) == list(range(len(sizes)))
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() <= 150 + 20 + 3 + 2


def test_simhash_components(spark, docs, none):
    import xxhash

    from quillmine.llm.simhash import link_components, near_duplicates

    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        if not words:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = near_duplicates(spark, docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.fingerprint == f"{brute(texts[r.doc_id]):016x}" for r in got) and len(got) == docs.count()
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = list(base)
    for b in base:
        for _ in range(12):
            fps.append(b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 6))))
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
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    got = link_components(spark, spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(fps))}
    assert near_duplicates(spark, none).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        p, kind = rng.randrange(len(s)), rng.randrange(3)
        s[p : p + 1] = [[rng.choice("abé")], [], [s[p], rng.choice("abé")]][kind]
    return "".join(s)


def test_edit_bands_and_segments():
    from quillmine.llm.line_dedup import segment_keys, within

    rng = random.Random(6)
    for _ in range(600):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(8, 50)))
        b = edited(rng, a, rng.randrange(0, 4))
        near = edit_distance(a, b) <= 2
        assert within(a, b, 2) == near == within(b, a, 2)
        if edit_distance(a, b) <= min(2, min(len(a), len(b)) // 4):
            which, keys, own = segment_keys([a, b], 2, 4)
            sides = [(set(keys[which == i]), set(keys[(which == i) & own])) for i in (0, 1)]
            assert sides[0][0] & sides[1][1] or sides[1][0] & sides[0][1]


def test_line_dedup_against_brute_force(spark, docs, none):
    from quillmine.llm.line_dedup import dedup_lines

    rng = random.Random(8)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(18, 90))) for _ in range(30)]
    data = []
    for d in range(25):
        own = [edited(rng, rng.choice(lines), rng.choice((0, 0, 1, 2, 5))) for _ in range(4)]
        data.append((d, "\n".join([*own, "short", "", "exactly the same line", "short"]), "t"))
    data += [(100, None, "t"), (101, "", "t"), (102, "\n\n", "t")]
    got = {r.doc_id: r for r in dedup_lines(spark, spark.createDataFrame(data, "doc_id long, text string, kept string")).collect()}
    seen = [(d, n, x.strip()) for d, t, _ in data for n, x in enumerate((t or "").split("\n")) if x.strip()]
    root = list(range(len(seen)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(seen)):
        for j in range(i):
            a, b = seen[i][2], seen[j][2]
            if a == b or abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= min(2, min(len(a), len(b)) // 20):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    drop = {seen[i][:2] for i in range(len(seen)) if find(i) != i}
    for d, t, _ in data:
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in drop)
        assert got[d].text == want and got[d].kept == "t"
    assert dedup_lines(spark, none).count() == 0 and dedup_lines(spark, docs).count() == docs.count()


def test_blocks_of_a_hot_key(spark, monkeypatch):
    from quillmine.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    stem = "the quick brown fox jumps over the lazy dog and then some more words "
    rows = [(i, stem + chr(97 + i % 26) + chr(97 + i // 26)) for i in range(60)]
    done = line_dedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert done.where("n_removed = 0").count() == 1


def test_decontamination(spark, docs, none):
    from quillmine.llm.decontaminate import best_fit_distance, find_contamination, without_contaminated

    assert best_fit_distance(list("abcd"), list("xxabxcdyy")) == (1, 7)
    rng = random.Random(2)
    vocabulary = ["w%d" % i for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(12, 40)))) for i in range(20)] + [(50, None), (51, "too short"), (52, "")]
    texts, want = [], set()
    for d in range(60):
        noise = rng.choices(vocabulary, k=80)
        if d % 2 == 0:
            i = d % 20
            words = items[i][1].split()
            for p in rng.sample(range(len(words)), int(0.15 * len(words))):
                words[p] = "zz"
            noise[30:30] = words
            want.add((d, i))
        texts.append((d, "\n".join(" ".join(noise[a : a + 9]) for a in range(0, len(noise), 9)).upper()))
    frame, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(spark, frame, bench, 0.2).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(abs(r.first_word - 30) <= 3 for r in got)
    assert {(r.doc_id, r.item_id) for r in find_contamination(spark, frame, bench, 0.2, block_items=7).collect()} == want
    clean = without_contaminated(spark, docs.unionByName(frame, allowMissingColumns=True), bench)
    assert clean.count() == docs.count() + 60 - 30 and clean.columns == docs.columns
    assert find_contamination(spark, none, bench).count() == 0 and find_contamination(spark, frame, bench.limit(0)).count() == 0


@pytest.mark.parametrize("size", [8, 10, 12, 15, 16, 24])
def test_decontamination_recall_by_length(size):
    from quillmine.llm.decontaminate import make_block, search_group

    rng = random.Random(size)
    vocabulary = ["w%d" % i for i in range(5000)]
    items = [rng.choices(vocabulary, k=size) for _ in range(200)]
    texts = []
    for words in items:
        words = [[w] for w in words]
        for p in rng.sample(range(size), size // 5):
            words[p] = rng.choice([["zz"], [], words[p] + ["yy"]])
        texts.append(" ".join(rng.choices(vocabulary, k=40) + sum(words, []) + rng.choices(vocabulary, k=40)))
    block = make_block(list(range(200)), [" ".join(x) for x in items], 0.2, 0.99)
    found = {f[:2] for f in search_group(block, texts, 0.2)}
    assert sum((i, i) in found for i in range(200)) >= 196


def test_decontamination_of_short_and_unspaced_items(spark):
    from quillmine.llm.decontaminate import find_contamination, without_contaminated

    items = [(1, "Forty-two!"), (2, "capital of northern france"), (3, "which river runs through vienna"), (4, "日本で一番高い山は何ですか"), (5, "---")]
    texts = [(10, "a b forty two c"), (11, "the capital of northern France is"), (12, "which big river runs through Vienna"), (13, "問い：日本で一番高い山はどこですか。"), (14, "capital of southern france; forty; 日本の山"), (15, None)]
    frame, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edit_distance) for r in find_contamination(spark, frame, bench, 0.2).collect()}
    assert got == {(10, 1, 0), (11, 2, 0), (12, 3, 1), (13, 4, 2)}
    assert sorted(r.doc_id for r in without_contaminated(spark, frame, bench).collect()) == [14, 15]


def test_toxicity(spark, docs, none):
    from quillmine.llm.toxicity import fit_toxicity, held_out, score_toxicity

    rng = random.Random(9)
    words = ["w%d" % i for i in range(500)]
    rows, labels = [], []
    for i in range(900):
        text, bad = rng.choices(words, k=60), i % 6 == 0
        if bad:
            for p in rng.sample(range(60), 3):
                text[p] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(bad)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    model = fit_toxicity(spark, frame, marks, max_rows=600)
    got = score_toxicity(spark, frame, model).join(marks.where("toxic is not null"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) > 0.97 * len(got)
    assert {zlib.crc32(str(r.doc_id).encode()) % 4 for r in frame.where(held_out()).collect()} == {2}
    odd = score_toxicity(spark, docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert score_toxicity(spark, none, model).count() == 0
    assert score_toxicity(spark, frame, fit_toxicity(spark, frame, marks.limit(0))).where("score <> 0").count() == 0


def test_nearest(spark):
    from quillmine.llm.ann import nearest

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).round(2)
    x[100:140] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, [1.0] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(spark, frame, F.col("vec_id") % 20 == 0, k=5, shortlist=60, block_queries=10).collect()
    by, hits = {}, 0
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 600, 20))
    for q, found in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(600), d)) if i != q][:5]
        found = [v for _, v, s in sorted(found)]
        hits += len(set(found) & set(want))
    assert hits >= 0.95 * 5 * len(by)
    assert [v for _, v, _ in sorted(by[100])] == [7, 101, 102, 103, 104]
    assert nearest(spark, frame.limit(0), F.lit(True)).count() == 0


def test_licenses(spark, docs, none):
    from quillmine.llm.licenses import TEMPLATES, scan_licenses

    long = TEMPLATES["Apache-2.0-header"].replace("compliance", "full compliance").replace("express or implied", "")
    rows = [(1, "text before\n" + long + " and after"), (2, "Released under the\nMIT license!"), (3, "licensed under nothing"), (4, None), (5, ""), (6, "All rights reserved. " * 3)]
    got = scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "Apache-2.0-header"), (2, "MIT")] + [(6, "all-rights-reserved")] * 3
    one = next(r for r in got if r.doc_id == 2)
    assert (one.coverage, one.first_word, one.n_words) == (1.0, 0, 5)
    assert scan_licenses(spark, none).count() == 0 and scan_licenses(spark, docs).count() >= 0


def test_whole_licenses(spark):
    from quillmine.llm.licenses import default_templates, scan_licenses

    whole = default_templates()
    assert {"MIT-text", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0-text", "GPL-2.0-text", "GPL-3.0-text", "LGPL-2.1-text", "LGPL-3.0-text", "MPL-2.0-text", "Unlicense-text"} <= set(whole)
    names = sorted(n for n in whole if len(whole[n].split()) > 90)
    rows = [(i, "some words of the software before it\n" + whole[n] + "\nand of the license after") for i, n in enumerate(names)]
    got = scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.coverage) for r in got) == [(i, n, 1.0) for i, n in enumerate(names)]
    assert all(r.first_word == 7 for r in got)
    mit = next(r for r in got if r.license == "MIT-text")
    assert rows[mit.doc_id][1][mit.first_byte : mit.first_byte + mit.n_bytes].endswith("DEALINGS IN THE SOFTWARE")


ARTICLE = "<article><h1>T{i}</h1><p>First {i} &amp; more<br>text</p><p>Second   {i}\n line</article>"
DIVS = (
    "<div class='top'><span>Site name</span><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></div><div id=c{i}><div><h2>Head {i}</h2><p>Body {i} of the page with words {i}{i}</p><p>Share this page</p>"
    "<p>More body {i} words here</p></div></div><div class='comments'><p>Reader {i} says</p></div><div><p>Copyright holder</p></div>"
)


def test_wrapper(spark):
    from quillmine.llm.wrapper import extract_pages

    rows = [(i, f"http://a.example/{i}", f"<html><body><nav>menu {i}</nav><div class=ad>buy {i}</div>{ARTICLE.format(i=i)}<footer>foot {i}<script>if (a<b) x()</script>") for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", "<body>" + DIVS.format(i=i)) for i in range(12)]
    rows += [(200, "http://c.example/", "<p>alone"), (201, None, None), (202, "odd", ""), (203, "http://d.example/x", "<b>" * 3000 + "deep" + "<div>" * 3000)]
    rows += [(300 + i, "http://e.example/same", "<article><p>always the same</p></article>") for i in range(20)]
    got = {r.page_id: r for r in extract_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert got[3].text == "T3\nFirst 3 & more text\nSecond 3 line"
    assert got[105].text == "Head 5\nBody 5 of the page with words 55\nMore body 5 words here"
    assert (got[200].text, got[201].text, got[202].text, got[203].text) == ("alone", "", "", "deep")
    assert got[305].text == "always the same" and all(r.n_chars == len(r.text) for r in got.values())


def test_wrapper_slots_choose_on_small_hosts(spark):
    from quillmine.llm.wrapper import extract_pages

    body = "<div><p>Site of the town</p><p>All the news</p></div><article><p>Welcome to us</p></article><div><div><h2>Head {i}</h2><p>First text {i} of this page</p><p>Sent by our desk</p><p>Second text {i} of it</p></div></div>"
    inner = "<article><h1>T{i}</h1><p>Body {i} of an article {i}</p><p>Read it in the app</p><p>Rest {i} of that article</p></article>"
    rows = [(i, f"http://a.example/{i}", body.format(i=i)) for i in range(2)] + [(10 + i, f"http://b.example/{i}", inner.format(i=i)) for i in range(3)]
    got = {r.page_id: r.text for r in extract_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Head 1\nFirst text 1 of this page\nSecond text 1 of it"
    assert got[12] == "T2\nBody 2 of an article 2\nRest 2 of that article"


def test_wrapper_with_odd_pages_and_layouts(spark):
    from quillmine.llm.wrapper import extract_pages

    page = "<article><h1>T{i}</h1><p>Body {i} of an article {i}, long enough</p><p>{note}</p><p>Rest {i} of that article</p></article>"
    other = "<main><section><h2>S{i}</h2><div>Story {i} of another kind {i}</div><div>Our other notice for all</div></section></main>"
    rows = [(i, f"http://a.example/{i}", page.format(i=i, note="Printed in 2023" if i == 5 else "Printed in 2024")) for i in range(30)]
    rows += [(100 + i, f"http://a.example/x{i}", other.format(i=i)) for i in range(10)]
    got = {r.page_id: r.text for r in extract_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        assert got[i] == f"T{i}\nBody {i} of an article {i}, long enough\nRest {i} of that article"
    for i in range(10):
        assert got[100 + i] == f"S{i}\nStory {i} of another kind {i}"


def test_components_of_a_chain_and_a_hub(spark):
    from quillmine.llm.common import component_labels

    edges = [(i, i + 1) for i in range(40)] + [(1000, 2000 + i) for i in range(50)] + [(7, 7)]
    got = {r.id: r.component for r in component_labels(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[2000 + i] == 1000 for i in range(50))


def test_line_stage_keeps_lines_of_its_own(spark):
    import corpus_pipeline

    shared = [f"passage number {i} that several documents have in common, word for word {i * i}" for i in range(12)]
    rows = [(1, "\n".join(shared[:6])), (2, "\n".join(shared[6:])), (3, "\n".join([*shared, "a closing remark that no other document has"])), (4, "\n".join(shared[:6])), (5, None), (6, "")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.drop_repeated_lines(spark, frame, SF).collect()}
    assert set(got) == {1, 2, 3, 5, 6} and got[3].text.strip() == "a closing remark that no other document has" and got[3].n_chars == len(got[3].text)


def test_near_copies_with_missing_and_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(9)
    a, b, c, d = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(4))
    rows = [(1, a, 0), (None, a, 1), (None, b, 2), (7, c, 3), (7, a, 4), (8, d, 5), (8, d, 6), (9, d, 7), (None, b, 8)]
    got = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), SF)
    assert got.columns == ["doc_id", "text", "n_chars"]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(1, a), (None, b), (7, c), (8, d)]))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF).persist()
        assert after.columns == docs.columns and after.join(kept, "doc_id", "left_anti").count() == 0, name
        kept = after
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in kept.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in (r.text or "") for i in items for r in kept.collect())
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"
