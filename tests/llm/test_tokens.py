"""Token ids, counts, files and packing against the library and sequential packing."""

import random
from bisect import bisect_left, insort

import numpy as np
import pytest

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
#: All characters that are worked on here, and some that are not.
CHARACTERS = "".join(map(chr, [*range(0x20, 0x7F), 9, 10, 11, 12, 13, *range(0xA0, 0x2C8), *range(0x2010, 0x203B), 0x20AC, 0x1E9E, 0x212A, 0x130, 0x23A, 0x300, 0x4E00, 0x85, 0, 0x1F, 0x1C]))
BITS = ["'s", "'t", "'re", "'ve", "'ll", "'m", "'d", "'S", "''s", " '", "x's", "'street", "1's", ".'s", "²", "½", "é's", "'é", "<|endoftext|>", "<|EndOfText|>", "\n\n", "  ", " \n", "\n 's", "\n's", " 's"]


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def library(name):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path(name))
    return lambda text: lib.encode(text or "", add_special_tokens=False).ids


def odd_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        alphabet = rng.choice(["abc'srtvelmd .,1é\n  ", CHARACTERS[:190], CHARACTERS])
        yield "".join(rng.choice(BITS) if rng.random() < 0.15 else rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))


def test_ids_of_any_text(monkeypatch):
    from quillmine.llm import tokens

    lib, ids = library(WORD), tokens.TokenIds(path(WORD))
    texts = [*odd_texts(1, 3000), "", None, "x" * 500, *(f"ab{c}cd {c}{c} x{c}" for c in CHARACTERS)]
    assert ids.by_piece
    for a in range(0, len(texts), 300):
        some = texts[a : a + 300]
        assert [x.tolist() for x in ids.encode(some)] == [lib(t) for t in some]
    monkeypatch.setattr(tokens, "PART", 40)
    monkeypatch.setattr(tokens.text_parts, "__defaults__", (40,))
    joined = [" ".join(texts[a : a + 50]) for a in range(0, 900, 50)]
    assert [x.tolist() for x in ids.encode(joined)] == [lib(t) for t in joined]


def test_counts_of_any_text(monkeypatch):
    from quillmine.llm import tokens
    from quillmine.llm.token_counts import MergeCounter

    lib, counter = library(BYTE), MergeCounter(path(BYTE))
    texts = [*odd_texts(2, 3000), "", "x" * 500, "ab" * 300, *(f"ab{c}cd {c}{c} x{c}" for c in CHARACTERS)]
    for a in range(0, len(texts), 300):
        some = texts[a : a + 300]
        assert counter.counts(some) == [len(lib(t)) for t in some]
    monkeypatch.setattr(tokens.text_parts, "__defaults__", (40,))
    joined = [" ".join(texts[a : a + 50]) for a in range(0, 900, 50)]
    assert counter.counts(joined) == [len(lib(t)) for t in joined]


def test_words_are_forgotten_and_stay_right():
    from quillmine.llm.tokens import padded
    from quillmine.llm.wordtable import Words

    def learn(words):
        return np.array([b for w in words for b in w], np.int64), np.array([len(w) for w in words], np.int64)

    known, rng = Words(learn, np.int64, bits=8), random.Random(3)
    for _ in range(60):
        words = ["".join(rng.choice("ab") for _ in range(rng.choice((1, 3, 8, 9, 16, 17, 40, 64, 65, 200)))) for _ in range(rng.randrange(1, 120))]
        data = " ".join(words).encode()
        size = np.array([len(w) for w in words])
        start = np.cumsum(size + 1) - size - 1
        entry = known.lookup(data, padded(data), start, start + size)
        assert known.values(entry).tolist() == [b for w in words for b in w.encode()]
        assert known.n <= known.most + 240 and all(4 * t.filled <= 3 << t.bits for t in known.tables)


def test_manifest_is_stored_with_the_files(spark, tmp_path):
    from quillmine.llm.token_files import read_manifest, read_token_files, remove_token_files, write_token_files

    rows = [(None, f"no id {i}") for i in range(40)] + [(7, f"same id {i % 9}") for i in range(40)] + [(i, "w " * i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written = write_token_files(spark, docs, path(WORD), 2, folder=f"file://{tmp_path}/tokens", shards=6)
    found = read_manifest(spark, f"file://{tmp_path}/tokens")
    assert found == written and len([s for s in found.shards if s.n_docs]) > 3
    got = read_token_files(spark, found).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    remove_token_files(spark, found)
    assert not (tmp_path / "tokens").exists()


def best_fit_decreasing(sizes, capacity):
    gaps, used = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect_left(gaps, s)
        if at < len(gaps):
            gap = gaps.pop(at) - s
        else:
            gap, used = capacity - s, used + 1
        if gap:
            insort(gaps, gap)
    return used


@pytest.mark.parametrize("kind", ["mixed", "small", "large", "one_size", "halves"])
def test_packing_against_sequential_best_fit(spark, kind):
    from quillmine.llm.packing import best_fit

    rng = random.Random(kind)
    draw = {
        "mixed": lambda: min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1),
        "small": lambda: rng.randrange(1, 300),
        "large": lambda: rng.randrange(500, 2049),
        "one_size": lambda: 400 if rng.random() < 0.4 else rng.randrange(1, 2049),
        "halves": lambda: rng.choice((1024, 1023, 1025, 1, 2)),
    }[kind]
    sizes = [draw() for _ in range(1500)]
    got = best_fit(spark, spark.createDataFrame(list(enumerate(sizes)), "uid long, length long"), 2048, part_rows=100).toPandas()
    assert sorted(got.uid) == list(range(len(sizes))) and got.groupby("sequence_id").length.sum().max() <= 2048
    least = best_fit_decreasing(sizes, 2048)
    assert got.sequence_id.nunique() <= least + max(1, least // 100)
