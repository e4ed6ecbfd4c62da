"""Toxicity by a convolutional text classifier, trained in numpy.

Each word is the sum of two rows of hashed embedding tables. Filters of widths
1, 2 and 3 run over all words of the text; the largest response of each filter
enters a logistic output. One embedding dimension begins with the word's
shrunken log-odds among the training documents, as max pooling passes few
gradients to words it has not found yet. A held-back fifth of the training rows
calibrates the score to a probability, and a threshold for each language.

Training takes at most ``max_rows`` labelled documents, those with the smallest
id hash, as long as they have ``max_words`` words in all; all else covers every
document. The score is a function of the text alone.

Cases: null text counts as empty and scores as such; texts of any length are
scored whole; a document with several labels counts as toxic if one says so; null
labels and ids are left out; of labelled rows equal in id, language and text one
is learned from; without labels of both kinds every score is the share of toxic
labels, or 0; repeated rows are scored each; a score equal to a threshold reaches
it; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, bounded_batches, dropped, give_back, lean, written
from .tokens import text_groups
from .words import words_of_texts

BITS, DIM, FILTERS, WIDTHS = 17, 8, 8, (1, 2, 3)
PAD = 1 << BITS


def codes(h: np.ndarray) -> np.ndarray:
    """32 bits of each word's hash, from which both table rows come."""
    return (h >> np.uint64(32)).astype(np.uint32)


def _rows(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (c >> np.uint32(32 - BITS)).astype(np.int32), (c & np.uint32((1 << BITS) - 1)).astype(np.int32)


def _slots(h: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both table rows of each word, with padding after each text, and where each text starts."""
    n = len(limits) - 1
    gap = max(WIDTHS) - 1
    at = np.arange(len(h)) + np.repeat(np.arange(n) * gap, np.diff(limits))
    one = np.full(len(h) + n * gap, PAD, dtype=np.int32)
    two = one.copy()
    one[at], two[at] = _rows(h)
    return one, two, limits[:-1] + np.arange(n) * gap


@dataclass
class TextCnn:
    tables: list[np.ndarray]
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)
    constant: float | None = None

    @staticmethod
    def make(seed: int) -> TextCnn:
        rng = np.random.default_rng(seed)
        tables = [rng.normal(0, 0.02, (PAD + 1, DIM)).astype(np.float32) for _ in range(2)]
        for t in tables:
            t[PAD] = 0
            t[:, 0] = 0
        filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[:, 0, :] = np.abs(f[:, 0, :])
        return TextCnn(tables, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(len(WIDTHS) * FILTERS, 0.2, np.float32), -2.0)

    def responses(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        emb = self.tables[0][one] + self.tables[1][two]
        padding = np.flatnonzero(one == PAD)
        out = []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            r = emb @ f[0] + b
            for k in range(1, w):
                r[:-k] += emb[k:] @ f[k]
            r[padding] = b  # whatever the next text begins with
            out.append(r)
        return emb, out

    def logits(self, h: np.ndarray, limits: np.ndarray) -> np.ndarray:
        one, two, starts = _slots(h, limits)
        _, responses = self.responses(one, two)
        pooled = np.concatenate([np.maximum(np.maximum.reduceat(r, starts, axis=0), 0) for r in responses], axis=1)
        return pooled @ self.out + self.out_bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        *_, h, limits = words_of_texts(texts)
        return _sigmoid(self.scale * self.logits(codes(h), limits).astype(np.float64) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_odds(model: TextCnn, docs: list[np.ndarray], y: np.ndarray) -> None:
    """Begin dimension 0 with half of each row's log-odds, shrunken by its document count."""
    toxic = int(y.sum())
    for k, table in enumerate(model.tables):
        n = np.zeros((2, PAD))
        for c, label in zip(docs, y):
            n[label, np.unique(_rows(c)[k])] += 1
        total = n.sum(axis=0)
        odds = np.log((n[1] + 1) / (toxic + 2)) - np.log((n[0] + 1) / (len(y) - toxic + 2))
        table[:PAD, 0] = 0.5 * odds * total / (total + 5)


def _step(model: TextCnn, h: np.ndarray, limits: np.ndarray, y: np.ndarray, state: dict, rate: float) -> None:
    one, two, starts = _slots(h, limits)
    emb, responses = model.responses(one, two)
    ends = np.append(starts[1:], len(one))
    best, pooled = [], []
    for r in responses:
        top = np.maximum.reduceat(r, starts, axis=0)
        where = np.where(r == np.repeat(top, ends - starts, axis=0), np.arange(len(r))[:, None], len(r))
        best.append(np.minimum.reduceat(where, starts, axis=0))
        pooled.append(top)
    hidden = np.concatenate(pooled, axis=1)
    live = np.maximum(hidden, 0)
    delta = (_sigmoid(live @ model.out + model.out_bias) - y) / len(y)
    back = (delta[:, None] * model.out[None, :] * (hidden > 0)).astype(np.float32)

    def update(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        seen = state.setdefault(name, np.zeros_like(value))
        seen += grad * grad
        value -= rate * grad / (np.sqrt(seen) + 1e-6)

    emb_at, emb_grad = [], []
    for i, w in enumerate(WIDTHS):
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        filters = model.filters[i].copy()
        for k in range(w):
            at = np.minimum(best[i] + k, len(emb) - 1)
            inside = (best[i] + k < ends[:, None])[:, :, None]
            update(f"f{i}{k}", model.filters[i][k], np.einsum("bfd,bf->df", emb[at] * inside, g))
            emb_at.append(at.ravel())
            emb_grad.append((g[:, :, None] * filters[k].T[None] * inside).reshape(-1, DIM))
        update(f"b{i}", model.bias[i], g.sum(axis=0))
    update("out", model.out, (live * delta[:, None]).sum(axis=0).astype(np.float32))
    model.out_bias -= 0.5 * rate * float(delta.sum())
    at, grad = np.concatenate(emb_at), np.concatenate(emb_grad)
    for name, table, rows in (("t0", model.tables[0], one[at]), ("t1", model.tables[1], two[at])):
        some, which = np.unique(rows, return_inverse=True)
        summed = np.zeros((len(some), DIM), np.float32)
        np.add.at(summed, which, grad)
        summed[some == PAD] = 0
        seen = state.setdefault(name, np.zeros_like(table))
        seen[some] += summed * summed
        table[some] -= rate * summed / (np.sqrt(seen[some]) + 1e-6)


def _batch(docs: list[np.ndarray], keep: float = 1.0, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    if keep < 1:
        docs = [h[rng.random(len(h)) < keep] for h in docs]
    return np.concatenate([np.empty(0, np.uint32), *docs]), np.cumsum([0, *map(len, docs)])


def train(docs: list[np.ndarray], labels: list[int], langs: list[str | None], epochs: int = 10, batch: int = 64, rate: float = 0.05, seed: int = 3) -> TextCnn:
    """docs: the words of each text, as codes()."""
    y = np.array(labels, dtype=np.int64)
    model = TextCnn.make(seed)
    if len(set(labels)) < 2:
        model.constant = float(y.mean()) if len(y) else 0.0
        return model
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        held[rng.permutation(at)[: len(at) // 5]] = True
    fit = np.flatnonzero(~held)
    _log_odds(model, [docs[i] for i in fit], y[fit])
    state: dict = {}
    for epoch in range(epochs):
        order = rng.permutation(fit)
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            _step(model, *_batch([docs[i] for i in some], 0.7, rng), y[some], state, rate / (1 + epoch))
    check = np.flatnonzero(held) if len(np.unique(y[held])) == 2 else np.arange(len(y))
    z = np.concatenate([model.logits(*_batch([docs[i] for i in check[a : a + 256]])) for a in range(0, len(check), 256)]).astype(np.float64)
    # logistic calibration, with a little mass on the other label so that the slope stays finite
    target, a, b = y[check] * 0.96 + 0.02, 1.0, 0.0
    for _ in range(500):
        p = _sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-6)
        gradient = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        hessian = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        move = np.linalg.solve(hessian, gradient)
        size = min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        a, b = a - size * move[0], b - size * move[1]
        if np.abs(move).max() < 1e-8:
            break
    model.scale, model.shift = max(float(a), 1e-3), float(b)
    score = _sigmoid(model.scale * z + model.shift)

    def threshold(rows: np.ndarray) -> float:
        """The middle of the thresholds with the best F1, away from the ends, where few rows decide."""
        cuts = np.arange(0.2, 0.61, 0.02)
        f1 = [2 * (y[check][rows] * (s := score[rows] >= c)).sum() / max(1, s.sum() + y[check][rows].sum()) for c in cuts]
        return float(np.median(cuts[np.isclose(f1, max(f1))]))

    model.thresholds[None] = threshold(np.arange(len(check)))
    names = np.array([str(langs[i]) for i in check])
    for lang in np.unique(names):
        rows = np.flatnonzero(names == lang)
        if y[check][rows].sum() >= 10:  # else the threshold of all
            model.thresholds[str(lang)] = threshold(rows)
    return model


def fit_toxicity(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 16_000,
    max_words: int = 20_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "toxic",
) -> TextCnn:
    """A classifier from the labelled documents outside the held-out quarter, whole
    ones, of max_words words in all."""
    bounded_batches(spark)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # the documented bound
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.join(F.broadcast(known), "doc_id").select("doc_id", "y", "lang", "text")

    def hashed(batches):
        for batch in batches:
            ids, y, lang, texts = (c.to_pylist() for c in batch.columns)
            for a, b in text_groups(texts):
                *_, h, limits = words_of_texts(texts[a:b])
                c = codes(h)
                raw = [c[x:y].tobytes() for x, y in zip(limits, limits[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(y[a:b], pa.int32()), pa.array(lang[a:b], pa.string()), pa.array(raw, pa.binary())], names=["doc_id", "y", "lang", "h"])

    # documents that share an id may be any number: the bound holds for them too
    worded = rows.mapInArrow(lean(hashed), "doc_id long, y int, lang string, h binary")
    worded = written(spark, worded.withColumns({"hash": F.xxhash64("h", "lang"), "words": (F.length("h") / 4).cast("long")}), "toxicity-words")
    drawn = worded.select("doc_id", "hash", "words").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "hash").limit(max_rows).collect()  # the documented bound
    total = np.cumsum([0, *(r.words for r in drawn)])[1:]
    drawn = [(r.doc_id, r.hash) for r, n in zip(drawn, total) if n <= max_words]
    chosen = F.broadcast(spark.createDataFrame(drawn, "doc_id long, hash long"))
    sample = worded.join(chosen, ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("doc_id", "y", "lang", "h").toArrow().sort_by([("doc_id", "ascending"), ("h", "ascending")])
    dropped(spark, worded)
    model = train([np.frombuffer(x, np.uint32) for x in sample.column("h").to_pylist()], [1 if v else 0 for v in sample.column("y").to_pylist()], sample.column("lang").to_pylist())
    del sample
    give_back(spark)  # a driver lives longer than its training
    return model


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def with_scores(spark: SparkSession, docs: DataFrame, model: TextCnn, text_col: str = "text", lang_col: str = "lang", names: tuple[str, str] = ("score", "threshold")) -> DataFrame:
    """docs with score, and threshold: that of the language. Columns with these names
    are replaced."""
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def scored(texts, langs):
        texts, cuts = texts.to_pylist(), shared.value.thresholds
        score = np.concatenate([np.empty(0), *(shared.value.scores(texts[a:b]) for a, b in text_groups(texts, 500_000))])
        return score, [cuts.get(str(x), cuts.get(None, 0.5)) for x in langs.to_pylist()]

    return appended(docs, [text_col, lang_col], [(name, "double", pa.float64()) for name in names], scored)


def score_toxicity(spark: SparkSession, docs: DataFrame, model: TextCnn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3), threshold of the
    language, toxic (score >= threshold)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = with_scores(spark, rows, model)
    held = F.coalesce(held_out("doc_id"), F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("toxic"))
