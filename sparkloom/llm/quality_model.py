"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a temperature.

A word stands for two terms: its hashed form and its shape (kinds of characters at both ends, length class, and
whether it lies in a run of eight words that the text repeats).  Every term has a fixed sparse random index vector;
a term's context vector sums the index vectors of its neighbours over all documents.  A document is the mean of its
terms' vectors, once for forms and once for shapes.  Only the network is fitted on the labelled sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import held_out, mapped, training_sample

#: Bound of the labelled sample that the model is fitted on, in rows.
SAMPLE_ROWS = 6000
FORMS, SHAPES, DIM, HIDDEN = 1 << 15, 1 << 10, 48, 32
NONZERO, WINDOW, EPOCHS, BATCH, RATE = 6, 2, 60, 64, 0.003
THRESHOLD = 0.7
#: Terms in a block of context sums; words whose sums fit 32 bits.
BLOCK, FULL = 64, 20_000_000

_KIND = np.full(256, 1, np.int64)  # other marks
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 2, 3, 4, 5
_KIND[list(b".,;:")], _KIND[list(b"!?")], _KIND[list(b"#*$%&|<>")] = 6, 7, 0


def repeated(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """True for each word in a ``k``-word window that its text has twice or more (all occurrences count)."""
    n = len(h)
    out = np.zeros(n, bool)
    if n < k:
        return out
    c = tc.seeds(k, 23)
    window = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        window += h[j : n - k + 1 + j] * c[j]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
    order = np.lexsort((window[at], text[at]))
    at = at[order]
    same = (window[at][1:] == window[at][:-1]) & (text[at][1:] == text[at][:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + k, -1)
    return np.cumsum(edge[:-1]) > 0


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(form, shape, first) of all words."""
    start, end, first = tc.words(data, offs)
    exact = tc.span_hashes(data, start, end)
    low = tc.LOWER[data]
    form = tc.span_hashes(low, start, end) % np.uint64(FORMS)
    if not len(start):
        return form.astype(np.int32), form.astype(np.int32), first
    size = np.minimum(end - start, 16) // 4
    shape = _KIND[data[start]] + 8 * _KIND[data[end - 1]] + 64 * (_KIND[data[np.maximum(end - 2, start)]] % 4 + 4 * np.minimum(size, 1)) + 512 * repeated(exact, first, 8)
    return form.astype(np.int32), shape.astype(np.int32), first


@dataclass
class Model:
    forms: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    heat: float

    def pooled(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        form, shape, first = terms(data, offs)
        n = np.diff(first)
        out = np.zeros((len(n), 2 * DIM + 2), np.float32)
        own = np.flatnonzero(n)
        if len(form):
            out[own, :DIM] = np.add.reduceat(self.forms[form], first[own], axis=0) / n[own, None]
            out[own, DIM : 2 * DIM] = np.add.reduceat(self.shapes[shape], first[own], axis=0) / n[own, None]
        out[:, -2], out[:, -1] = np.log1p(n), n == 0
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(data, offs)) / self.heat, -30, 30)))


def index_vectors(n: int, salt: int) -> np.ndarray:
    """Sparse ternary random index vectors, fixed by ``salt``."""
    out = np.zeros((n, DIM), np.float32)
    draw = tc.seeds(n * NONZERO, salt).reshape(n, NONZERO)
    np.add.at(out, (np.arange(n)[:, None], (draw >> np.uint64(8)) % np.uint64(DIM)), np.where(draw & np.uint64(1), 1.0, -1.0))
    return out


def context_sums(data: np.ndarray, offs: np.ndarray, index: tuple[np.ndarray, np.ndarray], sums: np.ndarray) -> int:
    """Adds to ``sums`` (DIM x (FORMS + SHAPES)) the index vectors around every word, to its form and to its shape;
    returns the number of words.  All are whole numbers, so that the order of sums doesn't matter."""
    form, shape, first = terms(data, offs)
    if not len(form):
        return 0
    # words with WINDOW empty places before, between and behind texts; those have a term of their own, without index
    at = np.arange(len(form)) + WINDOW * (np.repeat(np.arange(len(first) - 1), np.diff(first)) + 1)
    forms, shapes = np.full(len(form) + WINDOW * len(first), FORMS), np.full(len(form) + WINDOW * len(first), SHAPES)
    forms[at], shapes[at] = form, shape
    inner, n = slice(WINDOW, -WINDOW), len(forms) - 2 * WINDOW
    for d in range(DIM):
        own = index[0][d][forms] + index[1][d][shapes]
        around = sum(own[k : k + n] for k in range(2 * WINDOW + 1) if k != WINDOW)
        sums[d, :FORMS] += np.bincount(forms[inner], around, FORMS + 1)[:-1]
        sums[d, FORMS:] += np.bincount(shapes[inner], around, SHAPES + 1)[:-1]
    return len(form)


def index_tables() -> tuple[np.ndarray, np.ndarray]:
    """DIM rows of numbers of all forms, and of all shapes; each with one more term that has none."""
    return tuple(np.ascontiguousarray(np.vstack([v, np.zeros((1, DIM))]).T.astype(np.float64)) for v in (index_vectors(FORMS, 31), 2 * index_vectors(SHAPES, 37)))


def as_vectors(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit context vectors of forms and of shapes; those of terms without neighbours are zero (shapes keep a mark)."""
    unit = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)).astype(np.float32)
    return unit[:FORMS], unit[FORMS:] + 0.5 * index_vectors(SHAPES, 41)


def context_vectors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of some texts alone."""
    sums, index = np.zeros((DIM, FORMS + SHAPES)), index_tables()
    for a, b in tc.cuts(offs, 1 << 19):
        context_sums(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], index, sums)
    return as_vectors(sums.T)


def corpus_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of all documents: every task sums its texts, blocks of terms are summed over tasks."""

    def count(batches):
        sums, index, words = np.zeros((DIM, FORMS + SHAPES)), index_tables(), 0

        def sent():
            blocks = sums.T.astype(np.int32).reshape(-1, BLOCK * DIM)
            some = np.flatnonzero(blocks.any(1))
            return pa.RecordBatch.from_arrays([pa.array(some), pa.array([blocks[i].tobytes() for i in some], pa.binary())], names=["block", "sums"])

        for _, data, offs in tc.slices(batches, "text", 1 << 19):
            words += context_sums(data, offs, index, sums)
            if words > FULL:
                yield sent()
                sums[:], words = 0, 0
        if words:
            yield sent()

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(raw.as_buffer(), np.int32)
                sums[block] = sums[block] + part if block in sums else part.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "sums"])

    kind = "block bigint, sums binary"
    found = mapped(mapped(docs.select("text"), count, kind).repartition("block"), add, kind).collect()  # FORMS + SHAPES rows of DIM numbers
    sums = np.zeros((FORMS + SHAPES, DIM), np.int64)
    for row in found:
        sums.reshape(-1, BLOCK * DIM)[row.block] = np.frombuffer(row.sums, np.int64)
    return as_vectors(sums)


def fit(texts, labels, seed: int = 4, vectors: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """Adam on the logistic loss over pooled ``vectors`` (by default those of the texts alone).

    The temperature is found on a fifth of the rows that isn't trained on; with fewer than five rows it is 1.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    data, offs = tc.flat(pa.array(list(texts), type=pa.large_string()))
    zero = np.zeros
    if not len(y) or y.min() == y.max():
        return Model(zero((FORMS, DIM), np.float32), zero((SHAPES, DIM), np.float32), zero(2 * DIM + 2), np.ones(2 * DIM + 2), zero((2 * DIM + 2, HIDDEN)), zero(HIDDEN), zero(HIDDEN), 5.0 if len(y) and y[0] else -5.0, 1.0)
    forms, shapes = vectors or context_vectors(data, offs)
    width = 2 * DIM + 2
    model = Model(forms, shapes, zero(width), np.ones(width), rng.normal(0, width**-0.5, (width, HIDDEN)), zero(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), float(np.log(y.mean() / (1 - y.mean()))), 1.0)
    x = np.concatenate([model.pooled(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in tc.cuts(offs, 1 << 19)]).astype(np.float64)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    tune = rng.permutation(len(y)) < len(y) // 5
    train = np.flatnonzero(~tune)
    z = (x - model.mean) / model.scale
    params = [model.w1, model.b1, model.w2]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        for ids in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            step += 1
            h = np.tanh(z[ids] @ model.w1 + model.b1)
            g = (1 / (1 + np.exp(-(h @ model.w2 + model.b2))) - y[ids]) / len(ids)
            back = g[:, None] * model.w2 * (1 - h * h)
            model.b2 -= RATE * float(g.sum())
            for k, (p, d) in enumerate(zip(params, (z[ids].T @ back + 1e-4 * model.w1, back.sum(0), h.T @ g), strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p -= RATE * 0.97**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    logit = model.logits(x[tune])
    grid = np.geomspace(0.25, 8, 31)
    if tune.any():
        model.heat = float(grid[np.argmin([np.logaddexp(0, np.where(y[tune] > 0, -1, 1) * logit / t).mean() for t in grid])])
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Word vectors of all documents; a network fitted on about ``rows`` labelled rows whose crc32(doc_id) mod 4 isn't 2."""
    known = labels.where("quality IS NOT NULL").where(~held_out(4, 2)).select("doc_id", "quality")
    sample = training_sample(known, docs, rows, 4)
    return fit(sample["text"], sample["quality"], vectors=corpus_vectors(docs) if sample["quality"].nunique() > 1 else None)


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7) for every row; null and empty texts are scored as such.

    Repeated rows score alike; labels, lang, source and doc_id are no inputs of the score.
    """

    def score(batches):
        for part, data, offs in tc.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(data, offs).astype(np.float64))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = mapped(docs.select("doc_id", "text"), score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
