"""Toxicity: a convolutional text classifier in numpy.

Hashed embeddings of words and of their first bytes, filters of several widths, max pooling over the whole text,
one logistic output.  Thresholds are calibrated by language, the language being told from the text's own bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textcore as tc
from .common import held_out, mapped, training_sample

#: Bound of the labelled sample that the model is fitted on, in rows.
SAMPLE_ROWS = 6000
WORDS, PREFIXES, DIM = 1 << 15, 1 << 13, 16
WIDTHS, FILTERS, PREFIX_BYTES = (1, 2, 4, 8), 8, 5
EPOCHS, BATCH, RATE, DECAY = 14, 64, 0.01, 1e-5
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,!?;:\"')|#*$%&")] = True
_SPAN = sum(WIDTHS)
#: Words, and places behind texts, that are pooled at once.
ROWS = 1 << 16


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, prefix bucket, first) of all words, lower-cased, without closing marks."""
    data = tc.LOWER[data]
    start, end, first = tc.words(data, offs)
    for _ in range(3):
        end = end - ((end - start > 1) & _STOPS[data[end - 1]])
    word = tc.span_hashes(data, start, end) % np.uint64(WORDS)
    prefix = tc.span_hashes(data, start, np.minimum(end, start + PREFIX_BYTES)) % np.uint64(PREFIXES)
    return word.astype(np.int32), prefix.astype(np.int32), first


def byte_shares(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    counts = np.bincount(text * 256 + tc.LOWER[data], minlength=256 * (len(offs) - 1)).reshape(-1, 256).astype(np.float32)
    counts[:, 32] = 0
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


@dataclass
class Model:
    words: np.ndarray
    prefixes: np.ndarray
    filters: np.ndarray  # DIM x (_SPAN * FILTERS), offset after offset, width after width
    bias: np.ndarray
    out: np.ndarray
    const: float
    langs: np.ndarray  # byte profiles of the languages
    cuts: np.ndarray  # logit threshold of each language
    heat: float

    def pooled(self, word, prefix, first, places: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Per text and filter: the maximum, and with ``places`` the word where it is (-1: the text has no words)."""
        texts, k, gap = len(first) - 1, FILTERS, max(WIDTHS) - 1
        top = np.zeros((texts, len(WIDTHS) * k), self.words.dtype)
        where = np.full((texts, len(WIDTHS) * k), -1, np.int64)
        full = np.flatnonzero(np.diff(first))
        rows = np.cumsum(np.diff(first)[full] + gap)
        for a, b in tc.cuts(np.concatenate([[0], rows]), ROWS):
            own = full[a:b]
            size = np.diff(first)[own]
            words = np.arange(first[own[0]], first[own[-1] + 1])
            text = np.repeat(np.arange(len(own)), size)
            at = np.arange(len(words)) + gap * text
            x = np.zeros((len(words) + gap * len(own), DIM), self.words.dtype)  # windows at the end run into zeros
            x[at] = self.words[word[words]] + self.prefixes[prefix[words]]
            n = len(x) - gap
            begin = at[first[own] - words[0]]
            edges = np.stack([begin, begin + size], 1).ravel()[:-1]  # the last text ends where all do
            y, col = x @ self.filters, 0
            for i, width in enumerate(WIDTHS):
                z = y[:n, col : col + k].copy()
                for j in range(1, width):
                    z += y[j : n + j, col + j * k : col + (j + 1) * k]
                col += width * k
                best = np.maximum.reduceat(z, edges, axis=0)[::2]
                top[own, i * k : (i + 1) * k] = best
                if places:
                    f, hit = np.nonzero((z[at] == np.repeat(best, size, axis=0)).T)
                    where[own[text[hit[::-1]]], i * k + f[::-1]] = words[hit[::-1]]  # the first of equal maxima
        return top, where

    def logits(self, word, prefix, first) -> np.ndarray:
        top, _ = self.pooled(word, prefix, first, False)
        return np.maximum(top + self.bias, 0) @ self.out + self.const

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        logit = self.logits(*tokens(data, offs))
        lang = (byte_shares(data, offs) @ self.langs.T).argmax(1)
        return 1 / (1 + np.exp(-np.clip((logit - self.cuts[lang]) / self.heat, -30, 30)))


def _join(texts) -> tuple[np.ndarray, np.ndarray]:
    return tc.flat(pa.array(list(texts), type=pa.large_string()))


def start(rng: np.random.Generator) -> Model:
    """A model with small random weights, one language and no threshold."""
    cols = _SPAN * FILTERS
    return Model(
        rng.normal(0, 0.03, (WORDS, DIM)).astype(np.float32), rng.normal(0, 0.03, (PREFIXES, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, cols)).astype(np.float32),
        np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0, np.ones((1, 256), np.float32), np.zeros(1), 1.0,
    )


def gradients(model: Model, w: np.ndarray, p: np.ndarray, f: np.ndarray, y: np.ndarray, weight: np.ndarray, keep: np.ndarray) -> dict[str, np.ndarray | float]:
    """Of the weighted mean logistic loss of texts (words, prefixes, first of each); maxima pass theirs to the words
    where they are.  ``keep`` scales every text's filters (dropout)."""
    top, where = model.pooled(w, p, f)
    hidden = np.maximum(top + model.bias, 0)
    slope = (1 / (1 + np.exp(-((hidden * keep) @ model.out + model.const))) - y) * weight / len(y)
    d_top = slope[:, None] * model.out * keep * (top + model.bias > 0)
    d_x, d_filters = np.zeros((len(w), DIM), model.words.dtype), np.zeros_like(model.filters)
    x, end, col = model.words[w] + model.prefixes[p], np.repeat(f[1:], FILTERS), 0
    for i, width in enumerate(WIDTHS):
        at, g = where[:, i * FILTERS : (i + 1) * FILTERS].ravel(), d_top[:, i * FILTERS : (i + 1) * FILTERS].ravel()
        which = np.tile(np.arange(FILTERS), len(y))
        for j in range(width):
            ok = (at >= 0) & (at + j < end)
            c = col + j * FILTERS + which[ok]
            np.add.at(d_x, at[ok] + j, g[ok, None] * model.filters[:, c].T)
            np.add.at(d_filters.T, c, g[ok, None] * x[at[ok] + j])
        col += width * FILTERS
    d_words, d_prefixes = np.zeros_like(model.words), np.zeros_like(model.prefixes)
    hot = np.flatnonzero(np.abs(d_x).sum(1))
    np.add.at(d_words, w[hot], d_x[hot])
    np.add.at(d_prefixes, p[hot], d_x[hot])
    return {"words": d_words, "prefixes": d_prefixes, "filters": d_filters, "bias": d_top.sum(0), "out": (hidden * keep).T @ slope, "const": float(slope.sum())}


def fit(texts, labels, langs, seed: int = 5) -> Model:
    """Adam on the logistic loss; maxima pass their gradient to the words where they are.

    A fifth of the rows isn't trained on: there the threshold of each language and the temperature are found.
    Without both labels the model scores everything as the one label there is (0 without any); with fewer than five
    rows there is no fifth, the thresholds are 0 and the temperature is 1.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    model = start(rng)
    if not len(y) or y.min() == y.max():
        model.out[:], model.const = 0, 5.0 if len(y) and y[0] else -5.0
        return model
    data, offs = _join(texts)
    runs = [tokens(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in tc.cuts(offs, 1 << 19)]
    word, prefix = (np.concatenate([r[k] for r in runs]) for k in (0, 1))
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(r[2]) for r in runs]))])
    tune = rng.permutation(len(y)) < len(y) // 5
    train = np.flatnonzero(~tune & (np.diff(first) > 0))
    weight = np.where(y > 0, min(8.0, (y == 0).sum() / (y > 0).sum()) ** 0.5, 1.0).astype(np.float32)
    names = ("words", "prefixes", "filters", "bias", "out")
    params = {name: getattr(model, name) for name in names}
    first_moment, second_moment = ({name: np.zeros_like(v) for name, v in params.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        for ids in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            step += 1
            spans = [np.arange(first[i], first[i + 1]) for i in ids]
            w, p = (a[np.concatenate(spans)] for a in (word, prefix))
            f = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
            keep = (rng.random((len(ids), len(WIDTHS) * FILTERS)) < 0.8).astype(np.float32) / 0.8
            grads = gradients(model, w, p, f, y[ids], weight[ids], keep)
            model.const -= RATE * grads["const"]
            for name, value in params.items():
                grad, m, v = grads[name], first_moment[name], second_moment[name]
                at = np.flatnonzero(np.abs(grad).sum(1)) if name in ("words", "prefixes") else slice(None)  # of the embeddings only touched rows move
                g = grad[at] + DECAY * value[at]
                m[at] = 0.9 * m[at] + 0.1 * g
                v[at] = 0.999 * v[at] + 0.001 * g * g
                value[at] -= RATE * (0.93**epoch) * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.999**step)) + 1e-8)
    logit = np.concatenate([model.logits(word[first[a] : first[b]], prefix[first[a] : first[b]], first[a : b + 1] - first[a]) for a, b in tc.cuts(offs, 1 << 19)])
    names = np.array([x if isinstance(x, str) else "" for x in langs])
    shares = np.concatenate([byte_shares(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in tc.cuts(offs, 1 << 19)])
    profiles = np.array([shares[names == x].mean(0) for x in np.unique(names)])
    model.langs = (profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    told = (shares @ model.langs.T).argmax(1)
    model.cuts = np.array([_cut(logit[tune & (told == k)], y[tune & (told == k)]) for k in range(len(profiles))])
    shifted = logit - model.cuts[told]
    grid = np.geomspace(0.25, 4, 17)
    if tune.any():
        model.heat = float(grid[int(np.argmin([np.logaddexp(0, np.where(y[tune] > 0, -1, 1) * shifted[tune] / h).mean() for h in grid]))])
    return model


def _cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the fewest errors, in the middle of its gap and pulled to 0; 0 without both labels."""
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(logit)
    z, t = logit[order], y[order]
    errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum(1 - t[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    best = edges[errors <= errors.min()]
    return float(best[np.abs(best).argmin()])


def _scored(rows: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``rows`` with their score as one more column; ``text`` among them."""

    def score(batches):
        for part, data, offs in tc.slices(batches, "text", 1 << 19):
            s = pa.array(model.scores(data, offs).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*part.columns, s], names=[*part.schema.names, name])

    return mapped(rows, score, StructType([*rows.schema.fields, StructField(name, DoubleType())]))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    name = next(n for n in (f"score{i or ''}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    return _scored(docs, model, name).where(F.col(name) < 0.5).select(docs.columns)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most about ``rows`` labelled rows whose crc32(doc_id) mod 5 isn't 0."""
    known = labels.where("toxic IS NOT NULL").where(~held_out(5, 0)).select("doc_id", "toxic")
    sample = training_sample(known, docs, rows, 5, more=("lang",))
    return fit(sample["text"], sample["toxic"], sample["lang"])


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts get the score of no words.

    Repeated rows score alike.  Labels, lang, source and doc_id are no inputs of the score.
    """
    scored = _scored(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
