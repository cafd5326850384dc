"""Language ID by a string kernel.

The blended-spectrum kernel counts the byte n-grams (n = 1 to 4, hashed) that two texts share, as presence, over the
geometric mean of their numbers.  A Nyström map over landmark texts makes it linear; one-versus-rest kernel ridge
regression then needs one matrix product per batch.

Presence saturates on long texts, so it is taken by blocks: a text is cut into blocks of at most BLOCK bytes, which
hold all its n-grams (each in the block it begins in), and its kernel is the mean of theirs, weighted by letters.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import SAMPLE_LONGEST, held_out, mapped, training_sample

#: Bound of the labelled sample that the model is fitted on, in rows.
SAMPLE_ROWS = 4000
#: They are dealt evenly to the languages; none gets under about so many rows, or all it has.
LANG_ROWS = 50
GRAMS, BUCKETS, LANDMARKS, RIDGE, SHARPNESS = (1, 2, 3, 4), 1 << 13, 96, 1e-3, 12.0
UNKNOWN = "und"
#: Longest block, in bytes, and blocks that are told at once.
BLOCK, TOGETHER = 4096, 512
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def presence(data: np.ndarray, offs: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """0/1 per text and hashed n-gram; n-grams don't cross texts, letters A-Z are lowered.

    Of blocks, ``ends`` has the ends of their texts: n-grams that begin in a block may end behind it.
    """
    texts = len(offs) - 1
    ends = offs[1:] if ends is None else ends
    more = data[offs[-1] : offs[-1] + max(GRAMS) - 1]
    data, size = np.concatenate([data[: offs[-1]], more]), int(offs[-1])
    out = np.zeros((texts, BUCKETS), np.float32)
    if not size:
        return out
    flat = out.reshape(-1)
    b = tc.LOWER[data].astype(np.uint32)
    text = np.repeat(np.arange(texts, dtype=np.int64), np.diff(offs))
    base, left = text * BUCKETS, ends[text] - np.arange(size)
    code = np.zeros(len(data), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if n > len(data):
            break
        code = code[: len(data) - n + 1] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
        if n in GRAMS:
            h = ((code[:size] * np.uint32(2654435761 + 2 * n)) >> np.uint32(32 - 13)).astype(np.int64)
            ok = left[: len(h)] >= n
            flat[(base[: len(h)] + h)[ok]] = 1
    return out


def blocks(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, first): blocks of about equal size that tile all texts, and the first block of each; an empty text has one."""
    size = np.diff(offs)
    n = np.maximum(-(-size // BLOCK), 1)
    first = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(size)), n)
    return np.append(offs[:-1][text] + (np.arange(len(text)) - first[text]) * size[text] // n[text], offs[-1]), first


@dataclass
class Model:
    names: list
    landmarks: np.ndarray  # presence, BUCKETS x LANDMARKS, over the root of their sums
    weights: np.ndarray
    offset: np.ndarray

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.landmarks) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    def kernels(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The kernel of every text: the mean over all its blocks, weighted by their letters."""
        edges, first = blocks(offs)
        text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        out, total = np.zeros((len(offs) - 1, self.landmarks.shape[1])), np.zeros(len(offs) - 1)
        for a in range(0, len(text), TOGETHER):
            b = min(len(text), a + TOGETHER)
            part, at = data[edges[a] : edges[b] + max(GRAMS) - 1], edges[a : b + 1] - edges[a]
            k = self.kernel(presence(part, at, offs[1:][text[a:b]] - edges[a]))
            letters = np.concatenate([[0], np.cumsum(_LETTER[part] | (part >= 128))])
            weight = letters[at[1:]] - letters[at[:-1]] + 1e-6
            np.add.at(out, text[a:b], k * weight[:, None])
            np.add.at(total, text[a:b], weight)
        return out / np.maximum(total, 1e-9)[:, None]

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = SHARPNESS * (self.kernels(data, offs) @ self.weights + self.offset)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(texts, langs, seed: int = 9) -> Model:
    """Landmarks, first blocks of texts, are dealt evenly to the languages; targets are +1 and -1, every language weighs the same."""
    names = sorted(set(langs))
    if not names:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 1)), np.zeros(1))
    rng = np.random.default_rng(seed)
    data, offs = tc.flat(pa.array(list(texts), type=pa.large_string()))
    y = np.array([names.index(x) for x in langs])
    each = max(1, LANDMARKS // len(names))
    marks = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:each] for k in range(len(names))])
    model = Model(names, np.zeros(0), np.zeros(0), np.zeros(len(names)))
    edges, first = blocks(offs)
    own = np.concatenate([presence(data[edges[i] : edges[i + 1]], np.array([0, edges[i + 1] - edges[i]])) for i in first[marks]])
    model.landmarks = (own / np.sqrt(np.maximum(own.sum(1, keepdims=True), 1))).T.copy()
    value, vector = np.linalg.eigh(model.kernel(own).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = model.kernels(data, offs) @ root
    weight = 1 / np.bincount(y, minlength=len(names))[y]
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    mean, centre = (weight / weight.sum()) @ phi, (weight / weight.sum()) @ target
    left = (phi - mean).T * (weight / weight.sum())
    beta = np.linalg.solve(left @ (phi - mean) + RIDGE * np.eye(phi.shape[1]), left @ (target - centre))
    model.weights, model.offset = root @ beta, centre - mean @ beta
    return model


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """True for texts with a letter of any script."""
    sums = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = sums[offs[1:]] > sums[offs[:-1]]
    for i in np.flatnonzero(~out & (offs[1:] > offs[:-1])):
        out[i] = any(unicodedata.category(c)[0] == "L" for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most about ``rows`` documents with a lang whose crc32(doc_id) mod 4 isn't 2.

    Every lang of such documents is learned, however rare; of texts over SAMPLE_LONGEST the beginning is fitted on.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(4, 2)).select("doc_id", "lang")
    texts = docs.select("doc_id", F.substring("text", 1, SAMPLE_LONGEST).alias("text"))
    sample = training_sample(known, texts, rows, 9, "lang", LANG_ROWS)
    return fit(sample["text"], sample["lang"])


def language_id(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if no language was learned.
    Repeated rows are told alike; lang, source and doc_id are no inputs of a prediction.
    """

    def tell(batches):
        names = np.array(model.names, dtype=object)
        for part, data, offs in tc.slices(batches, "text", 1 << 20):
            for a in range(0, part.num_rows, 512):
                rows = part.slice(a, 512)
                own, to = data[offs[a] : offs[a + rows.num_rows]], offs[a : a + rows.num_rows + 1] - offs[a]
                s = model.scores(own, to)
                known = has_letter(own, to) & (len(model.weights) > 1)
                top = s.argmax(1)
                lang = np.where(known, names[top], UNKNOWN)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lang.tolist(), pa.string()), pa.array(np.where(known, s[np.arange(len(s)), top], 0.0))], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    told = mapped(docs.select("doc_id", "text"), tell, f"doc_id {kind}, lang_pred string, score double")
    return told.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


