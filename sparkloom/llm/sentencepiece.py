"""SentencePiece encoding and decoding: a batched numpy Viterbi over words.

A model file is read directly.  Texts are cut into words (blanks belong to the word behind them, as in the pieces),
distinct words of a slice are encoded once, and words of equal length advance together: for every end position and
piece length the substrings' hashes probe the sorted hashes of the pieces, and vectorised maxima store backpointers.

* Unigram models: a path scores the sum of its pieces' scores.
* BPE models: scores don't add up.  A path is worth 0 if every two neighbours on it stand apart, that is, if merging
  the two alone would leave them as they are, and minus infinity if not.  Merges are local, so the one path worth
  anything is the merge result.  Whether two pieces stand apart follows from the steps in which each is merged: both
  sequences are played, for all pairs at once, against the pieces that would span the cut.

Words are also cut where two characters meet that no piece has side by side, so that texts without blanks don't make
long words.  Refused are normalisers other than identity, USER_DEFINED pieces, and UNUSED ones in BPE models.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textcore as tc
from .common import mapped

#: Where the public tokenizer files lie on every machine; a parameter.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words beyond so many are forgotten; slots for pairs of pieces that are remembered.
WORD_MEMORY, PAIR_SLOTS = 200_000, 1 << 20
#: Words of over CUT characters are looked through for places to cut; edges are made for so many ends at once.
CUT, ENDS = 32, 4096
_MARK = "▁".encode()
_U = np.uint64


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value = number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            value = raw[at : at + size]
            at += size
        yield tag >> 3, value


class Model:
    """Pieces, scores and normaliser flags of a model file; blanks stand for the blank mark in all byte strings."""

    def __init__(self, raw: bytes, steps: tuple | None = None):
        self.raw = raw
        self.bytes: list[bytes] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.bpe, self.fallback, self.unknown = False, False, 0
        self.prefix, self.squeeze = True, True
        name, charsmap = "", b""
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                self.bytes.append(piece.get(1, b"").replace(_MARK, b" "))
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.types.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
                self.bpe, self.fallback = trainer.get(3, 1) == 2, bool(trainer.get(35, 0))
                if trainer.get(3, 1) not in (1, 2):
                    raise ValueError("only unigram and BPE models are supported")
            elif field == 3:
                rules = dict(_fields(value))
                name, charsmap = rules.get(1, b"").decode(), rules.get(2, b"")
                self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        if charsmap:
            raise ValueError(f"normaliser {name} isn't supported, only identity")
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        if USER in self.types:
            raise ValueError("USER_DEFINED pieces aren't supported")
        if self.bpe and UNUSED in self.types:
            raise ValueError("UNUSED pieces of a BPE model aren't supported")
        usable = [i for i, t in enumerate(self.types) if t == NORMAL and self.bytes[i]]
        self.split = not any(b" " in self.bytes[i].lstrip(b" ") for i in usable)
        texts = [self.bytes[i].decode() for i in usable]
        self.longest = max(map(len, texts), default=1)
        self.near = np.unique(hashes(sorted({t[k : k + 2].encode() for t in texts for k in range(len(t) - 1)})))
        # symbols of BPE: pieces, and characters that only occur inside pieces
        symbols = dict(zip(texts, usable, strict=True))
        if self.bpe:
            symbols |= {c: len(self.bytes) + k for k, c in enumerate(sorted({c for t in texts for c in t} - symbols.keys()))}
            self.steps = steps or _steps(symbols, self.scores)
        else:
            self.steps = None
        keys = hashes([t.encode() for t in symbols])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(symbols.values()), np.int64)[order]
        if self.bpe:
            self.reached = np.append(self.steps[4], True)  # the last symbol stands for characters of no piece
            self.pair_key, self.pair_value = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        self.score = np.array(self.scores)
        self.worst = min((self.scores[i] for i in usable), default=0.0) - 10.0
        byte = {int(self.bytes[i][3:5], 16): i for i, t in enumerate(self.types) if t == BYTE}
        self.byte_ids = np.array([byte.get(b, self.unknown) for b in range(256)], np.int64)
        plain = [bytes([int(b[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else b"" if t == CONTROL else b for b, t in zip(self.bytes, self.types, strict=True)]
        self.plain = np.frombuffer(b"".join(plain), np.uint8)
        self.plain_offs = np.concatenate([[0], np.cumsum([len(b) for b in plain])])
        self.entry = np.searchsorted(self.keys >> _U(48), np.arange((1 << 16) + 1, dtype=_U))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys & _U((1 << 20) - 1)).astype(np.int64)] = True
        self.forget()

    def __reduce__(self):
        return (_model, (self.raw, self.steps))

    # -- pieces side by side

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves the symbols (left, right) as they are; pairs met before are remembered."""
        none = len(self.reached) - 1  # characters of no piece
        left, right = np.where(left < 0, none, left), np.where(right < 0, none, right)
        key = left << 32 | right
        slot = (tc.mix(key.view(_U)) & _U(PAIR_SLOTS - 1)).astype(np.int64)
        out = self.pair_value[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            some = new[first]
            value = self._apart(left[some], right[some])
            out[new] = value[back]
            self.pair_key[slot[some]], self.pair_value[slot[some]] = key[some], value
        return out

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Plays both merge sequences in order of score, the left one first among equals, until a pair that spans the
        cut scores more than the left one's next merge and no less than the right one's, or both have ended."""
        pairs, scores, begin, (gain, first, last), _ = self.steps
        i, j = begin[left], begin[right]
        out, live = np.ones(len(left), bool), np.arange(len(left))
        while len(live):
            a, b = i[live], j[live]
            key = last[a] << 32 | first[b]
            at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
            across = np.where(pairs[at] == key, scores[at], -np.inf) if len(pairs) else np.full(len(key), -np.inf)
            joins = (across > gain[a]) & (across >= gain[b])
            out[live[joins]] = False
            ended = np.isneginf(gain[a]) & np.isneginf(gain[b])
            turn = gain[a] >= gain[b]
            i[live[turn]] += 1
            j[live[~turn]] += 1
            live = live[~joins & ~ended]
        return out

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Symbols of substring hashes, -1 where there is none: sorted keys, entered by their first 16 bits."""
        out = np.full(len(keys), -1)
        at = np.flatnonzero(self.filter[(keys & _U((1 << 20) - 1)).astype(np.int64)])
        key = keys[at]
        bucket = (key >> _U(48)).astype(np.int64)
        place, end = self.entry[bucket], self.entry[bucket + 1]
        while len(at):
            inside = place < end
            at, key, place, end = (x[inside] for x in (at, key, place, end)) if not inside.all() else (at, key, place, end)
            hit = self.keys[place] == key
            out[at[hit]] = self.ids[place[hit]]
            at, key, place, end = at[~hit], key[~hit], place[~hit] + 1, end[~hit]
        return out

    # -- words met before

    def forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.word_at, self.word_size, self.word_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def remembered(self, keys: np.ndarray) -> np.ndarray:
        if len(self.slots) > WORD_MEMORY:
            self.forget()
        get = self.slots.get
        return np.array([get(k, -1) for k in keys.tolist()], np.int64)

    def remember(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        have = len(self.slots)
        self.slots.update(zip(keys.tolist(), range(have, have + len(keys)), strict=True))
        self.word_at = np.concatenate([self.word_at, len(self.word_ids) + np.cumsum(size) - size])
        self.word_size, self.word_ids = np.concatenate([self.word_size, size]), np.concatenate([self.word_ids, ids])
        return np.arange(have, have + len(keys))


def _steps(symbols: dict[str, int], scores: list[float]) -> tuple:
    """How BPE merges each symbol's own characters: (pairs, their scores, begin, (gain, first, last), reached).

    ``pairs`` are the sorted pairs of symbols that make a piece.  From ``begin[symbol]`` on lie its states: the score
    of the next merge (minus infinity behind the last), and the first and the last part there are.  A symbol is
    ``reached`` if its characters merge to it.
    """
    made = {}
    for text, i in symbols.items():
        for k in range(1, len(text)):
            if text[:k] in symbols and text[k:] in symbols:
                made[symbols[text[:k]] << 32 | symbols[text[k:]]] = scores[i]
    count = max(symbols.values(), default=-1) + 2  # the last is for characters of no piece
    begin, reached = np.zeros(count, np.int64), np.zeros(count - 1, bool)
    gain, first, last = [-np.inf], [count - 1], [count - 1]
    for text, i in symbols.items():
        begin[i] = len(gain)
        parts = [symbols[c] for c in text]
        at = list(text)
        while True:
            found = [(made[a << 32 | b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a << 32 | b in made]
            best = max(found, default=None)
            gain.append(best[0] if best else -np.inf), first.append(parts[0]), last.append(parts[-1])
            if not best:
                break
            k = -best[1]
            at[k : k + 2] = [at[k] + at[k + 1]]
            parts[k : k + 2] = [symbols[at[k]]]
        reached[i] = len(parts) == 1
    keys = np.array(sorted(made), np.int64)
    return keys, np.array([made[k] for k in keys.tolist()], np.float64), begin, (np.array(gain), np.array(first, np.int64), np.array(last, np.int64)), reached


_loaded: dict[bytes, Model] = {}


def _model(raw: bytes, steps: tuple | None = None) -> Model:
    """A worker process keeps the model, and what it remembers, from task to task."""
    key = hashlib.sha256(raw).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Model(raw, steps)
    return _loaded[key]


def hashes(parts: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts]).astype(np.int64)
    return tc.span_hashes(data, np.concatenate([[0], end[:-1]]).astype(np.int64), end) if parts else np.zeros(0, _U)


class _Hasher:
    """Span hashes of one slice from one prefix sum."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(tc._BYTE[data] * tc._power("up", len(data)), out=self.sums[1:], dtype=_U)
        self.down = tc._power("down", len(data) + 1)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return tc.mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(_U) * _U(0xD6E8FEB86659FD93))


def prepared(model: Model, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with blanks for blank marks, squeezed if the model says so, and the model's leading blank."""
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
    if _MARK in raw:
        texts = [t.replace(_MARK, b" ") for t in texts]
    if model.squeeze:
        texts = [b" ".join(p for p in t.split(b" ") if p) for t in texts]
    if model.prefix:
        texts = [b" " + t if t else t for t in texts]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0]+size[0]-1, begin[1] .. and so on."""
    return np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def viterbi(model: Model, bound: np.ndarray, span: _Hasher) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Best paths of words with equally many characters.  ``bound``: words x (characters + 1), byte positions.

    Returns (word, begin, end) arrays, one per step back from the ends of the words.
    """
    words, n = bound.shape[0], bound.shape[1] - 1
    back, symbol = np.zeros((words, n + 1), np.int64), np.full((words, n + 1), -1)
    best = np.full((words, n + 1), -np.inf)
    best[:, 0] = 0
    for low in range(1, n + 1, ENDS):
        high, found = min(n + 1, low + ENDS), []
        for size in range(1, min(n, model.longest) + 1):
            ends = np.arange(max(low, size), high)
            piece = model.probe(span(bound[:, ends - size].ravel(), bound[:, ends].ravel()))
            hit = np.arange(len(piece)) if size == 1 else np.flatnonzero(piece >= 0)
            found.append((hit // max(1, len(ends)), ends[hit % max(1, len(ends))], np.full(len(hit), size), piece[hit]))
        word, end, size, piece = (np.concatenate([f[i] for f in found]) for i in range(4))
        if model.bpe:
            good = model.reached[piece] | (size == 1)
            word, end, size, piece = (x[good] for x in (word, end, size, piece))
        order = np.argsort(end, kind="stable")
        word, begin, piece = word[order], (end - size)[order], piece[order]
        edge = np.searchsorted(end[order], np.arange(low, high + 1))
        for e in range(low, high):
            rows = slice(edge[e - low], edge[e - low + 1])
            w, s, own = word[rows], begin[rows], piece[rows]
            live = best[w, s] > -np.inf
            w, s, own = w[live], s[live], own[live]
            if model.bpe:
                worth = (s == 0) | model.apart(symbol[w, s], own)
                w, s, own, value = w[worth], s[worth], own[worth], 0.0
            else:
                value = best[w, s] + np.where(own >= 0, model.score[np.maximum(own, 0)], model.worst)
                up = np.argsort(value, kind="stable")  # of several assignments to a word the last, greatest, stays
                w, s, own, value = w[up], s[up], own[up], value[up]
            best[w, e], back[w, e], symbol[w, e] = value, s, own
    path, at, word = [], np.full(words, n), np.arange(words)
    while len(word):
        s = back[word, at]
        path.append((word, bound[word, s], bound[word, at]))
        word, at = word[s > 0], s[s > 0]
    return path


def _cut_words(model: Model, data: np.ndarray, start: np.ndarray, span: _Hasher) -> None:
    """Starts a word wherever, inside long words, two characters meet that no piece has side by side."""
    char = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(char) or char[0]:
        return
    lead = np.flatnonzero(start[char])
    size = np.diff(np.append(lead, len(char)))
    own = np.flatnonzero(size > CUT)
    if not len(own):
        return
    at = ragged(lead[own] + 1, size[own] - 1)  # all characters of long words but the first
    bound = np.append(char, len(data))
    key = span(bound[at - 1], bound[at + 1])
    start[char[at]] |= ~_known(model.near, key)


def _known(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys if len(table) else np.zeros(len(keys), bool)


def _words(model: Model, data: np.ndarray, begin: np.ndarray, end: np.ndarray, span: _Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids) of the words."""
    char = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(char, begin)
    length = np.searchsorted(char, end) - first
    char = np.append(char, len(data))
    word_of, from_of, to_of = [], [], []
    for n in np.unique(length):
        own = np.flatnonzero(length == n)
        bound = char[first[own][:, None] + np.arange(n + 1)]
        bound[:, -1] = end[own]
        for word, a, b in viterbi(model, bound, span):
            word_of.append(own[word]), from_of.append(a), to_of.append(b)
    word, a, b = np.concatenate(word_of), np.concatenate(from_of), np.concatenate(to_of)
    order = np.lexsort((a, word))
    word, a, b = word[order], a[order], b[order]
    piece = model.probe(span(a, b))
    piece[piece >= len(model.bytes)] = -1
    size = np.where(piece >= 0, 1, b - a if model.fallback else 1)
    ids = np.repeat(piece, size)
    if model.fallback:
        miss = piece < 0
        ids[ids < 0] = model.byte_ids[data[ragged(a[miss], (b - a)[miss])]]
    else:
        ids[ids < 0] = model.unknown
    return ids, np.bincount(word, weights=size, minlength=len(begin)).astype(np.int64)


def encode(model: Model, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the texts."""
    data, offs = prepared(model, data, offs)
    texts = len(offs) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)
    start = np.zeros(len(data), bool)
    start[offs[:-1][offs[:-1] < offs[1:]]] = True
    if model.split:
        blank = data == 32
        start[1:] |= blank[1:] & ~blank[:-1]
    span = _Hasher(data)
    _cut_words(model, data, start, span)
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], len(data))
    unique, lead, which = np.unique(span(begin, end), return_index=True, return_inverse=True)
    slot = model.remembered(unique)
    new = np.flatnonzero(slot < 0)
    if len(new):
        slot[new] = model.remember(unique[new], *_words(model, data, begin[lead[new]], end[lead[new]], span))
    at, count = model.word_at[slot], model.word_size[slot]
    out = model.word_ids[ragged(at[which], count[which])]
    out_offs = np.concatenate([[0], np.cumsum(count[which])])[np.searchsorted(begin, offs)]
    if not model.fallback and len(out):  # unknowns in a row are one
        text = np.repeat(np.arange(texts), np.diff(out_offs))
        again = np.zeros(len(out), bool)
        again[1:] = (out[1:] == model.unknown) & (out[:-1] == model.unknown) & (text[1:] == text[:-1])
        out, out_offs = out[~again], np.concatenate([[0], np.cumsum(~again)])[out_offs]
    return out, out_offs


def decode(model: Model, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """Texts of id sequences: pieces joined, without the model's leading blank; broken bytes become U+FFFD."""
    size = np.diff(model.plain_offs)[ids]
    data = model.plain[ragged(model.plain_offs[ids], size)].tobytes() if len(ids) else b""
    ends = np.concatenate([[0], np.cumsum(size)])[offs].tolist()
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        text = data[a:b]
        out.append(text[1:] if model.prefix and text[:1] == b" " else text)
    return [t if t.isascii() else t.decode("utf-8", "replace").encode() for t in out]


def load(path: str = MODEL) -> Model:
    """Reads a model file on the driver; executors get it with the task (half a megabyte)."""
    with open(path, "rb") as f:
        return Model(f.read())


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256, round_trip for every row; ids are decoded again as a check.

    Null and empty texts have no ids.  ``round_trip`` is false only where the text has the blank mark U+2581 itself,
    which SentencePiece reads as a blank, or blanks that the model squeezes.  Repeated rows encode alike.
    """

    def run(batches):
        for part, data, offs in tc.slices(batches, "text"):
            ids, at = encode(model, data, offs)
            texts = decode(model, ids, at)
            raw = data.tobytes()
            same = [raw[a:b] == t for a, b, t in zip(offs[:-1], offs[1:], texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), lists, pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens bigint, ids array<int>, decoded_sha256 string, round_trip boolean")


def decoded(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, text of rows with doc_id, ids; null ids give an empty text."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            sizes = np.array([len(x) for x in lists], np.int64)
            texts = decode(model, np.asarray(lists.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows.select("doc_id", "ids"), run, f"doc_id {kind}, text string")
