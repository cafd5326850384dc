"""Quality rules by distribution divergence.

Every document has a histogram of character classes and one of common words (counted by hash); both are compared with
references of each language, counted over the whole corpus, by Jensen-Shannon distance (base 2, 0 to 1).  A document
is judged by the reference it is nearest to.  Nothing vouches for itself: a document's own counts are left out of its
language's reference, rows without lang make no reference, and neither does a lang of few documents or words.  Short
documents have noisy histograms and are only judged by the base rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .common import mapped
from .quality_model import repeated

#: Guards: below so many words a histogram isn't judged.
MIN_WORDS_CHARS, MIN_WORDS_COMMON = 30, 60
#: A document of n words is dropped above either distance: a + b / sqrt(n), as the noise of a histogram shrinks.
MAX_CHARS, MAX_COMMON = (0.22, 0.6), (0.36, 0.75)
#: A lang with fewer documents with words, or fewer words, makes no reference.
REF_DOCS, REF_WORDS = 20, 2_000
#: Base rules.
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
#: Words are counted by hash in so many buckets; the common words of a language are its top buckets.
BUCKETS, COMMON = 1 << 14, 64

#: Lower, upper, digits, marks, sentence ends, symbols, others; then scripts by the first byte of a character: Latin
#: with marks; Greek and Cyrillic; other two-byte ones; Indic and Thai; typographic marks; CJK; Hangul; others.
CLASSES = 16
_CLASS = np.full(256, 0, np.int64)  # other marks and controls
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[list(b".,;:'\"-()")], _CLASS[list(b"!?")], _CLASS[list(b"#*$%&|<>")] = 4, 5, 6
_CLASS[0xC0:0xCA], _CLASS[0xCA:0xD4], _CLASS[0xD4:0xE0] = 7, 8, 9
_CLASS[0xE0:0xE2], _CLASS[0xE2], _CLASS[0xE3:0xEA], _CLASS[0xEA:0xEE], _CLASS[0xEE:] = 10, 11, 12, 13, 14
_CLASS[128:192] = 15  # other bytes of a character: not counted
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return sums[offs[1:]] - sums[offs[:-1]]


def duplicate_lines(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per text: lines (split at \\n) with a word that equal an earlier line of the text."""
    cut = np.unique(np.concatenate([offs[:-1], np.flatnonzero(data == 10) + 1]))
    cut = cut[cut < len(data)]
    end = np.append(cut[1:], len(data))
    end = end - ((end > cut) & (data[end - 1] == 10))
    text = np.searchsorted(offs, cut, "right") - 1
    ink = np.concatenate([[0], np.cumsum(~tc.SPACE[data])])
    full = ink[end] > ink[cut]
    cut, end, text = cut[full], end[full], text[full]
    h = tc.span_hashes(data, cut, end)
    order = np.lexsort((h, text))
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text[order][1:][same], minlength=len(offs) - 1)


def base_counts(data: np.ndarray, offs: np.ndarray, words=None) -> dict[str, np.ndarray]:
    start, end, first = words or tc.words(data, offs)
    again = repeated(tc.span_hashes(data, start, end), first, WINDOW)
    return {
        "n_words": np.diff(first),
        "word_chars": _per_text(~tc.SPACE[data] & ((data & 0xC0) != 0x80), offs),
        "n_symbols": _per_text(_SYMBOL[data], offs),
        "n_dup_lines": duplicate_lines(data, offs),
        "n_repeat_words": _per_text(again, first),
    }


def _class_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    ink = ~tc.SPACE[data] & (data & 0xC0 != 0x80)
    return np.bincount(text[ink] * CLASSES + _CLASS[data[ink]], minlength=CLASSES * (len(offs) - 1)).reshape(-1, CLASSES)


def _word_buckets(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    low = tc.LOWER[data]
    stop = np.zeros(256, bool)
    stop[list(b".,;:!?")] = True
    end = end - ((end - start > 1) & stop[data[end - 1]])
    return (tc.span_hashes(low, start, end) % np.uint64(BUCKETS)).astype(np.int64)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of the rows of ``p`` (texts) and of ``q`` (references): texts x references."""
    return np.stack([_row_distance(p, ref[None]) for ref in q], 1)


def _row_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` to the same row of ``q``, or to its only one."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def references(docs: DataFrame) -> dict:
    """Counts of each lang over all documents: {"langs": L, "chars": L x CLASSES, "buckets": L x COMMON, "common": L x (COMMON+1)}.

    The last of ``common`` counts all other words.  Langs of under REF_DOCS documents or REF_WORDS words aren't among
    them, nor is null.  Every task sends one count vector per lang.
    """
    rows = CLASSES + BUCKETS  # the last place counts documents

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for part, data, offs in tc.slices(batches, "text"):
            start, end, first = tc.words(data, offs)
            text = np.repeat(np.arange(part.num_rows), np.diff(first))
            chars, bucket = _class_counts(data, offs), _word_buckets(data, start, end)
            langs = np.array(part.column(0).to_pylist(), dtype=object)
            for lang in set(langs):
                own = langs == lang
                sums = totals.setdefault(lang, np.zeros(rows + 1, np.int64))
                sums[:CLASSES] += chars[own].sum(0)
                sums[CLASSES:rows] += np.bincount(bucket[own[text]], minlength=BUCKETS)
                sums[rows] += (np.diff(first)[own] > 0).sum()
        for lang, sums in totals.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang], pa.string()), "at": pa.array([at.tolist()], pa.list_(pa.int32())), "n": pa.array([sums[at].tolist()], pa.list_(pa.int64()))})

    sent = mapped(docs.where("lang IS NOT NULL").select("lang", "text"), count, "lang string, at array<int>, n array<bigint>")
    sums = sent.select("lang", F.explode(F.arrays_zip("at", "n")).alias("x")).groupBy("lang", F.col("x.at").alias("at")).agg(F.sum("x.n").alias("n"))
    word = F.col("at").between(CLASSES, rows - 1)
    own, rank = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy(word, F.desc("n"), "at")  # rows + 1 a lang at most
    sums = sums.withColumns({"r": F.row_number().over(rank), "total": F.sum(F.when(word, F.col("n"))).over(own), "docs": F.sum(F.when(F.col("at") == rows, F.col("n"))).over(own)})
    found = sums.where((F.col("docs") >= REF_DOCS) & (F.col("total") >= REF_WORDS) & (F.col("r") <= CLASSES + 1 + COMMON)).toPandas()  # a few dozen rows a lang
    langs = sorted(set(found["lang"]))
    out = {"langs": langs, "chars": np.zeros((len(langs), CLASSES)), "buckets": np.full((len(langs), COMMON), -1, np.int64), "common": np.zeros((len(langs), COMMON + 1))}
    for k, lang in enumerate(langs):
        mine = found[found["lang"] == lang]
        chars = mine[mine["at"] < CLASSES]
        top = mine[mine["at"].between(CLASSES, rows - 1)].sort_values(["n", "at"], ascending=[False, True]).head(COMMON)
        out["chars"][k, chars["at"]] = chars["n"]
        out["buckets"][k, : len(top)] = top["at"] - CLASSES
        out["common"][k, : len(top)] = top["n"]
        out["common"][k, COMMON] = mine["total"].max() - top["n"].sum()
    return out


def distances(data: np.ndarray, offs: np.ndarray, words, refs: dict, lang: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each text to its nearest reference: distance of character classes, distance of common words.

    ``lang`` has the reference that each text is counted in (-1: none): there its own counts are left out.
    """
    start, end, first = words
    texts, n = len(offs) - 1, len(refs["chars"])
    if not n:
        return np.zeros(texts), np.zeros(texts)
    lang = np.full(texts, -1) if lang is None else lang
    share = lambda x: x / np.maximum(x.sum(1, keepdims=True), 1)
    chars = _class_counts(data, offs)
    bucket, text = _word_buckets(data, start, end), np.repeat(np.arange(texts), np.diff(first))
    d_chars, d_words = np.zeros((texts, n)), np.zeros((texts, n))
    for k, top in enumerate(refs["buckets"]):
        own = (lang == k)[:, None]
        place = np.full(BUCKETS, COMMON)
        place[top[top >= 0]] = np.flatnonzero(top >= 0)
        common = np.bincount(text * (COMMON + 1) + place[bucket], minlength=texts * (COMMON + 1)).reshape(texts, -1)
        for counts, ref, out in ((chars, refs["chars"][k], d_chars), (common, refs["common"][k], d_words)):
            out[:, k] = _row_distance(share(counts), share(np.maximum(ref - counts * own, 0)))
    best = (d_chars + d_words).argmin(1)
    return d_chars[np.arange(texts), best], d_words[np.arange(texts), best]


def quality_rules(docs: DataFrame, refs: dict | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, js_chars, js_words for every row.

    Null and empty texts have no words and fail.  Repeated rows are judged alike; extra columns are ignored.  Where no
    lang has enough documents to make a reference, the base rules alone decide; a null lang, or one without a
    reference, is judged by those of the others.  ``refs`` made from other documents count none of these.
    """
    counted = refs is None
    refs = references(docs.select("lang", "text")) if refs is None else refs
    place = {lang: k for k, lang in enumerate(refs["langs"])} if counted else {}

    def judge(batches):
        for part, data, offs in tc.slices(batches, "text", 1 << 20):
            words = tc.words(data, offs)
            c = base_counts(data, offs, words)
            n = c["n_words"]
            failed = (n < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED_PERCENT * n)
            lang = np.array([place.get(x, -1) for x in part.column(2).to_pylist()], np.int64)
            chars, common = distances(data, offs, words, refs, lang)
            noise = 1 / np.sqrt(np.maximum(n, 1))
            far = ((n >= MIN_WORDS_CHARS) & (chars > MAX_CHARS[0] + MAX_CHARS[1] * noise)) | ((n >= MIN_WORDS_COMMON) & (common > MAX_COMMON[0] + MAX_COMMON[1] * noise))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, pa.int64()) for v in c.values()), pa.array(failed), pa.array(~failed & ~far), pa.array(chars), pa.array(common)], names=["doc_id", *c, "base_failed", "kept", "js_chars", "js_words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return mapped(docs.select("doc_id", "text", "lang"), judge, f"doc_id {kind}, {counts}, base_failed boolean, kept boolean, js_chars double, js_words double")
