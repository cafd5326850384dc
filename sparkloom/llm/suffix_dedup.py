"""Removal of repeated substrings by a sparse, distributed suffix sort.

Every string of ``length`` bytes contains one anchor: its k-gram of least hash (the first of equals), chosen from its
content alone, so equal strings have their anchors at the same place.  Only suffixes that begin at anchors are
sorted; strings with one anchor position form a segment, the text around it.

* Sample: slices of the corpus show which k-grams anchor more segments than one merge task should hold.  Strings with
  such a hot anchor are anchored by a longer k-gram of theirs, and where that is hot too by themselves.  The list of
  hot k-grams only decides how work is dealt: whatever it holds, equal strings go to one place.
* Map: each run of text yields its segments, sorted by the suffix at the anchor, dealt by the anchor's k-gram and
  front-coded.  A segment that the run itself holds twice is known to be repeated and is sent once, without places.
* Exchange: the compressed front-coded runs.
* Reduce: a loser tree merges the runs.  It keeps the length of the common prefix with the last output for every
  head, compares bytes only beyond it, and delivers the LCP array of the merged order.  With the LCP array of the
  text before the anchors, sorted the same way, two strings are equal if both their parts lie in the same LCP classes.

All comparisons of text are of bytes; hashes choose anchors, deal out work, and name rows (96 bits of doc_id and text).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import mapped, partition_key
from .linking import groups

LENGTH, GRAM = 200, 16
#: Text bytes behind one sorted run, and behind one merge; segments of a run at most.
RUN_BYTES, PART_BYTES, RUN_SEGMENTS = 8 << 20, 6 << 20, 1 << 17
#: Merges of one partition, one after the other: the pieces of a run that are exchanged are this much longer.
MERGES = 6
#: Long texts are read in pieces of so many starts; so many segments are worked on at once.
PIECE, CHUNK = 4 << 20, 1 << 16
#: One slice in so many is sampled for hot k-grams, and so many of these are listed at most, about.
SAMPLE, HOT = 32, 1 << 20
_U = np.uint64
_PLACE = (1 << 31) - 1


def grams(length: int, gram: int) -> tuple[int, int, int]:
    """Lengths of the k-grams that anchor strings: the usual one, the one for hot anchors, the string itself."""
    return gram, (gram + length) // 2, length


def _anchor_of(data: np.ndarray, start: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, hash of its k-gram) of the strings at ``start``."""
    n, span = len(data), length - gram + 1
    at = np.arange(n - gram + 1)
    gram_hash = tc.span_hashes(data, at, at + gram)
    m = (gram_hash & ~_U(_PLACE)) | at.astype(_U)
    wide = 1
    while wide * 2 <= span:
        m = np.minimum(m[:-wide], m[wide:])
        wide *= 2
    if span > wide:
        m = np.minimum(m[: len(m) - (span - wide)], m[span - wide :])
    anchor = (m[start] & _U(_PLACE)).astype(np.int64)
    return anchor, gram_hash[anchor]


def _starts(offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of all strings of ``length`` bytes."""
    count = np.maximum(np.diff(offs) - length + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    return text, offs[:-1][text] + np.arange(len(text)) - (np.cumsum(count) - count)[text]


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int, hot: tuple = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first start, last start, hash of the anchor's k-gram) of all segments.

    ``hot[k]`` has the sorted hashes of k-grams of :func:`grams` that are too frequent; their strings move on.
    """
    text, start = _starts(offs, length)
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none, none, none, np.zeros(0, _U)
    anchor, key = _anchor_of(data, start, length, gram)
    level = np.zeros(len(start), np.int8)
    todo = np.arange(len(start))
    for k, often in enumerate(hot):
        todo = todo[_among(key[todo], often)]
        if not len(todo):
            break
        anchor[todo], key[todo] = _anchor_of(data, start[todo], length, grams(length, gram)[k + 1])
        level[todo] = k + 1
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (level[1:] != level[:-1])
    lead = np.flatnonzero(new)
    last = np.append(lead[1:], len(start)) - 1
    return text[lead], anchor[lead], start[lead], start[last], key[lead]


def _among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether keys are in the sorted table."""
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """(rows, bytes, offsets, place of the first byte): slices of texts; pieces of a long one share length - 1 bytes."""
    for rows, data, offs in tc.slices(batches, "text"):
        if len(data) <= PIECE + length:
            yield rows, data, offs, 0
            continue
        for a in range(0, len(data) - length + 1, PIECE):  # one text
            part = data[a : a + PIECE + length - 1]
            yield rows, part, np.array([0, len(part)]), a


def _counted(length: int, gram: int):
    """(level, key, n): how often k-grams anchor segments of sampled slices, on either level."""

    def run(batches):
        for _, data, offs, _ in _pieces(batches, length):
            if zlib.crc32(data) % SAMPLE:
                continue
            text, start = _starts(offs, length)
            if not len(start):
                continue
            for level, size in enumerate(grams(length, gram)[:-1]):
                anchor, key = _anchor_of(data, start, length, size)
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                key, n = np.unique(key[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), level, np.int32)), pa.array(key.view(np.int64)), pa.array(n)], names=["level", "key", "n"])

    return run


def hot_grams(texts: DataFrame, length: int, gram: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-grams, by level, that anchor more segments than a merge partition holds, by the sampled slices.

    Their number is bounded: at HOT such k-grams of the whole corpus the limit rises.
    """
    segments = (length - gram) // 2 + 1  # bytes of text for a segment
    limit = max(PART_BYTES // segments, total // segments // HOT)
    counted = mapped(texts.select("text"), _counted(length, gram), "level int, key bigint, n bigint")
    found = counted.groupBy("level", "key").agg(F.sum("n").alias("n")).where(F.col("n") * SAMPLE > limit).toPandas()
    return tuple(np.sort(found.loc[found["level"] == k, "key"].to_numpy(np.int64).view(_U)) for k in (0, 1))


def _rows(data: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Zero-padded rows of ``size`` bytes from ``at``, forwards or backwards."""
    cols = np.arange(width)
    out = data[np.clip(at[:, None] + step * cols, 0, len(data) - 1)]
    out[cols >= size[:, None]] = 0
    return out


def _sorted(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lexicographic order of padded rows, and the common prefix of each row, in that order, with the one before."""
    by_size = np.argsort(size, kind="stable")
    keys = np.ascontiguousarray(rows[by_size]).view(f"S{rows.shape[1]}").ravel()
    order = by_size[np.argsort(keys, kind="stable")]
    return order, _lcps(rows, size, order)


def _lcps(rows: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    lcp = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 16):
        b = min(len(order), a + (1 << 16))
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        lcp[a:b] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    lcp[1:] = np.minimum(lcp[1:], np.minimum(size[order][1:], size[order][:-1]))
    return lcp


def _pack(right, right_size, left, left_size, known, rk, rk2, place, order, counts) -> bytes:
    """A front-coded run, zstd-compressed: lengths and common prefixes, owners, then the bytes that are new.

    ``counts`` has the rows of each merge, which are coded apart.
    """
    r_lcp, l_lcp = _lcps(right, right_size, order), _lcps(left, left_size, order)
    first = np.cumsum(counts)[:-1]
    first = first[first < len(order)]
    r_lcp[first] = l_lcp[first] = 0
    cols = np.arange(right.shape[1])
    r_tail = right[order][(cols >= r_lcp[:, None]) & (cols < right_size[order][:, None])]
    cols = np.arange(left.shape[1])
    l_tail = left[order][(cols >= l_lcp[:, None]) & (cols < left_size[order][:, None])]
    parts = [np.array([len(order), len(counts), *counts], np.int64), rk[order], place[order], rk2[order], *(x.astype(np.uint16) for x in (r_lcp, right_size[order], l_lcp, left_size[order], known[order])), r_tail, l_tail]
    raw = b"".join(x.tobytes() for x in parts)
    return len(raw).to_bytes(8, "big") + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _unpack(run: bytes, merge: int) -> tuple:
    """The rows of one merge."""
    raw = pa.decompress(run[8:], decompressed_size=int.from_bytes(run[:8], "big"), codec="zstd", asbytes=True)
    n, merges = np.frombuffer(raw, np.int64, 2).tolist()
    counts = np.frombuffer(raw, np.int64, merges, 16)
    own, at = slice(counts[:merge].sum(), counts[: merge + 1].sum()), 16 + 8 * merges
    rk, place = np.frombuffer(raw, np.int64, 2 * n, at).reshape(2, n)
    rk2 = np.frombuffer(raw, np.int32, n, at + 16 * n)
    r_lcp, r_size, l_lcp, l_size, known = np.frombuffer(raw, np.uint16, 5 * n, at + 20 * n).reshape(5, n)
    at += 30 * n
    new = [(size.astype(np.int64) - lcp) for size, lcp in ((r_size, r_lcp), (l_size, l_lcp))]
    rights = _decode(raw, at + new[0][: own.start].sum(), r_lcp[own].tolist(), r_size[own].tolist())
    lefts = _decode(raw, at + new[0].sum() + new[1][: own.start].sum(), l_lcp[own].tolist(), l_size[own].tolist())
    return r_lcp[own].tolist(), rights, lefts, rk[own], rk2[own], place[own], known[own]


def _decode(raw: bytes, at: int, lcps: list[int], sizes: list[int]) -> list[bytes]:
    at, out, last = int(at), [], b""
    for lcp, size in zip(lcps, sizes, strict=True):
        last = last[:lcp] + raw[at : at + size - lcp]
        at += size - lcp
        out.append(last)
    return out


def _common(x: bytes, y: bytes, at: int) -> int:
    n = min(len(x), len(y))
    p, q = x[at:n], y[at:n]
    if p == q:
        return n
    return n - ((int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_length() + 7) // 8


def merged(runs: list[tuple[list[int], list[bytes]]]) -> tuple[list[int], list[int], list[int]]:
    """LCP-aware loser tree over sorted runs of (common prefixes, strings): (run, index, LCP with the one before).

    The head of each run carries its common prefix with the last output.  Of two heads the one with the longer is
    the smaller, without a look at its bytes; equal ones are compared beyond it only.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    heads = [r[1][0] if r[1] else None for r in runs] + [None] * (k - len(runs))
    known = [0 if h is not None else -1 for h in heads]
    index = [0] * k
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:  # (winner, loser)
        la, lb = known[a], known[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        if la < 0:
            return a, b
        x, y = heads[a], heads[b]
        c = _common(x, y, la)
        if c == len(x) or (c < len(y) and x[c] < y[c]):
            known[b] = c
            return a, b
        known[a] = c
        return b, a

    level = list(range(k))
    node = k // 2
    while len(level) > 1:
        up = []
        for i in range(0, len(level), 2):
            w, lost = play(level[i], level[i + 1])
            loser[node + i // 2] = lost
            up.append(w)
        level, node = up, node // 2
    winner = level[0]
    out_run, out_index, out_lcp = [], [], []
    while known[winner] >= 0:
        i = index[winner]
        out_run.append(winner)
        out_index.append(i)
        out_lcp.append(known[winner])
        lcps, strings = runs[winner]
        index[winner] = i = i + 1
        if i < len(strings):
            heads[winner], known[winner] = strings[i], lcps[i]
        else:
            heads[winner], known[winner] = None, -1
        node = (k + winner) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2
    return out_run, out_index, out_lcp


def _between(lcp: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The LCP array of the kept ones (indices in order) alone."""
    out = np.zeros(len(keep), np.int64)
    if len(keep) > 1:
        out[1:] = np.minimum.reduceat(lcp[: keep[-1] + 1], keep[:-1] + 1)
    return out


def repeated_offsets(r_lcp: np.ndarray, r_size: np.ndarray, left: list[bytes], length: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For segments in suffix order: the least and greatest bytes before the anchor of a repeated string (-1: none)."""
    n = len(r_lcp)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if n < 2:
        return low, high
    l_size = np.fromiter(map(len, left), np.int64, n)
    width = max(1, span - 1)
    rows = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in left), np.uint8).reshape(n, width)
    l_order, l_lcp = _sorted(rows, l_size)
    most_right = np.maximum(r_lcp, np.append(r_lcp[1:], 0))
    most_left = np.zeros(n, np.int64)
    most_left[l_order] = np.maximum(l_lcp, np.append(l_lcp[1:], 0))
    keep = np.flatnonzero(most_right + most_left >= length)
    if len(keep) < 2:
        return low, high
    r_lcp = _between(r_lcp, keep)
    place = np.full(n, -1, np.int64)
    place[keep] = np.arange(len(keep))
    kept_left = np.flatnonzero(place[l_order] >= 0)
    l_lcp = _between(l_lcp, kept_left)
    rank = np.zeros(len(keep), np.int64)
    rank[place[l_order[kept_left]]] = np.arange(len(keep))
    least, most = length - r_size[keep], l_size[keep]
    found_low, found_high = np.full(len(keep), -1, np.int64), np.full(len(keep), -1, np.int64)
    for a in range(span):
        live = np.flatnonzero((least <= a) & (a <= most))
        if len(live) < 2:
            continue
        key = np.cumsum(r_lcp < length - a)[live] * (len(keep) + 1) + np.cumsum(l_lcp < a)[rank[live]]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(live), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = live[twice]
        found_high[hit] = a
        found_low[hit[found_low[hit] < 0]] = a
    low[keep], high[keep] = found_low, found_high
    return low, high


def union_of(rk: np.ndarray, rk2: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(rk, rk2, low, high): the spans of every row as maximal runs."""
    order = np.lexsort((low, rk2, rk))
    rk, rk2, low, high = (x[order] for x in (rk, rk2, low, high))
    other = np.ones(len(rk), bool)
    other[1:] = (rk[1:] != rk[:-1]) | (rk2[1:] != rk2[:-1])
    shift = np.cumsum(other) << 32  # rows apart: one running maximum serves them all
    reach = np.maximum.accumulate(high + shift)
    other[1:] |= (low + shift)[1:] > reach[:-1]
    lead = np.flatnonzero(other)
    return rk[lead], rk2[lead], low[lead], np.maximum.reduceat(high, lead) if len(lead) else high


_FOUND = "rk bigint, rk2 int, low bigint, high bigint"


def _runs(length: int, gram: int, parts: int, hot: tuple, merges: int = 1):
    span = length - gram + 1

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        right, r_size, left, l_size, seg, gram_hash, rk, rk2, place = (np.concatenate([h[i] for h in held]) for i in range(9))
        _, lead, group, count = np.unique(seg, return_index=True, return_inverse=True, return_counts=True)
        own = lead[group]
        equal = (r_size == r_size[own]) & (l_size == l_size[own])
        for a in range(0, len(own), 1 << 16):
            b = slice(a, a + (1 << 16))
            equal[b] &= (right[b] == right[own[b]]).all(1) & (left[b] == left[own[b]]).all(1)
        count = np.bincount(group[equal], minlength=len(count))
        known = equal & (count[group] > 1)
        at = np.flatnonzero(known)
        if len(at):  # spans found here pass through the merge, spread over its partitions
            found = union_of(rk[at], rk2[at], place[at] - l_size[at], place[at] + r_size[at])
            yield _sent((found[0] + found[2]) % parts, pa.nulls(len(found[0]), pa.binary()), *found)
        send = np.flatnonzero(~equal | (own == np.arange(len(own))))
        order, _ = _sorted(right[send], r_size[send])
        merge = (gram_hash[send] % _U(parts * merges)).astype(np.int64)[order]
        by_merge = np.argsort(merge, kind="stable")
        order, merge = send[order[by_merge]], merge[by_merge]
        part, merge = merge // merges, merge % merges
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        blobs = [_pack(right, r_size, left, l_size, known, rk, rk2, place, order[a:b], np.bincount(merge[a:b], minlength=merges)) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        none = pa.nulls(len(blobs), pa.int64())
        yield _sent(part[edge[:-1]], pa.array(blobs, pa.binary()), none, pa.nulls(len(blobs), pa.int32()), none, none)

    def run(batches):
        held, size, segments = [], 0, 0
        for rows, data, offs, begin in _pieces(batches, length):
            rk, rk2 = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            text, anchor, start, last, gram_hash = anchors(data, offs, length, gram, hot)
            for a in range(0, len(text), CHUNK):
                t, x, first, end, key = (v[a : a + CHUNK] for v in (text, anchor, start, last, gram_hash))
                r_size, l_size = end + length - x, x - first
                right, left = _rows(data, x, r_size, length, 1), _rows(data, x - 1, l_size, max(1, span - 1), -1)
                seg = tc.span_hashes(data, first, end + length) ^ tc.mix(l_size.astype(_U))
                held.append((right, r_size, left, l_size, seg, key, rk[t], rk2[t], x - offs[:-1][t] + begin))
                segments += len(t)
                if segments >= RUN_SEGMENTS:
                    yield from flush(held)
                    held, size, segments = [], 0, 0
            size += len(data)
            if held and size >= RUN_BYTES:
                yield from flush(held)
                held, size, segments = [], 0, 0
        if held:
            yield from flush(held)

    return run


def _sent(part, run, rk, rk2, low, high) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(partition_key(part)), run, *map(pa.array, (rk, rk2, low, high))], names=["part", "run", "rk", "rk2", "low", "high"])


def _merge(length: int, gram: int, merges: int = 1):
    span = length - gram + 1

    def merged_spans(blobs: list[bytes], merge: int) -> pa.RecordBatch:
        runs = [_unpack(blob, merge) for blob in blobs]
        which, index, lcp = merged([(r[0], r[1]) for r in runs])
        which, index = np.array(which, np.int64), np.array(index, np.int64)
        begin = np.concatenate([[0], np.cumsum([len(r[1]) for r in runs])])
        at = begin[which] + index
        sizes = np.fromiter((len(s) for r in runs for s in r[1]), np.int64)[at]
        rk, rk2, place, known = (np.concatenate([r[i] for r in runs])[at] for i in (3, 4, 5, 6))
        lefts = [s for r in runs for s in r[2]]
        lefts = [lefts[i] for i in at.tolist()]
        low, high = repeated_offsets(np.array(lcp, np.int64), sizes, lefts, length, span)
        hit = (high >= 0) & (known == 0)
        return pa.RecordBatch.from_arrays([*map(pa.array, union_of(rk[hit], rk2[hit], (place - high)[hit], (place - low)[hit] + length))], names=["rk", "rk2", "low", "high"])

    def run(batches):
        for t in groups(batches, 1):
            is_run = t.column("run").is_valid()
            yield from t.filter(pc.invert(is_run)).select(["rk", "rk2", "low", "high"]).combine_chunks().to_batches()
            blobs = t.column("run").filter(is_run).to_pylist()
            del t
            for merge in range(merges) if blobs else ():
                yield merged_spans(blobs, merge)

    return run


def _cut(batches):
    for t in batches:
        data, offs = tc.flat(t.column(1))
        spans = t.column(2)
        s_offs = np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in spans])])
        values = spans.flatten()
        lows, highs = (values.field(i).to_numpy(zero_copy_only=False).tolist() if len(values) else [] for i in (0, 1))
        removed, count, digest, merged_spans = [], [], [], []
        raw = memoryview(np.ascontiguousarray(data))
        for i in range(t.num_rows):
            text = raw[offs[i] : offs[i + 1]]
            sha, at, gone, out = hashlib.sha256(), 0, 0, []
            for low, high in sorted(zip(lows[s_offs[i] : s_offs[i + 1]], highs[s_offs[i] : s_offs[i + 1]], strict=True)):
                if out and low <= out[-1]["to"]:
                    out[-1]["to"] = max(out[-1]["to"], high)
                else:
                    out.append({"from": low, "to": high})
            for s in out:
                sha.update(text[at : s["from"]])
                gone += s["to"] - s["from"]
                at = s["to"]
            sha.update(text[at:])
            removed.append(gone), count.append(len(out)), digest.append(sha.hexdigest()), merged_spans.append(out)
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield pa.RecordBatch.from_arrays([t.column(0), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(merged_spans, kind)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans for every row of ``docs``.

    ``spans`` are the byte ranges (from, to) covered by a string of ``length`` bytes that also starts anywhere else,
    in another text or the same, overlapping or not.  Null texts count as empty; texts below ``length`` bytes have
    no spans.  Repeated rows are copies of each other, so their whole texts are covered.  Extra columns are ignored.
    """
    name = [F.xxhash64("doc_id", "text").alias("rk"), F.shiftright(F.xxhash64(F.lit(1), "doc_id", "text"), 32).cast("int").alias("rk2")]
    # rows that agree in doc_id and text share their name: both are copies, and get the same spans
    rows = docs.select("doc_id", "text").select(*name, "doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (PART_BYTES * MERGES)))
    merges = max(1, -(-total // (PART_BYTES * parts)))
    long = rows.where(F.octet_length("text") >= length)
    hot = hot_grams(docs.select("text").where(F.octet_length("text") >= length), length, gram, total)
    sent = mapped(long.select("rk", "rk2", "text"), _runs(length, gram, parts, hot, merges), "part int, run binary, " + _FOUND)
    found = mapped(sent.repartition(parts, "part").sortWithinPartitions("part"), _merge(length, gram, merges), _FOUND)
    spans = found.groupBy("rk", "rk2").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    joined = rows.join(spans, ["rk", "rk2"], "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(joined, _cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<`from`: bigint, `to`: bigint>>")
