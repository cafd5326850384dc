"""MinHash near-dedup with HyperMinHash registers.

1. Every text gets its set of word shingles and, from it, REGISTERS compressed registers: each shingle falls in one
   bucket by the first bits of its hash, and the bucket keeps the leading zeros of its least hash and the mantissa
   bits behind them.  Buckets that a small set leaves empty take the least of a hash of their own over the whole
   set, so a register agrees with probability J for sets of any size.
2. Texts with the same words are one item (told by SHA-256 of the lower-cased words).  Bands of ROWS registers put
   items in buckets; buckets with the same members count once.  Within a bucket, pairs whose corrected estimate isn't
   five standard deviations below the threshold join items into candidate clusters.
3. Full shingle sets confirm the links inside every cluster; links make the components.

A pair at the threshold shares no band with probability (1 - 0.8^4)^32 = 5e-8.  Buckets and clusters of any size are
compared by :mod:`linking`: no task holds a large one, and not all its pairs are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import components, dropped, mapped, stored
from .linking import View, linked

BITS, MANTISSA, ROWS = 7, 10, 4
REGISTERS = 1 << BITS
BANDS = REGISTERS // ROWS
#: Items of one bucket, and shingles of one cluster, that a task may hold.
BUCKET_BLOCK, CLUSTER_BLOCK = 5_000, 500_000
_COLLISION = 0.169919487159739 / (1 << MANTISSA)
_U = np.uint64


def compress(least: np.ndarray, own: np.ndarray | int) -> np.ndarray:
    """16 bits of a 64-bit minimum: a flag, the leading zeros (31 at most), the MANTISSA bits behind the first one."""
    zeros = np.minimum(53 - np.frexp((least >> _U(11)).astype(np.float64))[1], 31)
    mantissa = (least << (zeros + 1).astype(_U)) >> _U(64 - MANTISSA)
    return (mantissa.astype(np.int64) | (zeros.astype(np.int64) << MANTISSA) | (own << 15)).astype(np.uint16)


def registers(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """texts x REGISTERS from hashes that are sorted within each text; texts without shingles have zeros."""
    texts = len(first) - 1
    out = np.zeros((texts, REGISTERS), np.uint16)
    if not len(h):
        return out
    text = np.repeat(np.arange(texts), np.diff(first))
    cell = text * REGISTERS + (h >> _U(64 - BITS)).astype(np.int64)
    lead = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    out.reshape(-1)[cell[lead]] = compress(h[lead] << _U(BITS), 0)
    empty = np.ones((texts, REGISTERS), bool)
    empty.reshape(-1)[cell[lead]] = False
    empty[np.diff(first) == 0] = False
    some = np.flatnonzero(empty.any(1))
    if len(some):
        size = np.diff(first)[some]
        mine = h[np.isin(text, some)] if len(some) < texts else h
        owner = np.repeat(np.arange(len(some)), size)
        salt = tc.seeds(REGISTERS, 61)
        for j in range(REGISTERS):
            need = empty[some, j]
            if need.any():
                part = tc.mix(mine[need[owner]] ^ salt[j])
                at = np.concatenate([[0], np.cumsum(size[need])[:-1]])
                out[some[need], j] = compress(np.minimum.reduceat(part, at), 1)
    return out


def text_shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    low = tc.LOWER[data]
    start, end, first = tc.words(low, offs)
    return tc.shingles(tc.span_hashes(low, start, end), first, k)


def _sketch(k: int) -> Callable:
    def run(batches):
        for part, data, offs in tc.slices(batches, "text"):
            h, first = text_shingles(data, offs, k)
            n = np.diff(first)
            raw = tc.LOWER[data].tobytes()
            same = [hashlib.sha256(b" ".join(raw[a:b].split())).digest() if m else None for a, b, m in zip(offs[:-1], offs[1:], n, strict=True)]
            regs = pa.array([r.tobytes() for r in registers(h, first)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(same, pa.binary()), regs], names=["doc_id", "mark", "n", "same", "regs"])

    return run


def _by_registers(percent: int) -> Callable[[pa.Table], View]:
    j = percent / 100
    least = max(0.0, j - 5 * (j * (1 - j) / REGISTERS) ** 0.5)

    def view(t: pa.Table) -> View:
        n = t.column("n").to_numpy()
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)

        def links(p: int) -> np.ndarray:
            phi = 4 * (n / n[p]) / ((1 + n / n[p]) ** 2)  # collisions are likelier between sets of like size
            seen = (regs == regs[p]).mean(1)
            fits = 100 * np.minimum(n, n[p]) >= percent * np.maximum(n, n[p])
            return fits & ((seen - _COLLISION * phi) / (1 - _COLLISION) >= least)

        def centre(some: np.ndarray) -> np.ndarray:
            values = [np.unique(column, return_counts=True) for column in regs[some].T]
            return (regs == np.array([v[c.argmax()] for v, c in values], np.uint16)).mean(1)

        return View(links, centre)

    return view


def _by_shingles(k: int, percent: int) -> Callable[[pa.Table], View]:
    def view(t: pa.Table) -> View:
        data, offs = tc.flat(t.column("text"))
        parts = [text_shingles(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], k) for a, b in tc.cuts(offs)]
        n = np.concatenate([np.diff(f) for _, f in parts])
        first = np.concatenate([[0], np.cumsum(n)])
        _, item = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        order = np.argsort(item, kind="stable")
        owner = np.repeat(np.arange(len(n)), n)
        holder = owner[order]
        begin = np.searchsorted(item[order], np.arange(item.max() + 2))

        def links(p: int) -> np.ndarray:
            own = item[first[p] : first[p + 1]]
            size = np.diff(begin)[own]
            at = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            both = np.bincount(holder[at], minlength=len(n))
            return 100 * both >= percent * (n + n[p] - both)

        def centre(some: np.ndarray) -> np.ndarray:
            often = np.bincount(item[some[owner]], minlength=len(begin) - 1)
            return np.add.reduceat(often[item], first[:-1]) / n

        return View(links, centre)

    return view


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Two texts are linked if 100 * common shingles >= percent * shingles of both; ``component_id`` is the least
    doc_id reachable.  Null and empty texts, and texts without words, have no shingles and no links.  Every row takes
    part, also rows without doc_id or with a shared one; the component_id is null if nothing else than rows without
    doc_id is reached, and such rows are kept.  Repeated rows are alike.  doc_id may be of any type that has an order.
    Extra columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    sketch = stored(mapped(docs, _sketch(words), f"doc_id {kind}, mark bigint, n bigint, same binary, regs binary"))
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "mark")).alias("first")
    items = sketch.where("n > 0").groupBy("same").agg(first, F.count("*").alias("rows"), F.any_value("n").alias("n"), F.any_value("regs").alias("regs"))
    items = stored(items.withColumn("rid", F.monotonically_increasing_id()))  # fixed by the table that is written

    keys = F.array(*(F.struct(F.lit(b).alias("band"), F.substring("regs", b * 2 * ROWS + 1, 2 * ROWS).alias("key")) for b in range(BANDS)))
    bands = items.select("rid", F.explode(keys).alias("b")).select("b.band", "b.key", "rid")
    mark = F.xxhash64("rid")
    buckets = bands.groupBy("band", "key").agg(F.count("*").alias("many"), F.min("rid").alias("low"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 20)).alias("y")).where("many > 1")
    buckets = stored(buckets.groupBy("many", "low", "x", "y").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key", "many", F.col("many").alias("weight")))
    links = None
    if not buckets.isEmpty():
        held = bands.join(buckets.select("band", "key"), ["band", "key"]).join(items.select("rid", "n", "regs"), "rid").select("band", "key", "rid", "n", "regs")
        near = stored(linked(held, buckets, ["band", "key"], BUCKET_BLOCK, _by_registers(percent)))
        clusters = stored(components(near).withColumnsRenamed({"node": "rid", "component": "cid"}).join(items.select("rid", "n", "first"), "rid"))
        sizes = stored(clusters.groupBy("cid").agg(F.sum("n").alias("weight"), F.count("*").alias("many")))
        whose = clusters.select("cid", "rid", F.col("first.doc_id").alias("f_id"), F.col("first.mark").alias("f_mark"))
        # merged at every size: a broadcast would be as long as the list of candidates
        texts = docs.join(whose.hint("merge"), F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("mark") == F.col("f_mark"))).select("cid", "rid", "text")
        edges = stored(linked(texts, sizes, ["cid"], CLUSTER_BLOCK, _by_shingles(words, percent)))
        links = stored(components(edges))
        for used in (near, clusters, sizes, edges):
            dropped(used)
    dropped(buckets)
    low = F.struct(F.col("first.none").alias("none"), F.col("first.doc_id").alias("doc_id"))
    roots = items.where("rows > 1").select("same", low.alias("low"))
    if links is not None:
        members = items.select("same", "rid", low.alias("low")).join(links, F.col("rid") == F.col("node"))
        least = members.groupBy("component").agg(F.min("low").alias("low"))
        roots = roots.join(members, "same", "left_anti").union(members.drop("low").join(least, "component").select("same", "low"))
    roots = stored(roots)
    found = sketch.select("doc_id", "n", "same").join(roots, "same", "left")
    component = F.when(F.col("low").isNull(), F.col("doc_id")).otherwise(F.col("low.doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
