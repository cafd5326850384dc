"""Links between the members of groups of any size, without a task that holds a large group or compares all its pairs.

Groups up to a limit of weight are settled in one task.  Larger ones are dealt to blocks of about that weight:

1. Some members, drawn by hash, go to every block; there the members most like the consensus of the drawn ones are
   found.  The best of all blocks become the group's pivots.
2. The pivots go to every block.  Their main component (the one with most pivots) is the same everywhere; members
   linked to one of its pivots are settled.
3. The rest, members not linked to a main pivot, is compared with all members, block by block.

A pair that isn't compared has both ends in the main component, so components are those of all pairs.  Where copies
surround an original the work is linear in the group; it grows with (members not linked to a pivot) x (members).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, mapped, stored

#: Members of a large group that are drawn, that a block proposes, and that become pivots.
DRAWN, PROPOSED, PIVOTS = 24, 4, 24


class View:
    """Distinct members of one block: ``links(p)`` compares member p with all, ``centre(mask)`` tells how near each one
    is to the consensus of some.  Made by a function of (rid, table of one row each)."""

    def __init__(self, links: Callable[[int], np.ndarray], centre: Callable[[np.ndarray], np.ndarray]):
        self.links, self.centre = links, centre


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows that agree in the first ``keys`` columns, from batches in that order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_pylist() for i in range(keys)]
        rows = list(zip(*cols, strict=True))
        at = 0
        for i in range(len(rows) + 1):
            if i == len(rows) or rows[i] != rows[at]:
                if last is not None and rows[at] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(at, i - at))
                last, at = rows[at], i
    if held:
        yield pa.Table.from_batches(held)


def settle(count: int, begin: int, links: Callable[[int], np.ndarray]) -> np.ndarray:
    """Component label of each of ``count`` items.  ``links(p)`` compares item p with all.

    Ends when every item is in the largest component or has been compared with all: no link between two components
    is missed.
    """
    label, done, p = np.arange(count), np.zeros(count, bool), begin
    while True:
        done[p] = True
        _join(label, p, links(p))
        main = np.bincount(label).argmax()
        left = np.flatnonzero(~done & (label != main))
        if not len(left):
            return label
        p = left[0]


def _join(label: np.ndarray, p: int, near: np.ndarray) -> None:
    label[np.isin(label, np.unique(label[near]))] = label[p]


def _stars(rid: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each component of several items: (item, least item)."""
    order = np.lexsort((rid, label))
    lead = np.concatenate([[True], label[order][1:] != label[order][:-1]])
    root = rid[order][lead][np.cumsum(lead) - 1]
    keep = root != rid[order]
    return rid[order][keep], root[keep]


def _members(t: pa.Table, view: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, View]:
    """(rid, whether sent as a guest, whether at home, view) of the distinct members of a block."""
    every, guest = t.column("rid").to_numpy(), t.column("guest").to_numpy(zero_copy_only=False).astype(bool)
    rid, at, back = np.unique(every, return_index=True, return_inverse=True)
    sent, home = np.zeros(len(rid), bool), np.zeros(len(rid), bool)
    sent[back[guest]] = True
    home[back[~guest]] = True
    return rid, sent, home, view(t.take(pa.array(at)))


def _whole(view: Callable, keys: int) -> Callable:
    def run(batches):
        for t in groups(batches, keys):
            if t.num_rows < 2:
                continue
            rid, _, _, v = _members(t, view)
            if len(rid) > 1:
                begin = 0 if len(rid) < 64 else int(v.centre(np.ones(len(rid), bool)).argmax())
                yield pa.RecordBatch.from_arrays([*map(pa.array, _stars(rid, settle(len(rid), begin, v.links)))], names=["a", "b"])

    return run


def _keyed(t: pa.Table, keys: list[str], rows: int, **columns) -> pa.RecordBatch:
    key = [pa.repeat(t.column(k)[0], rows) for k in keys]
    return pa.RecordBatch.from_arrays([*key, *map(pa.array, columns.values())], names=[*keys, *columns])


def _proposals(view: Callable, keys: list[str]) -> Callable:
    def run(batches):
        for t in groups(batches, len(keys) + 2):
            rid, sent, home, v = _members(t, view)
            if not home.any():
                continue
            score = np.where(home, v.centre(sent if sent.any() else home), -1.0)
            best = np.lexsort((rid, -score))[: min(PROPOSED, home.sum())]
            yield _keyed(t, keys, len(best), rid=rid[best], score=score[best])

    return run


def _around_pivots(view: Callable, keys: list[str]) -> Callable:
    def run(batches):
        for t in groups(batches, len(keys) + 2):
            rid, pivot, home, v = _members(t, view)
            label, near = np.arange(len(rid)), {}
            for p in np.flatnonzero(pivot):
                near[p] = v.links(p)
            own = label.copy()  # components of the pivots alone, alike in every block
            for p, x in near.items():
                _join(own, p, x & pivot)
            main = np.zeros(len(rid), bool)
            if near:
                names, size = np.unique(own[pivot], return_counts=True)
                first = [rid[pivot & (own == k)].min() for k in names]
                main = pivot & (own == names[np.lexsort((first, -size))[0]])
            done = main.copy()
            for p in np.flatnonzero(main):
                done |= near[p]
                _join(label, p, near[p])
            a, b = _stars(rid, label)
            yield _keyed(t, keys, len(a), a=a, b=b)
            rest = rid[home & ~done]
            yield _keyed(t, keys, len(rest), a=rest, b=pa.nulls(len(rest), pa.int64()))

    return run


def _rest(view: Callable, keys: int) -> Callable:
    def run(batches):
        for t in groups(batches, keys):
            rid, sent, _, v = _members(t, view)
            label = np.arange(len(rid))
            for p in np.flatnonzero(sent):
                _join(label, p, v.links(p))
            yield pa.RecordBatch.from_arrays([*map(pa.array, _stars(rid, label))], names=["a", "b"])

    return run


def linked(rows: DataFrame, sizes: DataFrame, keys: list[str], limit: int, view: Callable) -> DataFrame:
    """(a, b): edges whose components, within every group, are those of all links between its members.

    ``rows(keys, rid, ...)`` are the members with what ``view`` needs; ``sizes(keys, weight, many)``, a stored table,
    has every group's weight and number of members, ``limit`` is the weight that one task may hold.  The rows of large
    groups are written once, for all three steps.
    """
    blocks = F.least(F.col("many"), F.ceil(F.col("weight") / limit)).cast("int")
    sizes = sizes.select(*keys, blocks.alias("nb"), "weight", "many")
    more = [c for c in rows.columns if c not in (*keys, "rid")]
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def dealt(df: DataFrame, by: list[str]) -> DataFrame:
        return df.select(*by, "guest", "rid", *more).repartition(*by).sortWithinPartitions(*by)

    few = rows.join(sizes.where("nb = 1").select(*keys), keys).withColumn("guest", F.lit(False))
    small = mapped(dealt(few, keys), _whole(view, len(keys)), "a bigint, b bigint")
    big = sizes.where("nb > 1")
    if big.isEmpty():
        return small

    drawn = F.least(F.lit(DRAWN), F.greatest(F.lit(1), F.floor(F.col("many") * (limit / 4) / F.col("weight"))))  # a quarter of a block
    every = stored(rows.join(big, keys).withColumns({"i": F.lit(0), "j": F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int"), "guest": F.lit(False), "drawn": drawn}))
    by = [*keys, "i", "j"]

    def everywhere(df: DataFrame, count: Column) -> DataFrame:
        return df.withColumns({"j": F.explode(F.sequence(F.lit(0), count - 1)), "guest": F.lit(True)})

    chosen = everywhere(every.where(F.pmod(F.xxhash64("rid", F.lit(3)), F.col("many")) < F.col("drawn")), F.col("nb"))
    proposed = mapped(dealt(every.unionByName(chosen), by), _proposals(view, keys), f"{kinds}, rid bigint, score double")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "rid"))  # PROPOSED rows a block
    pivots = stored(proposed.withColumn("rank", rank).where(F.col("rank") <= PIVOTS))
    chosen = everywhere(every.join(pivots.select(*keys, "rid", "rank"), [*keys, "rid"]).where("rank <= drawn").drop("rank"), F.col("nb"))
    around = stored(mapped(dealt(every.unionByName(chosen), by), _around_pivots(view, keys), f"{kinds}, a bigint, b bigint"))
    dropped(pivots)
    edges = small.union(around.where("b IS NOT NULL").select("a", "b"))
    rest = around.where("b IS NULL").select(*keys, F.col("a").alias("rid"))
    if rest.isEmpty():
        return edges
    parts = rest.groupBy(*keys).agg(F.count("*").alias("left")).join(big, keys).select(*keys, F.ceil(F.col("left") * F.col("nb") / F.col("many")).cast("int").alias("nr"))
    every = every.join(parts, keys)
    part = F.pmod(F.xxhash64("rid", F.lit(5)), F.col("nr")).cast("int")
    guests = everywhere(every.join(rest, [*keys, "rid"], "left_semi").withColumn("i", part), F.col("nb"))
    homes = every.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)))
    return edges.union(mapped(dealt(homes.unionByName(guests), by), _rest(view, len(keys) + 2), "a bigint, b bigint"))
