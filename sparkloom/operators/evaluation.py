"""Statistics of predictions and of paired runs: all exact, every deviation named population or sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.shipping import ship


def rare_fold(df: DataFrame, y: str, least: int, other: str = "other") -> DataFrame:
    """Labels with fewer than ``least`` rows become ``other``; ``other`` stays, 0 turns it off."""
    if least <= 0:
        return df
    counts = df.groupBy(y).agg(F.count("*").alias("_n"))
    return df.join(counts, y).withColumn(y, F.when((F.col("_n") < least) & (F.col(y) != other), F.lit(other)).otherwise(F.col(y))).drop("_n")


def family(df: DataFrame, name: str, dim: DataFrame, other: str = "other") -> DataFrame:
    """Adds family, ``other`` for names without one."""
    return df.join(dim.select(F.col("name").alias(name), "family"), name, "left").withColumn("family", F.coalesce("family", F.lit(other)))


def majority(df: DataFrame, y: str) -> DataFrame:
    """(label, share) of the most frequent label."""
    counts = df.groupBy(y).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by(y, F.struct("n", F.col(y))).alias("label"), (F.max("n") / F.sum("n")).alias("share"))


def thin_classes(df: DataFrame, y: str, least: int) -> DataFrame:
    return df.groupBy(y).agg(F.count("*").alias("n")).where(F.col("n") < least)


def _cells(df: DataFrame, y: str, p: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, y: str, p: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, label, precision, recall, f1, support) for labels in truth or prediction; 0 where a share is of none."""
    keys = keys or []
    cells = _cells(df, y, p, keys)  # at most labels^2 rows a key: all that follows is small
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = cells.select(*keys, F.explode(F.array(F.struct(F.col("y").alias("label"), F.col("n").alias("truth"), F.lit(0).cast("bigint").alias("told"), hit.alias("tp")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("truth"), F.col("n").alias("told"), F.lit(0).cast("bigint").alias("tp")))).alias("s")).select(*keys, "s.*")
    sums = sides.groupBy(*keys, "label").agg(F.sum("truth").alias("support"), F.sum("told").alias("told"), F.sum("tp").alias("tp"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select(*keys, "label", share(F.col("tp"), F.col("told")).alias("precision"), share(F.col("tp"), F.col("support")).alias("recall"), share(2 * F.col("tp"), F.col("support") + F.col("told")).alias("f1"), "support")


def report_averages(report: DataFrame) -> DataFrame:
    """Macro and weighted means of a class report."""
    names = ("precision", "recall", "f1")
    macro = report.agg(F.lit("macro").alias("average"), *(F.avg(c).alias(c) for c in names), F.sum("support").alias("support"))
    weighted = report.agg(F.lit("weighted").alias("average"), *((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names), F.sum("support").alias("support"))
    return macro.union(weighted)


def scores(df: DataFrame, y: str, p: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, accuracy, balanced_accuracy, f1_macro): recall over classes present in truth, F1 over all seen."""
    keys = keys or []
    report = class_report(df, y, p, keys)
    return report.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("f1_macro"),
    )


def confusion(df: DataFrame, y: str, p: str, labels: list) -> DataFrame:
    """One row per label, one column per predicted label; absent ones are 0."""
    counts = df.groupBy(F.col(y).alias("y")).agg(*(F.count(F.when(F.col(p) == x, 1)).alias(f"p_{x}") for x in labels))
    rows = df.sparkSession.createDataFrame([(x,) for x in labels], f"y {df.schema[y].dataType.simpleString()}")
    return rows.join(counts, "y", "left").na.fill(0)


def mean_std(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation, standard error (sample)."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_pop"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"), F.count(value).alias("n"))


def paired_delta(a: DataFrame, b: DataFrame, keys: list[str], value: str, by: list[str] | None = None) -> DataFrame:
    """(by, mean, se, t, better, n, exact) of b - a over rows with the same keys; t is null where the error is 0."""
    by = by or []
    both = a.select(*by, *keys, F.col(value).alias("_a")).join(b.select(*by, *keys, F.col(value).alias("_b")), [*by, *keys]).where("_a IS NOT NULL AND _b IS NOT NULL")
    d = F.col("_b") - F.col("_a")
    out = both.groupBy(*by).agg(F.avg(d).alias("mean"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se"), F.sum((d > 0).cast("int")).cast("bigint").alias("better"), F.count("*").alias("n"))
    return out.withColumns({"t": F.when(F.col("se") > 1e-12, F.col("mean") / F.col("se")), "exact": F.col("se") <= 1e-12})


def slope(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Least-squares slope of y over x; no extrapolation."""
    return df.groupBy(*(keys or [])).agg(F.regr_slope(y, x).alias("slope"))


def nested_pools(ids: DataFrame, ident: str, draws: int, sizes: list[int], hashed=None) -> DataFrame:
    """(draw, size, id): per draw one seeded order; the pool of each size is its beginning, so pools are nested."""
    hashed = hashed or (lambda draw, i: F.md5(F.concat_ws(":", draw.cast("string"), i.cast("string"))))
    rows = ids.select(ident).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = Window.partitionBy("draw").orderBy(hashed(F.col("draw"), F.col(ident)), ident)
    rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(sizes))
    return rows.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where("rank <= size").select("draw", "size", ident)


#: Groups (sources of a labelled set) that the driver deals to folds, or that every row is repeated for.
MAX_GROUPS, MAX_HELD = 100_000, 1_000


def _few(groups: DataFrame, most: int) -> list:
    rows = groups.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} groups")
    return rows


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): the largest group first, always to the lightest fold; MAX_GROUPS groups at most."""
    rows = _few(df.groupBy(group).agg(F.count("*").alias("n")), MAX_GROUPS)
    counts = sorted(((r["n"], r[group]) for r in rows), key=lambda x: (-x[0], str(x[1])))
    load, out = [0] * max(1, min(k, len(counts))), []
    for n, g in counts:
        fold = load.index(min(load))
        load[fold] += n
        out.append((g, fold))
    return df.sparkSession.createDataFrame(out, f"{group} {df.schema[group].dataType.simpleString()}, fold int")


def hold_out(df: DataFrame, group: str, share: float = 0.25, seed: int = 0) -> DataFrame:
    """Adds held_out: a seeded share of the groups, rounded up, by the order of md5(seed:group)."""
    groups = df.select(group).distinct()
    w = Window.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"))), group)
    chosen = groups.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy()))
    return df.join(chosen.select(group, (F.col("_r") <= F.ceil(F.col("_n") * share)).alias("held_out")), group)


def leave_one_out(df: DataFrame, group: str) -> DataFrame:
    """(held, rows, is_test): every row once for each group, of which there may be MAX_HELD; rows aren't shuffled."""
    groups = [(r[0],) for r in _few(df.select(group).distinct(), MAX_HELD)]
    held = df.sparkSession.createDataFrame(groups, f"held {df.schema[group].dataType.simpleString()}")
    return df.crossJoin(F.broadcast(held)).withColumn("is_test", F.col(group).eqNullSafe(F.col("held")))


#: Rows that a task of :func:`permutation_test` has in memory at once.
STEP = 1 << 20
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _hashed(x: np.ndarray, start: np.ndarray, wide: bool = False) -> np.ndarray:
    """Spark's xxhash64 of int (``wide``: bigint) values, carried on from ``start``."""
    x = x.astype(np.int64).view(np.uint64)
    if wide:
        h = _turned((start + _P5 + np.uint64(8)) ^ (_turned(x * _P2, 31) * _P1), 27) * _P1 + _P4
    else:
        h = _turned((start + _P5 + np.uint64(4)) ^ ((x & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _places(i: np.ndarray, start: np.ndarray, seed: int) -> np.ndarray:
    """Keys of the rows ``i`` of a group, from 0, by which a shuffle orders them; all steps invert, so no two are equal."""
    h = _hashed(i + 1, start)
    return _hashed(np.full(1, seed), h, not -(1 << 31) <= seed < 1 << 31) ^ np.uint64(1 << 63)  # as signed numbers


def _small_hits(n: np.ndarray, y: np.ndarray, p: np.ndarray, group: np.ndarray, start: np.ndarray, seed: int) -> np.ndarray:
    """Hits by cell of y in shuffles of several groups at once; ``group`` has the place of each cell's ``start``."""
    cell = np.repeat(np.arange(len(n)), n)
    g = group[cell]
    i = np.arange(len(cell)) - np.searchsorted(g, g)
    drawn = cell[np.lexsort((_places(i, start[g], seed), g))]
    return np.bincount(drawn[y[drawn] == p[cell]], minlength=len(n))


def _large_hits(n: np.ndarray, y: np.ndarray, p: np.ndarray, start: np.ndarray, seed: int) -> np.ndarray:
    """As :func:`_small_hits` of one group, in STEPs: the keys at which a cell of p begins are found by counting."""
    ends = np.cumsum(n)
    total, shift = int(ends[-1]), np.uint64(48)
    steps = lambda: ((i, _places(i, start, seed)) for a in range(0, total, STEP) for i in [np.arange(a, min(a + STEP, total))])
    counts = sum(np.bincount((h >> shift).astype(np.int64), minlength=1 << 16) for _, h in steps())
    upto = np.cumsum(counts)
    holds = np.searchsorted(upto, ends[:-1], "right")  # the bucket of the row at each cell's beginning
    wanted = np.zeros(1 << 16, bool)
    wanted[holds] = True
    found = np.sort(np.concatenate([h[wanted[(h >> shift).astype(np.int64)]] for _, h in steps()]))
    within = np.cumsum(np.where(wanted, counts, 0)) - counts  # of those found, how many are in buckets before
    begins = found[within[holds] + ends[:-1] - (upto - counts)[holds]]
    out = np.zeros(len(n), np.int64)
    for i, h in steps():
        cell = np.searchsorted(ends, i, "right")
        met = p[np.searchsorted(begins, h, "right")]
        out += np.bincount(cell[y[cell] == met], minlength=len(n))
    return out


def _shuffled_hits(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """(perm, labels, support, hits) of (perm, start, labels, n, y, p): a group's cells in a shuffle; perm 0 is none."""
    for batch in batches:
        size, many = (batch.column(c).value_lengths().to_numpy() for c in ("n", "labels"))
        n, y, p = (batch.column(c).flatten().to_numpy() for c in ("n", "y", "p"))
        perm, start = batch.column("perm").to_numpy(), batch.column("start").to_numpy().view(np.uint64)
        row, ends = np.repeat(np.arange(len(size)), size), np.cumsum(size)
        rows = np.bincount(row, n, len(size)).astype(np.int64)
        hits, k = np.where(y == p, n, 0), 0
        while k < len(size):
            last = max(k + 1, k + int(np.searchsorted(np.cumsum(rows[k:]), STEP, "right")))
            at = slice(ends[k] - size[k], ends[last - 1])
            if rows[k] > STEP:
                drawn = _large_hits(n[at], y[at], p[at], start[k], seed)
            else:
                drawn = _small_hits(n[at], y[at], p[at], row[at] - k, start[k:last], seed)
            hits[at] = np.where(perm[row[at]] > 0, drawn, hits[at])
            k = last
        offset = np.cumsum(many) - many
        slot = offset[row] + y - 1
        lists = pa.array(np.append(offset, offset[-1:] + many[-1:]).astype(np.int32))
        sums = [pa.ListArray.from_arrays(lists, pa.array(np.bincount(slot, v, int(many.sum())).astype(np.int64))) for v in (n, hits)]
        yield pa.RecordBatch.from_arrays([batch.column("perm"), batch.column("labels"), *sums], ["perm", "labels", "support", "hits"])


def permutation_test(df: DataFrame, y: str, p: str, group: str, times: int = 200, seed: int = 0) -> DataFrame:
    """(observed, mean, std, z, p_value) of balanced accuracy under label shuffles within groups, null being one.

    Each shuffle pairs the i-th label of a group with the i-th prediction in a seeded order.  Rows are numbered by
    their values, so that both sides number them alike whatever the partitions, or a lost executor; rows that agree
    in label and prediction may change places, which changes nothing.  So a group is told by how often it has each
    label with each prediction: these counts go to the tasks, one for each group and shuffle, and rows are made there.
    """
    ship(df.sparkSession)
    cells = df.groupBy(F.col(group).alias("g"), F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    each = cells.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("y", "p", "n"))).alias("c")).withColumn("labels", F.array_distinct(F.transform("c", lambda c: c["y"])))
    place = lambda x, none: F.transform("c", lambda c: F.coalesce(F.array_position("labels", c[x]), F.lit(none)).cast("bigint"))
    each = each.select("g", "labels", F.col("c.n").alias("n"), place("y", 1).alias("y"), place("p", 0).alias("p"))  # a null label is the first
    many = each.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(times)))).withColumn("start", F.xxhash64("perm", "g"))
    many = many.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "start").select("perm", "start", "labels", "n", "y", "p")
    kind = df.schema[y].dataType.simpleString()
    drawn = many.mapInArrow(lambda batches: _shuffled_hits(batches, seed), f"perm int, labels array<{kind}>, support array<bigint>, hits array<bigint>")
    sums = drawn.select("perm", F.explode(F.arrays_zip("labels", "support", "hits")).alias("s")).groupBy("perm", "s.labels").agg((F.sum("s.hits") / F.sum("s.support")).alias("recall"))
    recalls = sums.groupBy("perm").agg(F.sort_array(F.collect_list(F.struct("labels", "recall"))).alias("r"))  # in order, so that equal shuffles are equal
    found = recalls.select("perm", (F.aggregate("r", F.lit(0.0), lambda a, r: a + r["recall"]) / F.size("r")).alias("balanced_accuracy"))
    real = F.max(F.when(F.col("perm") == 0, F.col("balanced_accuracy")))
    sums = found.agg(real.alias("observed"), F.avg(F.when(F.col("perm") > 0, F.col("balanced_accuracy"))).alias("mean"), F.stddev_pop(F.when(F.col("perm") > 0, F.col("balanced_accuracy"))).alias("std"), F.array_agg(F.when(F.col("perm") > 0, F.col("balanced_accuracy"))).alias("all"))
    above = F.size(F.filter("all", lambda x: x >= F.col("observed")))
    return sums.select("observed", "mean", "std", F.try_divide(F.col("observed") - F.col("mean"), F.col("std")).alias("z"), ((above + 1) / F.lit(times + 1)).alias("p_value"))


def top_k(df: DataFrame, key: str, label: str, score: str, k: int, low: float = 0.15) -> DataFrame:
    """(key, rank, label, score, low_margin): the best k of each key; flagged if the first two are close."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.desc(label))
    ranked = df.select(key, label, score, F.row_number().over(w).alias("rank"), F.lead(score).over(w).alias("_next"))
    margin = F.first(F.col(score) - F.col("_next")).over(Window.partitionBy(key).orderBy("rank"))
    return ranked.withColumn("low_margin", F.coalesce(margin < low, F.lit(False))).where(F.col("rank") <= k).drop("_next")


def set_status(names: DataFrame, cache: str, name: str) -> DataFrame:
    """(cache, n, status): reference (the most names, first of equals), fresh, stale (a strict subset) or conflict.

    ``names(cache, ord, name, pos)``; the same set in another order is a conflict.
    """
    sizes = names.groupBy(cache).agg(F.count("*").alias("n"), F.min("ord").alias("ord"), F.countDistinct(name).alias("d"))
    ref = sizes.orderBy(F.desc("n"), "ord").limit(1).select(F.col(cache).alias("ref"))
    of_ref = names.join(F.broadcast(ref), F.col(cache) == F.col("ref")).select(F.col(name).alias("r_name"), F.col("pos").alias("r_pos"))
    total = of_ref.agg(F.countDistinct("r_name").alias("total"), F.count("*").alias("rows"))
    met = names.join(of_ref, F.col(name) == F.col("r_name"), "left").groupBy(cache).agg(F.sum(F.col("r_name").isNull().cast("int")).alias("extra"), F.sum((F.col("pos") == F.col("r_pos")).cast("int")).alias("same"))
    rows = sizes.join(met, cache).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(ref))
    status = (
        F.when(F.col(cache) == F.col("ref"), "reference").when((F.col("extra") == 0) & (F.col("same") == F.col("n")) & (F.col("n") == F.col("rows")), "fresh").when((F.col("extra") == 0) & (F.col("d") < F.col("total")), "stale").otherwise("conflict")
    )
    return rows.select(cache, "n", status.alias("status"))


