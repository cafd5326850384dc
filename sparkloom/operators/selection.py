"""Selections: heads and strides per group, most frequent values, presence of pairs, differences of sets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def head(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key: review sheets, first misses, first errors."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def strided(df: DataFrame, keys: list[str], order: list[str], step: int, n: int) -> DataFrame:
    """Every ``step``-th row of each key, the first ``n`` of those."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_r", F.row_number().over(w) - 1)
    return rows.where((F.col("_r") % step == 0) & (F.col("_r") < step * n)).drop("_r")


def most_common(df: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """(value, n): the ``k`` most frequent values, those that appear first before others of the same count."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(k).drop("_first")


def present_pairs(pairs: DataFrame, present: DataFrame, name: str) -> DataFrame:
    """Pairs (kind, a, b) both of whose members are among the present names."""
    names = present.select(F.col(name).alias("a")).distinct()
    return pairs.join(names, "a", "left_semi").join(names.withColumnRenamed("a", "b"), "b", "left_semi").select("kind", "a", "b")


def partner(df: DataFrame, name: str, pairs: DataFrame) -> DataFrame:
    """Adds partner: the confusable counterpart by the first pair that has the name, null without one."""
    both = pairs.select(F.col("a").alias(name), F.col("b").alias("partner"), "ord").union(pairs.select("b", "a", "ord"))
    first = both.groupBy(name).agg(F.min_by("partner", "ord").alias("partner"))
    return df.join(F.broadcast(first), name, "left")  # 13 pairs


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in exactly one of two sets."""
    return a.subtract(b).union(b.subtract(a))


def existence(df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Adds missing: whether no row of ``found`` has the keys."""
    return df.join(found.select(*keys).distinct().withColumn("_there", F.lit(True)), keys, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def prefiltered(reads: DataFrame, scores: DataFrame, keys: list[str], score: str, least: float) -> DataFrame:
    """Reads whose frame scores over ``least``; all of a source's reads if it has no scores; all if least <= 0."""
    if least <= 0:
        return reads
    source, place = keys[:-1], keys[-1]
    kept = scores.where(F.col(score) > least).select(*keys).distinct()
    blind = reads.join(scores.select(*source).distinct(), source, "left_anti")
    return reads.join(kept, [*source, place], "left_semi").unionByName(blind)


def frames_between(frames: DataFrame, spans: DataFrame, key: str, least: int) -> DataFrame:
    """Frames within each span (key, t0, t1); spans with fewer than ``least`` frames give none."""
    from .signal import interval_join

    rows = interval_join(frames, spans, key)
    counts = rows.groupBy(key, "t0", "t1").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return rows.join(counts, [key, "t0", "t1"]).drop("_n")


def combos(names: list[str], largest: int, control: int = 3) -> list[tuple[str, list[str]]]:
    """Feature sets to compare: single ones, combinations of up to ``largest``, and each one repeated as a control."""
    out = [("+".join(c), list(c)) for k in range(1, largest + 1) for c in combinations(names, k)]
    return out + [(f"{n} x{control}", [n] * control) for n in names]
