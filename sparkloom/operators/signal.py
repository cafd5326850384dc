"""Sampled signals: robust thresholds, onsets, runs.  Keys are sources (videos); order is (t, idx) within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds between accepted onsets, lead and padding of a clip.
MIN_GAP, LEAD, PAD = 15.0, 5.0, 0.2


def median_mad(df: DataFrame, key: str, score: str) -> DataFrame:
    """(key, med, mad): exact median and median absolute deviation."""
    med = df.groupBy(key).agg(F.median(score).alias("med"))
    return df.join(med, key).groupBy(key).agg(F.first("med").alias("med"), F.median(F.abs(F.col(score) - F.col("med"))).alias("mad"))


def robust_limits(df: DataFrame, key: str, score: str, k: float) -> DataFrame:
    """(key, limit): median + k * MAD, exact; a MAD of 0 counts as 1."""
    return median_mad(df, key, score).select(key, (F.col("med") + k * F.coalesce(F.nullif(F.col("mad"), F.lit(0.0)), F.lit(1.0))).alias("limit"))


def rising_edges(df: DataFrame, key: str, order: list[str], above: Column) -> DataFrame:
    """Rows that are above while the one before, if any, isn't."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_above", above).withColumn("_before", F.lag("_above", 1, False).over(w)).where("_above AND NOT _before").drop("_above", "_before")


def min_gap(df: DataFrame, key: str, t: str, gap: float) -> DataFrame:
    """(key, t): values at least ``gap`` behind the last accepted one; the first is accepted.

    Each step depends on the last accepted value, so it's a fold over a key's few candidates, not a window frame.
    """
    keep = F.aggregate(
        F.sort_array(F.collect_list(t)),
        F.array().cast("array<double>"),
        lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, -1) >= gap), F.concat(a, F.array(x.cast("double")))).otherwise(a),
    )
    return df.groupBy(key).agg(keep.alias("_t")).select(key, F.explode("_t").alias(t))


def onsets(df: DataFrame, key: str, t: str, score: str, order: list[str], k: float = 6.0, gap: float = MIN_GAP) -> DataFrame:
    """(key, t): rising edges over the robust limit, with the minimum gap."""
    over = df.join(robust_limits(df, key, score, k), key)
    return min_gap(rising_edges(over, key, order, F.col(score) > F.col("limit")), key, t, gap)


def clip_spans(onset: DataFrame, key: str, t: str, lead: float = LEAD, pad: float = PAD) -> DataFrame:
    """(key, n, start, end) of clips before onsets; those before the beginning go before they are numbered."""
    w = Window.partitionBy(key).orderBy("start")
    rows = onset.select(key, (F.col(t) - pad - lead).alias("start")).where("start >= 0")
    return rows.select(key, F.row_number().over(w).alias("n"), "start", (F.col("start") + lead).alias("end"))


def expected_count(counts: DataFrame, n: str, expect: Column) -> DataFrame:
    """Flags counts outside 0.6 to 1.6 of what is expected."""
    return counts.withColumn("flagged", ~F.col(n).between(0.6 * expect, 1.6 * expect))


def indexed(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def _islands(df: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("idx")
    change = F.when(F.lag("flag").over(w) == F.col("flag"), 0).otherwise(1)
    return df.withColumn("_c", change).withColumn("island", F.sum("_c").over(w)).groupBy(key, "island").agg(F.first("flag").alias("flag"), F.min("idx").alias("i"), (F.max("idx") + 1).alias("j"))


def runs(df: DataFrame, key: str, min_len: int = 1, bridge: int = 0) -> DataFrame:
    """(key, i, j): half-open index runs of true ``flag`` with at least ``min_len`` rows.

    ``df(key, idx, flag)``.  Gaps of at most ``bridge`` rows between two true rows are filled first; gaps at either
    end never are.
    """
    parts = _islands(df.select(key, "idx", "flag"), key)
    if bridge:
        w = Window.partitionBy(key)
        inner = (F.col("island") > F.min("island").over(w)) & (F.col("island") < F.max("island").over(w))
        filled = parts.withColumn("flag", F.col("flag") | (inner & (F.col("j") - F.col("i") <= bridge)))
        by = Window.partitionBy(key).orderBy("i")
        change = F.when(F.lag("flag").over(by) == F.col("flag"), 0).otherwise(1)
        parts = filled.withColumn("_c", change).withColumn("island", F.sum("_c").over(by)).groupBy(key, "island").agg(F.first("flag").alias("flag"), F.min("i").alias("i"), F.max("j").alias("j"))
    return parts.where("flag").where(F.col("j") - F.col("i") >= min_len).select(key, "i", "j")


def longest_run(found: DataFrame, key: str) -> DataFrame:
    """The longest run of each key, the earliest of equals."""
    return found.groupBy(key).agg(F.max_by(F.struct("i", "j"), F.struct(F.col("j") - F.col("i"), -F.col("i"))).alias("r")).select(key, "r.i", "r.j")


def last_run(found: DataFrame, key: str) -> DataFrame:
    """The last run of each key; its end is where the signal ends."""
    return found.groupBy(key).agg(F.max_by("j", "i").alias("j"), F.max("i").alias("i"))


def hot(df: DataFrame, key: str, value: str, share: float = 0.6) -> DataFrame:
    """``flag``: above the share of a key's range; a constant signal is never hot."""
    w = Window.partitionBy(key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("flag", F.col(value) > low + share * (high - low))


def evenly_spaced(df: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """``k`` rows of each key, evenly spaced with both ends (slot 0 to k-1); repeats where a key has fewer."""
    from sparkloom.functions.text import spread

    w = Window.partitionBy(key)
    rows = indexed(df, key, order).withColumn("_n", F.count("*").over(w).cast("int"))
    slots = F.filter(F.transform(spread(F.col("_n"), k), lambda x, s: F.struct(x.alias("x"), s.alias("slot"))), lambda e: e["x"] == F.col("idx"))
    return rows.withColumn("_s", F.explode(slots)).withColumn("slot", F.col("_s.slot")).drop("_s", "_n")


def interval_join(points: DataFrame, spans: DataFrame, key: str, t: str = "t", t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Points within [t0, t1) of a span with the same key.

    Both sides are joined by key and time bin, so points meet only the spans near them.  Bins are as wide as the mean
    span, but no span has more than about 1000.
    """
    size = spans.agg(F.avg(F.col(t1) - F.col(t0)).alias("mean"), F.max(F.col(t1) - F.col(t0)).alias("most")).first()
    width = max(float(size["mean"] or 0), float(size["most"] or 0) / 1000, 1e-9)
    bin_of = lambda c: F.floor(c / F.lit(width))
    placed = spans.where(F.col(t1) > F.col(t0)).withColumn("_bin", F.explode(F.sequence(bin_of(F.col(t0)), bin_of(F.col(t1)))))
    found = points.withColumn("_bin", bin_of(F.col(t))).join(placed, [key, "_bin"])
    return found.where((F.col(t) >= F.col(t0)) & (F.col(t) < F.col(t1))).drop("_bin")
