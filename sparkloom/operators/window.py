"""Locating a bout in its window: wide shots, the banner, the acceptance chain, from per-frame signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import features, manifest, signal

#: Frames a second; seconds that a wide shot and a banner must last; the banner's share of the saturation range.
FPS, WIDE_RUN, BANNER_RUN, BANNER_SHARE = 4.0, 2.5, 3.0, 0.6


def searched(signals: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """The frames of each window from its start up to the caption less its guard, numbered (idx) from 0.

    ``signals(keys, t, share, saturation)``, ``windows(keys, start, caption_t)``.
    """
    rows = signals.join(windows.select(*keys, "start", "caption_t"), keys)
    rows = rows.where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("caption_t") - manifest.CAPTION_GUARD))
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("t")) - 1)


def located_windows(signals: DataFrame, windows: DataFrame, key: str, fps: float = FPS) -> DataFrame:
    """(key, start, caption_t, run_start, run_end, banner, purity, t0, t1, span, gap, reason), a row for every window.

    The run is the longest stretch of wide shots, the banner's end that of the last stretch of high saturation, the
    purity the share of wide shots in the window chosen.  Times are the frames' places over ``fps``.
    """
    frames = searched(signals, windows, [key]).select(key, "idx", "start", features.is_wide(F.col("share")).alias("wide"), "saturation")
    wide = signal.longest_run(signal.runs(frames.select(key, "idx", F.col("wide").alias("flag")), key, int(-(-fps * WIDE_RUN // 1))), key)
    hot = signal.hot(frames, key, "saturation", BANNER_SHARE)
    shown = signal.last_run(signal.runs(hot.select(key, "idx", "flag"), key, int(-(-fps * BANNER_RUN // 1))), key)
    place = lambda c: F.col("start") + F.col(c) / fps
    rows = windows.join(wide.select(key, "i", "j"), key, "left").join(shown.select(key, F.col("j").alias("b")), key, "left")
    rows = rows.select(key, "start", "caption_t", place("i").alias("run_start"), place("j").alias("run_end"), place("b").alias("banner"))
    chosen = manifest.accepted_window(rows.withColumn("purity", F.lit(1.0))).select(key, "t0", "t1")
    inside = frames.join(chosen, key).where((place("idx") >= F.col("t0")) & (place("idx") < F.col("t1")))
    purity = inside.groupBy(key).agg(F.avg(F.col("wide").cast("int")).alias("purity"))
    return manifest.accepted_window(rows.join(purity, key, "left"))


def multi_scale(embedded: DataFrame, key: str, scales: list[float]) -> DataFrame:
    """(key, features): the vectors of all scales of a clip, in their order, as one; fails if one is missing.

    ``embedded(key, scale, features)``, one row per clip and scale.
    """
    parts = embedded.groupBy(key).agg(*(F.any_value(F.when(F.col("scale") == s, F.col("features")), True).alias(f"_{i}") for i, s in enumerate(scales)))
    part = [F.when(F.col(f"_{i}").isNull(), F.raise_error(F.concat(F.lit(f"scale {s} is missing of "), F.col(key).cast("string")))).otherwise(F.col(f"_{i}")) for i, s in enumerate(scales)]
    return parts.select(key, F.concat(*part).alias("features"))
