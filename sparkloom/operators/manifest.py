"""Manifests: description lines to bout windows, first-wins dedupe, vote, window acceptance, clip projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X

MAX_WINDOW = 300
MIN_VOTES, MARGIN = 2, 2
SEARCH_TAIL = 45
#: Limits of the acceptance chain, in seconds and shares.
BANNER_LATE, BANNER_SPAN, CAPTION_GUARD, MAX_SPAN, MIN_SPAN, MAX_CAPTION_GAP, MIN_PURITY = 12.0, 3.0, 8.0, 30.0, 8.0, 70.0, 0.90
FINISH_WHOLE = 5.0


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def bouts(descriptions: DataFrame) -> DataFrame:
    """(video, line_no, start, east, west) from whole description texts (video, text); first line per start."""
    lines = descriptions.select("video", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = lines.withColumn("b", X.bout_line(F.col("line"))).where("b IS NOT NULL").select("video", "line_no", "b.*")
    return first_wins(rows, ["video", "start"], ["line_no"])


def lead_window(df: DataFrame, key: str, start: str, duration: str | None = None, most: float = MAX_WINDOW) -> DataFrame:
    """Adds n (position in the key) and end: the next start, the duration behind the last, clamped to ``most``.

    Rows whose end isn't behind their start go; the numbers of the others stay.
    """
    w = Window.partitionBy(key).orderBy(start)
    following = F.lead(start).over(w)
    rows = df.withColumns({"n": F.row_number().over(w), "end": F.coalesce(following, F.col(duration)) if duration else following})
    return rows.where(F.col("end") > F.col(start)).withColumn("end", F.least(F.col("end"), F.col(start) + most))


def manifest(playlists: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(tournament, video, n, start, end, east, west): a video in several playlists counts for the first."""
    videos = first_wins(playlists, ["video"], ["ord", "pos"])
    rows = bouts(descriptions).join(videos.select("tournament", "video", "duration"), "video")
    return lead_window(rows, "video", "start", "duration").select("tournament", "video", "n", "start", "end", "east", "west")


def without_bouts(playlists: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(tournament, video) of videos whose description has no bout line."""
    videos = first_wins(playlists, ["video"], ["ord", "pos"])
    return videos.join(bouts(descriptions), "video", "left_anti").select("tournament", "video")


def plurality(votes: DataFrame, keys: list[str], candidate: str, order: list[str], least: int = MIN_VOTES, margin: int = MARGIN) -> DataFrame:
    """(keys, candidate, votes, first): the candidate with the most votes, if enough and ahead of the runner-up.

    ``order`` is one sortable column list; ``first`` the least of its first column among the winner's votes.
    """
    counts = votes.where(F.col(candidate).isNotNull()).groupBy(*keys, candidate).agg(F.count("*").alias("votes"), F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("votes"), "_first")
    ranked = counts.withColumns({"_r": F.row_number().over(w), "_next": F.coalesce(F.lead("votes").over(w), F.lit(0))})
    won = ranked.where((F.col("_r") == 1) & (F.col("votes") >= least) & (F.col("votes") - F.col("_next") >= margin))
    return won.select(*keys, candidate, "votes", F.col("_first")[order[0]].alias("first"))


def caption_votes(reads: DataFrame, keys: list[str], fps: float, start: str) -> DataFrame:
    """(keys, kimarite, winner, votes, caption_t) from reader texts (keys, idx, text, start).

    The winner's name and the time come from the technique's first read.
    """
    hits = reads.withColumn("c", X.caption(F.col("text"))).where("c.technique IS NOT NULL")
    won = plurality(hits.select(*keys, "idx", F.col("c.technique").alias("kimarite")), keys, "kimarite", ["idx"])
    names = hits.select(*keys, "idx", start, F.col("c.winner").alias("winner"), F.col("c.technique").alias("kimarite"))
    rows = won.join(names, [*keys, "kimarite"]).where("idx = first")
    return rows.select(*keys, "kimarite", "winner", "votes", (F.col(start) + F.col("first") / fps).alias("caption_t"))


def search_tail(df: DataFrame, t: str, start: Column, end: Column, tail: float = SEARCH_TAIL) -> DataFrame:
    """Frames in the last ``tail`` seconds of a window."""
    return df.where((F.col(t) >= F.greatest(start, end - tail)) & (F.col(t) < end))


def accepted_window(df: DataFrame) -> DataFrame:
    """Adds t0, t1, span, gap, reason (null: accepted).  ``df(run_start, run_end, banner, caption_t, purity)``, nulls
    where none.

    No run; then a banner up to 12 s into the run gives the sharper start; the end keeps away from the caption; a long
    run loses its beginning; what is left must be long, near the caption and pure.  Reasons: ``no_run``,
    ``short_span`` (seconds in span), ``far_from_caption`` (seconds in gap), ``unread``, ``impure`` (share in purity).
    """
    run0, run1, banner, cap = (F.col(c) for c in ("run_start", "run_end", "banner", "caption_t"))
    sharp = banner.isNotNull() & (banner - run0).between(0.0, BANNER_LATE) & (run1 - banner >= BANNER_SPAN)
    t1 = F.least(run1, cap - CAPTION_GUARD)
    t0 = F.greatest(F.when(sharp, banner).otherwise(run0), t1 - MAX_SPAN)
    rows = df.withColumns({"t0": t0, "t1": t1}).withColumns({"span": F.col("t1") - F.col("t0"), "gap": cap - F.col("t0")})
    checks = [
        ("no_run", run0.isNull() | run1.isNull()),
        ("short_span", F.col("span") < MIN_SPAN),
        ("far_from_caption", F.col("gap") > MAX_CAPTION_GAP),
        ("unread", F.col("purity").isNull()),
        ("impure", F.col("purity") < MIN_PURITY),
    ]
    return rows.withColumn("reason", F.coalesce(*(F.when(failed, F.lit(code)) for code, failed in checks)))


def finish_span(df: DataFrame, length: float, tail: float = 0.0) -> DataFrame:
    """Adds f0, f1: the last ``length`` seconds of [t0, t1 - tail); all of it if that is under 5 seconds."""
    end = F.col("t1") - tail
    return df.withColumns({"f0": F.when(end - F.col("t0") < FINISH_WHOLE, F.col("t0")).otherwise(end - length), "f1": end})


def located(df: DataFrame) -> DataFrame:
    """Rows with a window and a clip."""
    cols = ("bout_start", "bout_end", "clip")
    return df.where(" AND ".join(f"{c} IS NOT NULL AND CAST({c} AS string) <> ''" for c in cols))


def drop_reasons(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows by reason, kept ones among them: nothing vanishes uncounted."""
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias(reason)).agg(F.count("*").alias("n"))


def miss_rate(df: DataFrame, missed: Column, alarm: float = 0.2) -> DataFrame:
    """(n, missed, rate, alarm) over all rows."""
    hits = df.agg(F.count("*").alias("n"), F.sum(missed.cast("int")).cast("bigint").alias("missed"))
    return hits.withColumn("rate", F.try_divide("missed", "n")).withColumn("alarm", F.col("rate") > alarm)
