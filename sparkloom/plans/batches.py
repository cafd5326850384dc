"""What to do next: resumable anti-joins, batches dealt in turn, disk gates, derived scales."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GB_PER_VIDEO, RESERVE_GB = 0.19, 5.0
#: Ids that names may be searched for one by one.
MAX_IDS = 10_000


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't done."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def union_of(*sets: DataFrame) -> DataFrame:
    """Ids in any of several one-column sets."""
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct()


def of_batch(rows: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    return rows.join(batch.select(key).distinct(), key, "left_semi")


def matching(files: DataFrame, ids: DataFrame, name: str, ident: str, pattern: str | None = None) -> DataFrame:
    """Files whose name contains an id, the first by name for each id.

    With a ``pattern`` that extracts the id from a name, the join is an equi-join; without, every name is searched for
    each id, of which there may be MAX_IDS.
    """
    if pattern:
        found = files.withColumn("_id", F.regexp_extract(name, pattern, 1)).join(ids.select(ident), F.col("_id") == F.col(ident)).drop("_id")
    else:
        if ids.limit(MAX_IDS + 1).count() > MAX_IDS:
            raise ValueError(f"more than {MAX_IDS} ids: give a pattern that extracts them from names")
        found = files.join(F.broadcast(ids.select(ident)), F.col(name).contains(F.col(ident)))
    w = Window.partitionBy(ident).orderBy(name)
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def round_robin(rows: DataFrame, group: str, order: list[str], last: Column | None = None) -> DataFrame:
    """Adds position: one row of each group in turn, groups by first appearance; rows that are ``last`` come after."""
    late = F.coalesce(last, F.lit(False)) if last is not None else F.lit(False)
    rows = rows.withColumn("_late", late.cast("int"))
    first = rows.groupBy("_late", group).agg(F.min(F.struct(*order)).alias("_first"))
    turn = F.row_number().over(Window.partitionBy("_late", group).orderBy(*order))
    dealt = rows.withColumn("_turn", turn).join(first, ["_late", group])
    # positions: rows of earlier turns, then groups of this turn that appear before; counted per turn, not in one sort
    per_turn = dealt.groupBy("_late", "_turn").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_late", "_turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per_turn.select("_late", "_turn", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_late", "_turn").orderBy("_first"))
    return dealt.withColumn("_inside", inside).join(starts, ["_late", "_turn"]).withColumn("position", F.col("_before") + F.col("_inside")).drop("_late", "_first", "_turn", "_before", "_inside")


def next_batch(rows: DataFrame, size: int, position: str = "position") -> DataFrame:
    """The first ``size`` rows of a dealt order, with how many are left behind them."""
    total = rows.agg(F.count("*").alias("_all"))
    return rows.where(F.col(position) <= size).crossJoin(F.broadcast(total)).withColumn("remaining", F.greatest(F.col("_all") - size, F.lit(0))).drop("_all")  # one row


def first_rows(rows: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first ``n`` rows in an explicit order; all of them without a limit."""
    return rows if n is None else rows.orderBy(*order).limit(n)


def in_name(rows: DataFrame, column: str, part: str | None) -> DataFrame:
    """Rows whose id contains ``part``; all without one."""
    return rows if not part else rows.where(F.col(column).contains(part))


def with_dims(rows: DataFrame, dims: DataFrame, key: str) -> DataFrame:
    """Adds the frame size (w, h) of each row's source from a table that has each source once; null if unknown."""
    return rows.join(dims.groupBy(key).agg(F.min(F.struct("w", "h")).alias("_d")).select(key, "_d.w", "_d.h"), key, "left")


def run_batches(plan: Callable[[], DataFrame], work: Callable[[DataFrame], object], batches: int, size: int, dry_run: bool = False) -> list[dict]:
    """Plans anew before every batch, as the one before took rows out; ends when nothing is left.

    ``plan()`` gives the rows to do with their position.  Returns {n, remaining, seconds} per batch; a dry run only
    plans the first.
    """
    done = []
    for number in range(1, batches + 1):
        batch = next_batch(plan(), size)
        count = batch.agg(F.count("*").alias("n"), F.max("remaining").alias("remaining")).first()
        if not count["n"]:
            break
        entry = {"n": count["n"], "remaining": count["remaining"], "seconds": 0.0}
        done.append(entry)
        if dry_run:
            break
        entry["seconds"] = timed(batch.sparkSession, f"batch {number} of {batches}", lambda batch=batch: work(batch.drop("remaining")))
    return done


def timed(spark: SparkSession, name: str, stage: Callable[[], object]) -> float:
    """Runs a stage under a job description; its seconds."""
    spark.sparkContext.setJobDescription(name)
    began = time.monotonic()
    try:
        stage()
    finally:
        spark.sparkContext.setJobDescription(None)
    return time.monotonic() - began


def disk_gate(rows: DataFrame, free_gb: float) -> DataFrame:
    """(n, need_gb, ok): whether the batch fits and leaves the reserve."""
    need = F.count("*") * F.lit(GB_PER_VIDEO)
    return rows.agg(F.count("*").alias("n"), need.alias("need_gb"), (F.lit(free_gb) - need >= RESERVE_GB).alias("ok"))


def scale_dir(scale: Column, overrides: dict[str, str]) -> Column:
    names = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv]) if overrides else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(names, scale), F.concat(F.lit("fin"), scale))


def scale_windows(clips: DataFrame, scales: list[float], duration: str = "duration") -> DataFrame:
    """One row per clip and scale: the last ``scale`` seconds."""
    rows = clips.withColumn("scale", F.explode(F.array(*map(F.lit, scales))))
    return rows.withColumns({"t0": F.greatest(F.lit(0.0), F.col(duration) - F.col("scale")), "t1": F.col(duration)})


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with those of the same keys replaced; columns of either side are kept."""
    return pending(old, new, keys).unionByName(new, allowMissingColumns=True)


def fresh(cache: DataFrame, current: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Cached rows whose version is still the current one."""
    return cache.join(current.select(*keys, version).distinct(), [*keys, version], "left_semi")


def committed_pairs(df: DataFrame, *flags: str) -> DataFrame:
    """Rows all of whose outputs succeeded: both or neither."""
    return df.where(" AND ".join(flags))
