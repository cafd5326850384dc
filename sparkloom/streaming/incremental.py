"""Structured Streaming: resumable stages, sessions, the minimum-gap rule on unbounded input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def run_stage(spark: SparkSession, source: str, schema, stage: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, done: str | None = None, key: str | None = None) -> int:
    """Processes the files of ``source`` that no earlier run has, appends ``stage``'s rows to ``sink``; returns rows.

    The checkpoint is the list of what is done; a batch is recorded only once its sink is written.  Each batch's
    folder is overwritten if it is run again, so a crash neither loses nor repeats rows.  ``done`` gets the keys.
    """
    written = 0

    def write(batch: DataFrame, number: int) -> None:
        nonlocal written
        out = stage(batch)
        out.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        written += spark.read.parquet(f"{sink}/batch={number}").count()
        if done and key:
            batch.select(F.col(key).cast("string")).distinct().write.mode("overwrite").text(f"{done}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return written


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Zone-less timestamps as timestamps (UTC session), as watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def sessions(df: DataFrame, key: str, ts: str, gap: str, late: str = "1 day") -> DataFrame:
    """(key, start, end, n): sessions by inactivity; late rows beyond the watermark are dropped in a stream."""
    rows = event_time(df, ts)
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    found = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_min_gap(df: DataFrame, key: str, t: str, gap: float) -> DataFrame:
    """(key, t): accepted onsets of an unbounded stream; the state of a key is its last accepted one.

    Rows of a key must not arrive before rows of earlier batches; within a batch they are sorted.
    """
    kind = df.schema[key].dataType.simpleString()

    def accept(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for x in sorted(x for part in parts for x in part[t].tolist()):
            if last is None or x - last >= gap:
                out.append(x)
                last = x
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(out), t: out})

    return df.select(key, F.col(t).cast("double").alias(t)).groupBy(key).applyInPandasWithState(accept, f"`{key}` {kind}, `{t}` double", "last double", "append", GroupStateTimeout.NoTimeout)
