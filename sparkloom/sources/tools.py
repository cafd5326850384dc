"""Interfaces to external programs and encoders.  None is needed by the engine; each is a stage over a DataFrame.

A tool is a function of one row's fields; it runs on executors in Arrow batches, and its failure is a value (reason),
not an exception.
"""

from __future__ import annotations

import shutil
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_tool(df: DataFrame, tool: Callable[..., object], columns: list[str], out: str) -> DataFrame:
    """Adds ``out`` (string) and ``reason``: what ``tool`` returns for the columns' values, or why it failed.

    Downloads, cuts, stills, frame decoding, probes of size and duration, and text recognition all take this form.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            results, reasons = [], []
            for row in b[columns].itertuples(index=False):
                try:
                    value = tool(*row)
                    results.append(None if value is None else str(value))
                    reasons.append("no output" if value is None else None)
                except (OSError, ValueError) as e:
                    results.append(None)
                    reasons.append(f"{type(e).__name__}: {e}")
            yield b.assign(**{out: results, "reason": reasons})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, `{out}` string, reason string")


def missing_tools(names: list[str]) -> list[str]:
    """Programs of a list that aren't on the driver's path, to be reported before a long run."""
    return [n for n in names if shutil.which(n) is None]


def page_texts(stills: DataFrame, together: Callable[[list], str], alone: Callable[[object], str], column: str, size: int = 32) -> DataFrame:
    """Adds ``text``: stills are read ``size`` at a time as form-feed separated pages; where the number of pages isn't
    that of the stills, or the run fails, they are read one by one, and one that fails has null."""

    def one(still: object) -> str | None:
        try:
            return alone(still)
        except (OSError, ValueError):
            return None

    def read(stills: list) -> list:
        try:
            parts = together(stills).removesuffix("\f").split("\f")
        except (OSError, ValueError):
            parts = []
        return parts if len(parts) == len(stills) else [one(s) for s in stills]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            stills = b[column].tolist()
            yield b.assign(text=[t for a in range(0, len(stills), size) for t in read(stills[a : a + size])])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stills.schema.fields)
    return stills.mapInPandas(run, f"{fields}, text string")


def dead(rows: DataFrame, key: str) -> DataFrame:
    """Ids of rows that a tool failed on, to be recorded so that no later run tries them."""
    return rows.where("reason IS NOT NULL").select(F.col(key).cast("string").alias(key)).distinct()


def thumbnails(rows: DataFrame, name: str, pixels: str, size: int) -> DataFrame:
    """(name, features): pixels of ``size`` bytes as standardised vectors; names that begin with ``probe_`` and short
    reads are skipped."""
    from sparkloom.functions.text import standardized

    whole = rows.where(~F.col(name).startswith("probe_") & (F.octet_length(pixels) == size))
    hexes = F.regexp_extract_all(F.hex(pixels), F.lit("[0-9A-F]{2}"), F.lit(0))
    numbers = F.transform(hexes, lambda x: F.conv(x, 16, 10).cast("double"))
    return whole.select(name, numbers.alias("_v")).select(name, standardized(F.col("_v")).alias("features"))


def remote(target: Column) -> Column:
    """Whether a target is a url rather than a file."""
    return target.rlike("^https?://")


def pages(text: Column, count: Column) -> Column:
    """Form-feed separated pages of one recognition run, as an array; null unless there are ``count``."""
    parts = F.split(F.regexp_replace(text, "\f$", ""), "\f")
    return F.when(F.size(parts) == count, parts)


def embed(frames: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], keys: list[str]) -> DataFrame:
    """(keys, features): an encoder, loaded once per task, over the patch matrix of each row; patches are averaged."""
    fields = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for b in batches:
            vectors = [np.asarray(encode(np.frombuffer(p, np.uint8))).mean(0).astype(np.float32).tolist() for p in b["pixels"]]
            yield b[keys].assign(features=vectors)

    return frames.mapInPandas(run, f"{fields}, features array<float>")


def restored(parameters: dict[str, np.ndarray], saved: dict[str, np.ndarray], expected: int) -> dict[str, np.ndarray]:
    """An encoder's parameters with those that loading lost (biases, say) put back from ``saved``; fails unless exactly
    ``expected`` of them are known and have the same shape, as a half-restored encoder gives vectors of another space."""
    known = [k for k, v in saved.items() if k in parameters and parameters[k].shape == v.shape]
    if len(known) != expected or len(saved) != expected:
        raise ValueError(f"{len(known)} of {len(saved)} saved parameters fit; {expected} must")
    return {**parameters, **saved}


def scene_cuts(log: Column) -> Column:
    """Seconds of scene cuts in a tool's log."""
    return F.transform(F.regexp_extract_all(log, F.lit(r"pts_time:([0-9.]+)"), F.lit(1)), lambda x: x.try_cast("double"))
