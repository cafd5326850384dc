"""Shared pieces: inputs, tables in the cluster's shared folder, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.shipping import ship
from sparkloom.sources.tables import shared_folder

#: White space of all word and text contracts here, as a character class.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_tables: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow``, with this package on the executors; a task gives freed memory back when it ends."""

    def run(batches):
        yield from function(batches)
        release()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def partition_key(place: np.ndarray) -> np.ndarray:
    """Whole numbers that ``repartition(n, key)`` deals to the partitions ``place``, one for each: Spark's hash of an int
    is a bijection of 32 bits, and this is its inverse.  Numbers dealt as they are would share partitions by chance."""
    bits = np.uint64(0xFFFFFFFF)

    def times(h: np.ndarray, factor: int) -> np.ndarray:  # inverse of h * factor
        return h * np.uint64(pow(factor, -1, 1 << 32)) & bits

    def turned(h: np.ndarray, n: int) -> np.ndarray:  # inverse of a rotation to the left
        return (h >> np.uint64(n) | h << np.uint64(32 - n)) & bits

    h = np.asarray(place).astype(np.uint64)
    h ^= h >> np.uint64(16)
    h = times(h, 0xC2B2AE35)
    h ^= (h >> np.uint64(13)) ^ (h >> np.uint64(26))
    h = times(h, 0x85EBCA6B)
    h ^= (h >> np.uint64(16)) ^ np.uint64(4)
    h = turned(times((h + np.uint64((1 << 32) - 0xE6546B64)) & bits, 5), 13) ^ np.uint64(42)
    h = times(turned(times(h, 0x1B873593), 15), 0xCC9E2D51)
    return h.astype(np.uint32).view(np.int32)


def release() -> None:
    """Workers live on between tasks; without this their allocator keeps the largest size they ever had."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU libc
    if trim:
        trim(0)


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors.

    The files go at the end of the driver, or earlier with :func:`dropped`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _tables[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a :func:`stored` table that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path in _tables:
        spark = _tables.pop(path)
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_tables.items()):
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: nothing left to do at exit
            return


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, component), component the least node reached.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is an aggregation with
    map-side combine and an equi-join that adaptive execution may split, so a hub needs no single task.
    Nulls and self-loops are ignored; nodes without an edge don't appear.  Every round is a stored table.
    """
    now = stored(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stored(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = stored(small)
        dropped(now)
        dropped(large)
        now, before = after, mark
        mark = _mark(now)
        if mark == before:
            break
    leaves = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return leaves.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)


def held_out(modulus: int, rest: int, doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod ``modulus`` is ``rest``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == rest, F.lit(False))


#: Longest text of a labelled sample, and characters of all its texts together, about.
SAMPLE_LONGEST, SAMPLE_CHARS = 200_000, 32_000_000


def training_sample(rows: DataFrame, docs: DataFrame, limit: int, seed: int, by: str | None = None, least: int = 1, more: tuple[str, ...] = ()):
    """About ``limit`` of the labelled ``rows(doc_id, ...)`` with their texts, as a pandas frame on the driver.

    Rows come by hash of doc_id, alike at every size: fewer than ``limit`` if their texts would be longer than
    SAMPLE_CHARS together.  Rows without doc_id or text, and texts over SAMPLE_LONGEST, aren't in the sample.
    With a label ``by``, both bounds are dealt evenly to its values, none of which gets under about ``least`` rows
    (or all it has): every value that has a text is in the sample, however large the table.  ``more`` are other
    columns of ``docs`` that come with the texts.
    """
    rows = rows.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = docs.select("doc_id", "text", *more).where(F.length("text") <= SAMPLE_LONGEST)
    if by:
        return _sample_by(rows, texts, limit, seed, by, least)
    total = max(1, rows.count())
    low = int(min(1.0, limit / total) * (1 << 30))
    rows = rows.withColumn("_h", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))).where(F.col("_h") < low)
    found = stored(texts.join(F.broadcast(rows), "doc_id"))  # the sample's labels: about ``limit`` rows
    chars = found.agg(F.sum(F.length("text"))).first()[0] or 0
    out = found.where(F.col("_h") < int(low * min(1.0, SAMPLE_CHARS / max(1, chars)))).drop("_h").toPandas()
    dropped(found)
    return out.sort_values("doc_id", kind="stable").drop_duplicates("doc_id").reset_index(drop=True)


def _sample_by(rows: DataFrame, texts: DataFrame, limit: int, seed: int, by: str, least: int):
    """The rows of least hash of every value: thresholds by value cut the table down, ranks of what is left do the rest."""
    count = rows.groupBy(by).agg(F.count("*").alias("_n"))
    values = max(1, count.count())
    each = max(least, limit // values)
    count = count.withColumn("_low", F.least(F.lit(1.0), F.lit(2.0 * each) / F.col("_n")) * (1 << 30))
    rows = rows.withColumn("_h", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))).join(F.broadcast(count), by).where("_h < _low").drop("_n", "_low")
    order = Window.partitionBy(by).orderBy("_h", "doc_id")  # about 2 * each rows of a value
    rows = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each).drop("_rank")
    found = stored(texts.join(F.broadcast(rows), "doc_id").dropDuplicates(["doc_id"]))
    so_far = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = found.withColumns({"_chars": so_far, "_rank": F.row_number().over(order)}).where((F.col("_rank") == 1) | (F.col("_chars") <= SAMPLE_CHARS // values))
    out = kept.drop("_h", "_chars", "_rank").toPandas()
    dropped(found)
    return out.sort_values("doc_id", kind="stable").reset_index(drop=True)
