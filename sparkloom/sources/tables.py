"""Text, CSV, JSON and Parquet tables of the pipeline, all with explicit schemas."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as X

BOUTS = "tournament string, video string, n int, start int, end int, east string, west string"
LABELS = f"{BOUTS}, kimarite string, winner string, votes int, caption_t double, clip string, bout_start double, bout_end double"
CLUSTER_LABELS = "cluster int, n int, kimarite string, example string"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset on a single machine (tests), an own one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header; blank fields are null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """``png,cluster`` lines without a header; lines without a comma go."""
    part = F.split("value", ",", 2)
    return spark.read.text(path).where(F.col("value").contains(",")).select(part[0].alias("png"), part[1].try_cast("int").alias("cluster"))


def read_ids(spark: SparkSession, path: str, name: str = "video") -> DataFrame:
    """Ids separated by white space; a missing file is an empty set."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{name} string")
    return lines.select(F.explode(F.split(F.trim("value"), r"\s+")).alias(name)).where(F.col(name) != "").distinct()


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """(video, duration) of ``id|duration`` lines."""
    return spark.read.text(path).select(X.listing(F.col("value")).alias("v")).where("v IS NOT NULL").select("v.*")


def read_descriptions(spark: SparkSession, path: str, pattern: str = r"([^/]+?)\.[^./]*$") -> DataFrame:
    """(video, text) of whole description files; broken UTF-8 is replaced; the id comes from the file name."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", pattern, 1).alias("video"), X.utf8(F.col("content")).alias("text"))


def read_files(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path, length) of files below a folder by extension; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length").where(F.lower("path").rlike(rf"\.({'|'.join(extensions)})$"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(label, name, features, video) of a cache partitioned by label; fails without rows."""
    rows = spark.read.parquet(path)
    if rows.isEmpty():
        raise ValueError(f"no vectors in {path}")
    return rows.select("label", "name", "features", X.group_of(F.col("name")).alias("video"))


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("label").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Appends; older files lack newer columns, so readers merge schemas."""
    df.write.mode("append").parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def replace_version(df: DataFrame, path: str, version: int) -> str:
    """Writes a new version beside the others, so the one before stays as it was; returns its path."""
    out = f"{path}/v={version}"
    df.write.mode("errorifexists").parquet(out)
    return out


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_ids(df: DataFrame, path: str) -> None:
    """Adds a one-column table of ids to a state set."""
    df.select(F.col(df.columns[0]).cast("string")).write.mode("append").text(path)


def relabelled(crops: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """Crops by cluster with the clusters' names: moved rows, and those dropped for want of a technique, by reason.

    ``crops(png, cluster)``, ``names(cluster, kimarite)``: a blank name drops its cluster; others are normalised, and
    results that are no techniques are counted apart.
    """
    from sparkloom.functions import vocabulary

    dim = vocabulary.taxonomy(crops.sparkSession)
    rows = crops.join(names, "cluster", "left").withColumn("name", X.normalize(F.col("kimarite")))
    rows = rows.join(F.broadcast(dim.select("name", "family", "is_technique")), "name", "left")
    reason = F.when(F.coalesce(F.trim("kimarite"), F.lit("")) == "", "unnamed cluster").when(F.col("name").isNull(), "unknown name").when(~F.col("is_technique"), "not a technique")
    rows = rows.withColumn("reason", reason)
    return {"moved": rows.where("reason IS NULL").select("png", "cluster", "name", "family"), "dropped": rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))}
