"""The fitted head: fit on all rows, save and load with its metadata, predict with margins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluation
from . import features as vectors
from .features import fit_logistic


#: Rows up to which the head is fitted on the driver; spark.ml fits larger sets.
DRIVER_ROWS = 20_000
_MODEL = "label string, weights array<double>, offset double, mean array<double>, std array<double>, dim int"


def fit_head(df: DataFrame, y: str, features: str = "features", least: int = 0) -> DataFrame:
    """One row per class (label, weights, offset, mean, std, dim): scaler and head fitted on all labelled rows.

    Up to DRIVER_ROWS rows by Newton steps on the driver, more by spark.ml; the objective is the same.
    """
    rows = evaluation.rare_fold(df.select(F.col(y).cast("string").alias("y"), F.col(features).cast("array<double>").alias("x")), "y", least)
    some = rows.limit(DRIVER_ROWS + 1).toPandas()
    if len(some) > DRIVER_ROWS:
        return fit_large(rows)
    if some["y"].nunique() < 2:
        raise ValueError("a head needs two classes")
    x = np.stack(some["x"]).astype(float)
    mean, std = x.mean(0), x.std(0)
    std = np.where(std > 0, std, 1.0)
    classes, weights, offsets = fit_logistic((x - mean) / std, some["y"].to_numpy())
    out = [(str(c), weights[:, k].tolist(), float(offsets[k]), mean.tolist(), std.tolist(), x.shape[1]) for k, c in enumerate(classes)]
    return df.sparkSession.createDataFrame(out, _MODEL)


def fit_large(rows: DataFrame) -> DataFrame:
    """:func:`fit_head` of ``rows(y, x)`` by spark.ml."""
    from pyspark.ml.functions import array_to_vector

    spark = rows.sparkSession
    classes = sorted(r.y for r in rows.select("y").distinct().collect())  # labels
    if len(classes) < 2:
        raise ValueError("a head needs two classes")
    fitted = vectors.scaler(rows, "x")
    scale = fitted.first()
    weighted = vectors.class_weights(vectors.scaled(rows, fitted, "x"), "y")
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("y")) - 1
    ready = weighted.select(array_to_vector("x").alias("scaled"), number.cast("double").alias("label"), "weight")
    model = vectors.head_pipeline(len(classes), rows.count()).fit(ready)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    if len(classes) == 2:  # one vector for the second class
        w, b = np.vstack([-w[0], w[0]]) / 2, np.array([-b[0], b[0]]) / 2
    out = [(c, w[k].tolist(), float(b[k]), list(scale["mean"]), list(scale["std"]), w.shape[1]) for k, c in enumerate(classes)]
    return spark.createDataFrame(out, _MODEL)


def save_head(model: DataFrame, path: str, **meta: str) -> None:
    """Parquet for the numbers, one JSON row for what they belong to."""
    model.coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    info = model.agg(F.first("dim").alias("dim"), F.sort_array(F.collect_list("label")).alias("labels"))
    info.select("*", *(F.lit(v).alias(k) for k, v in meta.items())).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_head(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/model")


def predict(df: DataFrame, model: DataFrame, key: str, features: str = "features", k: int = 3) -> DataFrame:
    """(key, label, p, rank, low_margin): the best ``k`` classes of each row; fails on vectors of another length."""
    rows = model.orderBy("label").collect()  # one row per class
    labels, w = [r.label for r in rows], np.array([r.weights for r in rows])
    b, mean, std, dim = np.array([r.offset for r in rows]), np.array(rows[0].mean), np.array(rows[0].std), rows[0].dim

    @F.pandas_udf("array<double>")
    def shares(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        if any(len(v) != dim for v in x):
            raise ValueError(f"features must have {dim} numbers")
        s = (np.stack(x).astype(float) - mean) / std @ w.T + b
        p = np.exp(s - s.max(1, keepdims=True))
        return pd.Series(list(p / p.sum(1, keepdims=True)))

    each = df.select(key, F.posexplode(shares(features)).alias("i", "p"))
    named = each.select(key, F.get(F.array(*map(F.lit, labels)), F.col("i")).alias("label"), "p")
    return evaluation.top_k(named, key, "label", "p", k)
