"""Feature sets: aligned concatenation, scaling, the logistic head, clustering, pixel signals."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.shipping import ship

from . import evaluation


def aligned(sets: list[DataFrame], key: str, features: str = "features") -> DataFrame:
    """(key, features) of several caches concatenated; fails if any name is missing from one of them."""
    out = sets[0].select(key, F.col(features).alias("_f0"))
    for i, s in enumerate(sets[1:], 1):
        out = out.join(s.select(key, F.col(features).alias(f"_f{i}")), key, "full_outer")
    parts = [F.col(f"_f{i}") for i in range(len(sets))]
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    return out.select(key, F.when(whole, F.concat(*parts)).otherwise(F.raise_error(F.concat(F.lit("caches hold different clips, e.g. "), F.col(key).cast("string")))).alias(features))


def repeated(df: DataFrame, times: int, features: str = "features") -> DataFrame:
    """The control without information: the same vector again and again."""
    return df.withColumn(features, F.concat(*[F.col(features)] * times))


def with_dim(df: DataFrame, dim: int, features: str = "features") -> DataFrame:
    """Fails unless every vector has the model's length."""
    return df.withColumn(features, F.when(F.size(features) == dim, F.col(features)).otherwise(F.raise_error(F.lit(f"features must have {dim} numbers"))))


def dimensions(df: DataFrame, key: str, features: str = "features") -> DataFrame:
    """(key, dim, x): one row per number."""
    return df.select(key, F.posexplode(features).alias("dim", "x"))


def scaler(train: DataFrame, features: str = "features") -> DataFrame:
    """One row (mean, std) of arrays: population deviation of the training rows only; 0 counts as 1."""
    each = train.select(F.posexplode(features).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    cols = F.sort_array(F.collect_list(F.struct("dim", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1.0)).alias("s"))))  # as long as a vector
    return each.agg(cols.alias("c")).select(F.transform("c", lambda c: c["m"]).alias("mean"), F.transform("c", lambda c: c["s"]).alias("std"))


def scaled(df: DataFrame, fitted: DataFrame, features: str = "features") -> DataFrame:
    rows = df.crossJoin(F.broadcast(fitted))  # one row
    centred = F.zip_with(features, "mean", lambda x, m: x - m)
    return rows.withColumn(features, F.zip_with(centred, "std", lambda x, s: x / s)).drop("mean", "std")


def centroids(df: DataFrame, label: str, features: str = "features") -> DataFrame:
    """(label, centroid): elementwise means."""
    each = df.select(label, F.posexplode(features).alias("dim", "x")).groupBy(label, "dim").agg(F.avg("x").alias("m"))
    return each.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda c: c["m"]).alias("centroid"))


def nearest(df: DataFrame, centres: DataFrame, key: str, label: str, features: str = "features") -> DataFrame:
    """(key, told, distance2): the nearest centroid, the smaller label of equals.  One row of centres per class."""
    table = centres.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), "centroid"))).alias("_c"))
    gap = lambda c: F.aggregate(F.zip_with(features, c["centroid"], lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, v: a + v)
    best = F.array_min(F.transform("_c", lambda c: F.struct(gap(c).alias("d"), c["label"].alias("label"))))
    return df.crossJoin(F.broadcast(table)).select(key, best["label"].alias("told"), best["d"].alias("distance2"))


# -- the head


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multinomial logistic regression: L2 with strength 1/C, balanced class weights; (classes, weights, offsets).

    Newton steps on the full objective sum(w * loss) + |W|^2 / (2C), the offset free.  Two classes have one vector W,
    here as its halves with opposite signs.
    """
    classes, t = np.unique(y, return_inverse=True)
    k, (n, d) = len(classes), x.shape
    w = n / (k * np.bincount(t))[t]
    z = np.hstack([x, np.ones((n, 1))])
    beta, ridge = np.zeros((d + 1, k)), np.full((d + 1, 1), (2 if k == 2 else 1) / c)
    ridge[-1] = 1e-10
    want = np.eye(k)[t]

    def loss(b: np.ndarray) -> float:
        s = z @ b
        top = s.max(1)
        return float((w * (np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(n), t])).sum() + (ridge * b * b).sum() / 2)

    now = loss(beta)
    for _ in range(steps):
        s = z @ beta
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = z.T @ (w[:, None] * (p - want)) + ridge * beta
        if np.abs(grad).max() < 1e-6 * n:
            break
        step = np.zeros_like(beta)
        for j in range(k):  # one block of the Hessian at a time, bounded above by p (1 - p) <= 1/4 + coupling
            h = (z * (w * np.maximum(p[:, j] * (1 - p[:, j]), 1e-6))[:, None]).T @ z + np.diag(ridge[:, 0])
            step[:, j] = np.linalg.solve(h, grad[:, j])
        rate = 1.0
        while loss(beta - rate * step) > now - 1e-4 * rate * (grad * step).sum() and rate > 1e-6:
            rate /= 2
        beta = beta - rate * step
        now = loss(beta)
    return classes, beta[:-1], beta[-1]


def predict_logistic(model: tuple, x: np.ndarray) -> np.ndarray:
    classes, weights, offsets = model
    return classes[np.argmax(x @ weights + offsets, axis=1)]


def _standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    std = x.std(0)
    return x.mean(0), np.where(std > 0, std, 1.0)


#: Rows that one task of :func:`fold_scores`, :func:`pool_scores` or :func:`ward_clusters` may get.
MAX_ROWS, MAX_WARD = 200_000, 400_000

#: Numbers that :func:`ward` has of pairs at once.
WARD_CELLS = 1 << 21


def _bounded(part: pd.DataFrame, most: int) -> pd.DataFrame:
    if len(part) > most:
        raise ValueError(f"{len(part)} rows in one set; {most} are the limit")
    return part


def fold_scores(df: DataFrame, folds: DataFrame, key: str, y: str, group: str, features: str = "features") -> DataFrame:
    """(fold, key, y, told): predictions of the head for every fold's rows, fitted on the others.

    Scaler and class weights are fitted on the training rows of each fold.  A fold's rows are the labelled set, a few
    thousand vectors: one task per fold.  Folds with under two training classes are skipped.
    """
    each = df.select(F.col(key).alias("key"), F.col(y).cast("string").alias("y"), F.col(features).alias("x"), group).join(folds, group)
    n = folds.agg(F.max("fold")).first()[0]
    ship(df.sparkSession)
    many = each.withColumn("test", F.explode(F.sequence(F.lit(0), F.lit(n))))
    kind = df.schema[key].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        test = int(_bounded(rows, MAX_ROWS)["test"].iloc[0])
        rows = rows.sort_values("key")
        train, held = rows[rows["fold"] != test], rows[rows["fold"] == test]
        if train["y"].nunique() < 2 or not len(held):
            return pd.DataFrame({"fold": [], "key": [], "y": [], "told": []}).astype({"fold": "int32"})
        x = np.stack(train["x"]).astype(float)
        mean, std = _standard(x)
        model = fit_logistic((x - mean) / std, train["y"].to_numpy())
        told = predict_logistic(model, (np.stack(held["x"]).astype(float) - mean) / std)
        return pd.DataFrame({"fold": np.int32(test), "key": held["key"], "y": held["y"], "told": told})

    return many.drop(group).groupBy("test").applyInPandas(run, f"fold int, key {kind}, y string, told string")


def compared_sets(sets: dict[str, DataFrame], folds: DataFrame, key: str, y: str, group: str) -> DataFrame:
    """(set, fold, accuracy, balanced_accuracy, f1_macro): the same folds for every feature set, so that they pair."""
    out = None
    for name, df in sets.items():
        rows = fold_metrics(fold_scores(df, folds, key, y, group)).select(F.lit(name).alias("set"), "*")
        out = rows if out is None else out.union(rows)
    return out


def paired_sets(found: DataFrame, reference: str, value: str = "balanced_accuracy") -> DataFrame:
    """(set, mean, se, t, better, n, exact): each set against the reference, fold by fold."""
    rest = found.where(F.col("set") != reference)
    base = found.where(F.col("set") == reference).select("fold", value).crossJoin(F.broadcast(rest.select("set").distinct()))  # folds x sets
    return evaluation.paired_delta(base, rest.select("set", "fold", value), ["fold"], value, ["set"])


def fold_metrics(predictions: DataFrame) -> DataFrame:
    return evaluation.scores(predictions, "y", "told", ["fold"])


def pool_scores(df: DataFrame, pools: DataFrame, y: str, group: str, features: str = "features") -> DataFrame:
    """(draw, size, balanced_accuracy) of leave-one-group-out in each pool of groups; null without any usable fold.

    ``pools(draw, size, group)``.
    """
    ship(df.sparkSession)
    rows = df.select(group, F.col(y).cast("string").alias("y"), F.col(features).alias("x")).join(pools, group).select("draw", "size", F.col(group).cast("string").alias("g"), "y", "x")

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        truth, told = [], []
        _bounded(pool, MAX_ROWS)
        x, t, g = np.stack(pool["x"]).astype(float), pool["y"].to_numpy(), pool["g"].to_numpy()
        for held in np.unique(g) if len(np.unique(g)) > 1 else []:
            train = g != held
            if len(np.unique(t[train])) < 2:
                continue
            mean, std = _standard(x[train])
            told.append(predict_logistic(fit_logistic((x[train] - mean) / std, t[train]), (x[~train] - mean) / std))
            truth.append(t[~train])
        score = None
        if truth:
            a, b = np.concatenate(truth), np.concatenate(told)
            score = float(np.mean([(b[a == k] == k).mean() for k in np.unique(a)]))
        return pd.DataFrame({"draw": [pool["draw"].iloc[0]], "size": [pool["size"].iloc[0]], "balanced_accuracy": [score]})

    return rows.groupBy("draw", "size").applyInPandas(run, "draw int, size int, balanced_accuracy double")


def head_pipeline(classes: int, rows: int, c: float = 1.0):
    """The head as a spark.ml estimator on column ``scaled`` with weights ``weight``, for large training sets."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", regParam=1 / (c * rows), elasticNetParam=0.0, standardization=False, maxIter=3000, family="multinomial" if classes > 2 else "auto")


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """Adds weight = n / (classes * n of the class)."""
    counts = df.groupBy(y).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    table = counts.crossJoin(F.broadcast(total)).select(y, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(table, y)


# -- clustering


def _nearest(rows: np.ndarray, c: np.ndarray, norm: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The cluster with which each of ``rows`` merges at the least cost; clusters with an infinite norm are gone."""
    out, step, share = np.empty(len(rows), np.int64), max(16, WARD_CELLS // len(c)), 1 / w
    for a in range(0, len(rows), step):
        at = rows[a : a + step]
        gap = (-2 * c[at]) @ c.T
        gap += norm
        gap += norm[at, None]
        np.maximum(gap, 0, out=gap)
        gap /= share[at, None] + share
        gap[np.arange(len(at)), at] = np.inf
        out[a : a + step] = gap.argmin(1)
    return out


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Ward clusters, numbered by first row.

    Clusters that are each other's nearest merge in Ward's tree whatever else merges before, so all such pairs merge at
    once, and the tree is cut by the cost of its merges, copies first.  Clusters that merged, or whose nearest
    did, look again.  Memory grows with the vectors, not with pairs.
    """
    n = len(x)
    k = max(1, min(k, n))
    if not np.isfinite(x).all():
        raise ValueError("vectors must be finite")
    met: dict[bytes, int] = {}
    first = np.array([met.setdefault(blake2b((v + 0.0).tobytes(), digest_size=16).digest(), i) for i, v in enumerate(x)])  # + 0.0: one zero
    del met
    copies = np.flatnonzero(first != np.arange(n))
    copies = copies[np.argsort(first[copies], kind="stable")]
    merges = [(np.zeros(len(copies)), first[copies], copies)]  # cost, row that stays, row that joins it
    name, w = np.unique(first, return_counts=True)
    c, w, done = x[name].astype(float, copy=False), w.astype(float), np.zeros(len(name))
    norm = np.einsum("ij,ij->i", c, c)
    best, stale, left, most = np.zeros(len(name), np.int64), np.ones(len(name), bool), len(name), len(name)
    while left > 1:
        todo = np.flatnonzero(stale)[:most]
        best[todo] = _nearest(todo, c, norm, w)
        stale[todo] = False
        live = np.flatnonzero((norm < np.inf) & ~stale)
        i = live[(best[best[live]] == live) & ~stale[best[live]] & (live < best[live])]
        if not len(i) and stale.any():
            most *= 2
            continue
        most = max(16, 32 * len(i))  # where many have the same nearest, few pairs merge: then few look again
        j = best[i]
        if not len(i):  # equal costs in a ring, told apart by rounding
            cost = ((c[live] - c[best[live]]) ** 2).sum(1) / (1 / w[live] + 1 / w[best[live]])
            at = live[np.argmin(cost)]
            i, j = np.minimum(at, best[at])[None], np.maximum(at, best[at])[None]
        apart = c[j] - c[i]
        cost = np.maximum(np.einsum("ij,ij->i", apart, apart) / (1 / w[i] + 1 / w[j]), np.maximum(done[i], done[j]))
        merges.append((cost, name[i], name[j]))
        apart *= (w[j] / (w[i] + w[j]))[:, None]
        c[i] += apart
        del apart
        w[i] += w[j]
        done[i], norm[i], norm[j] = cost, np.einsum("ij,ij->i", c[i], c[i]), np.inf
        left -= len(i)
        moved = np.zeros(len(c), bool)
        moved[i] = moved[j] = True
        stale = (stale | moved[best] | moved) & (norm < np.inf)
        if left < 0.8 * len(c):
            keep = norm < np.inf
            to = np.cumsum(keep) - 1
            c, w, norm, done, name, best, stale = c[keep], w[keep], norm[keep], done[keep], name[keep], to[best[keep]], stale[keep]
    cost, kept, joined = (np.concatenate(v) for v in zip(*merges, strict=True))
    label = np.arange(n)
    for m in np.argsort(cost, kind="stable")[: n - k]:
        label[joined[m]] = kept[m]
    while (label[label] != label).any():
        label = label[label]
    return np.searchsorted(np.unique(label), label)


def ward_clusters(df: DataFrame, key: str, k: int = 24, features: str = "features", block: str | None = None) -> DataFrame:
    """(key, cluster) of Ward's agglomeration over normalised vectors, per ``block`` if given.

    Agglomeration looks at all pairs of a set, so a set is one task, whose time grows with the square of its rows and
    whose memory with its rows.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(features).alias("x"), (F.col(block) if block else F.lit(0)).cast("string").alias("block"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = _bounded(part, MAX_WARD).sort_values("key")
        x = np.stack(part.pop("x"), dtype=float, casting="unsafe")
        std = np.concatenate([x[a : a + 4096].std(1, keepdims=True) for a in range(0, len(x), 4096)])
        x -= x.mean(1, keepdims=True)
        x /= np.where(std > 0, std, 1.0)
        return pd.DataFrame({"block": part["block"], "key": part["key"], "cluster": ward(x, k).astype("int32")})

    return rows.groupBy("block").applyInPandas(run, f"block string, key {kind}, cluster int").select(*([F.col("block")] if block else []), F.col("key").alias(key), "cluster")


# -- pixels: ``frames(video, idx, t, h, w, pixels)``, uint8 RGB or grey, in Arrow batches


def frame_signal(frames: DataFrame, measure: Callable[[np.ndarray], float], channels: int = 3) -> DataFrame:
    """(video, idx, t, score): ``measure`` of every frame."""

    def run(batches):
        for b in batches:
            shape = (lambda h, w: (h, w, channels)) if channels > 1 else (lambda h, w: (h, w))
            s = [float(measure(np.frombuffer(p, np.uint8).reshape(shape(h, w)).astype(np.float32))) for p, h, w in zip(b["pixels"], b["h"], b["w"], strict=True)]
            yield pd.DataFrame({"video": b["video"], "idx": b["idx"], "t": b["t"], "score": s})

    ship(frames.sparkSession)
    return frames.select("video", "idx", "t", "h", "w", "pixels").mapInPandas(run, "video string, idx int, t double, score double")


# The colour of clay, how much of a column and of the frame it must fill, the band and edge limits.
CLAY_BRIGHT, CLAY_FLAT, CLAY_WARM, COLUMN_SHARE, FRAME_SHARE = 90, 0.55, 12, 0.15, 0.80
BAND, EDGE_LEAST = (0.72, 0.98), 4.0


def wide_share(frame: np.ndarray) -> float:
    """Share of the columns with clay on more than 15 % of their height.

    Clay falls from red over green to blue, so red is its brightness and red less blue its range, which must be warm
    but not saturated.
    """
    red, fall = frame[..., 0], frame[..., :-1] - frame[..., 1:]
    extent = fall.sum(-1)
    clay = (fall > 0).all(-1) & (red > CLAY_BRIGHT) & (extent > CLAY_WARM) & (extent < CLAY_FLAT * red)
    return float(np.mean(np.count_nonzero(clay, axis=0) / len(clay) > COLUMN_SHARE))


def is_wide(share: Column) -> Column:
    """Whether a frame with that share is a wide shot."""
    return share > FRAME_SHARE


def saturation(frame: np.ndarray) -> float:
    """Mean saturation, 1 - least / greatest channel, of the band where the banner appears: chroma, not brightness."""
    low, high = (int(edge * len(frame)) for edge in BAND)
    band = np.sort(frame[low:high].astype(float), axis=-1)
    return float(np.mean(1 - band[..., 0] / np.maximum(band[..., -1], 1e-6)))


def edge_energy(frame: np.ndarray) -> float:
    """Mean absolute horizontal gradient; captions have more than 4."""
    return float(np.abs(np.diff(frame, axis=1)).mean())


def overlay_score(frames: DataFrame) -> DataFrame:
    """(video, idx, t, score): mean distance of every grey frame from the video's median frame.

    The median needs all frames of one video at once: one task per video, its frames already cut to the overlay box.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        x = np.stack([np.frombuffer(p, np.uint8) for p in part["pixels"]]).astype(np.float32)
        return pd.DataFrame({"video": part["video"], "idx": part["idx"], "t": part["t"], "score": np.abs(x - np.median(x, axis=0)).mean(1).astype(float)})

    ship(frames.sparkSession)
    return frames.select("video", "idx", "t", "pixels").groupBy("video").applyInPandas(run, "video string, idx int, t double, score double")
