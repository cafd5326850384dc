import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import evaluation as E
from sparkloom.operators import features as V
from sparkloom.operators import manifest as M
from sparkloom.operators import signal as S
from sparkloom.plans import batches as P


def test_min_gap_is_sequential(spark):
    df = spark.createDataFrame([("a", float(t)) for t in (31, 0, 5, 16, 20)], "k string, t double")
    assert sorted(r.t for r in S.min_gap(df, "k", "t", 15.0).collect()) == [0.0, 16.0, 31.0]
    rng = random.Random(1)
    rows = [(k, rng.uniform(0, 100)) for k in "xyz" for _ in range(40)]
    want = []
    for k in "xyz":
        last = None
        for t in sorted(t for q, t in rows if q == k):
            if last is None or t - last >= 7:
                want.append((k, t))
                last = t
    assert sorted((r.k, r.t) for r in S.min_gap(spark.createDataFrame(rows, "k string, t double"), "k", "t", 7.0).collect()) == want


def test_constant_signal_has_no_onsets(spark):
    df = spark.range(20).select(F.lit("v").alias("k"), F.col("id").cast("double").alias("t"), F.lit(3.0).alias("score"))
    assert S.robust_limits(df, "k", "score", 6.0).first().limit == 9.0
    assert S.onsets(df, "k", "t", "score", ["t"]).count() == 0 and S.hot(df, "k", "score").where("flag").count() == 0


def test_clip_spans(spark):
    got = S.clip_spans(spark.createDataFrame([("v", 5.1), ("v", 40.0)], "k string, t double"), "k", "t").collect()
    assert [(r.n, round(r.start, 3), round(r.end, 3)) for r in got] == [(1, 34.8, 39.8)]


def runs_by_hand(f, least, bridge):
    f, i = list(f), 0
    while bridge and i < len(f):
        j = i
        while j < len(f) and f[j] == f[i]:
            j += 1
        if not f[i] and 0 < i and j < len(f) and j - i <= bridge:
            f[i:j] = [True] * (j - i)
        i = j
    out, i = [], 0
    while i < len(f):
        j = i
        while j < len(f) and f[j] == f[i]:
            j += 1
        if f[i] and j - i >= least:
            out.append((i, j))
        i = j
    return out


def test_runs(spark):
    rng = random.Random(2)
    masks = {"m": [0, 1, 1, 0, 1, 1, 1, 0, 1], **{f"r{k}": [rng.random() < 0.5 for _ in range(40)] for k in range(20)}}
    df = spark.createDataFrame([(k, i, bool(f)) for k, m in masks.items() for i, f in enumerate(m)], "k string, idx int, flag boolean")
    for least, bridge in ((1, 0), (3, 0), (3, 2), (1, 1)):
        got = sorted((r.k, r.i, r.j) for r in S.runs(df, "k", least, bridge).collect())
        assert got == sorted((k, i, j) for k, m in masks.items() for i, j in runs_by_hand([bool(x) for x in m], least, bridge))
    best = {r.k: (r.i, r.j) for r in S.longest_run(S.runs(df, "k"), "k").collect()}
    assert best["m"] == (4, 7)
    assert {r.k: (r.i, r.j) for r in S.last_run(S.runs(df, "k"), "k").collect()}["m"] == (8, 9)


def test_lead_window(spark):
    df = spark.createDataFrame([("v", s, 900) for s in (0, 50, 400)] + [("w", 5, 10), ("w", 12, 10)], "video string, start int, duration int")
    got = sorted((r.video, r.n, r.start, r.end) for r in M.lead_window(df, "video", "start", "duration").collect())
    assert got == [("v", 1, 0, 50), ("v", 2, 50, 350), ("v", 3, 400, 700), ("w", 1, 5, 12)]


def test_manifest(spark):
    lists = spark.createDataFrame([("t7", 7, 0, "v", 900), ("t1", 1, 3, "v", 900), ("t1", 1, 4, "u", 60)], "tournament string, ord int, pos int, video string, duration int")
    texts = spark.createDataFrame([("v", "00:00 - Intro / Start\n01:55 - Ryuden vs Kotoeiho\n01:55 Copy vs Copy\n06:00 A vs B"), ("u", "nothing")], "video string, text string")
    got = [tuple(r) for r in M.manifest(lists, texts).orderBy("n").collect()]
    assert got == [("t1", "v", 1, 115, 360, "Ryuden", "Kotoeiho"), ("t1", "v", 2, 360, 660, "A", "B")]
    assert [tuple(r) for r in M.without_bouts(lists, texts).collect()] == [("t1", "u")]


@pytest.mark.parametrize("reads, want", [("kr", None), ("krr", None), ("rr", ("r", 2)), ("kkkrrr", None), ("krrr", ("r", 3)), ("", None)])
def test_plurality(spark, reads, want):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(reads)], "k int, idx int, c string")
    got = M.plurality(df, ["k"], "c", ["idx"]).first()
    assert (got and (got.c, got.votes)) == want


def test_caption_votes(spark):
    lines = ["KINBOZAN WINS BY OSHIDASHI", "junk", "Kinb0zan WINSBYOSHIDASHINe", "X"]
    df = spark.createDataFrame([("v", 1, i, t, 100.0) for i, t in enumerate(lines)], "video string, n int, idx int, text string, start double")
    got = M.caption_votes(df, ["video", "n"], 3.0, "start").first()
    assert (got.kimarite, got.winner, got.votes, got.caption_t) == ("oshidashi", "Kinbozan", 2, 100.0)


def test_acceptance_chain(spark):
    rows = [(0.0, 7.9, None, 30.0, 1.0), (0.0, 50.0, None, 80.0, 1.0), (0.0, 20.0, 5.0, 40.0, 1.0), (0.0, 20.0, -1.0, 40.0, 1.0), (0.0, 20.0, None, 100.0, 1.0), (0.0, 20.0, None, 40.0, 0.5), (None, None, None, 40.0, None), (0.0, 20.0, None, 40.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, run_start double, run_end double, banner double, caption_t double, purity double")
    got = {r.id: r for r in M.accepted_window(df).collect()}
    assert (got[0].reason, got[0].span) == ("short_span", 7.9)
    assert (got[1].t0, got[1].t1, got[1].reason) == (20.0, 50.0, None)
    assert got[2].t0 == 5.0 and got[3].t0 == 0.0 and got[2].reason is None
    assert (got[4].reason, got[4].gap) == ("far_from_caption", 100.0)
    assert (got[5].reason, got[5].purity, got[6].reason, got[7].reason) == ("impure", 0.5, "no_run", "unread")
    assert sum(r.n for r in M.drop_reasons(M.accepted_window(df)).collect()) == len(rows)


def test_finish_span(spark):
    df = spark.createDataFrame([(10.0, 14.9), (10.0, 15.5)], "t0 double, t1 double")
    assert [r.f0 for r in M.finish_span(df, 4.0).orderBy("t1").collect()] == [10.0, 11.5]
    assert M.finish_span(df, 6.0).where("t1 = 15.5").first().f0 == 9.5


def test_round_robin(spark):
    df = spark.createDataFrame([("A", 1), ("A", 2), ("A", 3), ("B", 4), ("C", 5), ("C", 6), ("N", 0)], "g string, v int")
    got = [r.v for r in P.round_robin(df, "g", ["v"], F.col("g") == "N").orderBy("position").collect()]
    assert got == [1, 4, 5, 2, 6, 3, 0]


def test_plans(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 9)], "k int, v string, w int")
    assert sorted(map(str, P.upsert(old, new, ["k"]).collect())) == ["Row(k=1, v='a', w=None)", "Row(k=2, v='c', w=9)"]
    assert P.fresh(old, old.where("k = 1"), ["k"], "v").count() == 1
    clips = spark.createDataFrame([(4.0,)], "duration double")
    assert sorted((r.t0, r.t1) for r in P.scale_windows(clips, [2.0, 6.0]).collect()) == [(0.0, 4.0), (2.0, 4.0)]
    assert [r[0] for r in spark.createDataFrame([("2",), ("x",)], "s string").select(P.scale_dir(F.col("s"), {"x": "y"})).collect()] == ["fin2", "y"]
    assert not P.disk_gate(spark.range(100), 23.0).first().ok and P.disk_gate(spark.range(10), 23.0).first().ok
    files = spark.createDataFrame([("b v1.mp4",), ("a v1.mp4",), ("v2.mp4",)], "f string")
    ids = spark.createDataFrame([("v1",), ("v3",)], "id string")
    assert [r.f for r in P.matching(files, ids, "f", "id").collect()] == ["a v1.mp4"]
    assert [r.f for r in P.matching(files, ids, "f", "id", "(v[0-9])").collect()] == ["a v1.mp4"]


def test_rare_fold(spark):
    df = spark.createDataFrame([(x,) for x in "aaab"] + [("other",)], "y string")
    assert sorted(r.y for r in E.rare_fold(df, "y", 2).collect()) == ["a", "a", "a", "other", "other"]
    assert E.rare_fold(df, "y", 0) is df


def test_scores_with_never_true_and_never_told_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "a"), ("b", "a")], "y string, p string")
    got = E.scores(df, "y", "p").first()
    assert got.accuracy == 0.25 and got.balanced_accuracy == 0.25 and abs(got.f1_macro - (2 / 5) / 3) < 1e-12
    table = {r.y: (r.p_a, r.p_b, r.p_c) for r in E.confusion(df, "y", "p", ["a", "b", "c"]).collect()}
    assert table == {"a": (1, 0, 1), "b": (2, 0, 0), "c": (0, 0, 0)}


def test_paired_delta(spark):
    a = spark.createDataFrame([(i, float(i)) for i in range(5)], "fold int, v double")
    exact = E.paired_delta(a, a.withColumn("v", F.col("v") + 1), ["fold"], "v").first()
    assert (exact.mean, exact.t, exact.exact, exact.better, exact.n) == (1.0, None, True, 5, 5)
    b = spark.createDataFrame([(i, float(2 * i)) for i in range(4)], "fold int, v double")
    got = E.paired_delta(a, b, ["fold"], "v").first()
    assert got.n == 4 and abs(got.t - 1.5 / (np.std([0, 1, 2, 3], ddof=1) / 2)) < 1e-9


def test_folds_and_pools(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 5), ("b", 3), ("c", 2), ("d", 2)) for i in range(n)], "g string, i int")
    assert {r.g: r.fold for r in E.group_folds(df, "g", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}
    pools = E.nested_pools(df, "g", 3, [1, 3])
    for d in range(3):
        small, large = ({r.g for r in pools.where(f"draw = {d} AND size = {s}").collect()} for s in (1, 3))
        assert len(small) == 1 and len(large) == 3 and small < large
    assert E.hold_out(df, "g").where("held_out").select("g").distinct().count() == 1
    assert E.leave_one_out(df, "g").count() == 48 and E.leave_one_out(df, "g").where("is_test").count() == 12


def test_permutation_test_is_extreme_for_perfect_predictions(spark):
    df = spark.createDataFrame([(g, i % 2, i % 2) for g in range(4) for i in range(20)], "g int, y int, p int")
    got = E.permutation_test(df, "y", "p", "g", 200).first()
    assert got.observed == 1.0 and abs(got.p_value - 1 / 201) < 1e-9 and got.z > 5


def test_top_k(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.36), (1, "c", 0.14), (2, "a", 0.9), (2, "b", 0.1)], "k int, l string, s double")
    got = [(r.k, r.l, r.low_margin) for r in E.top_k(df, "k", "l", "s", 2).orderBy("k", "rank").collect()]
    assert got == [(1, "a", True), (1, "b", True), (2, "a", False), (2, "b", False)]


def test_aligned_features(spark):
    a = spark.createDataFrame([("x", [1.0]), ("y", [2.0])], "name string, features array<double>")
    assert {r.name: r.features for r in V.aligned([a, a, a], "name").collect()} == {"x": [1.0] * 3, "y": [2.0] * 3}
    assert V.repeated(a, 3).first().features == [1.0] * 3
    with pytest.raises(Exception, match="different clips"):
        V.aligned([a, a.where("name = 'x'")], "name").collect()
    with pytest.raises(Exception, match="must have 2"):
        V.with_dim(a, 2).collect()


def test_scaler(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "features array<double>")
    assert sorted(r.features for r in V.scaled(df, V.scaler(df)).collect()) == [[-1.0, 0.0], [1.0, 0.0]]


def test_logistic_minimises_its_objective():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 4))
    y = (x @ rng.normal(size=(4, 3)) + rng.normal(size=(120, 3))).argmax(1)
    classes, w, b = V.fit_logistic(x, y)
    weight = len(y) / (3 * np.bincount(y))[y]
    p = np.exp(x @ w + b)
    p /= p.sum(1, keepdims=True)
    grad = x.T @ (weight[:, None] * (p - np.eye(3)[y])) + w
    assert np.abs(grad).max() < 1e-3 and (V.predict_logistic((classes, w, b), x) == y).mean() > 0.6


def test_fold_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], [float(v) for v in rng.normal(3 * (i % 2), 1, 3)], i // 2 % 6) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, y string, features array<double>, g int")
    told = V.fold_scores(df, E.group_folds(df, "g", 3), "id", "y", "g")
    assert told.count() == 120 and all(r.balanced_accuracy > 0.9 for r in V.fold_metrics(told).collect())
    pools = V.pool_scores(df, E.nested_pools(df, "g", 2, [1, 4]), "y", "g").collect()
    assert all((r.balanced_accuracy is None) == (r["size"] == 1) for r in pools) and len(pools) == 4


def test_ward():
    x = np.array([[0, 0], [0, 1], [10, 10], [10, 11], [50, 0]], float)
    assert V.ward(x, 3).tolist() == [0, 0, 1, 1, 2] and V.ward(x, 9).tolist() == [0, 1, 2, 3, 4] and V.ward(x, 1).tolist() == [0] * 5


def test_pixels(spark):
    clay = np.full((10, 20, 3), (200, 160, 120), np.uint8)
    half = clay.copy()
    half[:, 8:] = 0
    rows = [("v", i, i / 4, 10, 20, bytearray(f.tobytes())) for i, f in enumerate((clay, half))]
    frames = spark.createDataFrame(rows, "video string, idx int, t double, h int, w int, pixels binary")
    assert [round(r.score, 3) for r in V.frame_signal(frames, V.wide_share).orderBy("idx").collect()] == [1.0, 0.4]
    assert V.frame_signal(frames, V.saturation).where("idx = 0").first().score == pytest.approx(0.4)
    grey = spark.createDataFrame([("v", i, i / 4, 1, 2, bytearray([v, v])) for i, v in enumerate((10, 10, 90))], frames.schema)
    assert [r.score for r in V.overlay_score(grey).orderBy("idx").collect()] == [0.0, 0.0, 80.0]
    assert V.frame_signal(grey, V.edge_energy, 1).first().score == 0.0


def test_set_status(spark):
    sets = {"a": "xyz", "b": "xyz", "c": "xy", "d": "xq", "e": "zyx"}
    rows = [(c, i, n, p) for i, (c, names) in enumerate(sets.items()) for p, n in enumerate(names)]
    got = {r.cache: r.status for r in E.set_status(spark.createDataFrame(rows, "cache string, ord int, name string, pos int"), "cache", "name").collect()}
    assert got == {"a": "reference", "b": "fresh", "c": "stale", "d": "conflict", "e": "conflict"}


def test_head_round_trip(spark, tmp_path):
    from sparkloom.operators import head as H

    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], [float(v) for v in rng.normal(4 * (i % 2), 1, 2)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, y string, features array<double>")
    H.save_head(H.fit_head(df, "y"), str(tmp_path / "m"), scales="2,3")
    meta = spark.read.json(str(tmp_path / "m/meta")).first()
    assert (meta.dim, meta.labels, meta.scales) == (2, ["a", "b"], "2,3")
    got = H.predict(df, H.load_head(spark, str(tmp_path / "m")), "id", k=1).collect()
    assert len(got) == 60 and np.mean([r.label == "ab"[r.id % 2] for r in got]) > 0.95
    with pytest.raises(Exception, match="must have 2"):
        H.predict(spark.createDataFrame([(1, [1.0])], "id int, features array<double>"), H.load_head(spark, str(tmp_path / "m")), "id").collect()
    with pytest.raises(ValueError, match="two classes"):
        H.fit_head(df.where("y = 'a'"), "y")


def test_combos():
    from sparkloom.operators.selection import combos

    assert combos(["2s", "3s"], 2) == [("2s", ["2s"]), ("3s", ["3s"]), ("2s+3s", ["2s", "3s"]), ("2s x3", ["2s"] * 3), ("3s x3", ["3s"] * 3)]


def test_saturation_does_not_follow_brightness(spark):
    frame = np.full((50, 4, 3), (200, 160, 120), np.float32)
    assert V.saturation(frame) == pytest.approx(0.4) == V.saturation(frame / 2)
    assert V.saturation(np.zeros_like(frame)) == 1.0  # as of black: 1 - 0 / 1e-6


def test_window_location_end_to_end(spark):
    from sparkloom.operators import window as W

    def signals(video, wide, hot):
        return [(video, 10 + i / 4, 0.9 if w else 0.8, 0.7 if h else 0.2) for i, (w, h) in enumerate(zip(wide, hot, strict=True))]

    rows = signals("good", [0] * 8 + [1] * 60 + [0] * 12, [1] * 20 + [0] * 60)
    rows += signals("card", [0] * 8 + [1] * 60 + [0] * 12, [0] * 68 + [1] * 12)
    rows += signals("none", [1, 0] * 40, [0] * 80)
    rows += signals("short", [1] * 20 + [0] * 60, [0] * 80)
    frames = spark.createDataFrame(rows, "video string, t double, share double, saturation double")
    windows = spark.createDataFrame([(v, 10.0, 38.0) for v in ("good", "card", "none", "short", "absent")], "video string, start double, caption_t double")
    got = {r.video: r for r in W.located_windows(frames, windows, "video").collect()}
    assert (got["good"].run_start, got["good"].run_end, got["good"].banner, got["good"].t0, got["good"].t1, got["good"].reason) == (12.0, 27.0, 15.0, 15.0, 27.0, None)
    assert (got["card"].banner, got["card"].t0, got["card"].reason) == (30.0, 12.0, None)
    assert [got[v].reason for v in ("none", "short", "absent")] == ["no_run", "short_span", "no_run"]


def test_batches_are_planned_anew(spark):
    done = []

    def plan():
        rows = [(i, n) for n, i in enumerate([x for x in range(7) if x not in done], 1)]
        return spark.createDataFrame(rows, "v int, position int")

    seen = P.run_batches(plan, lambda batch: done.extend(r.v for r in batch.collect()), 10, 3)
    assert [(b["n"], b["remaining"]) for b in seen] == [(3, 4), (3, 1), (1, 0)] and sorted(done) == list(range(7))
    done.clear()
    assert P.run_batches(plan, lambda batch: done.append(1), 10, 3, dry_run=True)[0]["n"] == 3 and not done


def test_interval_join_meets_every_span(spark):
    rng = random.Random(5)
    points = [("a", rng.uniform(-50, 50)) for _ in range(60)] + [("b", 1.0), ("a", -10.0)]
    spans = [("a", t, t + rng.choice([0, 0.1, 3, 80])) for t in [-10.0, *(rng.uniform(-60, 50) for _ in range(20))]]
    got = S.interval_join(spark.createDataFrame(points, "k string, t double"), spark.createDataFrame(spans, "k string, t0 double, t1 double"), "k")
    assert sorted((r.k, r.t, r.t0) for r in got.collect()) == sorted((k, t, a) for k, t in points for q, a, b in spans if k == q and a <= t < b)


def test_bounds_are_enforced(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 3, [float(i), 1.0]) for i in range(9)], "key int, g int, features array<double>")
    monkeypatch.setattr(E, "MAX_HELD", 2)
    with pytest.raises(ValueError, match="groups"):
        E.leave_one_out(rows, "g")
    monkeypatch.setattr(E, "MAX_GROUPS", 2)
    with pytest.raises(ValueError, match="groups"):
        E.group_folds(rows, "g", 2)
    monkeypatch.setattr(P, "MAX_IDS", 2)
    with pytest.raises(ValueError, match="pattern"):
        P.matching(rows.select(F.col("key").cast("string").alias("f")), rows.select(F.col("g").cast("string").alias("id")), "f", "id")
    monkeypatch.setattr(V, "MAX_WARD", 2)
    with pytest.raises(Exception, match="limit"):
        V.ward_clusters(rows, "key", 2).collect()


def test_large_heads_are_those_of_the_driver(spark):
    from sparkloom.operators import head as H

    rng = np.random.default_rng(1)
    for classes in (2, 3):
        x = rng.normal(size=(120, 3)) + np.arange(120)[:, None] % classes
        rows = spark.createDataFrame([(str(i % classes), v.tolist()) for i, v in enumerate(x)], "y string, x array<double>")
        small = {r.label: r for r in H.fit_head(rows, "y", "x").collect()}
        large = {r.label: r for r in H.fit_large(rows).collect()}
        for label, r in small.items():
            assert np.allclose(r.weights, large[label].weights, atol=1e-3) and r.dim == 3 and np.allclose(r.mean, large[label].mean)


def test_logistic_objective_by_gradient():
    """The optimum of sum(w * loss) + |W|^2 / (2C), whose gradient is 0; of two classes the binomial one."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 4)), np.array(["a", "b"] * 20 + ["b"] * 20)
    classes, w, b = V.fit_logistic(x, y, 0.5)
    v, c, t = w[:, 1] - w[:, 0], b[1] - b[0], (y == "b").astype(float)
    weight = 60 / (2 * np.where(t > 0, t.sum(), (1 - t).sum()))
    slope = weight * (1 / (1 + np.exp(-(x @ v + c))) - t)
    assert np.abs(x.T @ slope + v / 0.5).max() < 1e-3 and abs(slope.sum()) < 1e-3
    y = np.array(list("abc") * 20)
    classes, w, b = V.fit_logistic(x, y, 0.5)
    p = np.exp(x @ w + b)
    p /= p.sum(1, keepdims=True)
    assert np.abs(x.T @ (p - (y[:, None] == classes)) + w / 0.5).max() < 1e-3


def test_ward_merges_what_adds_least_variance():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(25, 3))
    parts = [[i] for i in range(25)]
    spread = lambda p: ((x[p] - x[p].mean(0)) ** 2).sum()
    while len(parts) > 6:
        a, b = min(((a, b) for a in range(len(parts)) for b in range(a)), key=lambda ab: spread(parts[ab[0]] + parts[ab[1]]) - spread(parts[ab[0]]) - spread(parts[ab[1]]))
        parts[b] += parts.pop(a)
    got = V.ward(x, 6)
    assert {frozenset(np.flatnonzero(got == k).tolist()) for k in set(got)} == {frozenset(p) for p in parts}


def test_ward_of_many_rows_and_copies(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 6)) * 30
    kind = np.arange(9000) * 7 % 4
    x = (centres[kind] + rng.normal(size=(9000, 6))).round(2)
    x[:2000] = x[np.arange(2000) % 4]  # many copies
    rows = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "key int, g int, features array<double>")
    got = {r.key: r.cluster for r in V.ward_clusters(rows, "key", 4, block="g").collect()}
    first = {k: c for c, k in enumerate(dict.fromkeys(kind.tolist()))}
    assert [got[i] for i in range(9000)] == [first[k] for k in kind.tolist()]
    # the same as by merging one pair at a time; few pairs at once
    monkeypatch.setattr(V, "WARD_CELLS", 100)
    x = rng.normal(size=(60, 3))[rng.integers(0, 60, 90)]
    parts = [[i] for i in range(90)]
    mean = lambda p: x[p].mean(0)
    cost = lambda a, b: ((mean(a) - mean(b)) ** 2).sum() * len(a) * len(b) / (len(a) + len(b))
    for k in range(89, 6, -1):
        a, b = min(((a, b) for b in range(len(parts)) for a in range(b)), key=lambda ab: (round(cost(parts[ab[0]], parts[ab[1]]), 12), ab))
        parts[a] += parts.pop(b)
        if k % 7 == 0 or k > 80:
            assert V.ward(x, k).tolist() == [next(c for c, p in enumerate(parts) if i in p) for i in range(90)]


def test_ward_ends():
    grid = np.stack(np.meshgrid(np.arange(9.0), np.arange(9.0)), -1).reshape(-1, 2)
    for x in (grid, np.eye(50), np.zeros((50, 2))):
        assert [len(set(V.ward(x, k))) for k in (1, 5, 50, 100)] == [1, 5, 50, len(x)]  # equal costs
    with pytest.raises(ValueError, match="finite"):
        V.ward(np.array([[1.0, np.nan], [1.0, 2.0], [np.nan, 2.0]]), 1)


def test_permutations_are_of_labels_within_groups(spark):
    rows = [("g1", i % 2, i % 2) for i in range(20)] + [("g2", 1, 1)] * 5
    df = spark.createDataFrame(rows, "g string, y int, p int")
    a, b = (tuple(E.permutation_test(df.repartition(n), "y", "p", "g", 50).first()) for n in (1, 7))
    assert a == pytest.approx(b) and a[0] == 1.0 and 0.4 < a[1] < 0.75


def test_shuffles_are_made_of_counts_and_null_is_a_group(spark):
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), rng.choice(["x", "y", "z", None])) for rng in [random.Random(8)] for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, y string, p string")
    got = E.permutation_test(df, "y", "p", "g", 40, 5)
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan  # no row is sorted, joined or copied for a shuffle
    code = {x: k for k, x in enumerate("xyz")}
    truth, told = (np.array([code.get(r[c], -c) for r in rows]) for c in (1, 2))
    score = lambda t: np.mean([((t == k) & (told == k)).sum() / (t == k).sum() for k in (-1, 0, 1)])
    assert got.first().observed == pytest.approx(score(truth)) and got.first().observed == pytest.approx(E.scores(df, "y", "p").first().balanced_accuracy)
    # the same shuffles, row by row
    order = np.array(sorted(range(300), key=lambda k: tuple((v is not None, v or "") for v in rows[k])))
    places = {g: [k for k in order if rows[k][0] == g] for g in ("a", "b", None)}
    numbered = [(perm, g, i + 1) for perm in range(1, 41) for g, at in places.items() for i in range(len(at))]
    keys = spark.createDataFrame(numbered, "perm int, g string, i int").select("*", F.xxhash64("perm", "g", "i", F.lit(5)).alias("h")).collect()
    drawn = []
    for perm in range(1, 41):
        t = truth.copy()
        for g, at in places.items():
            t[at] = truth[[at[r.i - 1] for r in sorted((r for r in keys if r.perm == perm and r.g == g), key=lambda r: r.h)]]
        drawn.append(score(t))
    assert tuple(got.first())[1:3] == pytest.approx((np.mean(drawn), np.std(drawn)))


def test_shuffles_in_steps_are_those_at_once(monkeypatch):
    rng = np.random.default_rng(9)
    n, y, p, start = rng.integers(1, 500, 9), rng.integers(1, 4, 9), rng.integers(0, 4, 9), np.array([12345678901234567890], np.uint64)
    want = E._small_hits(n, y, p, np.zeros(9, int), start, 3)
    for step in (50, 1 << 20):
        monkeypatch.setattr(E, "STEP", step)
        assert (E._large_hits(n, y, p, start[0], 3) == want).all() and want.sum() > 0


def test_sets_share_folds_and_pair(spark):
    rng = np.random.default_rng(4)
    rows = [(i, str(i % 2), i % 5, (rng.normal(size=3) + 2 * (i % 2)).tolist(), rng.normal(size=3).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "key int, y string, g int, good array<double>, bad array<double>")
    sets = {n: df.select("key", "y", "g", F.col(n).alias("features")) for n in ("good", "bad")}
    found = V.compared_sets(sets, E.group_folds(df, "g", 5), "key", "y", "g")
    assert found.count() == 10
    paired = V.paired_sets(found, "bad").first()
    assert paired.set == "good" and paired.n == 5 and paired.mean > 0.2


def test_multi_scale_aborts_on_a_miss(spark):
    from sparkloom.operators import window as W

    rows = spark.createDataFrame([(1, 2.0, [1.0]), (1, 3.0, [2.0]), (2, 2.0, [3.0])], "k int, scale double, features array<double>")
    assert W.multi_scale(rows.where("k = 1"), "k", [3.0, 2.0]).first().features == [2.0, 1.0]
    with pytest.raises(Exception, match="missing"):
        W.multi_scale(rows, "k", [2.0, 3.0]).collect()
