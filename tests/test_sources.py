import pytest
from pyspark.sql import functions as F

from sparkloom.sources import tables as T
from sparkloom.sources import tools
from sparkloom.streaming import incremental as I


def test_text_tables(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("a b\n\n c a ")
    assert sorted(r.video for r in T.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b", "c"]
    assert T.read_ids(spark, str(tmp_path / "none.txt")).count() == 0
    (tmp_path / "map.csv").write_text("x.png,3\nbad\ny,z.png,1\n")
    assert [(r.png, r.cluster) for r in T.read_map(spark, str(tmp_path / "map.csv")).collect()] == [("x.png", 3), ("y", None)]
    (tmp_path / "list.txt").write_text("v1|12\nnope\nv2|NA\n")
    assert [(r.video, r.duration) for r in T.read_listing(spark, str(tmp_path / "list.txt")).collect()] == [("v1", 12), ("v2", 0)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "v1.description").write_bytes(b"01:55 A vs B\x9d\n")
    assert [tuple(r) for r in T.read_descriptions(spark, str(tmp_path / "d")).collect()] == [("v1", "01:55 A vs B�\n")]


def test_csv_and_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "oshidashi", None)], T.CLUSTER_LABELS)
    T.write_csv(rows, str(tmp_path / "c"))
    assert tuple(T.read_csv(spark, str(tmp_path / "c"), T.CLUSTER_LABELS).first()) == (1, 2, "oshidashi", None)
    T.replace_version(rows, str(tmp_path / "v"), 1)
    T.replace_version(rows.limit(0), str(tmp_path / "v"), 2)
    assert spark.read.parquet(str(tmp_path / "v/v=1")).count() == 1
    with pytest.raises(Exception, match="exists"):
        T.replace_version(rows, str(tmp_path / "v"), 2)
    T.append_rows(rows.select("cluster"), str(tmp_path / "m"))
    T.append_rows(rows.select("cluster", "n"), str(tmp_path / "m"))
    assert sorted(str(r.n) for r in T.read_merged(spark, str(tmp_path / "m")).collect()) == ["2", "None"]
    T.append_ids(spark.createDataFrame([("q",)], "video string"), str(tmp_path / "s"))
    assert T.read_ids(spark, str(tmp_path / "s")).first().video == "q"
    T.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().kimarite == "oshidashi"


def test_vectors_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("yorikiri", "v__01", [1.0])], "label string, name string, features array<float>")
    T.write_vectors(rows, str(tmp_path / "cache"))
    got = T.read_vectors(spark, str(tmp_path / "cache")).first()
    assert (got.label, got.name, got.video) == ("yorikiri", "v__01", "v")
    files = T.read_files(spark, str(tmp_path / "cache"), ("parquet", "mp4"))
    assert files.count() == 1 and files.first().length > 0
    T.write_vectors(rows.limit(0), str(tmp_path / "empty"))


def test_relabelled(spark):
    crops = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 3), ("e", 4), ("f", 9)], "png string, cluster int")
    names = spark.createDataFrame([(1, "Yorikiri"), (2, " "), (3, "fusen"), (4, "qqq")], "cluster int, kimarite string")
    got = T.relabelled(crops, names)
    assert sorted((r.png, r.name) for r in got["moved"].collect()) == [("a", "yorikiri"), ("b", "yorikiri")]
    assert {r.reason: r.n for r in got["dropped"].collect()} == {"unnamed cluster": 2, "not a technique": 1, "unknown name": 1}


def test_tools(spark):
    def cut(x):
        if x == 2:
            raise ValueError("bad")
        return None if x == 3 else x * 10

    rows = tools.run_tool(spark.createDataFrame([(1,), (2,), (3,)], "x int"), cut, ["x"], "out").orderBy("x").collect()
    assert [(r.out, r.reason) for r in rows] == [("10", None), (None, "ValueError: bad"), (None, "no output")]
    text = spark.createDataFrame([("a\fb\f", 2), ("a", 2)], "x string, n int")
    assert [r[0] for r in text.select(tools.pages(F.col("x"), F.col("n"))).collect()] == [["a", "b"], None]
    log = spark.createDataFrame([("q pts_time:1.5 x\npts_time:20",)], "x string")
    assert log.select(tools.scene_cuts(F.col("x"))).first()[0] == [1.5, 20.0]
    assert spark.createDataFrame([("https://x",), ("/x",)], "x string").where(tools.remote(F.col("x"))).count() == 1
    frames = spark.createDataFrame([("v", bytearray([1, 3]))], "name string, pixels binary")
    got = tools.embed(frames, lambda: lambda x: x.reshape(2, 1).astype(float), ["name"]).first()
    assert (got.name, got.features) == ("v", [2.0])


def test_stage_runs_once_per_file(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "video string, n int")
    rows.write.parquet(src)
    args = (spark, src, rows.schema, lambda df: df.where("n > 1"), out, str(tmp_path / "ck"), str(tmp_path / "done"), "video")
    assert I.run_stage(*args) == 1 and I.run_stage(*args) == 0
    rows.withColumn("n", F.col("n") + 5).write.mode("append").parquet(src)
    assert I.run_stage(*args) == 2
    assert spark.read.parquet(out).count() == 3


def test_streamed_min_gap_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    for part in ([0.0, 5.0, 16.0], [20.0, 31.0]):
        spark.createDataFrame([("k", t) for t in part], "k string, t double").coalesce(1).write.mode("append").parquet(src)
        query = I.stream_min_gap(spark.readStream.schema("k string, t double").parquet(src), "k", "t", 15.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(r.t for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0.0, 16.0, 31.0]


def test_sessions(spark):
    df = spark.sql("SELECT 1 AS u, timestamp_ntz'2024-01-01 00:00:00' AS ts UNION ALL SELECT 1, timestamp_ntz'2024-01-01 00:05:00' UNION ALL SELECT 1, timestamp_ntz'2024-01-01 01:00:00'")
    assert sorted(r.n for r in I.sessions(df, "u", "ts", "10 minutes").collect()) == [1, 2]


def test_pages_fall_back_to_single_stills(spark):
    def together(stills):
        if "boom" in stills:
            raise OSError("failed")
        return "\f".join("x" if s == "lost" else s.upper() for s in stills if s != "lost") + "\f"

    def alone(still):
        if still == "bad":
            raise ValueError(still)
        return still.upper()

    for rows in (["a", "b", "c"], ["a", "lost", "bad"], ["a", "boom", "c"]):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string").coalesce(1)
        got = [r.text for r in tools.page_texts(df, together, alone, "s", 3).orderBy("i").collect()]
        assert got == [None if s == "bad" else s.upper() for s in rows]


def test_tools_are_checked_and_failures_recorded(spark):
    assert tools.missing_tools(["python", "no-such-tool"]) == ["no-such-tool"]
    rows = spark.createDataFrame([("a", None), ("b", "OSError: x"), ("b", "OSError: y")], "video string, reason string")
    assert [r.video for r in tools.dead(rows, "video").collect()] == ["b"]


def test_command_surface(capsys):
    from sparkloom.__main__ import main

    main([])
    assert "window_location" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["no-such-query"])


def test_restored_parameters_are_counted():
    import numpy as np

    have = {"q.bias": np.zeros(2), "v.bias": np.zeros(2), "w": np.ones((2, 2))}
    saved = {"q.bias": np.ones(2), "v.bias": np.full(2, 2.0)}
    assert tools.restored(have, saved, 2)["v.bias"].tolist() == [2.0, 2.0] and have["v.bias"].tolist() == [0.0, 0.0]
    for wrong in ({"q.bias": np.ones(2)}, {**saved, "x": np.ones(2)}, {"q.bias": np.ones(3), "v.bias": np.ones(2)}):
        with pytest.raises(ValueError, match="fit"):
            tools.restored(have, wrong, 2)
