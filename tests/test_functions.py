import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions import vocabulary


def values(spark, rows, make, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}").select("i", make.alias("v")).orderBy("i").select("v").collect()]


def test_vocabulary(spark):
    dim = vocabulary.taxonomy(spark)
    assert dim.count() == 89 and dim.where("is_technique").count() == 82 and dim.select("name").distinct().count() == 89
    counts = {r.family: r["count"] for r in dim.where("is_technique").groupBy("family").count().collect()}
    assert counts == {"kihonwaza": 7, "kakete": 18, "nagete": 13, "hinerite": 19, "sorite": 6, "tokushuwaza": 19}
    assert [vocabulary.pairs(spark).where(f"kind = '{k}'").count() for k in ("outcome", "grip")] == [7, 6]


def test_clock_times(spark):
    assert values(spark, ["1:02:03", "01:55", "x", "1:y", None, "5"], X.to_seconds(F.col("x"))) == [3723, 115, None, None, None, None]
    assert values(spark, [0, 61, 3600], X.mmss(F.col("x")), "x int") == ["0m00s", "1m01s", "60m00s"]


def test_bout_lines(spark):
    rows = ["01:55 - Ryuden vs Kotoeiho", "01:09 Tamashoho vs Shishi", "00:00 - Intro / Start", "1:00:01 – Ōho VS. Abi", "  2:03: A v B", None]
    got = values(spark, rows, X.bout_line(F.col("x")))
    assert [tuple(g) if g else None for g in got] == [(115, "Ryuden", "Kotoeiho"), (69, "Tamashoho", "Shishi"), None, None, (123, "A", "B"), None]


def test_listing(spark):
    got = values(spark, ["abc|12.7", "abc|NA", "abc", "a|b|3"], X.listing(F.col("x")))
    assert [tuple(g) if g else None for g in got] == [("abc", 12), ("abc", 0), None, ("a", 0)]


def test_normalize(spark):
    rows = ["Gasshō-Hineri", "押し出し", "  ", None, "OSHIDASHINe", "oshida", "yorikir", "fusen", "yorikirixxx"]
    assert values(spark, rows, X.normalize(F.col("x"))) == ["gasshohineri", "oshidashi", None, None, "oshidashi", None, "yorikiri", "fusen", None]


def test_readings_of_captions(spark):
    rows = ["1SUKIOTOSH!", "OSHIDASHINe", "TSUKIOJOSHI", "FSUKIOTOSHI", "zzz"]
    assert values(spark, rows, X.normalize_ocr(F.col("x"))) == ["tsukiotoshi", "oshidashi", "tsukiotoshi", None, None]
    rows = ["KINBOZAN WINS BY OSHIDASHI", "KinbozanWINSBYOSHIDASHINe", "A1B WIN5 8Y ASHITORI", "NOTHING", "ABC WINS BY ASUKIOTOSHI"]
    got = [tuple(g) if g else None for g in values(spark, rows, X.caption(F.col("x")))]
    assert got == [("Kinbozan", "oshidashi"), ("Kinbozan", "oshidashi"), ("A1B", "ashitori"), None, ("Abc", None)]
    assert values(spark, ["X1Y WINS BY ASHITORI"], X.caption(F.col("x"), strict=True))[0].technique is None


def test_title_and_groups(spark):
    assert values(spark, ["a1b o'neil"], X.title(F.col("x"))) == ["A1B O'Neil"]
    assert values(spark, ["vid1__03", "a_CLIP2", "plain", "__x"], X.group_of(F.col("x"))) == ["vid1", "a", "plain", ""]


def test_spread(spark):
    want = [[0, 1, 3, 4, 6, 7, 8, 10, 11, 13, 14, 15, 17, 18, 20, 21], [0] * 16]
    assert values(spark, [22, 1], X.spread(F.col("x"), 16), "x int") == want
    assert values(spark, [5], X.spread(F.col("x"), 1), "x int") == [[0]]


def test_arrays(spark):
    rows = [([1.0, 2.0, 3.0, 4.0],), ([5.0],)]
    assert values(spark, rows, X.upper_median(F.col("x")), "x array<double>") == [3.0, 5.0]
    got = values(spark, [([1.0, 3.0],), ([2.0, 2.0],)], X.standardized(F.col("x")), "x array<double>")
    assert got == [[-1.0, 1.0], [0.0, 0.0]]


def test_utf8(spark):
    assert values(spark, [bytearray(b"a\x9db")], X.utf8(F.col("x")), "x binary") == ["a�b"]


def test_boxes(spark):
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.729).alias("y0"), F.lit(0.445).alias("x1"), F.lit(0.8).alias("y1"))
    got = spark.range(1).select(X.box_pixels(box, F.lit(854), F.lit(480)).alias("b"), X.mask_filter(F.array(box), F.lit(854), F.lit(480), 0.01).alias("m")).first()
    assert tuple(got.b) == (0, 349, 380, 34)
    assert got.m.startswith("drawbox=x=0:y=345:w=388") and got.m.endswith(":color=black:t=fill")


@pytest.mark.parametrize("sql", ["normalize_vocab", "regex_timestamp_lines"])
def test_queries_are_registered(sql):
    from sparkloom import queries

    assert sql in queries.QUERIES and sql in queries.ORACLES


def test_rounding_is_by_the_binary_value(spark):
    import random

    rng = random.Random(1)
    rows = [2.675, 0.125, 1.005, -2.675, -0.125, 0.375, 0.005, 0.015, 0.0, 1e300, 123456789.125, *(rng.uniform(-1000, 1000) for _ in range(300)), *(rng.randrange(-100000, 100000) / 1000 for _ in range(500))]
    assert values(spark, rows, X.round2(F.col("x")), "x double") == [round(x, 2) for x in rows]
