"""More queries: captions, folds, windows located from signals, batches, tables written and read back, streams.

What is written goes to a folder of its own in the shared folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions import vocabulary
from sparkloom.operators import evaluation as E
from sparkloom.operators import features as V
from sparkloom.operators import head as H
from sparkloom.operators import manifest as M
from sparkloom.operators import signal as S
from sparkloom.operators import window as W
from sparkloom.plans import batches as P
from sparkloom.sources import tables as T
from sparkloom.sources import tools
from sparkloom.streaming import incremental as I

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_EV = "(SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"
_NAMES = ", ".join(f"({i}, '{n}', '{k}', {str(t).lower()})" for i, n, k, _, t in vocabulary.entries())


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").withColumn("t", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / F.lit(1e6))


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{T.shared_folder(spark)}/{uuid.uuid4().hex}"


# -- captions and text

_RAW = """CASE s_suppkey % 6 WHEN 0 THEN upper(name) WHEN 1 THEN translate(upper(name), 'IO', '10') WHEN 2 THEN '1' || substr(upper(name), 2) WHEN 3 THEN 'A' || upper(name) WHEN 4 THEN 'F' || upper(name) ELSE upper(name) || 'Ne' END"""


def _caption_reads(spark, sf_dir) -> DataFrame:
    """Captions as a reader gives them: exact, with digits for letters, a glyph lost, glued or added."""
    rows = _t(spark, sf_dir, "supplier").join(F.broadcast(vocabulary.taxonomy(spark)), (F.col("s_suppkey") * 7 % 89) == F.col("ord"))
    up, k = F.upper("name"), F.col("s_suppkey") % 6
    raw = F.when(k == 0, up).when(k == 1, F.translate(up, "IO", "10")).when(k == 2, F.concat(F.lit("1"), F.substr(up, F.lit(2)))).when(k == 3, F.concat(F.lit("A"), up)).when(k == 4, F.concat(F.lit("F"), up)).otherwise(F.concat(up, F.lit("Ne")))
    return rows.select("s_suppkey", F.concat(F.lit("x KIN8O"), F.col("s_nationkey").cast("string"), F.lit("B WIN5 8Y "), raw).alias("text"))


_CAPTIONS = f"""v(ord, name, kanji, tech) AS (VALUES {_NAMES}),
 raw AS (SELECT s_suppkey, s_nationkey, {_RAW} AS whole FROM supplier JOIN v ON s_suppkey * 7 % 89 = ord),
 tok AS (SELECT *, CASE WHEN regexp_matches(whole, '(?i)^[A4][A-Z]{{4}}') THEN substr(whole, 2) ELSE whole END AS strict FROM raw),
 two AS (SELECT s_suppkey, s_nationkey, 0 AS p, strict AS token FROM tok UNION ALL SELECT s_suppkey, s_nationkey, 1, whole FROM tok),
 fix AS (SELECT *, translate(token, '1!|[]/\\05862', 'IIIIIIIOSBGZ') AS f FROM two),
 cand AS (SELECT s_suppkey, s_nationkey, p * 5 + unnest(range(5)) AS o, unnest([token, f, regexp_replace(f, '^([^I]*)I', '\\1T'), regexp_replace(regexp_replace(f, '([AEIOU])[JD]([AEIOU])', '\\1T\\2', 'g'), '([AEIOU])[JD]([AEIOU])', '\\1T\\2', 'g'), substr(f, 2)]) AS c FROM fix),
 hit AS (SELECT s_suppkey, s_nationkey, o, name, ord, name <> lower(c) AS near FROM cand JOIN v ON name = lower(c) OR ((starts_with(lower(c), name) OR starts_with(name, lower(c))) AND abs(length(c) - length(name)) <= 2)),
 best AS (SELECT s_suppkey, name FROM hit QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY o, near, ord) = 1)"""


@query(f"WITH {_CAPTIONS} SELECT s_suppkey, 'Kin8O' || s_nationkey || 'B' AS winner, name AS technique FROM supplier LEFT JOIN best USING (s_suppkey)")
def caption_readings(spark, sf_dir):
    rows = _caption_reads(spark, sf_dir).select("s_suppkey", X.caption(F.col("text")).alias("c"))
    return rows.select("s_suppkey", "c.winner", "c.technique")


@query(f"""WITH {_CAPTIONS}, r AS (SELECT s_nationkey, name, s_suppkey AS idx FROM supplier JOIN best USING (s_suppkey)),
 n AS (SELECT s_nationkey, name, count(*) AS votes, min(idx) AS first FROM r GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(votes) OVER w, 0) AS nxt FROM n WINDOW w AS (PARTITION BY s_nationkey ORDER BY votes DESC, first))
 SELECT s_nationkey, name AS kimarite, 'Kin8O' || s_nationkey || 'B' AS winner, votes, round(10 + first / 3.0, 6) AS caption_t FROM k WHERE rn = 1 AND votes >= 2 AND votes - nxt >= 2""")
def caption_plurality(spark, sf_dir):
    rows = _caption_reads(spark, sf_dir).join(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    reads = rows.select("s_nationkey", F.col("s_suppkey").alias("idx"), "text", F.lit(10.0).alias("start"))
    return M.caption_votes(reads, ["s_nationkey"], 3.0, "start").withColumn("caption_t", F.round("caption_t", 6))


@query("SELECT c_custkey, list_aggregate(list_transform(regexp_extract_all(lower(c_name || '''s 1b'), '\\pL+|[^\\pL]+'), lambda x: upper(x[1]) || x[2:]), 'string_agg', '') AS name FROM customer")
def title_case(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", X.title(F.concat("c_name", F.lit("'s 1b"))).alias("name"))


@query("SELECT p_partkey, (p_size * 37 // 60) || 'm' || lpad((p_size * 37 % 60)::VARCHAR, 2, '0') || 's' AS shown, p_size * 37 AS seconds FROM part")
def clock_times(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37).alias("s"))
    clock = F.concat_ws(":", (F.floor(F.col("s") / 3600)).cast("string"), F.floor(F.col("s") % 3600 / 60).cast("string"), (F.col("s") % 60).cast("string"))
    return rows.select("p_partkey", X.mmss(F.col("s")).alias("shown"), X.to_seconds(clock).alias("seconds"))


@query("SELECT doc_id, coalesce(text, '') || chr(65533) || 'x' AS text FROM documents")
def broken_bytes(spark, sf_dir):
    raw = F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.unhex(F.lit("9D78")))
    return _t(spark, sf_dir, "documents").select("doc_id", X.utf8(raw).alias("text"))


@query(f"WITH v(ord, name, kanji, tech) AS (VALUES {_NAMES}) SELECT tech AS is_technique, count(*) AS n FROM part JOIN v ON p_partkey % 89 = ord GROUP BY 1")
def technique_flags(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").join(F.broadcast(vocabulary.taxonomy(spark)), (F.col("p_partkey") % 89) == F.col("ord"))
    return rows.groupBy("is_technique").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'fin' || c_nationkey ELSE coalesce(CASE c_nationkey WHEN 3 THEN 'whole' END, 'fin' || c_nationkey) END AS dir FROM customer")
def scale_dirs(spark, sf_dir):
    scale = F.col("c_nationkey").cast("string")
    return _t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, P.scale_dir(scale, {})).otherwise(P.scale_dir(scale, {"3": "whole"})).alias("dir"))


@query("SELECT p_partkey, 'a' || chr(12) || 'b ' || p_partkey AS joined, 2::INT AS pages, p_size % 2 = 0 AS fits FROM part")
def recognised_pages(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a\f"), F.lit("b "), F.col("p_partkey").cast("string"), F.lit("\f")).alias("text"), F.when(F.col("p_size") % 2 == 0, 2).otherwise(3).alias("want"))
    rows = rows.select("p_partkey", tools.pages(F.col("text"), F.lit(2)).alias("two"), tools.pages(F.col("text"), F.col("want")).alias("p"))
    return rows.select("p_partkey", F.array_join("two", "\f").alias("joined"), F.size("two").alias("pages"), F.col("p").isNotNull().alias("fits"))


@query("SELECT p_partkey, unnest([p_size / 4.0, p_size + 0.5]) AS t FROM part")
def scene_cut_times(spark, sf_dir):
    size = F.col("p_size")
    log = F.concat(F.lit("frame:1 pts_time:"), (size / 4).cast("string"), F.lit("\nlavfi=1\nframe:2 pts_time:"), (size + 0.5).cast("string"), F.lit(" x"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.explode(tools.scene_cuts(log)).alias("t"))


@query("SELECT url, starts_with(lower(url), 'http') AS remote FROM pages UNION ALL SELECT 'raw/' || page_id, false FROM pages")
def remote_targets(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    rows = pages.select("url").union(pages.select(F.concat(F.lit("raw/"), F.col("page_id").cast("string"))))
    return rows.select("url", tools.remote(F.col("url")).alias("remote"))


# -- vectors, folds, selections


@query("SELECT vec_id, unnest(range(64))::INT AS dim, round(unnest(list_transform(embedding, lambda x: (x::DOUBLE - m) / CASE WHEN s > 0 THEN s ELSE 1 END)), 4) AS x FROM (SELECT *, list_avg(embedding::DOUBLE[]) AS m, list_aggregate(embedding::DOUBLE[], 'stddev_pop') AS s FROM embeddings)")
def standardized_vectors(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", X.standardized(F.col("embedding").cast("array<double>")).alias("features"))
    return V.dimensions(rows, "vec_id").select("vec_id", "dim", F.round("x", 4).alias("x"))


@query("SELECT vec_id, len(v)::INT AS dim, round(list_sum(v[1:64]::DOUBLE[]), 4) AS first, round(list_sum(v[129:]::DOUBLE[]), 4) AS third FROM (SELECT vec_id, embedding || embedding || embedding AS v FROM embeddings)")
def repeated_control(spark, sf_dir):
    rows = V.with_dim(V.repeated(_t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features")), 3), 192)
    total = lambda a: F.round(F.aggregate(F.slice("features", a, 64), F.lit(0.0), lambda s, x: s + x), 4)
    return rows.select("vec_id", F.size("features").alias("dim"), total(1).alias("first"), total(129).alias("third"))


@query("SELECT vec_id, unnest(range(len(v)))::INT AS dim, round(unnest(v)::DOUBLE, 5) AS x FROM (SELECT vec_id, embedding[1:4] || embedding[11:14] || embedding[21:24] AS v FROM embeddings)")
def multi_scale_vectors(spark, sf_dir):
    clips = P.scale_windows(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.lit(4.0).alias("duration")), [2.0, 3.0, 6.0])
    at = F.when(F.col("scale") == 2, 1).when(F.col("scale") == 3, 11).otherwise(21)
    encoded = clips.select("vec_id", "scale", F.slice("embedding", at, F.lit(4)).alias("features"))
    return V.dimensions(W.multi_scale(encoded, "vec_id", [2.0, 3.0, 6.0]), "vec_id").select("vec_id", "dim", F.round(F.col("x").cast("double"), 5).alias("x"))


@query("WITH g AS (SELECT DISTINCT c_nationkey FROM customer), r AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || c_nationkey::VARCHAR), c_nationkey) <= ceil(count(*) OVER () * 0.25) AS held_out FROM g) SELECT c_custkey, held_out FROM customer JOIN r USING (c_nationkey)")
def group_hold_out(spark, sf_dir):
    return E.hold_out(_t(spark, sf_dir, "customer"), "c_nationkey", 0.25, 7).select("c_custkey", "held_out")


@query("""WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), g AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS r FROM c),
 w(r, source, fold, load) AS (SELECT 0::BIGINT, NULL::VARCHAR, NULL::BIGINT, [0::BIGINT, 0, 0, 0, 0][1:least(5, (SELECT count(*) FROM c))]
  UNION ALL SELECT g.r, g.source, list_position(load, list_min(load)) - 1, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + g.n ELSE x END) FROM w JOIN g ON g.r = w.r + 1)
 SELECT source, fold::INT AS fold FROM w WHERE r > 0""")
def greedy_folds(spark, sf_dir):
    return E.group_folds(_t(spark, sf_dir, "documents").where("source IS NOT NULL"), "source", 5)


@query("WITH h AS (SELECT DISTINCT c_nationkey AS held FROM customer) SELECT held, is_test, count(*) AS n FROM (SELECT held, held = c_nationkey AS is_test FROM customer, h) GROUP BY 1, 2")
def held_groups(spark, sf_dir):
    return E.leave_one_out(_t(spark, sf_dir, "customer"), "c_nationkey").groupBy("held", "is_test").agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) < 60")
def thin_classes(spark, sf_dir):
    return E.thin_classes(_t(spark, sf_dir, "embeddings"), "label", 60)


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first FROM orders GROUP BY 1")
def first_appearance(spark, sf_dir):
    rows = M.first_wins(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], ["o_orderkey"])
    return rows.select("o_custkey", F.col("o_orderpriority").alias("first"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def distinct_sources(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("n"))


@query("""WITH r AS (SELECT s_suppkey, s_nationkey = 0 AS late, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS turn, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS first FROM supplier),
 p AS (SELECT s_suppkey, row_number() OVER (ORDER BY late, turn, first) AS position FROM r)
 SELECT s_suppkey, position, greatest((SELECT count(*) FROM p) - 40, 0) AS remaining FROM p WHERE position <= 40""")
def batch_limit(spark, sf_dir):
    dealt = P.round_robin(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", ["s_suppkey"], F.col("s_nationkey") == 0)
    return P.next_batch(dealt.select("s_suppkey", "position"), 40)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def ordered_limit(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("down"))
    return P.first_rows(rows, ["down", "o_orderkey"], 25).drop("down")


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'an')")
def name_filter(spark, sf_dir):
    return P.in_name(_t(spark, sf_dir, "part"), "p_name", "an").select("p_partkey")


@query("SELECT s_suppkey, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey * 10 END AS w, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey + 1 END AS h FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def frame_sizes(spark, sf_dir):
    key = F.col("n_nationkey")
    dims = _t(spark, sf_dir, "nation").where(key % 4 > 0).select(key.alias("s_nationkey"), (key * 10).alias("w"), (key + 1).alias("h"))
    return P.with_dims(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), dims.union(dims), "s_nationkey").select("s_suppkey", "w", "h")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <> 3 AND l_returnflag <> 'A' AND l_discount > 0")
def located_rows(spark, sf_dir):
    no, flag = F.col("l_linenumber"), F.col("l_returnflag")
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(no != 3, no.cast("double")).alias("bout_start"), F.when(flag == "A", "").otherwise(flag).alias("clip"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("bout_end"))
    return M.located(rows).select("l_orderkey", "l_linenumber")


@query(f"SELECT event_id FROM {_EV} JOIN (SELECT user_id, min(t) AS a, max(t) - 1000 AS b FROM {_EV} GROUP BY 1) USING (user_id) WHERE t >= greatest(a, b - 86400) AND t < b")
def search_tail(spark, sf_dir):
    rows = _events(spark, sf_dir)
    spans = rows.groupBy("user_id").agg(F.min("t").alias("a"), (F.max("t") - 1000).alias("b"))
    return M.search_tail(rows.join(spans, "user_id"), "t", F.col("a"), F.col("b"), 86400.0).select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_tax < 0.05")
def both_or_neither(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 10).alias("ok_clip"), (F.col("l_tax") < 0.05).alias("ok_crop"))
    return P.committed_pairs(rows, "ok_clip", "ok_crop").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 = n_regionkey")
def fresh_cache(spark, sf_dir):
    cache = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), (F.col("c_custkey") % 5).alias("version"))
    current = _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("version"))
    return P.fresh(cache, current, ["n_nationkey"], "version").select("c_custkey")


@query(f"""WITH v(ord, name, kanji, tech) AS (VALUES {_NAMES}), n AS (SELECT ord AS cluster, CASE WHEN ord % 4 = 1 THEN '  ' WHEN ord % 4 = 2 THEN 'qqqq' ELSE kanji END AS given, name, tech FROM v WHERE ord % 4 < 3 OR ord > 60),
 j AS (SELECT p_partkey, CASE WHEN n.cluster IS NULL OR trim(given) = '' THEN 'unnamed cluster' WHEN given = 'qqqq' THEN 'unknown name' WHEN NOT tech THEN 'not a technique' END AS reason, n.name FROM part LEFT JOIN n ON p_partkey % 89 = cluster)
 SELECT 'moved' AS side, name AS what, count(*) AS n FROM j WHERE reason IS NULL GROUP BY 2 UNION ALL SELECT 'dropped', reason, count(*) FROM j WHERE reason IS NOT NULL GROUP BY 2""")
def relabelled_crops(spark, sf_dir):
    o = F.col("ord")
    names = vocabulary.taxonomy(spark).where((o % 4 < 3) | (o > 60)).select(o.cast("int").alias("cluster"), F.when(o % 4 == 1, "  ").when(o % 4 == 2, "qqqq").otherwise(F.col("kanji")).alias("kimarite"))
    crops = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("png"), (F.col("p_partkey") % 89).cast("int").alias("cluster"))
    sides = T.relabelled(crops, names)
    moved = sides["moved"].groupBy("name").agg(F.count("*").alias("n")).select(F.lit("moved").alias("side"), F.col("name").alias("what"), "n")
    return moved.union(sides["dropped"].select(F.lit("dropped").alias("side"), F.col("reason").alias("what"), "n"))


# -- windows located from signals

_SIGNALS = f"""f AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1) / 4.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS r FROM {_EV}),
 w AS (SELECT user_id, user_id % 3 AS start, user_id % 3 + (user_id * 7 % 60) + 9 AS caption_t, user_id AS u FROM (SELECT DISTINCT user_id FROM events)),
 s AS (SELECT f.user_id, start, caption_t, row_number() OVER (PARTITION BY f.user_id ORDER BY t) - 1 AS idx, CASE WHEN (r // (5 + f.user_id % 40)) % 3 <> 1 THEN 0.9 ELSE 0.8 END > 0.8 AS wide, CASE WHEN (r // (6 + f.user_id % 11)) % 2 = 0 THEN 0.7 ELSE 0.2 END + (r % 3) / 100.0 AS sat FROM f JOIN w USING (user_id) WHERE t >= start AND t < caption_t - 8),
 h AS (SELECT *, sat > min(sat) OVER u + 0.6 * (max(sat) OVER u - min(sat) OVER u) AS hot FROM s WINDOW u AS (PARTITION BY user_id)),
 gw AS (SELECT *, idx - row_number() OVER (PARTITION BY user_id, wide ORDER BY idx) AS g FROM h), gh AS (SELECT *, idx - row_number() OVER (PARTITION BY user_id, hot ORDER BY idx) AS g FROM h),
 rw AS (SELECT user_id, min(idx) AS i, max(idx) + 1 AS j FROM gw WHERE wide GROUP BY user_id, g HAVING count(*) >= 10), rh AS (SELECT user_id, max(idx) + 1 AS j FROM gh WHERE hot GROUP BY user_id, g HAVING count(*) >= 12),
 b AS (SELECT user_id, arg_max([i, j], (j - i, -i)) AS r FROM rw GROUP BY 1), c AS (SELECT user_id, max(j) AS j FROM rh GROUP BY 1),
 x AS (SELECT w.*, start + b.r[1] / 4.0 AS r0, start + b.r[2] / 4.0 AS r1, start + c.j / 4.0 AS ban FROM w LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id)),
 y AS (SELECT *, CASE WHEN r1 IS NULL THEN caption_t - 8 ELSE least(r1, caption_t - 8) END AS t1, CASE WHEN ban IS NOT NULL AND ban - r0 BETWEEN 0 AND 12 AND r1 - ban >= 3 THEN ban ELSE r0 END AS s0 FROM x),
 z AS (SELECT *, CASE WHEN s0 IS NULL THEN t1 - 30 ELSE greatest(s0, t1 - 30) END AS t0 FROM y),
 pur AS (SELECT z.user_id, avg(wide::INT) AS purity FROM z JOIN s ON s.user_id = z.user_id AND s.start + idx / 4.0 >= t0 AND s.start + idx / 4.0 < t1 GROUP BY 1)"""


@query(f"""WITH {_SIGNALS} SELECT user_id, r0 AS run_start, r1 AS run_end, ban AS banner, round(purity, 6) AS purity, t0, t1,
 CASE WHEN r0 IS NULL THEN 'no_run' WHEN t1 - t0 < 8 THEN 'short_span' WHEN caption_t - t0 > 70 THEN 'far_from_caption' WHEN purity IS NULL THEN 'unread' WHEN purity < 0.9 THEN 'impure' ELSE 'kept' END AS reason FROM z LEFT JOIN pur USING (user_id)""")
def window_location(spark, sf_dir):
    rows = S.indexed(_events(spark, sf_dir).select("user_id", "t", "event_id"), "user_id", ["t", "event_id"])
    r, u = F.col("idx"), F.col("user_id")
    share = F.when(F.floor(r / (5 + u % 40)) % 3 != 1, 0.9).otherwise(0.8)
    saturation = F.when(F.floor(r / (6 + u % 11)) % 2 == 0, 0.7).otherwise(0.2) + (r % 3) / 100
    signals = rows.select("user_id", (r / 4).alias("t"), share.alias("share"), saturation.alias("saturation"))
    windows = rows.select("user_id").distinct().select("user_id", (u % 3).cast("double").alias("start"), (u % 3 + u * 7 % 60 + 9).cast("double").alias("caption_t"))
    found = W.located_windows(signals, windows, "user_id")
    return found.select("user_id", "run_start", "run_end", "banner", F.round("purity", 6).alias("purity"), "t0", "t1", F.coalesce("reason", F.lit("kept")).alias("reason"))


_BYTES = "md5(doc_id::VARCHAR) || md5('g' || doc_id::VARCHAR) || md5('b' || doc_id::VARCHAR)"
_PIXELS = f"""raw AS (SELECT doc_id, {_BYTES} AS hex FROM documents), byte AS (SELECT doc_id, k, ('0x' || hex[2 * k + 1:2 * k + 2])::INT AS v FROM raw, range(48) x(k)),
 px AS (SELECT doc_id, k // 12 AS y, k // 3 % 4 AS x, max(v) FILTER (k % 3 = 0) AS r, max(v) FILTER (k % 3 = 1) AS g, max(v) FILTER (k % 3 = 2) AS b FROM byte GROUP BY 1, 2, 3)"""


def _frames(spark, sf_dir) -> DataFrame:
    """Frames of 4 x 4 pixels from hashes of document ids."""
    d = F.col("doc_id").cast("string")
    hexes = F.concat(F.md5(d), F.md5(F.concat(F.lit("g"), d)), F.md5(F.concat(F.lit("b"), d)))
    return _t(spark, sf_dir, "documents").select((F.col("doc_id") % 7).cast("string").alias("video"), F.col("doc_id").cast("int").alias("idx"), F.lit(0.0).alias("t"), F.lit(4).alias("h"), F.lit(4).alias("w"), F.unhex(hexes).alias("pixels"))


@query(f"""WITH {_PIXELS}, col AS (SELECT doc_id, x, avg((greatest(r, g, b) > 90 AND r > g AND g > b AND greatest(r, g, b) - least(r, g, b) < 0.55 * greatest(r, g, b, 1) AND r - b > 12)::INT) > 0.15 AS clay FROM px GROUP BY 1, 2),
 w AS (SELECT doc_id, avg(clay::INT) AS share FROM col GROUP BY 1), s AS (SELECT doc_id, avg(1 - least(r, g, b) / greatest(r, g, b, 1e-6)) AS saturation FROM px WHERE y = 2 GROUP BY 1)
 SELECT doc_id::INT AS idx, round(share, 6) AS share, share > 0.8 AS wide, round(saturation, 4) AS saturation FROM w JOIN s USING (doc_id)""")
def frame_signals(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    share = V.frame_signal(frames, V.wide_share).select("idx", F.round("score", 6).alias("share"))
    band = V.frame_signal(frames, V.saturation).select("idx", F.round("score", 4).alias("saturation"))
    return share.join(band, "idx").select("idx", "share", V.is_wide(F.col("share")).alias("wide"), "saturation")


@query(f"""WITH raw AS (SELECT doc_id, md5(doc_id::VARCHAR) AS hex FROM documents), byte AS (SELECT doc_id, k // 4 AS y, k % 4 AS x, k, ('0x' || hex[2 * k + 1:2 * k + 2])::INT AS v FROM raw, range(16) z(k)),
 e AS (SELECT doc_id, avg(abs(d)) AS edge FROM (SELECT doc_id, v - lag(v) OVER (PARTITION BY doc_id, y ORDER BY x) AS d FROM byte) WHERE d IS NOT NULL GROUP BY 1),
 m AS (SELECT doc_id % 7 AS vid, k, median(v) AS m FROM byte GROUP BY 1, 2), o AS (SELECT doc_id, avg(abs(v - m)) AS overlay FROM byte JOIN m ON doc_id % 7 = vid AND byte.k = m.k GROUP BY 1)
 SELECT doc_id::INT AS idx, round(edge, 4) AS edge, edge > 4 AS readable, round(overlay, 4) AS overlay FROM e JOIN o USING (doc_id)""")
def grey_signals(spark, sf_dir):
    frames = _frames(spark, sf_dir).withColumn("pixels", F.substring("pixels", 1, 16))
    frames = frames.withColumn("pixels", F.unhex(F.md5(F.col("idx").cast("string"))))
    edges = V.frame_signal(frames, V.edge_energy, 1).select("idx", F.round("score", 4).alias("edge"))
    return edges.join(V.overlay_score(frames).select("idx", F.round("score", 4).alias("overlay")), "idx").select("idx", "edge", (F.col("edge") > V.EDGE_LEAST).alias("readable"), "overlay")


@query("SELECT doc_id::VARCHAR AS name, k::INT AS dim, round((v - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 4) AS x FROM (SELECT doc_id, k, v, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM (SELECT doc_id, k, ('0x' || md5(doc_id::VARCHAR)[2 * k + 1:2 * k + 2])::INT AS v FROM documents, range(16) z(k) WHERE doc_id % 5 > 0 AND doc_id % 3 > 0) WINDOW w AS (PARTITION BY doc_id))")
def thumbnail_vectors(spark, sf_dir):
    d = F.col("doc_id")
    name = F.when(d % 5 == 0, F.concat(F.lit("probe_"), d.cast("string"))).otherwise(d.cast("string"))
    whole = F.unhex(F.md5(d.cast("string")))
    rows = _t(spark, sf_dir, "documents").select(name.alias("name"), F.when(d % 3 == 0, F.substring(whole, 1, 9)).otherwise(whole).alias("pixels"))
    return V.dimensions(tools.thumbnails(rows, "name", "pixels", 16), "name").select("name", "dim", F.round("x", 4).alias("x"))


# -- tables written and read back


@query("SELECT n_nationkey AS cluster, n_regionkey AS n, CASE WHEN n_regionkey > 0 THEN n_name END AS kimarite, '\"' || n_name || '\", x' AS example FROM nation")
def csv_tables(spark, sf_dir):
    at = _folder(spark)
    rows = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("cluster"), F.col("n_regionkey").cast("int").alias("n"), F.when(F.col("n_regionkey") > 0, F.col("n_name")).alias("kimarite"), F.concat(F.lit('"'), "n_name", F.lit('", x')).alias("example"))
    T.write_csv(rows, at)
    return T.read_csv(spark, at, T.CLUSTER_LABELS)


@query("SELECT 'c' || c_custkey || '.png' AS png, c_nationkey::INT AS cluster FROM customer WHERE c_custkey % 3 > 0")
def cluster_map(spark, sf_dir):
    at, key = _folder(spark), F.col("c_custkey")
    line = F.when(key % 3 == 0, F.lit("no comma")).otherwise(F.concat(F.lit("c"), key.cast("string"), F.lit(".png,"), F.col("c_nationkey").cast("string")))
    _t(spark, sf_dir, "customer").select(line.alias("value")).write.text(at)
    return T.read_map(spark, at)


@query("SELECT DISTINCT s_nationkey::VARCHAR AS video FROM supplier UNION SELECT 'x' || s_suppkey FROM supplier")
def state_sets(spark, sf_dir):
    at, rows = _folder(spark), _t(spark, sf_dir, "supplier")
    T.append_ids(rows.select("s_nationkey"), at)
    T.append_ids(rows.select(F.concat(F.lit(" x"), F.col("s_suppkey").cast("string"), F.lit("  "))), at)
    return T.read_ids(spark, at).unionByName(T.read_ids(spark, at + "-missing"))


@query("SELECT 'v' || p_partkey AS video, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS duration FROM part WHERE p_partkey % 5 > 0")
def listing_lines(spark, sf_dir):
    at, key, size = _folder(spark), F.col("p_partkey"), F.col("p_size")
    shown = F.when(size % 2 == 0, F.concat(size.cast("string"), F.lit(".9"))).otherwise(F.lit("NA"))
    line = F.when(key % 5 == 0, F.lit("no bar")).otherwise(F.concat(F.lit("v"), key.cast("string"), F.lit("|"), shown))
    _t(spark, sf_dir, "part").select(line.alias("value")).write.text(at)
    return T.read_listing(spark, at)


@query("SELECT n_nationkey::VARCHAR AS video, n_name || chr(10) || 'ü' || chr(10) AS text FROM nation")
def description_files(spark, sf_dir):
    at = _folder(spark)
    rows = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit("\nü")).alias("value"))
    rows.repartition(1).write.partitionBy("id").text(at)
    return T.read_descriptions(spark, at + "/*/*.txt", r"id=([^/]+)/[^/]*$")


@query("SELECT (SELECT count(DISTINCT n_regionkey) FROM nation) AS files, true AS sized")
def file_listing(spark, sf_dir):
    at = _folder(spark)
    _t(spark, sf_dir, "nation").repartition(1).write.partitionBy("n_regionkey").parquet(at)
    return T.read_files(spark, at, ("parquet", "mp4")).agg(F.count("*").alias("files"), F.min(F.col("length") > 0).alias("sized"))


@query("SELECT label, vec_id || '__07' AS name, vec_id::VARCHAR AS video, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def vector_cache(spark, sf_dir):
    at = _folder(spark)
    T.write_vectors(_t(spark, sf_dir, "embeddings").select("label", X.clip_key(F.col("vec_id").cast("string"), F.lit(7)).alias("name"), F.col("embedding").alias("features")), at)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return T.read_vectors(spark, at).select("label", "name", "video", F.round(total, 4).alias("total"))


@query("SELECT n_nationkey, NULL::VARCHAR AS n_name FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey > 0")
def appended_rows(spark, sf_dir):
    at, rows = _folder(spark), _t(spark, sf_dir, "nation")
    T.append_rows(rows.where("n_regionkey = 0").select("n_nationkey"), at)
    T.append_rows(rows.where("n_regionkey > 0").select("n_nationkey", "n_name"), at)
    return T.read_merged(spark, at).select("n_nationkey", "n_name")


@query("SELECT 1 AS v, n_nationkey FROM nation UNION ALL SELECT 2, n_nationkey FROM nation WHERE n_regionkey = 1")
def replaced_versions(spark, sf_dir):
    at, rows = _folder(spark), _t(spark, sf_dir, "nation").select("n_nationkey")
    first, second = T.replace_version(rows, at, 1), T.replace_version(_t(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey"), at, 2)
    read = lambda v, path: spark.read.schema(rows.schema).parquet(path).select(F.lit(v).alias("v"), "n_nationkey")
    return read(1, first).union(read(2, second))


@query("SELECT n_name AS tournament, 'v' || n_nationkey AS video FROM nation")
def json_lists(spark, sf_dir):
    at = _folder(spark)
    T.write_json(_t(spark, sf_dir, "nation").select(F.col("n_name").alias("tournament"), F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("video")), at)
    return spark.read.schema("tournament string, video string").json(at)


@query("SELECT label::VARCHAR AS label, 64 AS dim, 1 AS meta FROM embeddings GROUP BY 1")
def saved_heads(spark, sf_dir):
    at = _folder(spark)
    H.save_head(H.fit_head(_t(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("features")), "label"), at, encoder="hash")
    return H.load_head(spark, at).join(F.broadcast(spark.read.json(f"{at}/meta").where("encoder = 'hash'").select(F.lit(1).alias("meta"))), how="cross").select("label", "dim", "meta")


# -- streams


@query("SELECT event_type, count(*) AS n, 2::BIGINT AS runs FROM events WHERE value > 0 GROUP BY 1")
def resumed_stage(spark, sf_dir):
    """A stage over files that arrive between two runs: no row is lost or done twice."""
    at, rows = _folder(spark), _t(spark, sf_dir, "events").select("event_id", "event_type", "value")
    stage = lambda df: df.where("value > 0")
    for part in (0, 1):
        T.append_rows(rows.where(F.col("event_id") % 2 == part), f"{at}/in")
        I.run_stage(spark, f"{at}/in", rows.schema, stage, f"{at}/out", f"{at}/state", f"{at}/done", "event_id")
    out = spark.read.schema(rows.schema).parquet(f"{at}/out/batch=*")
    runs = T.read_files(spark, f"{at}/out", ("parquet",)).agg(F.countDistinct(F.regexp_extract("path", "batch=([0-9]+)", 1)).alias("runs"))
    return out.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(runs))  # one row


@query(f"""WITH RECURSIVE o AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS r FROM {_EV}),
 w(user_id, r, last, hit) AS (SELECT user_id, r, t, true FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.r, CASE WHEN o.t - w.last >= 43200 THEN o.t ELSE w.last END, o.t - w.last >= 43200 FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1)
 SELECT user_id, last AS t FROM w WHERE hit""")
def streamed_min_gap(spark, sf_dir):
    """The minimum-gap rule with state, over two days' files in order."""
    at, rows = _folder(spark), _events(spark, sf_dir).select("user_id", "t")
    schema, half = rows.schema, 1704067200.0 + 15 * 86400
    for part in (F.col("t") < half, F.col("t") >= half):
        T.append_rows(rows.where(part).coalesce(1), f"{at}/in")
        stream = I.stream_min_gap(spark.readStream.schema(schema).parquet(f"{at}/in"), "user_id", "t", 43200.0)
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events),
 g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s), e AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS b, count(*) AS n FROM g GROUP BY user_id, g)
 SELECT user_id, epoch_us(a) AS start_us, epoch_us(b) AS end_us, n FROM e WHERE b <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def session_stream(spark, sf_dir):
    """Sessions of a stream: those that the watermark has passed are out."""
    at, rows = _folder(spark), _t(spark, sf_dir, "events").select("user_id", "ts")
    T.append_rows(rows.coalesce(1), f"{at}/in")
    stream = I.sessions(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), "user_id", "ts", "6 hours")
    stream = stream.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
    for _ in range(2):
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id bigint, start_us bigint, end_us bigint, n bigint").parquet(f"{at}/out")
