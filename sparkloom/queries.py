"""One query per operator over the driver's tables, with the same result as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions import vocabulary
from sparkloom.operators import evaluation as E
from sparkloom.operators import features as V
from sparkloom.operators import head as H
from sparkloom.operators import manifest as M
from sparkloom.operators import selection as C
from sparkloom.operators import signal as S
from sparkloom.plans import batches as P
from sparkloom.streaming import incremental as I

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_EV = "(SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"
_FLAGS = f"""f AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS idx,
 value > median(value) OVER (PARTITION BY user_id) AS flag FROM {_EV})"""
_ISLANDS = "SELECT user_id, island, any_value(flag) AS flag, min(i) AS i, max(j) AS j FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS island FROM (SELECT *, CASE WHEN flag = lag(flag) OVER (PARTITION BY user_id ORDER BY i) THEN 0 ELSE 1 END AS c FROM {})) GROUP BY 1, 2"
_RUNS = f"{_FLAGS}, s AS (SELECT user_id, flag, idx AS i, idx + 1 AS j FROM f), p AS ({_ISLANDS.format('s')})"


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
    """Events with t, seconds since 1970."""
    return _t(spark, sf_dir, "events").withColumn("t", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / F.lit(1e6))


def _days(ts: str):
    return F.datediff(F.col(ts).cast("date"), F.lit("1992-01-01").cast("date"))


def _above_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.indexed(_events(spark, sf_dir), "user_id", ["t", "event_id"])
    med = rows.groupBy("user_id").agg(F.median("value").alias("med"))
    return rows.join(med, "user_id").select("user_id", "idx", (F.col("value") > F.col("med")).alias("flag"))


_EDGES = f"""med AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1),
 lim AS (SELECT event_type, any_value(m) + 6 * coalesce(nullif(median(abs(value - m)), 0), 1) AS lim FROM events JOIN med USING (event_type) GROUP BY 1),
 a AS (SELECT e.*, value > lim AS above FROM {_EV} e JOIN lim USING (event_type)),
 edge AS (SELECT * FROM (SELECT *, lag(above, 1, false) OVER (PARTITION BY event_type ORDER BY t, event_id) AS before FROM a) WHERE above AND NOT before)"""


@query(f"""WITH RECURSIVE {_EDGES},
 o AS (SELECT event_type, t, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) AS r FROM edge),
 w(event_type, r, last, hit) AS (SELECT event_type, r, t, true FROM o WHERE r = 1
  UNION ALL SELECT o.event_type, o.r, CASE WHEN o.t - w.last >= 21600 THEN o.t ELSE w.last END, o.t - w.last >= 21600 FROM w JOIN o ON o.event_type = w.event_type AND o.r = w.r + 1)
 SELECT event_type, last AS t FROM w WHERE hit""")
def onset_mad_mingap(spark, sf_dir):
    return S.onsets(_events(spark, sf_dir), "event_type", "t", "value", ["t", "event_id"], 6.0, 21600.0)


@query(f"WITH {_EDGES} SELECT event_type, event_id FROM edge")
def rising_edges(spark, sf_dir):
    rows = _events(spark, sf_dir)
    over = rows.join(S.robust_limits(rows, "event_type", "value", 6.0), "event_type")
    return S.rising_edges(over, "event_type", ["t", "event_id"], F.col("value") > F.col("limit")).select("event_type", "event_id")


@query("SELECT event_type, round(any_value(m), 6) AS med, round(median(abs(value - m)), 6) AS mad FROM events JOIN (SELECT event_type, median(value) AS m FROM events GROUP BY 1) USING (event_type) GROUP BY 1")
def median_mad(spark, sf_dir):
    rows = S.median_mad(_t(spark, sf_dir, "events"), "event_type", "value")
    return rows.select("event_type", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"))


@query(f"WITH {_RUNS} SELECT user_id, i, j FROM p WHERE flag AND j - i >= 2")
def islands_runs(spark, sf_dir):
    return S.runs(_above_median(spark, sf_dir), "user_id", 2)


_BRIDGED = f"""{_RUNS}, b AS (SELECT user_id, flag OR (j - i <= 2 AND island > min(island) OVER u AND island < max(island) OVER u) AS flag, i, j FROM p WINDOW u AS (PARTITION BY user_id)), q AS ({_ISLANDS.format("b")})"""


@query(f"WITH {_BRIDGED} SELECT user_id, i, j FROM q WHERE flag AND j - i >= 3")
def islands_bridged(spark, sf_dir):
    return S.runs(_above_median(spark, sf_dir), "user_id", 3, 2)


@query(f"WITH {_RUNS} SELECT user_id, i, j FROM p WHERE flag QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY j - i DESC, i) = 1")
def longest_run(spark, sf_dir):
    return S.longest_run(S.runs(_above_median(spark, sf_dir), "user_id"), "user_id")


@query(f"WITH {_RUNS} SELECT user_id, max(i) AS i, max(j) AS j FROM p WHERE flag AND j - i >= 2 GROUP BY 1")
def last_run(spark, sf_dir):
    return S.last_run(S.runs(_above_median(spark, sf_dir), "user_id", 2), "user_id").select("user_id", "i", "j")


@query(f"SELECT user_id, event_id FROM {_EV} QUALIFY value > min(value) OVER (PARTITION BY user_id) + 0.6 * (max(value) OVER (PARTITION BY user_id) - min(value) OVER (PARTITION BY user_id))")
def hot_share(spark, sf_dir):
    return S.hot(_events(spark, sf_dir), "user_id", "value").where("flag").select("user_id", "event_id")


@query("""WITH d AS (SELECT o_custkey, o_orderkey, datediff('day', DATE '1992-01-01', o_orderdate::DATE) AS start FROM orders),
 u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY o_custkey, start ORDER BY o_orderkey) = 1),
 w AS (SELECT *, row_number() OVER c AS n, coalesce(lead(start) OVER c, 4000) AS e FROM u WINDOW c AS (PARTITION BY o_custkey ORDER BY start))
 SELECT o_custkey, o_orderkey, n, start, least(e, start + 300) AS "end" FROM w WHERE e > start""")
def lead_window_clamp(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", _days("o_orderdate").alias("start"), F.lit(4000).alias("duration"))
    rows = M.first_wins(rows, ["o_custkey", "start"], ["o_orderkey"])
    return M.lead_window(rows, "o_custkey", "start", "duration").select("o_custkey", "o_orderkey", "n", "start", "end")


@query("SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def dedupe_first_wins(spark, sf_dir):
    return M.first_wins(_t(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"])


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 45)")
def resume_anti(spark, sf_dir):
    done = _t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return P.pending(_t(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("SELECT c_custkey FROM customer EXCEPT (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def pending_anti_union(spark, sf_dir):
    cust = _t(spark, sf_dir, "customer")
    urgent = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    out = P.union_of(urgent, cust.where("c_acctbal < 0").select("c_custkey"), cust.where("c_nationkey = 3").select("c_custkey"))
    return P.pending(cust.select("c_custkey"), out, ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_totalprice > 300000)")
def batch_semi(spark, sf_dir):
    chosen = _t(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"))
    return P.of_batch(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), chosen, "l_orderkey")


_BOUT = r"(?i)^\s*((?:\d{1,2}:)?\d{1,2}:\d{2})\s*[-–—:]?\s+([A-Za-z][\pL\pN_''.-]*)\s+(?:vs?\.?)\s+([A-Za-z][\pL\pN_''.-]*)"
_TOKENS = ("cheap-pills", "spam-farm", "blog.", "nothing-here")


@query("SELECT token, min(url) AS url FROM pages, (VALUES ('cheap-pills'), ('spam-farm'), ('blog.'), ('nothing-here')) v(token) WHERE contains(url, token) GROUP BY 1")
def substring_theta(spark, sf_dir):
    ids = spark.createDataFrame([(x,) for x in _TOKENS], "token string")
    return P.matching(_t(spark, sf_dir, "pages").select("url"), ids, "url", "token").select("token", "url")


@query("SELECT n_nationkey, min(s_name) AS s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def extracted_id_join(spark, sf_dir):
    files = _t(spark, sf_dir, "supplier").select(F.concat_ws("_", F.col("s_nationkey").cast("string"), "s_name").alias("file"), "s_name")
    ids = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"))
    return P.matching(files, ids, "file", "id", "^([0-9]+)_").select(F.col("id").cast("int").alias("n_nationkey"), "s_name")


@query(f"SELECT s.event_id, count(*) AS n FROM {_EV} s JOIN {_EV} e ON s.user_id = e.user_id AND e.t >= s.t AND e.t < s.t + 3600 WHERE s.event_type = 'signup' GROUP BY 1")
def interval_range(spark, sf_dir):
    rows = _events(spark, sf_dir)
    spans = rows.where("event_type = 'signup'").select("user_id", "event_id", F.col("t").alias("t0"), (F.col("t") + 3600).alias("t1"))
    return S.interval_join(rows.select("user_id", "t"), spans, "user_id").groupBy("event_id").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT s_suppkey, s_nationkey, s_nationkey = 0 AS late, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS turn, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS first FROM supplier)
 SELECT s_suppkey, row_number() OVER (ORDER BY late, turn, first) AS position FROM r""")
def round_robin(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return P.round_robin(rows, "s_nationkey", ["s_suppkey"], F.col("s_nationkey") == 0).select("s_suppkey", "position")


@query(f"""WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM {_EV})
 SELECT user_id, event_id, s::INT AS slot FROM f, range(16) r(s) WHERE round_even(s * (n - 1) / 15, 0) = idx""")
def evenly_spaced_k(spark, sf_dir):
    return S.evenly_spaced(_events(spark, sf_dir), "user_id", ["t", "event_id"], 16).select("user_id", "event_id", "slot")


@query(f"""WITH c AS (SELECT user_id, event_type, count(*) AS votes, min((t, event_id)) AS f FROM {_EV} GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(votes) OVER w, 0) AS nxt FROM c WINDOW w AS (PARTITION BY user_id ORDER BY votes DESC, f))
 SELECT user_id, event_type, votes, f[1] AS first FROM r WHERE r = 1 AND votes >= 2 AND votes - nxt >= 2""".replace("f[1]", "struct_extract(f, 1)"))
def plurality_margin(spark, sf_dir):
    return M.plurality(_events(spark, sf_dir), ["user_id"], "event_type", ["t", "event_id"])


_LINE = """lpad((turn % 60)::VARCHAR, 2, '0') || ':' || lpad((no * 7 % 60)::VARCHAR, 2, '0') || CASE WHEN turn % 2 = 0 THEN ' - ' ELSE ' ' END || split_part(line, ' ', 1) || CASE WHEN no % 3 = 2 THEN ' / ' ELSE ' vs ' END || split_part(line, ' ', 2)"""


@query(f"""WITH l AS (SELECT conv_id, turn, unnest(range(len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS line FROM conversations), m AS (SELECT *, {_LINE} AS made FROM l), k AS (SELECT 'made' AS kind, conv_id, turn, no, made AS line FROM m UNION ALL SELECT 'plain', conv_id, turn, no, line FROM m)
 SELECT kind, conv_id, turn, no, split_part(regexp_extract(line, '{_BOUT}', 1), ':', 1)::INT * 60 + split_part(regexp_extract(line, '{_BOUT}', 1), ':', 2)::INT AS start, regexp_extract(line, '{_BOUT}', 2) AS east, regexp_extract(line, '{_BOUT}', 3) AS west FROM k WHERE regexp_matches(line, '{_BOUT}')""")
def regex_timestamp_lines(spark, sf_dir):
    """All lines of all conversations, as they are and with a clock before their first two words."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    word = lambda i: F.coalesce(F.get(F.split("line", " "), F.lit(i)), F.lit(""))
    lines = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    made = F.concat(two(F.col("turn") % 60), F.lit(":"), two(F.col("no") * 7 % 60), F.when(F.col("turn") % 2 == 0, " - ").otherwise(" "), word(0), F.when(F.col("no") % 3 == 2, " / ").otherwise(" vs "), word(1))
    both = lines.withColumn("k", F.explode(F.array(F.struct(F.lit("made").alias("kind"), made.alias("l")), F.struct(F.lit("plain").alias("kind"), F.col("line").alias("l")))))
    rows = both.select("k.kind", "conv_id", "turn", "no", X.bout_line(F.col("k.l")).alias("b"))
    return rows.where("b IS NOT NULL").select("kind", "conv_id", "turn", "no", F.col("b.start").alias("start"), "b.east", "b.west")


_VOCABULARY = ", ".join(f"({i}, '{n}', '{k}')" for i, n, k, _, _ in vocabulary.entries())


@query(f"""WITH v(ord, name, kanji) AS (VALUES {_VOCABULARY}),
 p AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN upper(substr(name, 1, greatest(1, length(name) - p_size % 7))) WHEN 1 THEN ' ' || name || repeat('x', p_size % 4) WHEN 2 THEN kanji WHEN 3 THEN reverse(name) ELSE p_type END AS raw FROM part JOIN v ON p_partkey % 89 = ord),
 k AS (SELECT *, replace(replace(replace(replace(lower(trim(raw)), '''', ''), '-', ''), ' ', ''), '_', '') AS key FROM p),
 m AS (SELECT p_partkey, v.name, v.ord, CASE WHEN kanji = trim(raw) THEN 0 WHEN name = key THEN 1 ELSE 2 END AS how FROM k JOIN v ON kanji = trim(raw) OR name = key OR ((starts_with(key, name) OR starts_with(name, key)) AND abs(length(key) - length(name)) <= 2))
 SELECT p_partkey, name FROM part LEFT JOIN (SELECT p_partkey, name FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY how, ord) = 1) USING (p_partkey)""")
def normalize_vocab(spark, sf_dir):
    dim = vocabulary.taxonomy(spark)
    rows = _t(spark, sf_dir, "part").join(F.broadcast(dim), (F.col("p_partkey") % 89) == F.col("ord"))
    size, name = F.col("p_size"), F.col("name")
    cut = F.upper(F.substr(name, F.lit(1), F.greatest(F.lit(1), F.length(name) - size % 7)))
    raw = F.when(size % 5 == 0, cut).when(size % 5 == 1, F.concat(F.lit(" "), name, F.repeat(F.lit("x"), size % 4))).when(size % 5 == 2, F.col("kanji")).when(size % 5 == 3, F.reverse(name)).otherwise(F.col("p_type"))
    return rows.select("p_partkey", X.normalize(raw).alias("name"))


@query("SELECT doc_id, translate(text, '1!|[]/\\05862', 'IIIIIIIOSBGZ') AS fixed FROM documents")
def glyph_repair(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", X.glyph_repair(F.col("text")).alias("fixed"))


def _spans(spark, sf_dir) -> DataFrame:
    q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") < 7, q).alias("run_start"), (q + F.col("l_extendedprice") / 2000).alias("run_end"), F.when(F.col("l_linenumber") % 2 == 0, q + disc * 100).alias("banner"), disc, tax)
    rows = rows.withColumns({"caption_t": F.coalesce("run_end", F.lit(0.0)) + tax * 1000, "purity": 1 - disc})
    return M.accepted_window(rows)


_ACCEPT = """s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 7 THEN l_quantity END AS r0, l_quantity + l_extendedprice / 2000 AS r1, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity + l_discount * 100 END AS b, l_quantity + l_extendedprice / 2000 + l_tax * 1000 AS cap, 1 - l_discount AS purity FROM lineitem),
 e AS (SELECT *, least(r1, cap - 8) AS t1, CASE WHEN b IS NOT NULL AND b - r0 BETWEEN 0 AND 12 AND r1 - b >= 3 THEN b ELSE r0 END AS s0 FROM s),
 w AS (SELECT *, greatest(s0, t1 - 30) AS t0 FROM e),
 a AS (SELECT *, CASE WHEN r0 IS NULL OR r1 IS NULL THEN 'no_run' WHEN t1 - t0 < 8 THEN 'short_span' WHEN cap - t0 > 70 THEN 'far_from_caption' WHEN purity < 0.9 THEN 'impure' END AS reason FROM w)"""


@query(f"WITH {_ACCEPT} SELECT l_orderkey, l_linenumber, CASE WHEN r0 IS NOT NULL THEN t0 END AS t0, t1, coalesce(reason, 'kept') AS reason FROM a")
def accept_reason_chain(spark, sf_dir):
    rows = _spans(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", F.when(F.col("run_start").isNotNull(), F.col("t0")).alias("t0"), "t1", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query(f"WITH {_ACCEPT} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM a GROUP BY 1")
def drop_reasons(spark, sf_dir):
    return M.drop_reasons(_spans(spark, sf_dir).select("reason"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity + l_extendedprice / 5000 - l_quantity < 5 THEN l_quantity ELSE l_quantity + l_extendedprice / 5000 - 4 END AS f0 FROM lineitem")
def finish_projection(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("t0"), (F.col("l_quantity") + F.col("l_extendedprice") / 5000).alias("t1"))
    return M.finish_span(rows, 4.0).select("l_orderkey", "l_linenumber", "f0")


@query("SELECT count(*) AS n, sum((l.doc_id IS NULL)::INT)::BIGINT AS missed, round(sum((l.doc_id IS NULL)::INT) / count(*), 6) AS rate, sum((l.doc_id IS NULL)::INT) / count(*) > 0.2 AS alarm FROM documents d LEFT JOIN labels l USING (doc_id)")
def miss_rate_alarm(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return M.miss_rate(rows, F.col("quality").isNull()).withColumn("rate", F.round("rate", 6))


@query("SELECT l_orderkey, min(l_quantity) AS low, list_sort(list(l_quantity))[count(*) // 2 + 1] AS mid, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def upper_median_span(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("low"), F.collect_list("l_quantity").alias("all"), F.max("l_quantity").alias("high"))
    return rows.select("l_orderkey", "low", X.upper_median(F.col("all")).alias("mid"), "high")  # an order has few lines


@query("SELECT CASE WHEN n < 50 THEN 'other' ELSE label::VARCHAR END AS label, sum(n)::BIGINT AS n FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) GROUP BY 1")
def rare_fold(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("label"))
    return E.rare_fold(rows, "label", 50).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT quality AS label, round(n / sum(n) OVER (), 6) AS share FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, quality DESC) = 1")
def majority_baseline(spark, sf_dir):
    return E.majority(_t(spark, sf_dir, "labels"), "quality").withColumn("share", F.round("share", 6))


def _told(spark, sf_dir) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") % 7 > 1).cast("int").alias("p"))
    return _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")


_TOLD = "t AS (SELECT doc_id, source, quality AS y, (n_chars % 7 > 1)::INT AS p FROM labels JOIN documents USING (doc_id))"
_REPORT = f"""{_TOLD}, l AS (SELECT y AS label FROM t UNION SELECT p FROM t),
 r AS (SELECT label, count(*) FILTER (y = label) AS support, count(*) FILTER (p = label) AS told, count(*) FILTER (y = label AND p = label) AS tp FROM l, t GROUP BY 1),
 m AS (SELECT label, coalesce(tp / nullif(told, 0), 0) AS prec, coalesce(tp / nullif(support, 0), 0) AS rec, coalesce(2 * tp / nullif(support + told, 0), 0) AS f1, support FROM r)"""


@query(f"WITH {_TOLD} SELECT v.y, count(t.y) FILTER (p = 0) AS p_0, count(t.y) FILTER (p = 1) AS p_1, count(t.y) FILTER (p = 2) AS p_2 FROM (VALUES (0), (1), (2)) v(y) LEFT JOIN t ON t.y = v.y GROUP BY 1")
def confusion(spark, sf_dir):
    return E.confusion(_told(spark, sf_dir), "y", "p", [0, 1, 2])


@query(f"WITH {_REPORT} SELECT label, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1, support FROM m")
def class_report(spark, sf_dir):
    return E.class_report(_told(spark, sf_dir), "y", "p").select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"WITH {_REPORT} SELECT 'macro' AS average, round(avg(prec), 6) AS precision, round(avg(rec), 6) AS recall, round(avg(f1), 6) AS f1 FROM m UNION ALL SELECT 'weighted', round(sum(prec * support) / sum(support), 6), round(sum(rec * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6) FROM m")
def report_averages(spark, sf_dir):
    rows = E.report_averages(E.class_report(_told(spark, sf_dir), "y", "p"))
    return rows.select("average", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {_REPORT} SELECT round(sum(rec * support) / sum(support), 6) AS accuracy, round(avg(rec) FILTER (support > 0), 6) AS balanced_accuracy, round(avg(f1), 6) AS f1_macro FROM m")
def balanced_accuracy(spark, sf_dir):
    return E.scores(_told(spark, sf_dir), "y", "p").select(*(F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "f1_macro")))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std_pop, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS se, count(*) AS n FROM orders GROUP BY 1")
def mean_std(spark, sf_dir):
    rows = E.mean_std(_t(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return rows.select("o_orderpriority", *(F.round(c, 4).alias(c) for c in ("mean", "std_pop", "se")), "n")


@query("""WITH m AS (SELECT c_nationkey AS k, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), yr AS (SELECT min(y) + 1 AS y0 FROM m),
 d AS (SELECT b.v - a.v AS d FROM m a JOIN m b USING (k), yr WHERE a.y = y0 AND b.y = y0 + 1)
 SELECT round(avg(d), 4) AS mean, round(stddev_samp(d) / sqrt(count(*)), 4) AS se, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t, sum((d > 0)::INT)::BIGINT AS better, count(*) AS n, false AS exact FROM d""")
def paired_delta_t(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    means = rows.groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    first = means.agg((F.min("y") + 1).alias("y0"))
    means = means.crossJoin(F.broadcast(first))  # one row
    out = E.paired_delta(means.where("y = y0"), means.where("y = y0 + 1"), ["c_nationkey"], "v")
    return out.select(*(F.round(c, 4).alias(c) for c in ("mean", "se", "t")), "better", "n", "exact")


@query("SELECT event_type, round(regr_slope(n, d), 6) AS slope FROM (SELECT event_type, datediff('day', DATE '2024-01-01', ts::DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def curve_slope(spark, sf_dir):
    days = _t(spark, sf_dir, "events").groupBy("event_type", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("d")).agg(F.count("*").alias("n"))
    return E.slope(days, "d", "n", ["event_type"]).withColumn("slope", F.round("slope", 6))


@query("""WITH r AS (SELECT d AS draw, c_custkey, row_number() OVER (PARTITION BY d ORDER BY md5(d::VARCHAR || ':' || c_custkey::VARCHAR), c_custkey) AS rk FROM customer, range(5) x(d))
 SELECT draw::INT AS draw, s AS size, c_custkey FROM r, (VALUES (5), (20), (50)) v(s) WHERE rk <= s""")
def nested_pools(spark, sf_dir):
    return E.nested_pools(_t(spark, sf_dir, "customer"), "c_custkey", 5, [5, 20, 50])


@query("SELECT vec_id, unnest(range(len(v)))::INT AS dim, round(unnest(v)::DOUBLE, 5) AS x FROM (SELECT vec_id, embedding[33:] || embedding[1:32] AS v FROM embeddings)")
def feature_concat_align(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings")
    part = lambda a, n: rows.select("vec_id", F.slice("embedding", a, n).alias("features"))
    both = V.aligned([part(33, 1 << 20), part(1, 32)], "vec_id")
    return V.dimensions(both, "vec_id").select("vec_id", "dim", F.round(F.col("x").cast("double"), 5).alias("x"))


@query("SELECT * FROM (VALUES ('all', (SELECT count(*) FROM embeddings), 'reference'), ('copy', (SELECT count(*) FROM embeddings), 'fresh'), ('some', (SELECT count(*) FROM embeddings WHERE label < 5), 'stale'), ('more', (SELECT count(*) FROM embeddings WHERE label < 5), 'conflict'), ('order', (SELECT count(*) FROM embeddings), 'conflict')) v(cache, n, status)")
def feature_set_status(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings")
    one = lambda cache, ord_, src, name, pos: src.select(F.lit(cache).alias("cache"), F.lit(ord_).alias("ord"), name.alias("name"), pos.alias("pos"))
    vec, some = F.col("vec_id"), rows.where("label < 5")  # a cache left behind, and one that has a vector of its own
    sets = [one("all", 0, rows, vec, vec), one("copy", 1, rows, vec, vec), one("some", 2, some, vec, vec), one("more", 3, some, -vec - 1, vec), one("order", 4, rows, vec, -vec)]
    names = sets[0]
    for s in sets[1:]:
        names = names.union(s)
    return E.set_status(names, "cache", "name")


@query("SELECT d::INT AS dim, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings) GROUP BY 1")
def standardize_pop(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    fitted = V.scaler(rows)
    return fitted.select(F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "c")).select("dim", F.round("c.mean", 5).alias("mean"), F.round("c.std", 5).alias("std"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings), c AS (SELECT label AS told, d, avg(x) AS m FROM e GROUP BY 1, 2),
 g AS (SELECT vec_id, told, sum((x - m) * (x - m)) AS q FROM e JOIN c USING (d) GROUP BY 1, 2)
 SELECT vec_id, told, round(q, 4) AS distance2 FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY q, told) = 1""")
def centroid_nearest(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))
    return V.nearest(rows, V.centroids(rows, "label"), "vec_id", "label").withColumn("distance2", F.round("distance2", 4))


@query(f"""WITH r AS (SELECT user_id, event_id, value, row_number() OVER w AS rank, lead(value) OVER w AS nxt FROM {_EV} WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id DESC)),
 m AS (SELECT user_id, value - nxt < 0.15 AS low FROM r WHERE rank = 1)
 SELECT user_id, event_id, value, rank::INT AS rank, coalesce(low, false) AS low_margin FROM r JOIN m USING (user_id) WHERE rank <= 3""")
def topk_margin(spark, sf_dir):
    return E.top_k(_events(spark, sf_dir), "user_id", "event_id", "value", 3)


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events),
 g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
 SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS end_us, count(*) AS n FROM g GROUP BY user_id, g""")
def session_windows(spark, sf_dir):
    rows = I.sessions(_t(spark, sf_dir, "events"), "user_id", "ts", "6 hours")
    return rows.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(f"WITH c AS (SELECT user_id, t - 5.2 - 1704067200 AS start FROM {_EV} WHERE event_type = 'error') SELECT user_id, n, round(start, 3) AS start FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start) AS n FROM c WHERE start >= 0)")
def clip_spans(spark, sf_dir):
    rows = _events(spark, sf_dir).where("event_type = 'error'").select("user_id", (F.col("t") - 1704067200).alias("t"))
    return S.clip_spans(rows, "user_id", "t").select("user_id", "n", F.round("start", 3).alias("start"))


@query("SELECT c_nationkey, n, NOT (n >= 0.6 * 60 AND n <= 1.6 * 60) AS flagged FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)")
def expected_count(spark, sf_dir):
    counts = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return S.expected_count(counts, "n", F.lit(60))


@query("SELECT count(*) AS n, round(count(*) * 0.19, 4) AS need_gb, 25 - count(*) * 0.19 >= 5 AS ok FROM supplier")
def disk_gate(spark, sf_dir):
    return P.disk_gate(_t(spark, sf_dir, "supplier"), 25.0).withColumn("need_gb", F.round("need_gb", 4))


@query("SELECT p_partkey, s::DOUBLE AS scale, greatest(0, p_size - s)::DOUBLE AS t0 FROM part, (VALUES (2), (3), (6)) v(s)")
def scale_windows(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("duration"))
    return P.scale_windows(rows, [2.0, 3.0, 6.0]).select("p_partkey", "scale", "t0")


@query("SELECT n_nationkey, coalesce(o.n_name, n.n_name) AS n_name FROM nation n LEFT JOIN (SELECT n_nationkey, upper(n_name) || '!' AS n_name FROM nation WHERE n_regionkey = 1) o USING (n_nationkey)")
def upsert_rows(spark, sf_dir):
    old = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    new = _t(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("n_name"))
    return P.upsert(old, new, ["n_nationkey"])


@query("SELECT conv_id || '__' || lpad(turn::VARCHAR, 2, '0') AS clip, conv_id::VARCHAR AS grp FROM conversations")
def clip_groups(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select(X.clip_key(F.col("conv_id").cast("string"), F.col("turn")).alias("clip"))
    return rows.select("clip", X.group_of(F.col("clip")).alias("grp"))


@query()
def logistic_head_cv(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("features"), (F.col("vec_id") % 13).alias("grp"))
    return V.fold_metrics(V.fold_scores(rows, E.group_folds(rows, "grp", 5), "vec_id", "label", "grp"))


@query()
def pool_curve(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("features"), (F.col("vec_id") % 13).alias("grp"))
    return V.pool_scores(rows, E.nested_pools(rows, "grp", 3, [2, 5, 13]), "label", "grp")


@query()
def ward_clusters(spark, sf_dir):
    return V.ward_clusters(_t(spark, sf_dir, "embeddings"), "vec_id", 24, "embedding", "label")


@query()
def permutation_test(spark, sf_dir):
    return E.permutation_test(_told(spark, sf_dir), "y", "p", "source")


@query("SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 5")
def head_per_group(spark, sf_dir):
    return C.head(_t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], 5)


@query("SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS r FROM customer) WHERE r % 7 = 0 AND r < 42")
def strided_sample(spark, sf_dir):
    return C.strided(_t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], 7, 6)


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, min(p_partkey) LIMIT 5")
def most_common(spark, sf_dir):
    return C.most_common(_t(spark, sf_dir, "part"), "p_brand", "p_partkey", 5)


def _named(spark, sf_dir) -> DataFrame:
    dim = F.broadcast(vocabulary.taxonomy(spark))  # 89 rows
    return _t(spark, sf_dir, "supplier").join(dim, (F.col("s_suppkey") * 3 % 89) == F.col("ord")).select("s_suppkey", "name")


_PAIRS = ", ".join(f"('{k}', '{a}', '{b}', {i})" for k, a, b, i in vocabulary.pair_rows())
_NAMED = f"v(ord, name, kanji) AS (VALUES {_VOCABULARY}), q(kind, a, b, i) AS (VALUES {_PAIRS}), s AS (SELECT s_suppkey, name FROM supplier JOIN v ON s_suppkey * 3 % 89 = ord)"


@query(f"WITH {_NAMED} SELECT kind, a, b FROM q WHERE a IN (SELECT name FROM s) AND b IN (SELECT name FROM s)")
def present_pairs(spark, sf_dir):
    return C.present_pairs(vocabulary.pairs(spark), _named(spark, sf_dir), "name")


@query(f"WITH {_NAMED} SELECT s_suppkey, name, (SELECT arg_min(CASE WHEN a = name THEN b ELSE a END, i) FROM q WHERE a = name OR b = name) AS partner FROM s")
def partner_lookup(spark, sf_dir):
    return C.partner(_named(spark, sf_dir), "name", vocabulary.pairs(spark)).select("s_suppkey", "name", "partner")


@query(f"SELECT s_suppkey, coalesce(family, 'other') AS family FROM supplier JOIN (VALUES {', '.join(f'({i}, ' + (chr(39) + f + chr(39) if f else 'NULL') + ')' for i, _, _, f, _ in vocabulary.entries())}) v(ord, family) ON s_suppkey * 3 % 89 = ord")
def family_lookup(spark, sf_dir):
    return E.family(_named(spark, sf_dir), "name", vocabulary.taxonomy(spark)).select("s_suppkey", "family")


@query("(SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders)")
def symmetric_difference(spark, sf_dir):
    a = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return C.symmetric_difference(a, _t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("SELECT missing, count(*) AS n FROM (SELECT c_custkey NOT IN (SELECT o_custkey FROM orders) AS missing FROM customer) GROUP BY 1")
def missing_files(spark, sf_dir):
    rows = C.existence(_t(spark, sf_dir, "customer").select("c_custkey"), _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])
    return rows.groupBy("missing").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_orderkey = l.l_orderkey AND s.l_returnflag = 'R') OR EXISTS (SELECT 1 FROM lineitem s WHERE s.l_orderkey = l.l_orderkey AND s.l_linenumber = l.l_linenumber AND s.l_returnflag = 'R' AND s.l_quantity > 25)")
def edge_prefilter(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem")
    seen = rows.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")
    return C.prefiltered(rows.select("l_orderkey", "l_linenumber"), seen, ["l_orderkey", "l_linenumber"], "l_quantity", 25.0)


@query(f"SELECT user_id, event_id FROM (SELECT e.user_id, e.event_id, count(*) OVER (PARTITION BY s.user_id, s.t) AS n FROM (SELECT DISTINCT user_id, t FROM {_EV} WHERE event_type = 'purchase') s JOIN {_EV} e ON s.user_id = e.user_id AND e.t >= s.t AND e.t < s.t + 43200) WHERE n >= 3")
def frames_between(spark, sf_dir):
    rows = _events(spark, sf_dir)
    spans = rows.where("event_type = 'purchase'").select("user_id", F.col("t").alias("t0"), (F.col("t") + 43200).alias("t1")).distinct()
    return C.frames_between(rows.select("user_id", "event_id", "t"), spans, "user_id", 3).select("user_id", "event_id")


@query()
def head_predictions(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("features"))
    return H.predict(rows, H.fit_head(rows, "label"), "vec_id")


from sparkloom import more_queries as _more  # noqa: E402

QUERIES |= _more.QUERIES
ORACLES |= _more.ORACLES
