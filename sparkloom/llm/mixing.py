"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame functions only).

The words of a source, document after document, are one stream cut into blocks of ``BLOCK`` words.  Its target is a
number of draws: whole passes over all blocks and, in the last pass, the first blocks of a keyed permutation (the very
last block cut to the word).  A binary tree deals the draws of all sources to output shards; each node splits its vector
of draws per source between its two halves by a multivariate hypergeometric draw, as a full shuffle of all draws would.
A shard then owns a range of each source's permuted draws, disjoint from every other shard's.  A block is taken when
a shard owns its draw, and only then; a document goes, pass by pass, to the shard of its first block taken, where
documents are shuffled by hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
BLOCK, SHARDS, SEED = 64, 64, 20240607
#: Sources that one mix may have: their draws are a vector in the tree.
MAX_SOURCES = 10_000
#: Documents are summed in hash buckets of about this many, and these in runs, so that no source needs one task.
BUCKET_DOCS, RUN_BUCKETS = 1_000, 4_096
#: Documents of one task that places blocks, and words of one task that shuffles a piece of a shard.
TASK_DOCS, TASK_WORDS = 8_000, 2_000_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``sources(source, source_size)`` with ``ord`` and ``target``: shares by weight, none above ``cap`` sizes.

    With sources in order of cap / weight, those before the first one that its share does not fill are capped; the
    others share what is left by weight.  That is where resharing the excess again and again ends.
    """
    everything = Window.partitionBy()
    out = sources.withColumn("ord", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    out = out.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("ord") % len(weights) + 1).cast("int")).cast("double"))
    out = out.withColumns({"most": F.col("source_size") * F.lit(cap), "goal": F.sum("source_size").over(everything) * F.lit(float(share))})
    rank = Window.orderBy(F.col("most") / F.col("w"), "ord")
    before = F.coalesce(F.sum("most").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("level", (F.col("goal") - before) / F.sum("w").over(rank.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("level", F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct(F.col("most") / F.col("w"), F.col("level").alias("level")))).over(everything)["level"])
    return out.select("source", "source_size", "ord", F.least(F.col("most").cast("double"), F.col("w") * F.coalesce("level", F.lit(0.0))).alias("target"))


def _uniform(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def hypergeometric(u: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """The number of marked ones among ``drawn`` of ``total``: inversion over 8 standard deviations of the mean."""
    t, m, n = (c.cast("double") for c in (total, marked, drawn))
    mean = F.when(t > 0, n * m / t).otherwise(F.lit(0.0))
    sd = F.sqrt(F.when(t > 1, F.greatest(mean * (F.lit(1.0) - m / t) * (t - n) / (t - 1), F.lit(0.0))).otherwise(F.lit(0.0)))
    low = F.greatest(F.lit(0.0), n + m - t, F.floor(mean - sd * 8 - 1).cast("double"))
    high = F.least(n, m, F.ceil(mean + sd * 8 + 1).cast("double"))
    span = F.sequence(low.cast("bigint"), F.greatest(high, low).cast("bigint"))
    ratio = lambda k: (m - k) * (n - k) / ((k + 1) * F.greatest(t - m - n + k + 1, F.lit(1.0)))
    one = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    mass = F.aggregate(span, one, lambda a, k: F.struct((a["w"] * ratio(k.cast("double"))).alias("w"), (a["sum"] + a["w"]).alias("sum")), lambda a: a["sum"])
    start = F.struct(F.lit(1.0).alias("w"), (u * mass).alias("left"), low.cast("bigint").alias("pick"))
    step = lambda a, k: F.struct((a["w"] * ratio(k.cast("double"))).alias("w"), (a["left"] - a["w"]).alias("left"), F.when(a["left"] > 0, k).otherwise(a["pick"]).alias("pick"))
    return F.aggregate(span, start, step, lambda a: a["pick"])


def quotas(sources: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(ord, shard, quota, start, end): how many draws of each source a shard gets, and the range of them it owns.

    ``sources(ord, draws)``.  Quotas of a source add up to its draws; shards differ by at most one draw per level.
    """
    nodes = sources.agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "draws"))), lambda x: x["draws"]).alias("n"))
    nodes = nodes.select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "n")
    for _ in range((shards - 1).bit_length()):
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        whole = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)
        room = F.round(whole * ((mid - F.col("low")) / (F.col("high") - F.col("low")))).cast("bigint")
        nodes = nodes.select("low", "high", "n", mid.alias("mid"), whole.alias("whole"), room.alias("room"))
        first = F.struct(F.col("whole").alias("whole"), F.col("room").alias("room"), F.array().cast("array<bigint>").alias("out"))

        def split(a: Column, x: Column) -> Column:
            k = hypergeometric(_uniform(F.lit(seed), F.col("low"), F.col("high"), F.size(a["out"])), a["whole"], x, a["room"])
            return F.struct((a["whole"] - x).alias("whole"), (a["room"] - k).alias("room"), F.concat(a["out"], F.array(k)).alias("out"))

        nodes = nodes.withColumn("left", F.aggregate("n", first, split, lambda a: a["out"]))
        halves = F.array(
            F.struct("low", F.col("mid").alias("high"), F.col("left").alias("n")),
            F.struct(F.col("mid").alias("low"), "high", F.zip_with("n", "left", lambda x, y: x - y).alias("n")),
        )
        nodes = nodes.select(F.explode(F.when(F.col("high") - F.col("low") > 1, halves).otherwise(F.array(F.struct("low", "high", "n")))).alias("x")).select("x.*")
    leaf = nodes.select(F.col("low").alias("shard"), F.posexplode("n").alias("ord", "quota"))
    so_far = F.sum("quota").over(Window.partitionBy("ord").orderBy("shard"))
    return leaf.select("ord", "shard", "quota", (so_far - F.col("quota")).alias("start"), so_far.alias("end"))


def owner(ends: Column, draw: Column, shards: int) -> Column:
    """The shard that owns a draw, by the sorted ``ends`` of the shards' ranges; null if none does."""
    halves = [1 << k for k in reversed(range((shards - 1).bit_length() + 1))]  # a search by halves of those left

    def on(low: Column, step: Column) -> Column:
        return F.when((low + step <= shards) & (F.get(ends, low + step - 1) <= draw), low + step).otherwise(low)

    found = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), on)
    return F.when(found < shards, found)


def permuted(block: Column, count: Column, *key: Column) -> Column:
    """Where ``block`` (0 to count-1) stands in a keyed permutation: Feistel rounds on a grid of count cells or a
    few more; cells outside are walked on.  A walk leaves them after as many steps as there are, below sqrt(count)."""
    a = F.greatest(F.ceil(F.sqrt(count.cast("double"))), F.lit(1)).cast("bigint")
    b = F.greatest(F.ceil(count / a), F.lit(1)).cast("bigint")
    cell = lambda x, y, m, n: F.struct(x.alias("x"), y.alias("y"), m.alias("m"), n.alias("n"))

    def once(x: Column) -> Column:  # each round adds a hash of one coordinate to the other and swaps them
        turn = lambda s, r: cell(s["y"], F.pmod(s["x"] + F.pmod(F.xxhash64(*key, r, s["y"]), s["m"]), s["m"]), s["n"], s["m"])
        return F.aggregate(F.sequence(F.lit(1), F.lit(4)), cell(F.floor(x / b).cast("bigint"), x % b, a, b), turn, lambda s: s["x"] * s["n"] + s["y"])

    walk = lambda first: F.aggregate(F.sequence(F.lit(1), F.lit(64)), first, lambda x, _: F.when(x.between(0, count - 1), x).otherwise(once(x)))
    # nearly all arrive with the first step; transform of one element binds it to a name
    return F.transform(F.array(once(block)), lambda x: F.when(x.between(0, count - 1), x).otherwise(walk(x)))[0]


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies, spans, shards.

    ``shards`` are the shards that own draws of the row's blocks, with the words of it that each takes; ``taken`` is
    their sum.  Of these, ``copies`` are whole passes, ``spans`` the word ranges (from, to) of the last pass.  Over a
    source ``taken`` is the target, rounded.  Null and empty texts have size 0 and are never taken; a null source is
    a source, the last.  Without any word all targets are 0.  Repeated rows are documents of their own.  Extra
    columns are ignored.  There may be MAX_SOURCES sources.
    """
    sized = stored(docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("mark"), F.lit(0).alias("row")))
    plan, _ = _plan(sized, weights, share, cap, block, shards, seed)
    words = lambda ps: F.aggregate(ps, F.lit(0).cast("bigint"), lambda a, p: a + p["to"] - p["from"])
    each = F.transform(F.array_sort(F.array_distinct(F.transform("drawn", lambda p: p["shard"]))), lambda s: F.struct(s.alias("shard"), words(F.filter("drawn", lambda p: p["shard"] == s)).alias("words")))
    plan = plan.withColumn("shards", each)
    taken = F.aggregate("shards", F.lit(0).cast("bigint"), lambda a, s: a + s["words"])
    spans = F.transform(F.filter("drawn", lambda p: p["turn"] == F.col("copies")), lambda p: F.struct(p["from"].alias("from"), p["to"].alias("to")))
    return plan.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", spans.alias("spans"), "shards")


def _plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, int]:
    """The stored ``sized(doc_id, source, size, mark, row)`` with source_size, target, copies and ``drawn``: (turn,
    shard, from, to) of every block that a shard takes of the row, pass by pass, in text order.  And the words of all.

    Rows of a source lie in its stream by a hash of doc_id, size and mark; rows that agree in these are alike.
    """
    spark = sized.sparkSession
    count = sized.count()
    buckets = max(1, -(-count // BUCKET_DOCS))
    rows = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "mark"), F.lit(buckets)).cast("int"))
    parts = stored(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sizes = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    if sizes.count() > MAX_SOURCES:
        raise ValueError(f"a mix may have {MAX_SOURCES} sources")
    goals = targets(sizes, weights, share, cap)
    size, words = F.col("source_size"), F.floor(F.col("target") + 0.5).cast("bigint")
    goals = goals.withColumn("copies", F.when(size > 0, F.floor(words / size)).otherwise(F.lit(0)).cast("bigint"))
    goals = goals.withColumns({"rest": words - F.col("copies") * size, "blocks": F.ceil(size / block).cast("bigint")})
    goals = stored(goals.withColumns({"last": F.ceil(F.col("rest") / block).cast("bigint")}).withColumn("draws", F.col("copies") * F.col("blocks") + F.col("last")))
    ends = quotas(goals.select("ord", "draws"), shards, seed).groupBy("ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    total = goals.agg(F.sum("target")).first()[0] or 0
    goals = stored(goals.join(ends, "ord").withColumnRenamed("source", "g_source"))
    run = F.floor(F.col("bucket") / RUN_BUCKETS).alias("run")
    parts = parts.select("source", "bucket", "words", run)
    before = F.sum("words").over(Window.partitionBy("source").orderBy("run")) - F.col("words")
    runs = parts.groupBy("source", "run").agg(F.sum("words").alias("words")).select(F.col("source").alias("r_source"), F.col("run").alias("r_run"), before.alias("before"))
    inside = F.sum("words").over(Window.partitionBy("source", "run").orderBy("bucket")) - F.col("words")
    parts = parts.withColumn("inside", inside).join(runs, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("run") == F.col("r_run")))
    parts = stored(parts.select(F.col("source").alias("p_source"), F.col("bucket").alias("p_bucket"), (F.col("before") + F.col("inside")).alias("base")))

    # a count of its own: adaptive execution would put this small but laborious input in few tasks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // TASK_DOCS))
    order = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "mark")
    rows = rows.repartition(tasks, "source", "bucket").withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket"))).drop("p_source", "p_bucket")
    rows = rows.join(F.broadcast(goals), F.col("source").eqNullSafe(F.col("g_source")))  # MAX_SOURCES rows at most
    rows = rows.withColumn("from", F.col("base") + F.col("before"))
    full = F.floor(F.col("source_size") / block).cast("bigint")
    b, end = F.lit(block).cast("bigint"), F.col("from") + F.col("size")
    rows = rows.withColumn("own", F.when(F.col("size") > 0, F.sequence(F.floor(F.col("from") / block), F.floor((end - 1) / block))).otherwise(F.array().cast("array<bigint>")))

    def draw(turn: Column, x: Column) -> Column:  # a short block at the end of the stream stays last
        at = F.when(x < full, permuted(x, full, F.lit(seed), F.col("ord"), turn)).otherwise(x)
        return F.struct(turn.alias("turn"), x.alias("block"), (turn * F.col("blocks") + at).alias("draw"))

    draws = F.flatten(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("copies")), lambda t: F.transform("own", lambda x: draw(t, x))))
    rows = rows.withColumn("draws_", F.filter(draws, lambda d: d["draw"] < F.get("ends", F.lit(shards - 1))))

    def taken(d: Column) -> Column:
        cut = F.when(d["draw"] == F.col("draws") - 1, F.when(F.col("rest") > 0, F.col("rest") - (F.col("last") - 1) * b).otherwise(b)).otherwise(b)
        low = F.greatest(d["block"] * b, F.col("from"))
        high = F.greatest(F.least(d["block"] * b + cut, end), low)
        return F.struct(d["turn"].alias("turn"), owner(F.col("ends"), d["draw"], shards).alias("shard"), (low - F.col("from")).alias("from"), (high - F.col("from")).alias("to"))

    drawn = F.filter(F.transform("draws_", taken), lambda p: (p["to"] > p["from"]) & p["shard"].isNotNull())
    # explode of one element keeps the optimizer from putting the expression into the lambdas of those who use it
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", F.explode(F.array(drawn)).alias("drawn"), "row", "mark"), int(total)


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **options) -> DataFrame:
    """The mix as documents, one for each pass over a row: the row as it is where shards take all its words, else the
    word ranges taken.

    Rows lie in the order of their shards, which are shuffled by hash.  Needs doc_id, text, source, n_chars;
    ``n_chars`` follows the text, all other columns are kept.  Every row has a plan of its own, also among rows
    without doc_id, or with one doc_id.
    """
    plain = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind]
    # ``row`` is unique and fixed, as the table is stored; it takes no part in a draw, so that runs give the same mix
    rows = stored(docs.select(F.struct("*").alias("doc"), word_count().alias("words"), F.xxhash64(*plain).alias("mark"), F.monotonically_increasing_id().alias("row")))
    plan, total = _plan(rows.select("doc.doc_id", "doc.source", F.col("words").alias("size"), "mark", "row"), shards=shards, seed=seed, **options)
    turns = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("copies")), lambda t: F.struct(t.alias("turn"), F.filter("drawn", lambda p: p["turn"] == t).alias("own")))
    passes = F.filter(turns, lambda t: F.size(t["own"]) > 0)
    whole = lambda t: F.aggregate(t["own"], F.lit(0).cast("bigint"), lambda a, p: a + p["to"] - p["from"]) == F.col("size")
    spans = lambda t: F.transform(t["own"], lambda p: F.struct(p["from"].alias("from"), p["to"].alias("to")))
    passes = F.transform(passes, lambda t: F.struct(t["turn"].alias("turn"), t["own"][0]["shard"].alias("shard"), whole(t).alias("whole"), spans(t).alias("spans")))
    plan = plan.select("row", "mark", F.explode(F.array(passes)).alias("passes"))
    # as many tasks as the words need, whatever the session's number
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_WORDS))
    rows = rows.select("doc", "row").repartition(tasks, "row").join(plan, "row")
    tokens = F.regexp_extract_all("doc.text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    rows = rows.select("*", F.explode(F.array(F.when(F.exists("passes", lambda p: ~p["whole"]), tokens))).alias("tokens"))  # once a row, not once a span
    pieces = lambda p: F.array_join(F.flatten(F.transform(p["spans"], lambda s: F.slice("tokens", (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))), "")
    made = F.transform("passes", lambda p: F.struct(p["turn"].alias("turn"), p["shard"].alias("shard"), F.when(p["whole"], F.col("doc.text")).otherwise(pieces(p)).alias("text")))
    rows = rows.select("doc", F.explode(made).alias("p"), "mark")
    # a shard's own order is by hash; its first bits deal a shard's rows to several tasks, about 8 such slots to a task,
    # so that tasks are of like size
    slots = max(1, -(-8 * total // (shards * TASK_WORDS)))
    place = F.pmod(F.xxhash64(F.lit(seed), "p.shard", "p.turn", "mark"), F.lit(1 << 62))
    rows = rows.select("doc", "p.text", "p.shard", place.alias("place")).withColumn("slot", F.floor(F.col("place") / F.lit((1 << 62) / slots)))
    rows = rows.repartition(tasks, "shard", "slot").sortWithinPartitions("shard", "slot", "place")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return rows.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))
