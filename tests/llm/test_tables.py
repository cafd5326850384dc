import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing, url_filter

from .conftest import documents


def reshared(sizes, weights, share, cap):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left = dict.fromkeys(names, 0.0), share * sum(sizes.values())
    open_ = set(names)
    while left > 1e-9 and open_:
        part = {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        left = 0.0
        for s, x in part.items():
            out[s] += x
            if out[s] >= cap * sizes[s]:
                left += out[s] - cap * sizes[s]
                out[s] = float(cap * sizes[s])
        open_ = {s for s in open_ if out[s] < cap * sizes[s]}
    return out


def test_mix(spark):
    rng = random.Random(1)
    sources = [None, "a", "b", "ä", "c", "Z"]
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 300, 2000]))), "en", sources[min(rng.randrange(9), 5)]) for i in range(200)]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.size == len((rows[r.doc_id][1] or "").split()) and 0 <= r.taken <= 2 * r.size
        assert r.taken == r.copies * r.size + sum(s["to"] - s["from"] for s in r.spans)
    owned = {}
    for r in got:  # a document has what the shards that own its draws take of it
        assert r.taken == sum(s["words"] for s in r.shards) and all(0 <= s["shard"] < 64 and s["words"] > 0 for s in r.shards)
        for s in r.shards:
            owned[s["shard"]] = owned.get(s["shard"], 0) + s["words"]
    assert sum(owned.values()) == sum(taken.values()) and max(owned.values()) - min(owned.values()) <= 7 * 2 * 64
    want = reshared(sizes, (5, 2, 1), 1.5, 2)
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.word_count())).first()[0] == sum(taken.values())


def test_shards_decide_what_is_taken(spark, monkeypatch):
    docs = documents(spark, [(i, "w " * 300, "en", "ab"[i % 2]) for i in range(40)])
    whole = mixing.quotas

    def without_one(*args):  # the draws of the last shard belong to nobody
        plan = whole(*args)
        return plan.withColumn("end", F.when(F.col("shard") < 63, F.col("end")).otherwise(F.col("start")))

    before = {s["shard"]: s["words"] for r in mixing.mix(docs).collect() for s in r.shards if s["shard"] == 63}
    monkeypatch.setattr(mixing, "quotas", without_one)
    rows = mixing.mix(docs).collect()
    assert before and not any(s["shard"] == 63 for r in rows for s in r.shards)
    mixed = mixing.mixed_documents(docs)
    assert mixed.select(F.sum(mixing.word_count())).first()[0] == sum(r.taken for r in rows) < 1.5 * 40 * 300


def test_mix_of_many_buckets(spark, monkeypatch):
    """Streams of several runs of buckets: every word has a place of its own."""
    docs = documents(spark, [(i, "w " * (i % 90), "en", "abc"[i % 3] if i % 7 else None) for i in range(300)])
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 5)
    monkeypatch.setattr(mixing, "RUN_BUCKETS", 4)
    got = mixing.mix(docs).collect()
    sizes, taken, target = {}, {}, {}
    for r in got:
        for table, n in ((sizes, r.size), (taken, r.taken)):
            table[r.source_size] = table.get(r.source_size, 0) + n
        target[r.source_size] = r.target
    assert len(sizes) == 4 and all(size == total for size, total in sizes.items())
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in sizes)


def test_owner_of_a_draw(spark):
    ends = [0, 3, 3, 10, 11]
    got = spark.range(13).select(mixing.owner(F.array(*map(F.lit, ends)), F.col("id"), 5).alias("s")).collect()
    assert [r.s for r in got] == [1, 1, 1, 3, 3, 3, 3, 3, 3, 3, 4, None, None]


def test_mixed_documents_are_shuffled_in_shards(spark):
    docs = documents(spark, [(i, f"d{i} " + "w " * 70, "en", "a") for i in range(600)])
    order = [r.doc_id for r in mixing.mixed_documents(docs, shards=4).collect()]
    assert len(order) > 600 and order != sorted(order)
    steps = [abs(a - b) for a, b in zip(order, order[1:], strict=False)]
    assert sum(steps) / len(steps) > 100  # neighbours come from anywhere
    with pytest.raises(ValueError, match="sources"):
        few, mixing.MAX_SOURCES = mixing.MAX_SOURCES, 0
        try:
            mixing.mix(docs)
        finally:
            mixing.MAX_SOURCES = few


def test_mix_of_awkward_rows(awkward, nothing):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == 12 and all(r.taken <= 2 * r.size for r in rows) and all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    assert mixing.mix(awkward.where("doc_id <= 3")).where("target <> 0 OR taken <> 0").count() == 0


def test_mix_of_rows_that_share_a_doc_id(spark):
    # sizes that blocks don't fit: spans of the rows differ
    rows = [(None, " ".join(f"t{i // 2}w{j}" for j in range(90)), "en", "a") for i in range(60)]  # every row twice
    rows += [(i, " ".join(["b"] * 200), "en", "b") for i in range(20)]
    docs = documents(spark, rows)
    plan = mixing.mix(docs).collect()
    taken = sorted((r.source, t) for r in plan for t in [r.size] * r.copies + [sum(s["to"] - s["from"] for s in r.spans)] if t)
    mixed = mixing.mixed_documents(docs).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(r.taken for r in plan)
    assert sum(n for source, n in taken if source == "a") == sum(len(r.text.split()) for r in mixed if r.source == "a")
    words = {}
    for r in mixed:
        for w in r.text.split() if r.source == "a" else ():
            words[w] = words.get(w, 0) + 1
    assert max(words.values()) <= 4  # two rows, each at most twice
    again = mixing.mixed_documents(docs.repartition(7)).collect()
    assert sorted(r.text for r in mixed) == sorted(r.text for r in again)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000])
def test_permutation_is_one(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(7)).alias("p"))
    assert sorted(r.p for r in got.collect()) == list(range(n))


def test_hypergeometric_draws(spark):
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    long = lambda n: F.lit(n).cast("bigint")
    got = [r[0] for r in u.select(mixing.hypergeometric(F.col("u"), long(50), long(20), long(10))).collect()]
    total = math.comb(50, 10)
    for k in range(11):
        assert abs(got.count(k) / 4000 - math.comb(20, k) * math.comb(30, 10 - k) / total) < 0.002
    edge = u.limit(1).select(*(mixing.hypergeometric(F.col("u"), *map(long, x)) for x in ((0, 0, 0), (5, 5, 3), (5, 0, 3), (5, 2, 5)))).first()
    assert tuple(edge) == (0, 3, 0, 2)


def test_quotas_add_up(spark):
    sources = spark.createDataFrame([(0, 1000), (1, 1), (2, 0), (3, 77777)], "ord int, draws bigint")
    rows = mixing.quotas(sources, shards=10).collect()
    assert len(rows) == 40 and all(r.quota >= 0 for r in rows)
    for ord_, draws in ((0, 1000), (1, 1), (2, 0), (3, 77777)):
        assert sum(r.quota for r in rows if r.ord == ord_) == draws
    totals = [sum(r.quota for r in rows if r.shard == k) for k in range(10)]
    assert max(totals) - min(totals) <= 4


def test_url_filter(spark):
    link = '<link rel="canonical" href="%s">'
    rows = [
        (1, "http://a.org/x", link % "http://b.net/es/q"),
        (2, "http://b.net/es/q?z", None),
        (3, "http://c.org/y", '<META http-equiv=refresh content="0; url=http://a.org/x">'),
        (4, None, None),
        (5, "http://WWW.example.com/en/1#f", link % "http://b.net/es/q"),
        (6, "abc", "x"),
        (7, "https://example.com/en/", ""),
        (8, "https://example.com", ""),
        (9, "http://d.org/p/q", link % "r"),
        (10, "http://d.org/p/r", link % "/s"),
        (11, "http://d.org/s", link % "//e.net/fr/"),
        (12, "http://notexample.org/en/", ""),
        (12, "http://notexample.org/en/", ""),
    ]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id bigint, url string, html string, host string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages).collect())
    verdicts = {r[0]: (r[3], r[4]) for r in got}
    assert len(got) == 13
    assert verdicts == {1: (None, "block"), 2: ("net/es/", "block"), 3: (None, "block"), 4: (None, "allow"), 5: ("www.example.com/en/", "allow"), 6: (None, "allow"), 7: ("example.com/en/", "block"), 8: (None, "allow"), 9: (None, "block"), 10: (None, "block"), 11: (None, "block"), 12: (None, "allow")}
    assert url_filter.url_filter(pages.limit(0)).count() == 0
    extra = spark.createDataFrame([("http://notexample.org/en/", "http://x.net/es/1"), (None, "http://q")], "url string, target string")
    assert {r.page_id: r.verdict for r in url_filter.url_filter(pages, redirects=extra).collect()}[12] == "block"


def test_url_filter_of_long_tags_bare_hosts_and_urls_in_queries(spark):
    long = '<link data-x="' + "y" * 9000 + '" rel="canonical" href="%s">'
    link = '<link rel="canonical" href="%s">'
    rows = [
        (1, "http://a.org/x", long % "http://b.net/es/q"),
        (2, "http://bare.org", ""),
        (3, "http://bare.org/", link % "http://b.net/es/q"),
        (4, "http://c.org/y", link % "http://host.com"),
        (5, "http://host.com/", link % "http://b.net/es/q"),
        (6, "http://d.org/z", link % "/go?u=http://b.net/es/"),
        (7, "http://e.org/z", link % "HTTPS://b.net/fr/1"),
        (8, "http://f.org/z", '<link rel="canonical" href="http://b.net/es/"'),
        (9, "http://host.com?q", ""),
        (10, "http://g.net", link % "es/1"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: (r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages).collect()}
    assert {i: v for i, (_, _, v) in got.items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "block", 10: "block"}
    assert got[2] == ("", None, "block") and got[5] == ("/", "com/", "allow")


LINKED = [
    (1, "http://t.org/r?u=1", '<link rel="canonical" href="http://b.net/es/q">'),
    (2, "http://t.org/r?u=2", '<link rel="canonical" href="http://good.org/">'),
    (3, "http://good.org", ""),
    (4, "http://t.org/r?u=3", None),
    (5, "http://u.org/Case?x", '<meta http-equiv="refresh" content="0;url=sub/Page#f">'),
    (6, "http://u.org/sub/Page?z=1", ""),
    (7, "HTTP://U.ORG/sub/Page", "<LINK REL=canonical HREF=//c.net/fr/A>"),
    (8, "http://u.org/sub/page", ""),
    (9, "http://v.org", '<link rel="canonical" href="/es/?q">'),
    (10, "http://v.org/es/?q", '<link rel="canonical" href="https://w.net/es/z">'),
    (11, "http://v.org/es/", ""),
    (12, None, '<link rel="canonical" href="http://b.net/es/q">'),
    (13, "no scheme", '<link rel="canonical" href="http://b.net/es/q">'),
    (14, "http://www.example.com/en/", '<link rel="canonical" href="http://b.net/es/q">'),
    (15, "http://x.com/?q", '<link rel="canonical" href="http://b.net/es/q">'),
    (16, "http://x.com?q", ""),
]


def test_url_filter_is_its_sql_where_pages_are_linked(spark):
    import duckdb

    pages = spark.createDataFrame(LINKED, "page_id bigint, url string, html string")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    got = sorted(tuple(r) for r in url_filter.url_filter(pages).select(columns).collect())
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({url_filter.ORACLE})").fetchall())
    assert got == want
    verdicts = {r[0]: r[4] for r in got}
    assert [i for i, v in verdicts.items() if v == "block"] == [1, 5, 6, 7, 9, 10, 16]


def test_url_filter_joins_long_lists_of_rules(spark, monkeypatch):
    pages = spark.createDataFrame([*LINKED, (20, "http://" + "a." * 3000 + "net/es/", ""), (21, "http://net/es/", "")], "page_id bigint, url string, html string")
    want = sorted(map(tuple, url_filter.url_filter(pages).collect()))
    rules = spark.createDataFrame([*url_filter.RULES, *((["block", "allow"][i % 2], f"h{i}.example", "/") for i in range(50)), ("block", None, "/")], "action string, host string, path string")
    assert sorted(map(tuple, url_filter.url_filter(pages, rules).collect())) == want
    monkeypatch.setattr(url_filter, "FEW_RULES", 2)
    assert sorted(map(tuple, url_filter.url_filter(pages).collect())) == want
    assert url_filter.url_filter(pages, []).where("rule IS NOT NULL OR verdict <> 'allow'").count() == 0


def test_pipeline(spark, texts, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    rows = [(i, t, "en", f"s{rng.randrange(3)}") for i, t in enumerate(texts)] + [(1000, texts[10] + " ", "en", "s0"), (1001, None, None, None), (5, texts[5], "en", "s1"), (5, texts[5], "en", "s1")]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        left[name] = docs
        if name != "sentencepiece":
            assert docs.columns == left["toxicity"].columns
    assert left["toxicity"].count() == len(rows)
    normal = {"".join((t or "").split()) for _, t, _, _ in rows}
    assert left["exact_dedup"].count() == len(normal)
    from .test_dedup import classes_by_hand

    kept = [r.text for r in sorted(left["exact_dedup"].collect(), key=lambda r: r.doc_id)]
    assert left["near_dedup"].count() == sum(i == c for i, _, c in classes_by_hand(kept, 5, 80))
    assert left["sentencepiece"].count() == left["mixing"].count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == left["sentencepiece"].count()


def test_dedup_stages_follow_rows(spark):
    import corpus_pipeline

    rng = random.Random(6)
    text = lambda n=60: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c, d, e = (text() for _ in range(5))
    exact = [(1, a), (None, a), (None, a + " "), (2, b), (2, a), (None, c), (None, c), (None, c + "\n"), (7, d), (7, d), (7, d + "  "), (None, None), (4, " "), (4, "\t")]
    left = corpus_pipeline.exact_dedup_stage(spark, documents(spark, [(i, t, "en", "a") for i, t in exact]), "").collect()
    assert sorted(((r.doc_id or 0), (r.text or "").rstrip()) for r in left) == sorted([(0, a), (2, b), (0, c), (7, d), (4, "")])
    near = [(1, a), (None, a + " near"), (2, b), (2, a + " far"), (None, c), (None, c + " x"), (3, c + " y"), (5, d), (6, d + " z"), (9, e), (9, e), (None, None), (8, "")]
    left = corpus_pipeline.near_dedup_stage(spark, documents(spark, [(i, t, "en", "a") for i, t in near]), "").collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in left) == sorted([(1, a), (2, b), (3, c + " y"), (5, d), (9, e), (0, ""), (8, "")])


def test_pipeline_of_awkward_and_empty_tables(spark, awkward, nothing, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(5, 1, 0), (None, None, 1)], "doc_id bigint, quality int, toxic int")
    for name, docs in (("awkward", awkward), ("nothing", nothing)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(rows) > 0) == (name == "awkward") and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_training_sample_is_bounded(spark, monkeypatch):
    from sparkloom.llm import common

    docs = documents(spark, [(i, "word " * 10, "en", "a") for i in range(400)])
    rows = docs.select("doc_id", "lang")
    assert 20 < len(common.training_sample(rows, docs, 50, 1)) < 90
    monkeypatch.setattr(common, "SAMPLE_CHARS", 5000)
    assert 40 < len(common.training_sample(rows, docs, 1000, 1)) < 180
    monkeypatch.setattr(common, "SAMPLE_LONGEST", 10)
    assert len(common.training_sample(rows, docs, 1000, 1)) == 0


def test_training_sample_has_every_value(spark):
    from sparkloom.llm import common

    docs = documents(spark, [(i, "word " * 10, "rare" if i == 7 else "few" if i % 400 == 3 else "en", "a") for i in range(4000)])
    sample = common.training_sample(docs.select("doc_id", "lang"), docs, 60, 1, "lang", 5)
    count = sample["lang"].value_counts().to_dict()
    assert count["rare"] == 1 and count["few"] == 10 and 15 <= count["en"] <= 20
