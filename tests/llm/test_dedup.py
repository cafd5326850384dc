import collections
import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, linking, near_dedup, suffix_dedup
from sparkloom.llm import textcore as tc
from sparkloom.llm.common import components

from .conftest import documents

WORDS = re.compile("[^\x20\x09-\x0d]+")


def spans_by_hand(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t))), hashlib.sha256(kept).hexdigest()))
    return out


def test_spans_against_brute_force(spark, texts):
    rng = random.Random(1)
    odd = ["".join(rng.choice("ab é\0") for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["a" * 100, "ab" * 50, None, ""]
    for rows, length, gram in ((odd, 20, 6), (texts, 40, 9), (texts, 200, 24)):
        docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(rows)])
        got = {r.doc_id: r[1:5] for r in suffix_dedup.repeated_spans(docs, length, gram).collect()}
        assert got == dict(enumerate(spans_by_hand([(t or "").encode() for t in rows], length)))


def test_spans_with_production_settings_and_hot_passages(spark, texts, monkeypatch):
    rng = random.Random(7)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (150, 190, 199, 230, 500)]
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = texts[:60] + [text(rng.randint(0, 80)) + passages[i % 5] + text(rng.randint(0, 300)) for i in range(200)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(rows)])
    want = dict(enumerate(spans_by_hand([t.encode() for t in rows], 200)))
    assert {r.doc_id: r[1:5] for r in suffix_dedup.repeated_spans(docs).collect()} == want
    for name, value in (("SAMPLE", 1), ("HOT", 1 << 30), ("PART_BYTES", 700), ("PIECE", 3000), ("CHUNK", 50), ("RUN_SEGMENTS", 300)):
        monkeypatch.setattr(suffix_dedup, name, value)
    hot = suffix_dedup.hot_grams(docs, 200, 16, 0)
    assert len(hot[0]) and len(hot[1])  # all three levels of anchors are in use
    monkeypatch.setattr(suffix_dedup, "hot_grams", lambda *_: hot)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 5_000)  # several merges in a partition
    assert {r.doc_id: r[1:5] for r in suffix_dedup.repeated_spans(docs).collect()} == want


def test_union_of_spans():
    rng = random.Random(4)
    spans = [(rng.randint(-2, 1), rng.randint(0, 1), a, a + rng.randint(1, 9)) for a in rng.choices(range(80), k=60)]
    want = set()
    for rk, rk2 in {s[:2] for s in spans}:
        covered = sorted({x for s in spans if s[:2] == (rk, rk2) for x in range(s[2], s[3])})
        starts = [x for x in covered if x - 1 not in covered]
        want |= {(rk, rk2, x, next(y for y in range(x, 200) if y not in covered)) for x in starts}
    got = suffix_dedup.union_of(*(np.array(x) for x in zip(*spans, strict=True)))
    assert set(zip(*(x.tolist() for x in got), strict=True)) == want and len(got[0]) == len(want)
    assert len(suffix_dedup.union_of(*(np.zeros(0, np.int64),) * 4)[0]) == 0


def test_pieces_of_long_texts_have_every_string_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "PIECE", 50)
    texts = ["a" * 30, "b" * 500, "", "c" * 69, "d" * 71]
    rows = pa.RecordBatch.from_pydict({"rk": pa.array(range(5)), "text": pa.array(texts)})
    found = collections.Counter()
    monkeypatch.setattr(suffix_dedup.tc.slices, "__defaults__", (1,))  # a slice for each text
    for part, data, offs, begin in suffix_dedup._pieces([rows], 20):
        i = part.column(0)[0].as_py()
        for a in range(len(data) - 19):
            assert data[a : a + 20].tobytes().decode() == texts[i][begin + a : begin + a + 20]
            found[i, begin + a] += 1
    assert found == {(i, a): 1 for i, t in enumerate(texts) for a in range(len(t) - 19)}


def test_a_frequent_line_does_not_make_one_large_group(texts):
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = ["".join(rng.choice("abcdefghij ") for _ in range(300)) + line + "".join(rng.choice("abcdefghij ") for _ in range(300)) for _ in range(400)]
    import pyarrow as pa

    data, offs = tc.flat(pa.array(rows))
    largest = lambda hot: np.unique(suffix_dedup.anchors(data, offs, 200, 16, hot)[4], return_counts=True)[1].max()
    assert largest(()) >= 300
    keys, n = np.unique(suffix_dedup.anchors(data, offs, 200, 16)[4], return_counts=True)
    hot = keys[n > 100]
    keys, n = np.unique(suffix_dedup.anchors(data, offs, 200, 16, (hot,))[4], return_counts=True)
    again = keys[n > 100]
    assert largest((hot, again)) < 100


def test_spans_of_awkward_rows(awkward, nothing):
    rows = suffix_dedup.repeated_spans(awkward).collect()
    assert len(rows) == 12
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert [(r.n_bytes, r.n_removed) for r in by[1] + by[2]] == [(0, 0), (0, 0)]
    assert all(r.n_removed == r.n_bytes > 0 for r in by[5] + by[6] + by[8])
    assert len(by[9]) == 2 and all(r.n_removed == 0 for r in by[9])  # below 200 bytes
    assert suffix_dedup.repeated_spans(nothing).count() == 0


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(2)
    runs = []
    for k in range(5):
        strings = sorted("".join(rng.choice("ab\0") for _ in range(rng.randint(0, 9))).encode() for _ in range(k * 7))
        lcps = [0] + [suffix_dedup._common(a, b, 0) for a, b in zip(strings, strings[1:], strict=False)]
        runs.append((lcps[: len(strings)], strings))
    run, index, lcp = suffix_dedup.merged(runs)
    out = [runs[r][1][i] for r, i in zip(run, index, strict=True)]
    assert out == sorted(s for _, r in runs for s in r)
    assert lcp[1:] == [suffix_dedup._common(a, b, 0) for a, b in zip(out, out[1:], strict=False)]


def classes_by_hand(texts, k, percent):
    fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(fold))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def test_near_duplicates_against_brute_force(spark, texts, monkeypatch):
    rows = [*texts, None, "", "one Two", "ONE two", "one two three"]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(rows)])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect())
    assert got == classes_by_hand(rows, 4, 80)
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 2)  # many blocks: still whole
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 150)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, 5, 80).collect())
    assert got == classes_by_hand(rows, 5, 80)


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """Copies around originals, in groups of many blocks: by pivots, with a rest, and by nothing but the rest."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows = []
    for _ in range(3):
        base = [rng.choice(words) for _ in range(120)]
        rows.append(" ".join(base))
        for _ in range(45):
            own = list(base)
            for _ in range(rng.randint(1, 5)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    rng.shuffle(rows)
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(rows)])
    want = classes_by_hand(rows, 4, 80)
    assert 4 < len({c for _, _, c in want}) < 120
    for block, shingles, pivots in ((7, 1000, 24), (7, 700, 2), (3, 300, 1)):
        monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", block)
        monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", shingles)
        monkeypatch.setattr(linking, "PIVOTS", pivots)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect())
        assert got == want


def test_near_duplicates_of_rows_that_share_a_doc_id(spark):
    rng = random.Random(12)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (3, b + " more"), (4, a.upper()), (1 << 62, c), ((1 << 62) + 7, c + " more"), (None, c), (-5, b)]
    got = near_dedup.near_duplicates(documents(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    named = sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str)
    assert named == sorted([(1, 1, True), (1, -5, False), (3, -5, False), (4, 1, False), (1 << 62, 1 << 62, True), ((1 << 62) + 7, 1 << 62, False), (None, 1 << 62, False), (-5, -5, True)], key=str)
    named = spark.createDataFrame([("x", a), ("b", a + " more"), (None, None)], "doc_id string, text string")
    assert {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(named).collect()} == {"x": ("b", False), "b": ("b", True), None: (None, True)}


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    rows = near_dedup.near_duplicates(awkward).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[1].n_shingles, by[1].component_id, by[1].kept) == (0, 1, True)
    assert (by[5].kept, by[6].component_id, by[6].kept) == (True, 5, False)
    assert sorted((r.component_id or 0, r.kept) for r in rows if r.doc_id is None) == [(0, True), (5, False)]
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_registers_agree_with_probability_of_similarity():
    rng = np.random.default_rng(0)
    for n in (5, 60, 3000):
        seen = []
        for _ in range(40):
            h = rng.integers(0, 1 << 63, 2 * n, dtype=np.int64).astype(np.uint64) * np.uint64(2)
            a, b = np.sort(h[: int(1.5 * n)]), np.sort(h[n // 2 :])
            both = near_dedup.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            seen.append((both[0] == both[1]).mean())
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(np.mean(seen) - true) < 0.06


def test_exact_dedup_against_brute_force(spark, texts):
    rows = [*texts, *(t.replace(" ", "\n") for t in texts[:20]), None, "", " ", "A b", "a b"]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(rows)])
    groups = collections.defaultdict(list)
    for i, t in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append(i)
    want = {}
    for text, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(rows[i] or ""), i))
        want |= {i: (keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids}
    weak = lambda c: F.length(c).cast("bigint")  # noqa: E731  identifiers that collide: the dictionary must tell
    for ident in (exact_dedup.identifier, weak):
        assert {r.doc_id: r[1:] for r in exact_dedup.exact_dedup(docs, ident).collect()} == want


def test_chunks_follow_content_in_any_script(spark):
    rng = random.Random(13)
    alphabets = ["漢字仮名交文東京大学生物", "абвгдежзиклмнопрст", "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "the quick brown fox".replace(" ", "")]
    texts = ["".join(rng.choice(a) for _ in range(12_000)) for a in alphabets]
    rows = [(i, t, "x" * (i % 3 + 1) + t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    for r in df.select(exact_dedup.chunks(F.col("a")).alias("a"), exact_dedup.chunks(F.col("b")).alias("b")).collect():
        assert len(r.a) > 5 and len(set(r.a) & set(r.b)) >= 0.8 * len(r.a)  # a shift moves only the first chunks
    ids = spark.createDataFrame([("b", "x y"), ("a", "xy"), (None, "x  y"), ("c", "z")], "doc_id string, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(ids).collect()), key=str)
    assert got == sorted([("b", None, 3, False), ("a", None, 3, False), (None, None, 3, True), ("c", "c", 1, True)], key=str)


def test_exact_dedup_of_awkward_rows(awkward, nothing):
    rows = exact_dedup.exact_dedup(awkward).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[1].group_size, by[1].keep_id, by[3].kept) == (4, 3, True)
    assert (by[5].keep_id, by[6].keep_id, by[5].group_size) == (5, 5, 3)
    assert by[9].group_size == 2 and by[9].kept
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 100), (5, 5), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 90: 90, 100: 90}
    assert components(edges.limit(0)).count() == 0


def test_every_partition_gets_its_key(spark):
    from sparkloom.llm.common import partition_key

    for n in (1, 7, 83):
        keys = spark.createDataFrame([(i, int(k)) for i, k in enumerate(partition_key(np.arange(n)))], "i int, k int")
        assert all(r.i == r.p for r in keys.repartition(n, "k").select("i", F.spark_partition_id().alias("p")).collect())
    assert len(set(partition_key(np.arange(100_000)).tolist())) == 100_000


def test_words_and_shingles():
    import pyarrow as pa

    data, offs = tc.flat(pa.array(["a b\x0bc", None, "", " d\x1ce ", "é f g"]))
    start, end, first = tc.words(data, offs)
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end, strict=True)] == ["a", "b", "c", "d\x1ce", "é f", "g"]
    assert first.tolist() == [0, 3, 3, 3, 4, 6]
