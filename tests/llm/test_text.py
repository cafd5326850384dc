import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import language_id, quality_model, quality_rules, toxicity
from sparkloom.llm import sentencepiece as sp
from sparkloom.llm import textcore as tc

from .conftest import documents

WORDS = re.compile("[^\x20\x09-\x0d]+")


def flat(texts):
    return tc.flat(pa.array(texts, pa.large_string()))


def base_by_hand(text):
    w = WORDS.findall(text or "")
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_base_counts(spark, texts):
    rows = [*texts, *(t.replace(" ", "\n") for t in texts[:30]), "a b c d e f g h " * 4, "x\n\n x\nx\n", None, "", "#|\n#|"]
    got = quality_rules.quality_rules(documents(spark, [(i, t, "en", "a") for i, t in enumerate(rows)])).collect()
    for r in got:
        want = base_by_hand(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def prose(rng, n, letters="aeioutnrs"):
    common = ["the", "of", "and", "to", "in"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_quality_rules_drop_what_diverges(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 150), "en", "a") for i in range(60)]
    rows += [(100, " ".join(w + "###" for w in prose(rng, 150).split()), "en", "a"), (101, prose(rng, 150).upper().replace(" ", "!! "), None, "a")]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(documents(spark, rows)).collect()}
    assert [i for i, k in kept.items() if not k] == [100, 101]


def verdicts_by_hand(rows):
    """kept by explicit histograms: character classes, and the buckets of the commonest words of each language."""
    def klass(c):
        for k, chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"-()", "!?", "#*$%&|<>"]):
            if c in chars:
                return k + 1
        lead = c.encode()[0]
        return 0 if lead < 128 else [e > lead for e in (0xCA, 0xD4, 0xE0, 0xE2, 0xE3, 0xEA, 0xEE, 256)].index(True) + 7

    def bucket(w):
        w = "".join(c.lower() if c.isascii() else c for c in w)
        w = w[:-1] if len(w.encode()) > 1 and w[-1] in ".,;:!?" else w
        data = np.frombuffer(w.encode(), np.uint8)
        return int(tc.span_hashes(data, np.array([0]), np.array([len(data)]))[0]) % quality_rules.BUCKETS

    def js(p, q):
        total = 0
        for x in set(p) | set(q):
            a, b = p.get(x, 0) / sum(p.values()), q.get(x, 0) / sum(q.values())
            total += sum(v * np.log2(2 * v / (a + b)) / 2 for v in (a, b) if v)
        return max(total, 0) ** 0.5

    docs = [(lang, WORDS.findall(t or "")) for _, t, lang, _ in rows]
    chars, words = ([collections.Counter(f(w) for w in ws) for _, ws in docs] for f in (lambda w: None, bucket))
    chars = [collections.Counter(klass(c) for w in ws for c in w) for _, ws in docs]
    langs = {lang for lang, _ in docs if lang}
    langs = [x for x in langs if sum(lang == x and len(ws) > 0 for lang, ws in docs) >= 20 and sum(len(ws) for lang, ws in docs if lang == x) >= 2000]
    out = []
    for i, (lang, ws) in enumerate(docs):
        found = []
        for x in langs:
            both = [sum((c[j] for j in range(len(docs)) if docs[j][0] == x), collections.Counter()) for c in (chars, words)]
            top = sorted(both[1], key=lambda b: (-both[1][b], b))[: quality_rules.COMMON]
            if lang == x:
                both = [b - c[i] for b, c in zip(both, (chars, words), strict=True)]
            fold = lambda h: collections.Counter({k: sum(v for b, v in h.items() if (b if b in top else -1) == k) for k in [*top, -1]})  # noqa: E731, B023
            if ws:
                found.append((js(chars[i], both[0]), js(fold(words[i]), fold(both[1]))))
        c, w = min(found, key=sum) if found else (0, 0)
        n = len(ws)
        far = n and ((n >= 30 and c > 0.22 + 0.6 / n**0.5) or (n >= 60 and w > 0.36 + 0.75 / n**0.5))
        base = base_by_hand(rows[i][1])
        out.append((not (base[0] < 20 or 100 * base[4] > 30 * base[0]) and not far, c, w))
    return out


def test_quality_rules_verdicts_by_hand(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(25, 150), "aeioutnrs" if i % 2 else "аеиоутнрс"), "en" if i % 2 else "ru", "a") for i in range(60)]
    rows += [(100 + i, prose(rng, 90, "漢字仮名!#"), ["en", None, "zz", "ru"][i % 4], "a") for i in range(8)] + [(200, "short", "en", "a"), (201, None, "en", "a")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(documents(spark, rows)).collect()}
    for (i, *_), (kept, chars, words) in zip(rows, verdicts_by_hand(rows), strict=True):
        assert got[i].kept == kept
        if got[i].n_words:
            assert np.allclose((got[i].js_chars, got[i].js_words), (chars, words), atol=1e-9)
    assert not any(got[100 + i].kept for i in range(8))


def test_quality_rules_nothing_vouches_for_itself(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 150), "en", "a") for i in range(60)]
    junk = lambda: prose(rng, 150).upper().replace(" ", "!! ")
    rows += [(100, junk(), None, "a"), (101, junk(), "zz", "a"), (102, junk() * 4, "en", "a"), *((110 + i, junk(), None, "a") for i in range(30))]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(documents(spark, rows)).collect()}
    assert [i for i, k in kept.items() if not k] == [100, 101, 102, *range(110, 140)]
    few = quality_rules.quality_rules(documents(spark, rows[:10])).collect()
    assert all(r.kept and r.js_chars == 0 for r in few)


def test_quality_rules_of_awkward_rows(awkward, nothing):
    rows = quality_rules.quality_rules(awkward).collect()
    assert len(rows) == 12 and all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert quality_rules.quality_rules(nothing).count() == 0


def test_js_distance():
    p = np.array([[0.5, 0.5], [1, 0]])
    assert np.allclose(quality_rules.js_distance(p, np.array([[0.5, 0.5], [0, 1]])), [[0, 0.5579230452841438], [0.5579230452841438, 1]])


def labelled(n=500):
    rng = random.Random(2)
    bad = ["scum", "moron", "trash"]
    texts, toxic, quality = [], [], []
    for i in range(n):
        words = prose(rng, rng.randint(10, 120)).split()
        toxic.append(int(i % 4 == 0))
        quality.append(int(i % 3 != 0))
        if toxic[-1]:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        if not quality[-1]:
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        texts.append(" ".join(words))
    return texts, toxic, quality


def test_toxicity_learns(spark):
    texts, toxic, _ = labelled()
    model = toxicity.fit(texts[:400], toxic[:400], ["en"] * 400)
    s = model.scores(*flat([*texts[400:], "", None]))
    assert (((s[:-2] >= 0.5) == toxic[400:]).mean() > 0.9) and ((s >= 0) & (s <= 1)).all() and s[-1] == s[-2] < 0.5
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id bigint, quality int, toxic int")
    found = toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()
    assert np.mean([r.predicted == toxic[r.doc_id] for r in found if r.held_out]) > 0.9
    assert all(r.predicted == (r.score >= 0.5) for r in found)
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns and left.count() < 420


def test_quality_learns():
    texts, _, quality = labelled()
    model = quality_model.fit(texts[:400], quality[:400])
    s = model.scores(*flat([*texts[400:], ""]))
    assert ((s[:-1] >= 0.7) == quality[400:]).mean() > 0.95 and ((s >= 0) & (s <= 1)).all()


def test_quality_vectors_are_of_all_documents(spark, texts):
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate([*texts, None, ""])]).repartition(5)
    for got, want in zip(quality_model.corpus_vectors(docs), quality_model.context_vectors(*flat(texts)), strict=True):
        assert np.array_equal(got, want)
    # by hand, for one form
    index_forms, index_shapes = quality_model.index_tables()
    want, word = np.zeros(quality_model.DIM), None
    for t in texts:
        form, shape, _ = quality_model.terms(*flat([t]))
        if not len(form):
            continue
        word = form[0] if word is None else word
        own = index_forms.T[form] + index_shapes.T[shape]
        for i in np.flatnonzero(form == word):
            want += sum(own[j] for j in range(max(0, i - 2), min(len(form), i + 3)) if j != i)
    assert np.allclose(quality_model.context_vectors(*flat(texts))[0][word], want / np.linalg.norm(want))


def test_quality_scores_by_a_naive_pass(texts):
    """Mean of the words' vectors, two layers, temperature: word by word in plain Python."""
    rows, _, quality = labelled(200)
    model = quality_model.fit(rows, quality)
    few = [*texts[:20], "", "x"]
    for t, score in zip(few, model.scores(*flat(few)), strict=True):
        form, shape, _ = quality_model.terms(*flat([t]))
        n = len(WORDS.findall(t))
        mean = lambda table, at: [sum(float(table[a][d]) for a in at) / n if n else 0.0 for d in range(quality_model.DIM)]  # noqa: E731, B023
        x = [*mean(model.forms, form), *mean(model.shapes, shape), math.log1p(n), float(n == 0)]
        z = [(a - m) / s for a, m, s in zip(x, model.mean, model.scale, strict=True)]
        hidden = [math.tanh(sum(z[i] * model.w1[i][j] for i in range(len(z))) + model.b1[j]) for j in range(quality_model.HIDDEN)]
        logit = (sum(h * w for h, w in zip(hidden, model.w2, strict=True)) + model.b2) / model.heat
        assert abs(score - 1 / (1 + math.exp(-logit))) < 1e-4


def test_toxicity_scores_by_a_naive_pass(texts):
    """Every filter at every place, the maximum, one output, the threshold of the language."""
    rows, toxic, _ = labelled(200)
    model = toxicity.fit(rows, toxic, ["en", "de"] * 100)
    few = [*texts[:12], "", "one", "You Moron!!"]
    for t, score in zip(few, model.scores(*flat(few)), strict=True):
        word, prefix, _ = toxicity.tokens(*flat([t]))
        x = [model.words[w] + model.prefixes[p] for w, p in zip(word, prefix, strict=True)]
        out, col = [], 0
        for width in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                at = [sum(float(x[i + j] @ model.filters[:, col + j * toxicity.FILTERS + f]) for j in range(width) if i + j < len(x)) for i in range(len(x))]
                out.append(max(at, default=0.0))
            col += width * toxicity.FILTERS
        logit = sum(max(v + b, 0) * w for v, b, w in zip(out, model.bias, model.out, strict=True)) + model.const
        raw = collections.Counter(b for b in t.lower().encode() if b != 32)
        shares = [(raw[b] / max(1, len(t.encode()))) ** 0.5 for b in range(256)]
        lang = max(range(len(model.langs)), key=lambda k: sum(a * b for a, b in zip(shares, model.langs[k], strict=True)))
        assert abs(score - 1 / (1 + math.exp(-(logit - model.cuts[lang]) / model.heat))) < 1e-4


def test_toxicity_gradients_are_those_of_the_loss():
    """Maxima pass their gradient to the words where they are: against differences of the loss."""
    rng = np.random.default_rng(3)
    rows, toxic, _ = labelled(12)
    model = toxicity.start(rng)
    word, prefix, first = toxicity.tokens(*flat(rows))
    y, weight, keep = np.array(toxic, np.float32), np.ones(12, np.float32), np.ones((12, len(toxicity.WIDTHS) * toxicity.FILTERS), np.float32)
    for name in ("words", "prefixes", "filters", "bias", "out"):
        setattr(model, name, getattr(model, name).astype(np.float64) * (3 if name != "bias" else 1))
    loss = lambda: np.logaddexp(0, np.where(y > 0, -1, 1) * model.logits(word, prefix, first)).mean()
    grads = toxicity.gradients(model, word, prefix, first, y, weight, keep)
    for name, grad in grads.items():
        if name == "const":
            continue
        value = getattr(model, name)
        for at in [tuple(rng.integers(0, k) for k in value.shape) for _ in range(4)] + [np.unravel_index(np.abs(grad).argmax(), grad.shape)]:
            old, step = value[at], 1e-4
            value[at] = old + step
            up = loss()
            value[at] = old - step
            down = loss()
            value[at] = old
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-4 + 5e-3 * abs(grad[at])


def test_language_kernel_by_explicit_sets():
    """Shared n-grams over the root of their numbers, block by block, weighted by letters."""
    rng = random.Random(5)
    rows = [(prose(rng, rng.randint(20, 60), letters), lang) for lang, letters in (("de", "äöüßchk"), ("en", "aeioutnrs")) for _ in range(40)]
    model = language_id.fit(*zip(*rows, strict=True))

    def codes(raw, a, b):
        out = set()
        low = raw.lower()
        for n in language_id.GRAMS:
            for i in range(a, min(b, len(raw) - n + 1)):
                code = 0
                for c in low[i : i + n]:
                    code = (code * 257 + c + 1) % (1 << 32)
                out.add((code * (2654435761 + 2 * n) % (1 << 32)) >> 19)
        return out

    for t in (prose(rng, 30), "ä", prose(rng, 1500, "äöüßchk")):
        raw = t.encode()
        edges, _ = language_id.blocks(np.array([0, len(raw)]))
        found, total = np.zeros(model.landmarks.shape[1]), 0.0
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = codes(raw, a, b)
            weight = sum(c >= 128 or chr(c).isalpha() for c in raw[a:b]) + 1e-6
            found += weight * np.array([sum(float(model.landmarks[c, k]) for c in own) for k in range(len(found))]) / len(own) ** 0.5
            total += weight
        assert np.allclose(model.kernels(*flat([t]))[0], found / total, atol=1e-4)
        z = language_id.SHARPNESS * (found / total @ model.weights + model.offset)
        assert np.allclose(model.scores(*flat([t]))[0], np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-3)


def test_repeated_words_by_hand(texts):
    data, offs = flat([*texts, "a b " * 9])
    start, end, first = tc.words(data, offs)
    again = quality_model.repeated(tc.span_hashes(data, start, end), first, 8)
    for i, t in enumerate([*texts, "a b " * 9]):
        assert again[first[i] : first[i + 1]].sum() == base_by_hand(t)[4]


def test_language_id(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(5, 60), letters) if lang != "xx" else "".join(rng.choice("жщюя ") for _ in range(90)), lang, "a") for i in range(300) for lang, letters in [[("en", "aeioutnrs"), ("de", "äöüßchk"), ("xx", "")][i % 3]]]
    docs = documents(spark, [*rows, (900, None, "en", "a"), (901, " 123 !?", "en", "a"), (902, "жщюя", None, "a")])
    model = language_id.train(docs)
    found = {r.doc_id: r for r in language_id.language_id(docs, model).collect()}
    assert np.mean([found[i].lang_pred == lang for i, _, lang, _ in rows if found[i].held_out]) > 0.97
    assert (found[900].lang_pred, found[901].lang_pred, found[902].lang_pred) == ("und", "und", "xx")
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_of_long_texts():
    rng = random.Random(8)
    vocabularies = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(4000)] for lang, letters in (("de", "abcdefghijklmnopqrstuvwxyzäöüß"), ("en", "abcdefghijklmnopqrstuvwxyzeeett"), ("fr", "abcdefghijklmnopqrstuvwxyzéèàç"))}
    draw = lambda lang, n: " ".join(rng.choices(vocabularies[lang], k=n))
    rows = [(draw(lang, rng.randint(30, 200)), lang) for _ in range(60) for lang in vocabularies]
    model = language_id.fit(*zip(*rows, strict=True))
    long = {lang: draw(lang, 150_000) for lang in vocabularies}
    mixed = {lang: draw(lang, 40_000) + " " + draw("fr", 800) for lang in ("de", "en")}
    told = lambda texts: np.array(model.names)[model.scores(*flat(list(texts.values()))).argmax(1)].tolist()
    assert told(long) == list(long) and told(mixed) == list(mixed)
    data, offs = flat(["ab", "", long["de"], "x" * 4097])
    edges, first = language_id.blocks(offs)
    assert edges[0] == 0 and edges[-1] == len(data) and set(offs) <= set(edges) and np.diff(edges).max() <= language_id.BLOCK and first[:3].tolist() == [0, 1, 2]


def test_models_of_tables_with_string_ids(spark):
    texts, toxic, quality = labelled(60)
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    labels = spark.createDataFrame([(f"d{i}", q, t) for i, (q, t) in enumerate(zip(quality, toxic, strict=True))], "doc_id string, quality int, toxic int")
    assert toxicity.toxicity(docs, toxicity.train(docs, labels)).where("doc_id LIKE 'd%'").count() == 60
    assert quality_model.quality(docs, quality_model.train(docs, labels)).where("doc_id LIKE 'd%'").count() == 60
    assert language_id.language_id(docs, language_id.train(docs)).where("doc_id LIKE 'd%'").count() == 60


@pytest.mark.parametrize("module, call", [(toxicity, "toxicity"), (quality_model, "quality"), (language_id, "language_id")])
def test_models_of_awkward_and_empty_tables(spark, awkward, nothing, module, call):
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None), (77, 1, 1)], "doc_id bigint, quality int, toxic int")
    args = () if module is language_id else (labels,)
    for docs, n in ((awkward, 12), (nothing, 0)):
        for use in (args, tuple(x.limit(0) for x in args)):
            rows = getattr(module, call)(docs, module.train(docs, *use)).collect()
            assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)


TRICKY = ["", " ", "  Hello  wörld\n\nfoo\tbar 漢字 🙂 <s> </s> <0x0A>", "a▁b", "a" * 700, " " * 40 + "x" + " " * 17, "\0\x01", "한국어 テスト", "x  y   z    ", "漢字かな交じり文" * 300, "aGVsbG8gd29ybGQ" * 200 + "=" * 50, "ab" * 6000, "é漢" * 100, "the" * 500 + "漢" * 40]


@pytest.fixture(scope="module")
def raw():
    try:
        with open(sp.MODEL, "rb") as f:
            return f.read()
    except FileNotFoundError:
        pytest.skip("no model file")


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece")


def test_bpe_ids_are_the_librarys(raw, texts, library):
    model, lib = sp.Model(raw), library.SentencePieceProcessor(model_proto=raw)
    rows = texts + TRICKY
    ids, offs = sp.encode(model, *flat(rows))
    back = sp.decode(model, ids, offs)
    for i, t in enumerate(rows):
        assert ids[offs[i] : offs[i + 1]].tolist() == lib.encode(t)
        assert back[i].decode() == lib.decode(lib.encode(t))


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def message(field, value):
    return varint(field << 3 | 2) + varint(len(value)) + value


def unigram(pieces):
    import struct

    body = b"".join(message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([t])) for p, s, t in pieces)
    return body + message(2, b"\x18\x01") + message(3, message(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")


def test_viterbi_of_a_unigram_model_is_the_librarys(texts, library):
    rng = random.Random(7)
    pieces = {"▁"} | {c for t in texts for c in t if c not in "e "} | {"".join(rng.choice("▁abcdé") if j == 0 else rng.choice("abcdé") for j in range(rng.randint(2, 5))) for _ in range(400)}
    raw = unigram([("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((p, -rng.uniform(2, 12), 1) for p in sorted(pieces))])
    model, lib = sp.Model(raw), library.SentencePieceProcessor(model_proto=raw)
    ids, offs = sp.encode(model, *flat(texts))
    for i, t in enumerate(texts):
        assert ids[offs[i] : offs[i + 1]].tolist() == lib.encode(t)


def test_pairs_stand_apart_as_merging_says(raw):
    """Against plain merging of both pieces' characters, best score first, leftmost among equals."""
    model, rng = sp.Model(raw), random.Random(3)
    rank = {b.decode(): s for b, s, t in zip(model.bytes, model.scores, model.types, strict=True) if t == sp.NORMAL}

    def merged(text):
        parts = list(text)
        while True:
            found = [(rank[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
            if not found:
                return parts
            k = -max(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    ids = [i for i, t in enumerate(model.types) if t == sp.NORMAL]
    left, right = (np.array(rng.choices(ids, k=3000)) for _ in range(2))
    near = [(model.bytes[a] + model.bytes[b]).decode() for a, b in zip(left, right, strict=True)]
    want = [merged(t) == [model.bytes[a].decode(), model.bytes[b].decode()] for t, a, b in zip(near, left, right, strict=True)]
    assert model.apart(left, right).tolist() == want and model.apart(left, right).tolist() == want
    assert 300 < sum(want) < 2950


def bpe(pieces):
    return unigram(pieces).replace(message(2, b"\x18\x01"), message(2, b"\x18\x02"))


def test_small_bpe_models_are_the_librarys(library):
    """Characters of no piece, characters that only occur inside pieces, pieces that merging never reaches."""
    rng = random.Random(17)
    for _ in range(20):
        pieces = {"▁"} | set(rng.sample("abcdeé漢", 5)) | {"".join(rng.choice("▁abcdé") if j == 0 else rng.choice("abcdé") for j in range(rng.randint(2, 5))) for _ in range(40)}
        raw = bpe([("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((p, -k, 1) for k, p in enumerate(rng.sample(sorted(pieces), len(pieces))))])
        model, lib = sp.Model(raw), library.SentencePieceProcessor(model_proto=raw)
        rows = ["".join(rng.choice("abcdeé漢z  ") for _ in range(rng.randint(0, 60))) for _ in range(60)]
        ids, offs = sp.encode(model, *flat(rows))
        for i, t in enumerate(rows):
            assert ids[offs[i] : offs[i + 1]].tolist() == lib.encode(t)


def test_unused_and_user_defined_pieces(library):
    plain = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -3, 1), ("a", -3, 1), ("b", -3, 1), ("ab", -1, 5), ("▁a", -2, 1)]
    model, lib = sp.Model(unigram(plain)), library.SentencePieceProcessor(model_proto=unigram(plain))
    rows = ["ab aab", "b a ab ab", "", "abba"]
    ids, offs = sp.encode(model, *flat(rows))
    assert [ids[offs[i] : offs[i + 1]].tolist() for i in range(4)] == [lib.encode(t) for t in rows]
    with pytest.raises(ValueError, match="UNUSED"):
        sp.Model(bpe(plain))
    for make in (unigram, bpe):
        with pytest.raises(ValueError, match="USER_DEFINED"):
            sp.Model(make([*plain[:6], ("ab", -1, 4)]))


def test_encoding_round_trip(spark, awkward, nothing, raw):
    model = sp.Model(raw)
    rows = sp.encoded(awkward, model)
    assert rows.count() == 12 and rows.where("NOT round_trip").count() == 0 and sp.encoded(nothing, model).count() == 0
    want = sorted((r.text or "") for r in awkward.collect())
    assert sorted(r.text for r in sp.decoded(rows, model).collect()) == want
    assert rows.where("doc_id IN (1, 2) AND n_tokens <> 0").count() == 0
