import random

import pytest

#: Columns of ``documents`` and some that clash with names used inside the operators.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, part int, run string, rk string, size int, spans string, did string, n string, kept string, ids string"


def documents(spark, rows):
    """rows of (doc_id, text, lang, source) as documents with clashing extra columns."""
    full = [(i, t, lang, src, None if t is None else len(t), 0.5, 1, "x", "y", 7, "z", "q", "n", "k", "i") for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and blank texts, a long one, copies, rows repeated in full."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8)))
    long = " ".join(word() for _ in range(30_000))
    plain = " ".join(word() for _ in range(300))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, long, "en", "a"), (5, plain, "de", "b"), (6, plain, None, "b"), (7, "ünïcödé 漢字 \0 🙂", "de", "c"), (8, "x" * 5000, "en", "a"), (None, plain, "en", "a"), (None, None, None, None)]
    rows += [(9, "twice the same row " * 3, "en", "a")] * 2
    return documents(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def texts():
    """Random texts with copies, near copies and shared passages."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for i in range(150):
        kind = i % 5
        base = out[rng.randrange(len(out))].split(" ") if out and kind in (1, 2) else [rng.choice(words) for _ in range(rng.randint(0, 150))]
        if kind == 2:
            for _ in range(rng.randint(1, 5)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
        if kind == 3:
            at = rng.randint(0, len(base))
            base = base[:at] + passage + base[at:]
        out.append(" ".join(base))
    return out
