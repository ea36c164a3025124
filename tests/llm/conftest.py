import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, print long, h long, size long, band string, node long, w array<string>, found string, bucket int"


def prose(rng, n, words):
    return " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls, empty and long texts, repeated rows, ties."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    passage = prose(rng, 60, words)
    out = []
    for i in range(60):
        t = prose(rng, rng.randrange(1, 120), words)
        if i % 7 == 0:
            t = out[-1][1] if out else t
        elif i % 7 == 1 and out and out[-1][1]:
            w = out[-1][1].split()
            w[rng.randrange(len(w))] = "Changed"
            t = " ".join(w)
        elif i % 7 == 2:
            t = t + "\n" + passage + " " + t[: rng.randrange(40)]
        out.append((i * 3, t, "de" if i % 2 else "fr", f"s{i % 4}"))
    out += [
        (500, None, None, None), (501, "", "de", "s0"), (502, " \t\n ", "fr", None), (503, "!!! ... 123", None, "s9"), (504, "one", "de", "s1"),
        (None, passage, "de", "s1"), (None, out[3][1], None, None), (505, passage * 40, "fr", "s2"), (506, passage.upper(), "fr", "s2"), (506, passage.upper(), "fr", "s2"), (507, "a\x00b Ünder \U0001f600 x", "fr", "é"), (507, "other text of one id", "fr", "é"),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3, "x", 4, ["w"], "f", 5) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
