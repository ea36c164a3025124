import hashlib
import random

import numpy as np
import pyarrow as pa

from strandline.llm import suffix_dedup
from strandline.llm.suffix_dedup import Frequent, previous_factors, repeated_bytes, runs_of, smaller_neighbours, suffix_order


def brute(rows):
    data = [(d, (t or "").encode()) for d, t, *_ in rows]
    first = {}
    for d, t in data:
        if d is not None:
            for i in range(len(t) - 49):
                first[t[i : i + 50]] = min(first.get(t[i : i + 50], d), d)
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - 49 if d is not None else 0):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(docs, rows):
    assert sorted((tuple(r) for r in repeated_bytes(docs).collect()), key=str) == brute(rows)


def test_adversarial_bytes(spark):
    rng = random.Random(3)
    parts = ["".join(rng.choice("ab é\x00c") for _ in range(rng.randrange(40, 200))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) + ("x" if rng.random() < 0.5 else "") for _ in range(rng.randrange(6)))) for i in range(60)]
    rows += [(100, "a" * 9000), (101, "b" + "a" * 5000), (101, "b" + "a" * 5000), (-5, parts[0]), (1 << 40, parts[0] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in repeated_bytes(df.repartition(5)).collect()), key=str) == brute(rows)


def test_very_long_text_in_pieces(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(3_000_000))
    rows = [(1, long[1_048_500:1_048_700]), (2, long), (3, long[2_097_000:2_097_300])]
    got = {r.doc_id: r.n_removed for r in repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 200, 3: 300}


def test_empty(nothing):
    assert repeated_bytes(nothing).collect() == []


def test_frequent_grams_do_not_change_the_result(spark, monkeypatch):
    """A phrase in many contexts: its grams are found, are a minimiser only of strings without others, and the result is the same."""
    rng = random.Random(6)
    phrase = "a phrase that stands in very many documents, of some eighty bytes, in every context"
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(80)) + phrase + "".join(rng.choice("abcdefgh ") for _ in range(80))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in repeated_bytes(df).collect()), key=str) == brute(rows)
    texts = [t.encode() for _, t in rows]
    gram, n = np.unique(runs_of(texts)[3], return_counts=True)
    frequent = Frequent(gram[n >= 256])
    assert len(frequent.grams)
    keys = {g: set() for g in range(len(texts))}
    text, first, length, key, _ = runs_of(texts, frequent)
    for t, a, m, x in zip(text, first, length, key, strict=True):
        keys[t].add(int(x))
        if any(80 <= s and s + 50 <= 80 + len(phrase) for s in range(a, a + m)):
            keys[t].discard(int(x))
    shared = set.intersection(*keys.values())
    assert not shared  # strings that leave the phrase have minimisers of their own


def test_neighbours_and_their_common_prefixes():
    v, c = np.array([3, 1, 2, 2, 5, 0, 7]), np.array([0, 4, 9, 5, 2, 1, 8])
    prev, before, nxt, after = smaller_neighbours(v, c)
    assert prev.tolist() == [-1, -1, 1, 1, 3, -1, 5]
    assert before.tolist() == [0, 0, 9, 5, 2, 0, 8]
    assert nxt.tolist() == [1, 5, 5, 5, 5, -1, -1]
    assert after.tolist() == [4, 1, 1, 1, 1, 0, 0]


def test_previous_factors_need_both_neighbours():
    """Lengths against all pairs of starts; neither the previous nor the next smaller document is enough."""
    rng = np.random.default_rng(9)
    data = rng.integers(97, 99, 1500).astype(np.uint8)
    starts = np.sort(rng.choice(len(data) - 12, 400, replace=False))
    docs = rng.integers(0, 60, 400)
    want = []
    for s, d in zip(starts, docs, strict=True):
        other = starts[docs < d]
        same = data[other[:, None] + np.arange(12)] == data[s : s + 12]
        want.append(int(np.where(same.all(axis=1), 12, same.argmin(axis=1)).max(initial=0)))
    assert previous_factors(data, starts, docs, 12).tolist() == want
    order, lcp = suffix_order(data, starts, 12)
    _, before, _, after = smaller_neighbours(docs[order], lcp)
    full = np.array(want)[order] == 12
    assert (full & (before < 12)).any() and (full & (after < 12)).any()


def test_nothing_that_was_sent_is_kept(monkeypatch):
    """While Spark takes a batch of runs, the worker doesn't hold them as well, and it gives its memory back at the end."""
    given = []
    monkeypatch.setattr(suffix_dedup, "FLUSH", 1)
    monkeypatch.setattr(suffix_dedup, "give_back", lambda: given.append(1), raising=False)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["abcdefghij" * 20, "klmnopqrst" * 20]})
    rows = suffix_dedup._first_round(8, suffix_dedup.Frequent(np.empty(0, np.uint64)))(iter([batch, batch]))
    sent = 0
    for out in rows:
        sent += out.num_rows
        assert not rows.gi_frame.f_locals["held"]
    assert sent and given
