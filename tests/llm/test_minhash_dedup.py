import re
from collections import defaultdict

import numpy as np
import pytest

from strandline.llm.minhash_dedup import components, keep_one, near_duplicates, sketch, stars

FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def grams(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=4):
    sets = [grams(t, k) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            named = rows[i][0] is not None and rows[j][0] is not None
            same_id = named and rows[i][0] == rows[j][0] and a and b
            if a and b and (a == b or same_id or named and 100 * len(a & b) >= 80 * len(a | b)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        if sets[i] and r[0] is not None:
            groups[find(i)].append(r[0])
    return [(r[0], len(s), min(groups[find(i)], default=None) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def test_components_equal_brute_force(docs, rows):
    got = near_duplicates(docs).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r.kept == ((r.component_id is None) if r.doc_id is None else r.doc_id == r.component_id) for r in got)


def test_keep_one_keeps_columns_and_one_row_a_group(docs, rows):
    kept = keep_one(docs, 4)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got))
    expected = {(r[0], r[1]) for r, b in zip(rows, brute(rows), strict=True) if (b[2] is None if r[0] is None else r[0] == b[2])}
    assert set(got) == expected


def test_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    from strandline.llm import minhash_dedup as m

    monkeypatch.setattr(m, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(80)]
    data = []
    for i in range(120):
        w = list(base)
        for at in rng.choice(80, rng.integers(0, 5), replace=False):
            w[at] = f"x{rng.integers(10**6)}"
        data.append((i, " ".join(w), None, None))
    got = near_duplicates(spark.createDataFrame([(a, b) for a, b, *_ in data], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(data))


def test_empty(nothing):
    assert near_duplicates(nothing).collect() == []
    assert keep_one(nothing).collect() == []


@pytest.mark.parametrize("n", [1, 2, 50, 700])
def test_every_coordinate_is_filled(n):
    g = np.random.default_rng(n).integers(1, 1 << 62, n).astype(np.uint64)
    s = sketch(g, np.array([n]))
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert (s == sketch(g[::-1].copy(), np.array([n]))).all()


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    share = []
    for _ in range(60):
        x = rng.integers(1, 1 << 62, 300).astype(np.uint64)
        y = np.concatenate([x[:250], rng.integers(1, 1 << 62, 50).astype(np.uint64)])
        s = sketch(np.concatenate([x, y]), np.array([300, 300]))
        share.append((s[0] == s[1]).mean())
    assert abs(np.mean(share) - 250 / 350) < 0.02


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def least_reached(pairs):
    comp = {n: n for p in pairs for n in p}
    while True:
        new = dict(comp)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == comp:
            return comp
        comp = new


def written(monkeypatch, m):
    """Names of what is staged from now on."""
    names, put = [], m.stage
    monkeypatch.setattr(m, "stage", lambda df, name: names.append(name) or put(df, name))
    return names


def test_components_of_a_hub_and_a_chain_take_two_rounds(spark, monkeypatch):
    from strandline.llm import minhash_dedup as m

    links = [(500, i) for i in range(300)] + [(i, i + 1) for i in range(600, 700)] + [(900, 901), (901, 900)]
    names = written(monkeypatch, m)
    got = components(spark.createDataFrame(links, "a long, b long").repartition(7))
    assert names.count("links") <= 2
    assert sorted((r.node, r.comp) for r in got.collect()) == sorted(least_reached(links).items())


def test_components_when_a_task_holds_few_links(spark, monkeypatch):
    from strandline.llm import minhash_dedup as m

    rng = np.random.default_rng(5)
    chain = rng.permutation(60)
    links = [(int(a), int(b)) for a, b in zip(chain[:-1], chain[1:], strict=True)] + [(i, i + 1) for i in range(100, 160)] + [(300, i) for i in range(200, 220)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(9).localCheckpoint()
    seeds, contracted = [], m._contracted
    monkeypatch.setattr(m, "_contracted", lambda seed: seeds.append(seed) or contracted(seed))
    monkeypatch.setattr(m, "LINKS", 4)
    many = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "1000"}
    before = {key: spark.conf.get(key) for key in many}
    try:
        for key, value in many.items():
            spark.conf.set(key, value)
        got = dict(components(frame).collect())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == least_reached(links)
    assert any(seeds)  # more than half of the links were left once


@pytest.mark.parametrize("seed", [0, 3])
def test_stars_connect_what_pairs_connect(seed):
    rng = np.random.default_rng(2)
    pairs = rng.integers(-50, 50, (60, 2))
    found = stars(pairs, seed)
    assert len(set(found[:, 0])) == len(found) and not set(found[:, 0]) & set(found[:, 1])
    reached = least_reached(pairs.tolist())
    assert least_reached(found.tolist()).items() <= reached.items()
    assert {n for n in reached} - set(found.ravel().tolist()) == {n for n, c in reached.items() if list(reached.values()).count(c) == 1}
    if not seed:
        assert all(reached[n] == r for n, r in found.tolist())
