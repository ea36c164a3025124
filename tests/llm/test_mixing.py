import re
from collections import defaultdict

import pytest

from strandline.llm.mixing import WEIGHTS, mix_sources, mixed_documents


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def fill(sizes, share=1.5, epochs=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, total, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= epochs * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: epochs * sizes[s] for s in over}
        free -= over
    return target


def test_targets_and_what_is_taken(docs, rows):
    got = mix_sources(docs, WEIGHTS).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((r[0] is None, r[0] or 0, size(r[1])) for r in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    target = fill(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_reruns_agree(docs):
    key = lambda r: str(r)
    assert sorted(mix_sources(docs, WEIGHTS).collect(), key=key) == sorted(mix_sources(docs.repartition(7), WEIGHTS).collect(), key=key)


def test_one_source_and_no_words(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (2, None, "x"), (3, "d", "x")], "doc_id long, text string, source string")
    assert sum(r.taken for r in mix_sources(df, WEIGHTS).collect()) == 6
    empty = df.filter("text is null")
    assert [(r.target, r.taken) for r in mix_sources(empty, WEIGHTS).collect()] == [(0.0, 0)]


def test_documents_repeat_whole(docs):
    out = mixed_documents(docs, WEIGHTS)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.source] += size(r.text)
    largest = max(size(r.text) for r in docs.collect())
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += size(r.text)
    assert all(abs(words[s] - t) <= largest for s, t in fill(sizes).items())


def test_empty(nothing):
    assert mix_sources(nothing, WEIGHTS).collect() == [] and mixed_documents(nothing, WEIGHTS).collect() == []


def test_main_path_has_no_python(docs):
    plan = mix_sources(docs, WEIGHTS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
