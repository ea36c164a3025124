import math
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import language_id
from strandline.llm.language_id import UNDECIDED, Model, held_out, identify, infer, keep_identified, op2_language_id, predict


def two_languages(spark, n=120):
    rng = random.Random(2)
    vocab = {"aa": ["thing", "which", "would", "other", "about", "these"], "bb": ["chose", "aussi", "autre", "avoir", "être", "même"], "cc": ["nicht", "werden", "über", "schön", "haben", "zwischen"]}
    rows = []
    for i in range(n):
        lang = "abc"[i % 3] * 2
        rows.append((i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(5, 60))), lang))
    return rows, vocab, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_undecided(spark):
    rows, _, df = two_languages(spark)
    extra = spark.createDataFrame([(900, None, "aa"), (901, "", "aa"), (902, "12 !? 3", "aa"), (903, "thing which", None), (None, "chose aussi", None), (904, "ÜBER SCHÖN ZWISCHEN", None)], df.schema)
    every = df.unionByName(extra)
    model = Model.learn(every.filter(~held_out()).select("text", "lang"))
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in identify(every, model).collect()}
    truth = {i: lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert truth and all(got[i].lang_pred == lang for i, lang in truth.items())
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None, 904)] == [UNDECIDED] * 3 + ["aa", "bb", "cc"]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixture_has_both_languages(spark):
    _, vocab, df = two_languages(spark)
    model = Model.learn(df.select("text", "lang"))
    text = " ".join(vocab["aa"] * 30 + vocab["bb"] * 10)
    r = identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert r.lang_pred == "aa" and r.languages.startswith("aa:0.7") and "bb:0.2" in r.languages and 0.7 < r.score < 0.8


def test_nothing_learned_and_empty(spark, nothing, docs):
    model = Model.learn(docs.filter("1 = 0").select("text", "lang"))
    assert {r.lang_pred for r in identify(docs, model).collect()} == {UNDECIDED}
    assert identify(nothing, model).collect() == []
    assert keep_identified(docs, model).collect() == []


def test_stage_keeps_columns_and_clean_documents(spark, docs, rows):
    model = Model.learn(docs.select("text", "lang"))
    out = keep_identified(docs, model)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert all(r[0] in kept for r in rows if r[0] is not None and r[0] < 500 and len(r[1].split()) > 10)
    assert not {500, 501, 502, 503} & set(kept)


def test_one_language_only():
    pi, score, value = infer(np.array([[-3.0], [-4.0], [-5.0]]), np.array([0, 1]))
    assert pi.tolist() == [[1.0], [1.0]] and score.tolist() == [1.0, 1.0] and value.tolist() == [-3.0, -9.0]


def test_six_languages_in_one_text(spark):
    rng = random.Random(8)
    vocab = {x * 2: ["".join(rng.choice("bcdfghjklmnpqrstvwxz"[3 * i : 3 * i + 5] + "aeiou") for _ in range(6)) for _ in range(30)] for i, x in enumerate("abcdef")}
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), lang) for i, (lang, words) in enumerate(list(vocab.items()) * 20)]
    model = Model.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = " ".join(" ".join(rng.choice(words) for _ in range(80)) for words in vocab.values())
    lang, score, sets, fits = predict(model, [text.encode(), b"0x9f$ ## \xc3\xbf\xc3\xbf%% qqqq \xe4\xb8\xad\xe6\x96\x87 wwww;;" * 3])
    shares = dict(x.split(":") for x in sets[0].split(","))
    assert sorted(shares) == sorted(vocab) and all(0.1 < float(x) < 0.25 for x in shares.values())
    assert 0.1 < score[0] < 0.25 and fits.tolist() == [True, False]


def test_many_languages_hash_to_fewer_grams(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MODEL", 1 << 16)
    rng = random.Random(3)
    vocab = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(10)] for i in range(40)}
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)), lang) for i, (lang, words) in enumerate(vocab.items())]
    model = Model.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.logs.size <= 1 << 16 and predict(model, [t.encode() for _, t, _ in rows])[0] == [lang for *_, lang in rows]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.lists(st.integers(1, 9), min_size=1, max_size=6), st.integers(0, 1 << 30))
def test_sets_equal_those_of_plain_expectation_maximisation(langs, sizes, seed):
    """Text by text, every language tried, in plain Python."""
    rng = np.random.default_rng(seed)
    logs = rng.normal(-30, 8, (sum(sizes), langs))
    bounds = np.cumsum(sizes) - sizes
    pi, _, value = infer(logs, bounds)
    for t, (a, n) in enumerate(zip(bounds, sizes, strict=True)):
        part = logs[a : a + n].tolist()
        chosen = [max(range(langs), key=lambda x: (sum(r[x] for r in part), -x))]
        share, best = {chosen[0]: 1.0}, sum(r[chosen[0]] for r in part)
        while n > 1:
            tried = []
            for new in set(range(langs)) - set(chosen):
                p = dict.fromkeys([*chosen, new], 1 / (len(chosen) + 1))
                for _ in range(12):
                    sums = dict.fromkeys(p, 0.0)
                    for r in part:
                        top = max(r)
                        joint = {x: p[x] * math.exp(r[x] - top) for x in p}
                        for x in p:
                            sums[x] += joint[x] / max(sum(joint.values()), 1e-300)
                    p = {x: sums[x] / n for x in p}
                ll = sum(max(r) + math.log(max(sum(p[x] * math.exp(r[x] - max(r)) for x in p), 1e-300)) for r in part)
                tried.append((ll, -new, p))
            if not tried or max(tried)[0] - best <= 0.5 * math.log(n + 1) + 3.0:
                break
            best, new, share = max(tried, key=lambda x: x[:2])
            chosen.append(-new)
        assert abs(value[t] - best) < 1e-6 * abs(best)
        assert all(abs(pi[t, x] - share.get(x, 0)) < 1e-6 for x in range(langs))


def test_query_columns(spark):
    out = op2_language_id(spark, "/root/testdata/sf0.001")
    held = out.filter("held_out").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id")
    assert held.selectExpr("avg(cast(lang_pred = lang as int)) a").first().a > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out.collect())
