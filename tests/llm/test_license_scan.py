import re

from strandline.llm.license_scan import LOWER, PHRASES, TEMPLATES, UPPER, WORD, scan_licenses

FOLD = str.maketrans(UPPER, LOWER)


def words(t):
    return re.findall(WORD, (t or "").translate(FOLD))


def brute(t):
    w, starts, labels = words(t), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


CASES = [
    (1, "This code is under the MIT License, see LICENSE. Again under the mit license!"), (2, "apache-license version 2 and CC-BY-NC"), (3, "under the mit licensé"), (4, None), (5, ""), (6, "under the mit"),
    (7, "x " * 5000 + "cc by nc " * 3), (8, TEMPLATES[0][1]), (9, " ".join(w if i % 9 else w + " extra" for i, w in enumerate(TEMPLATES[0][1].split()))), (10, "the software is provided to deal in the software"),
    (None, "cc by nc"), (11, "cc by nc"), (11, "cc by nc"), (11, "something else with the same id"),
]


def test_base_places_equal_brute_force(spark, docs, rows):
    cases = [(a, b) for a, b, *_ in rows] + CASES
    df = docs.select("doc_id", "text", "print", "h", "w").unionByName(spark.createDataFrame([(a, b, 0, 0, ["q"]) for a, b in CASES], "doc_id long, text string, print long, h long, w array<string>"))
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan_licenses(df).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t in cases), key=str)


def test_templates_are_found_whole_and_with_insertions(spark):
    df = spark.createDataFrame(CASES, "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(df.filter("doc_id in (1, 8, 9, 10)")).collect()}
    assert got[8].labels == "mit" and got[8].score == 1.0 and got[8].base_labels == ""
    assert got[9].labels == "mit" and 0.6 <= got[9].score < 1
    assert got[10].labels == "" and got[10].score < 0.6
    assert got[1].labels == "mit"


def test_empty_and_native(nothing):
    out = scan_licenses(nothing)
    assert out.collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
