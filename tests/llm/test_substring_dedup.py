import hashlib
import random
import re

import pytest

from strandline.llm import substring_dedup
from strandline.llm.substring_dedup import MIN_LINE, MIN_WORDS, Units, _print, frequent_digests, remove_repeats, spans_of, substring_spans, without


def brute(rows):
    """All units in rank order; the first of each digest stays."""
    every, units = [], {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        units[d, b] = u = Units([b])
        every += [((d is None, d if d is not None else 0, hashlib.sha256(b).hexdigest() if d is None else "", int(x)), int(h), (d, b)) for x, h in zip(u.start, u.hash, strict=True)]
    return every, units


def test_first_occurrence_stays_and_later_ones_go(docs, rows):
    named = docs.filter("doc_id is not null and doc_id < 500")
    got = {r.doc_id: r for r in substring_spans(named).collect()}
    every, units = brute([r for r in rows if r[0] is not None and r[0] < 500])
    seen, later = set(), {}
    for _, h, key in sorted(every):
        pass
    for rank, h, key in sorted(every, key=lambda e: e[0]):
        if h in seen:
            later.setdefault(key, []).append(rank[3])
        seen.add(h)
    for (d, b), u in units.items():
        spans, n, gone = spans_of(b, later.get((d, b), []), u)
        r = got[d]
        assert (r.n_units, r.n_removed, [tuple(s) for s in r.spans]) == (n, gone, spans)
        assert r.kept_sha256 == hashlib.sha256(without(b, spans)).hexdigest()


def test_shared_passage_in_the_middle_of_a_line_is_caught(spark):
    passage = " ".join(f"word{i}" + ("." if i % 9 == 8 else "") for i in range(60))
    rows = [(1, "Some quite unlike beginning of words here " + passage + " and an end."), (2, "Another thing altogether then " + passage + " with its own close."), (3, "A clean document of its own with nothing that anybody else would say at any length.")]
    got = {r.doc_id: r for r in substring_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[3].n_removed == 0
    cut = b"".join(rows[1][1].encode()[s.start : s.end] for s in got[2].spans).decode()
    assert len(cut.split()) >= 40 and "altogether" not in cut


def test_short_repeats_stay(spark):
    rows = [(i, f"Yes. No. OK. Unlike{i} text{i} of{i} its{i} own{i}.") for i in range(5)]
    assert all(r.n_removed == 0 for r in substring_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert MIN_LINE <= MIN_WORDS


def test_stage_keeps_columns_nulls_and_rows(docs, rows):
    out = remove_repeats(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert any(r.text is None for r in got)
    spans = {(r.doc_id, r.kept_sha256) for r in substring_spans(docs).collect()}
    assert all((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) in spans for r in got)


def test_empty(nothing):
    assert substring_spans(nothing).collect() == [] and remove_repeats(nothing).collect() == []


def shared_words(texts, least=20):
    """Words of each text that lie in a run of `least` words that an earlier place has too; word by word, without hashes."""
    seen, out = set(), []
    for t in texts:
        w = t.lower().split()
        grams = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        again = set()
        for i, g in enumerate(grams):
            if g in seen:
                again.update(range(i, i + least))
            seen.add(g)
        out.append(again)
    return out


def gone_words(text, spans):
    """Places of the words that the spans take."""
    b, out, at = text.encode(), set(), 0
    for i, w in enumerate(b.split()):
        at = b.index(w, at)
        out |= {i} if any(s <= at < e for s, e in spans) else set()
        at += len(w)
    return out


def test_passages_in_short_lines_go(spark):
    rng = random.Random(11)
    texts = []
    for n in (20, 24, 50, 400):
        for size in (3, 4, 5, 6, 7):
            lines = [" ".join(f"w{rng.randrange(300)}" for _ in range(size)) for _ in range(-(-n // size))]
            own = [[" ".join(f"own{rng.randrange(10**9)}" for _ in range(size)) for _ in range(4)] for _ in range(4)]
            texts += ["\n".join(own[0] + lines + own[1]), "\n".join(own[2] + lines + own[3]), "\n".join(lines)]
    texts.append("\n".join(["Erheed. Titionly."] * 18))
    got = {r.doc_id: r for r in substring_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, want in enumerate(shared_words(texts)):
        gone = gone_words(texts[i], [tuple(s) for s in got[i].spans])
        assert want <= gone, (i, sorted(want - gone))
        assert not any(w.startswith("own") for j, w in enumerate(texts[i].split()) if j in gone)


def test_later_lines_of_three_words_go_and_shorter_ones_stay(spark):
    lines = ["One two.", "Only.", "All rights reserved.", "a line of four", "Nine words that stand in many of the documents."]
    texts = ["\n".join(f"own{i} text{j} of{i} its{j} own{i}\n{line}" for j, line in enumerate(lines)) + f"\nend{i} of{i} it{i}" for i in range(6)]
    seen = set()
    got = {r.doc_id: r for r in substring_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want, at = set(), 0
        for line in t.split("\n"):
            n = len(line.split())
            if n >= 3 and line in seen:
                want.update(range(at, at + n))
            seen.add(line)
            at += n
        assert gone_words(t, [tuple(s) for s in got[i].spans]) == want and bool(want) == (i > 0)


def test_passages_without_marks_are_found_wherever_they_stand(spark):
    rng = random.Random(12)
    texts, least = [], []
    for n in (38, 51, 60, 80):
        for _ in range(60):
            passage = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            for _ in range(2):
                own = [[f"own{rng.randrange(10**9)}" for _ in range(rng.randrange(60))] for _ in range(2)]
                texts.append(" ".join(own[0] + passage + own[1]))
            least += [0, n - 18]
    got = {r.doc_id: r for r in substring_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (t, want) in enumerate(zip(texts, shared_words(texts), strict=True)):
        gone = gone_words(t, [tuple(s) for s in got[i].spans])
        assert gone <= want and len(gone) >= least[i], (i, len(gone), len(want))


@pytest.mark.parametrize("by", ["lines", "paragraphs"])
def test_later_lines_and_paragraphs_go_whole(spark, docs, rows, by):
    """The rule in plain Python, without hashes or the module's own units: what is left, word by word."""
    rng = random.Random(14)
    pool = [" ".join(rng.choice(["a", "B", "c", "dd"]) for _ in range(rng.randrange(1, 4))) for _ in range(12)]
    every = [(r[0], r[1]) for r in rows if r[0] is not None] + [(1000 + i, "".join(rng.choice(pool).upper() + rng.choice(["\n", "\n\n", " \n \t\n", "\r\n", " "]) for _ in range(8))) for i in range(40)]
    every = list(dict.fromkeys(r for r in every if r[0] != 507))
    seen, want = set(), {}
    for d, t in sorted(every):
        parts = re.split(r"\n" if by == "lines" else r"\n[ \t\r\x0b\x0c]*\n[ \t\r\x0b\x0c\n]*", t or "")
        kept = []
        for part in parts:
            words = re.findall(r"[^\x20\x09-\x0D]+", part)
            key = tuple(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words)
            if key and key not in seen:
                kept += words
            seen.add(key)
        want[d] = kept
    df = spark.createDataFrame(every, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in substring_spans(df, by).collect()}
    left = {d: re.findall(r"[^\x20\x09-\x0D]+", without((t or "").encode(), [tuple(x) for x in got[d]]).decode()) for d, t in every}
    assert left == want


def test_frequent_digests_are_dealt_out_with_the_same_result(spark, docs, monkeypatch):
    line = "One line that very many of the documents have."
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, f"{line}\nown{i} words{i} here{i}\n{line}") for i in range(200)], "doc_id long, text string"))
    plain = sorted(substring_spans(every).collect(), key=str)
    monkeypatch.setattr(substring_dedup, "SALTED", 20)
    monkeypatch.setattr(substring_dedup, "FREQUENT", 5)
    digests, groups = frequent_digests(every.withColumn("print", _print()), "words")
    assert len(digests) >= 1 and groups.max() > 10
    assert sorted(substring_spans(every).collect(), key=str) == plain
    assert {r.n_removed for r in plain if r.doc_id is not None and r.doc_id > 1000} == {2}
