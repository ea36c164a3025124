import zlib

import numpy as np
import pytest

from strandline.llm.packing import Packer, WordEncoder, exchanges, pack_documents, tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    with open(tokenizer_path(), encoding="utf-8") as f:
        return WordEncoder(f.read())


def test_words_equal_library(encoder, rows):
    texts = [r[1] or "" for r in rows] + ["It's 'twas we'll \xbd x\xb2 \xa0 a\x85b <|endoftext|> İstanbul ΣΑΣ", "!'s ''s '' 'd'd 12.5", "\x1c a\x00b", "\xad soft\xadhyphen", "ÀÉÎ ß ÿ"]
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert [x.tolist() for x in encoder.encode(texts)] == want


def test_pieces_cover_every_id_once(docs, rows, encoder):
    got = pack_documents(docs, tokenizer_path()).collect()
    ids = [np.array([*encoder.library.encode(r[1] or "", add_special_tokens=False).ids, 2], np.uint32) for r in rows]
    by_seq, tokens = {}, 0
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and (at & (at - 1)) == 0
        tokens += at
    assert tokens == sum(map(len, ids))
    for row, own in zip(rows, ids, strict=True):
        same = [r for r in got if r.doc_id == row[0]]
        if sum(1 for x in rows if x[0] == row[0]) > 1:
            continue
        at = 0
        for r in sorted(same, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own)
            assert r.ids_crc32 == zlib.crc32(own[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(own)


def test_all_limits_hold_at_once():
    rng = np.random.default_rng(2)
    p, total = Packer(64, 5, 40), 0
    for i in range(400):
        n = int(rng.integers(1, 150))
        total += n
        p.add(i, np.arange(n, dtype=np.uint32), rng.random(n) < 0.6)
    p.finish()
    seqs, masks = {}, np.random.default_rng(2)
    mask = []
    for _ in range(400):
        n = int(masks.integers(1, 150))
        mask.append(masks.random(n) < 0.6)
    for key, start, length, _, _, s, _ in p.take():
        seqs.setdefault(s, []).append((length, int(mask[key][start : start + length].sum())))
    for pieces in seqs.values():
        assert sum(x for x, _ in pieces) <= 64 and len(pieces) <= 5 and sum(x for _, x in pieces) <= 40
    assert sum(x for v in seqs.values() for x, _ in v) == total


def test_empty(nothing):
    assert pack_documents(nothing, tokenizer_path()).collect() == []


@pytest.mark.parametrize(("limits", "binds"), [((256, 99, 256), 0), ((256, 3, 256), 1), ((256, 99, 60), 2)])
def test_each_limit_binds_for_conversations(spark, encoder, limits, binds):
    """Exchanges of a table of conversations, with one conversation of a third of all rows, null texts and repeated turns."""
    rng = np.random.default_rng(4)
    words = ["alpha", "beta", "gamma", "delta", "some", "other", "word"]
    rows = [(i if i % 3 else 1, t, "assistant" if t % 2 else "user", None if i == 7 else " ".join(rng.choice(words, int(rng.integers(1, 30))))) for i in range(60) for t in range(2 * (i + 1) if i % 3 == 0 else 0, 2 * (i + 1) + 2 if i % 3 == 0 else 2)]
    rows += [(500, 0, "assistant", "alone"), (501, 0, "user", "nobody answers"), (502, 0, "user", "twice"), (502, 0, "user", "asked"), (502, 1, "assistant", "yes"), (None, 1, "assistant", "no id")]
    got = exchanges(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    parts = {}
    for r in got.collect():
        parts.setdefault(r.doc_id, []).append([(p.text, p.loss) for p in r.parts])
    assert parts[500] == [[("alone", True)]] and 501 not in parts and len(parts[502]) == 2 and parts[None] == [[("no id", True)]]
    assert len(parts[1]) == 1 + 20  # the large one, in pairs
    examples = spark.createDataFrame([(i, [p.asDict() for p in r.parts]) for i, r in enumerate(got.collect())], "doc_id long, parts array<struct<text: string, loss: boolean>>")
    masks = {}
    for r in examples.collect():
        flags = [f for p in r.parts for f in [p.loss] * len(encoder.library.encode(p.text or "", add_special_tokens=False).ids)]
        masks[r.doc_id] = np.array([*flags, r.parts[-1].loss])
    seqs = {}
    for r in pack_documents(examples, tokenizer_path(), 2, *limits).collect():
        assert r.doc_tokens == len(masks[r.doc_id])
        seqs.setdefault(r.sequence_id, []).append((r.length, 1, int(masks[r.doc_id][r.start : r.start + r.length].sum())))
    sums = np.array([np.sum(v, axis=0) for v in seqs.values()])
    assert (sums <= limits).all() and sums[:, 0].sum() == sum(map(len, masks.values()))
    assert [bool((sums[:, i] == limits[i]).any()) for i in range(3)] == [i == binds for i in range(3)]


def test_null_parts(spark):
    rows = [(1, None), (2, []), (3, [None, {"text": None, "loss": True}, {"text": "a", "loss": None}])]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, parts array<struct<text: string, loss: boolean>>"), tokenizer_path()).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in got) == [(1, 1), (2, 1), (3, 2)]
