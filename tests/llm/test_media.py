import hashlib
import struct
import zlib

import numpy as np
import pytest

from strandline.llm import jpeg
from strandline.llm.media import UNIT, decode_column, described, op6_media_columns, padded, store_bytes


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 378, 5000, 200_000])
def test_round_trip(n):
    text = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    payload = padded(text)
    assert payload.startswith(text) and len(payload) % UNIT == 0 and len(payload) > 0 and set(payload[n:]) <= {255}
    media = jpeg.encode_bytes(payload)
    picture = jpeg.Picture(media)
    assert jpeg.carried_bytes(picture) == payload
    assert picture.rgb().shape == (picture.height, picture.width, 3)
    assert described(text)[2] == hashlib.sha256(payload).hexdigest()


def test_fast_paths_equal_general_path(monkeypatch):
    media = jpeg.encode_bytes(padded(bytes(range(256)) * 5))
    fast = jpeg.Picture(media)

    class Slow(jpeg.Picture):
        def _ac_first(self, bits, part, order, start, end, low):
            codes = self.huffman[0x10 | part[1] & 15]
            self.huffman[0x10 | part[1] & 15] = codes | {(16, 0xFFFE): 0xF0}  # a second symbol, never used
            super()._ac_first(bits, part, order, start, end, low)
            self.huffman[0x10 | part[1] & 15] = codes

        def _ac_refine(self, bits, part, order, start, end, low):
            class Never(np.ndarray):
                def all(self, *a, **k):
                    return False

            c = part[0]
            c.blocks = c.blocks.view(Never)
            super()._ac_refine(bits, part, order, start, end, low)
            c.blocks = np.asarray(c.blocks)

    slow = Slow(media)
    for a, b in zip(fast.components, slow.components, strict=True):
        assert (a.blocks == b.blocks).all()
    assert (fast.rgb() == slow.rgb()).all()


class Writer:
    """A small encoder of general progressive scans, for the decoder's sake: every symbol has a code of eight bits or more."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def number(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def data(self):
        b = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(b, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def general_file(blocks):
    """A grey picture of one row of blocks (zigzag order): DC and AC with successive approximation, runs and zeros."""
    seg = lambda m, b: struct.pack(">BBH", 255, m, len(b) + 2) + b
    n = len(blocks)
    symbols = bytes(range(255))  # code of symbol s is s on nine bits
    counts = bytes([0] * 8 + [255] + [0] * 7)
    out = b"\xff\xd8" + seg(0xDB, b"\x00" + bytes([2] * 64)) + seg(0xC2, struct.pack(">BHHB", 8, 8, 8 * n, 1) + bytes([1, 0x11, 0])) + seg(0xC4, b"\x00" + counts + symbols) + seg(0xC4, b"\x10" + counts + symbols)
    scan = lambda ss, se, ah, al, w: seg(0xDA, bytes([1, 1, 0, ss, se, ah << 4 | al])) + w.data()
    w, last = Writer(), 0
    for b in blocks:
        d = (int(b[0]) >> 1) - last
        last += d
        w.put(abs(d).bit_length(), 9)
        if d:
            w.number(d)
    out += scan(0, 0, 0, 1, w)
    w = Writer()
    for b in blocks:
        w.put(int(b[0]) & 1, 1)
    out += scan(0, 0, 1, 0, w)
    w, run = Writer(), 0
    half = lambda v: int(np.sign(v)) * (abs(int(v)) >> 1)

    def flush():
        nonlocal run
        if run:
            k = run.bit_length() - 1
            w.put(k << 4, 9)
            w.put(run - (1 << k), k)
            run = 0

    for b in blocks:
        zeros = 0
        for k in range(1, 64):
            v = half(b[k])
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                w.put(0xF0, 9)
                zeros -= 16
            w.put(zeros << 4 | abs(v).bit_length(), 9)
            w.number(v)
            zeros = 0
        if zeros:
            run += 1
    flush()
    out += scan(1, 63, 0, 1, w)
    w = Writer()
    for b in blocks:  # refinement, one end of band a block
        zeros, pending = 0, []
        last_new = max([k for k in range(1, 64) if abs(int(b[k])) == 1], default=0)
        for k in range(1, 64):
            v = int(b[k])
            if half(v):
                pending.append(abs(v) & 1)
                continue
            if abs(v) == 1:
                w.put(zeros << 4 | 1, 9)
                w.put(int(v > 0), 1)
                for p in pending:
                    w.put(p, 1)
                zeros, pending = 0, []
            else:
                zeros += 1
                if zeros == 16 and k < last_new:
                    w.put(0xF0, 9)
                    for p in pending:
                        w.put(p, 1)
                    zeros, pending = 0, []
        if last_new < 63:
            w.put(0, 9)
            for p in pending:
                w.put(p, 1)
    return out + scan(1, 63, 1, 0, w) + b"\xff\xd9"


def test_general_progressive_file():
    rng = np.random.default_rng(3)
    blocks = np.where(rng.random((7, 64)) < 0.25, rng.integers(-40, 41, (7, 64)), 0)
    blocks[2, 1:] = 0
    blocks[3, 1:] = 0
    blocks[:, 0] = rng.integers(-60, 61, 7)
    picture = jpeg.Picture(general_file(blocks))
    assert (picture.components[0].blocks == blocks).all()
    assert picture.rgb().shape == (8, 56, 3)


def test_zigzag_and_flat_block():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    flat = np.zeros((1, 64), int)
    flat[0, 0] = 40
    assert (jpeg.Picture(general_file(flat)).rgb() == 128 + 40 * 2 // 8).all()


def test_columns(spark, docs, rows, nothing):
    media = store_bytes(docs).collect()
    assert len(media) == len(rows)
    tensors = decode_column(spark.createDataFrame([(1, bytes(media[0].media)), (2, None)], "doc_id long, media binary")).collect()
    assert len(tensors[0].rgb) == tensors[0].height * tensors[0].width * 3 and tensors[1].rgb is None
    assert store_bytes(nothing).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op6_media_columns(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(30).collect():
        b = (r.text or "").encode()
        p = b + b"\xff" * (576 - len(b) if not b else -len(b) % 576)
        o = got[r.doc_id]
        assert (o.n_bytes, o.payload_bytes, o.payload_sha256, o.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
