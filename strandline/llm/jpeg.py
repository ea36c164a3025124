"""Progressive JPEG in numpy: a decoder for Huffman-coded files of 8-bit samples, and a lossless carrier of bytes.

Scans are accumulated into coefficient arrays (spectral selection and successive approximation), then inverse
transformed by one matrix product per block, chroma is upsampled by replication, and YCbCr becomes RGB.

The carrier puts each byte b into one AC coefficient of value 256 + b under a quantiser of 1, so the file keeps the
bytes exactly: coefficients, not samples, are what JPEG stores. 4:2:0 sampling, five kinds of scans. As all its AC
coefficients have the same size category, the decoder reads such scans as fixed-width fields; any other scan goes bit
by bit through the general path.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: The order in which JPEG numbers an 8 x 8 block's coefficients.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_SCALE = 1 << 16
_FILL = 63
PIECE = 1 << 16


def _basis() -> np.ndarray:
    """Row z: what one unit of zigzag coefficient z adds to the 64 samples, as whole multiples of 1 / _SCALE."""
    x = np.arange(8)
    c = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, np.sqrt(0.125), 0.5)
    return np.rint(np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG] * _SCALE)


_BASIS = _basis()


def huffman_codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


# --- the carrier ---------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(bits: bytes) -> bytes:
    return bits.replace(b"\xff", b"\xff\x00")


def _padded(bits: np.ndarray) -> bytes:
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def _scan(components: list[tuple[int, int]], start: int, end: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes(x) for x in components) + bytes([start, end, high << 4 | low])
    return _segment(0xDA, head) + _stuffed(data)


def _first_bits(top: np.ndarray) -> bytes:
    """The code 0 and eight bits for each value."""
    flat, out = top.reshape(-1), []
    for at in range(0, len(flat), PIECE * 8):
        part = flat[at : at + PIECE * 8]
        bits = np.zeros((len(part), 9), np.uint8)
        bits[:, 1:] = np.unpackbits(part).reshape(-1, 8)
        out.append(_padded(bits.reshape(-1)))
    return b"".join(out)


def _refine_bits(low: np.ndarray) -> bytes:
    """End-of-band runs over all blocks, each followed by its blocks' correction bits."""
    out = []
    for at in range(0, len(low), 32767):
        part = low[at : at + 32767]
        n = len(part).bit_length() - 1
        head = f"{n:04b}" + (f"{len(part) - (1 << n):0{n}b}" if n else "")
        out += [np.frombuffer(head.encode(), np.uint8) - 48, part.reshape(-1)]
    return _padded(np.concatenate(out))


def encode_bytes(payload: bytes) -> bytes:
    """A progressive JPEG that carries the payload."""
    mcus = max(1, -(-len(payload) // (6 * _FILL)))
    wide = int(np.ceil(np.sqrt(mcus)))
    high = -(-mcus // wide)
    if max(wide, high) > 4095:
        raise ValueError("the payload is too large for one picture")
    mcus = wide * high
    raw = np.zeros(mcus * 6 * _FILL, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    ac = raw.reshape(-1, _FILL)
    planes = {1: ac[: 4 * mcus], 2: ac[4 * mcus : 5 * mcus], 3: ac[5 * mcus :]}
    out = [b"\xff\xd8", _segment(0xFE, b"bytes " + str(len(payload)).encode()), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_segment(0xC4, b"\x00" + bytes([1] + [0] * 15) + b"\x00"))  # DC 0: category 0
    out.append(_segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x08"))  # AC 0: no zeros, then eight bits
    out.append(_segment(0xC4, b"\x11" + bytes([0, 0, 0, 15] + [0] * 12) + bytes(n << 4 for n in range(15))))  # AC 1: runs of ended bands
    zeros = _padded(np.zeros(6 * mcus, np.uint8))
    out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1, zeros))
    for c, plane in planes.items():
        top = plane >> 1 | 0x80  # (256 + b) >> 1
        out += [_scan([(c, 0)], 1, 5, 0, 1, _first_bits(top[:, :5])), _scan([(c, 0)], 6, 63, 0, 1, _first_bits(top[:, 5:]))]
    out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0, zeros))
    out += [_scan([(c, 1)], 1, 63, 1, 0, _refine_bits(plane & 1)) for c, plane in planes.items()]
    return b"".join(out) + b"\xff\xd9"


def carried_bytes(picture: Picture) -> bytes:
    """The payload of a decoded carrier."""
    n = int(picture.comment.removeprefix(b"bytes "))
    ac = np.concatenate([c.blocks[:, 1:].reshape(-1) for c in picture.components])[:n]
    return (ac - 256).astype(np.uint8).tobytes()


# --- the decoder ---------------------------------------------------------------------------------------------


class Bits:
    """A scan's data without stuffing; reads single bits for the general path."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def take(self, n: int) -> int:
        a, self.at = self.at, self.at + n
        first, last = a >> 3, (self.at + 7) >> 3
        piece = self.data[first:last] + b"\xff" * max(0, last - max(first, len(self.data)))
        return int.from_bytes(piece, "big") >> (8 * last - self.at) & ((1 << n) - 1) if n else 0

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("not a code of the table")

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def flat(self, n: int) -> np.ndarray:
        """The next n bits as an array."""
        a, self.at = self.at, self.at + n
        return np.unpackbits(np.frombuffer(self.data, np.uint8)[a >> 3 : (self.at + 7) >> 3])[a & 7 : (a & 7) + n]


class Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.ident, self.h, self.v, self.table = ident, h, v, table

    def lay_out(self, width: int, height: int, hmax: int, vmax: int) -> None:
        """Blocks of its own scans, and of the interleaved ones, which fill whole units."""
        self.own_wide, self.own_high = (-(-(-(-x * f // m)) // 8) for x, f, m in ((width, self.h, hmax), (height, self.v, vmax)))
        self.wide, self.high = -(-width // (8 * hmax)) * self.h, -(-height // (8 * vmax)) * self.v
        self.blocks = np.zeros((self.wide * self.high, 64), np.int16)


class Picture:
    """A decoded file: coefficient arrays by component, and the RGB tensor made of them."""

    def __init__(self, data: bytes):
        self.comment, self.tables, self.huffman, self.restart = b"", {}, {}, 0
        self.components: list[Component] = []
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at = 2
        while True:
            marker = data[at + 1]
            if marker == 0xD9:
                break
            (n,) = struct.unpack_from(">H", data, at + 2)
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xDA:
                found = _MARKER.search(data, at)
                end = found.start() if found else len(data)
                self._read_scan(body, data[at:end])
                at = end
                if not found:
                    break
            else:
                self._read_segment(marker, body)

    def _read_segment(self, marker: int, body: bytes) -> None:
        if marker == 0xFE:
            self.comment = body
        elif marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, 1 + 64 * (1 + (body[0] >> 4))
                self.tables[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else "u1").astype(np.int64)
                body = body[n:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                self.huffman[body[0]] = huffman_codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            (self.restart,) = struct.unpack(">H", body)
        elif marker == 0xC2:
            precision, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
            if precision != 8:
                raise ValueError("only 8-bit samples")
            self.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
            self.hmax, self.vmax = max(c.h for c in self.components), max(c.v for c in self.components)
            for c in self.components:
                c.lay_out(self.width, self.height, self.hmax, self.vmax)
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only progressive Huffman frames")

    def _read_scan(self, head: bytes, data: bytes) -> None:
        by = {c.ident: c for c in self.components}
        parts = [(by[head[1 + 2 * i]], head[2 + 2 * i]) for i in range(head[0])]
        start, end, approx = head[-3:]
        high, low = approx >> 4, approx & 15
        pieces = _RESTART.split(data) if self.restart else [data]
        order = self._order([c for c, _ in parts])
        step = self.restart * (sum(c.h * c.v for c, _ in parts) if len(parts) > 1 else 1) if self.restart else len(order)
        for i, piece in enumerate(pieces):
            bits = Bits(piece.replace(b"\xff\x00", b"\xff"))
            some = order[i * step : (i + 1) * step]
            if not len(some):
                break
            if start == 0:
                self._dc(bits, parts, some, high, low)
            elif high == 0:
                self._ac_first(bits, parts[0], some[:, 1], start, end, low)
            else:
                self._ac_refine(bits, parts[0], some[:, 1], start, end, low)

    def _order(self, comps: list[Component]) -> np.ndarray:
        """(component's place, block) in the order of the scan."""
        if len(comps) == 1:
            c = comps[0]
            return np.stack([np.zeros(c.own_wide * c.own_high, np.int64), (np.arange(c.own_high)[:, None] * c.wide + np.arange(c.own_wide)).reshape(-1)], axis=1)
        wide, high = comps[0].wide // comps[0].h, comps[0].high // comps[0].v
        y, x = np.divmod(np.arange(wide * high), wide)
        cols = [np.stack([np.full(len(x), k), (y * c.v + j) * c.wide + x * c.h + i], axis=1) for k, c in enumerate(comps) for j in range(c.v) for i in range(c.h)]
        return np.stack(cols, axis=1).reshape(-1, 2)

    def _dc(self, bits: Bits, parts: list, order: np.ndarray, high: int, low: int) -> None:
        if high:
            b = bits.flat(len(order)).astype(np.int16) << low
            for k, (c, _) in enumerate(parts):
                at = order[:, 0] == k
                c.blocks[order[at, 1], 0] |= b[at]
            return
        if all(self.huffman[t >> 4] == {(1, 0): 0} for _, t in parts):
            return  # every difference is zero
        last = [0] * len(parts)
        for k, block in order.tolist():
            c, t = parts[k]
            last[k] += bits.signed(bits.symbol(self.huffman[t >> 4]))
            c.blocks[block, 0] = last[k] << low

    def _ac_first(self, bits: Bits, part: tuple, order: np.ndarray, start: int, end: int, low: int) -> None:
        c, codes = part[0], self.huffman[0x10 | part[1] & 15]
        width = end - start + 1
        if len(codes) == 1 and 0 < (size := next(iter(codes.values()))) < 16:  # no other symbol: one field each
            length = next(iter(codes))[0]
            field, weights = length + size, 1 << np.arange(size - 1, -1, -1, dtype=np.int32)
            out = np.empty(len(order) * width, np.int16)
            for at in range(0, len(out), PIECE * 8):
                n = min(PIECE * 8, len(out) - at)
                v = bits.flat(n * field).reshape(n, field)[:, length:]
                v = np.packbits(v, axis=1)[:, 0].astype(np.int32) if size == 8 else v @ weights
                out[at : at + n] = np.where(v >> (size - 1), v, v - (1 << size) + 1) << low
            if len(order) == len(c.blocks):
                c.blocks[:, start : end + 1] = out.reshape(-1, width)
            else:
                c.blocks[order, start : end + 1] = out.reshape(-1, width)
            return
        run = 0
        for block in order.tolist():
            if run:
                run -= 1
                continue
            k = start
            while k <= end:
                s = bits.symbol(codes)
                zeros, size = s >> 4, s & 15
                if size:
                    k += zeros
                    c.blocks[block, k] = bits.signed(size) << low
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    run = (1 << zeros) + bits.take(zeros) - 1
                    break

    def _ac_refine(self, bits: Bits, part: tuple, order: np.ndarray, start: int, end: int, low: int) -> None:
        c, codes = part[0], self.huffman[0x10 | part[1] & 15]
        width, bit = end - start + 1, 1 << low
        whole = len(order) == len(c.blocks)
        band = c.blocks[:, start : end + 1] if whole else c.blocks[order, start : end + 1]
        if band.all():  # nothing new can come: runs of ended bands, and a correction bit for each coefficient
            at = 0
            while at < len(order):
                n = bits.symbol(codes) >> 4
                n = min((1 << n) + bits.take(n), len(order) - at)
                for a in range(at, at + n, PIECE):
                    b = min(at + n, a + PIECE)
                    band[a:b] += np.where(band[a:b] > 0, bit, -bit).astype(np.int16) * bits.flat((b - a) * width).reshape(-1, width)
                at += n
            if not whole:
                c.blocks[order, start : end + 1] = band
            return
        run = 0
        for i in order.tolist():
            block, k = c.blocks[i], start

            def correct(k: int, block: np.ndarray = block) -> None:
                if bits.take(1) and not abs(int(block[k])) & bit:
                    block[k] += bit if block[k] > 0 else -bit

            while k <= end and not run:
                s = bits.symbol(codes)
                zeros, size = s >> 4, s & 15
                value = 0
                if size:
                    value = bit if bits.take(1) else -bit
                elif zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                while k <= end:
                    if block[k]:
                        correct(k)
                    elif zeros:
                        zeros -= 1
                    else:
                        if value:
                            block[k] = value
                        k += 1
                        break
                    k += 1
            if run:
                for j in range(k, end + 1):
                    if block[j]:
                        correct(j)
                run -= 1

    def _plane(self, c: Component) -> np.ndarray:
        """Samples of a component, before the offset of 128 as uint8."""
        scaled = _BASIS * self.tables[c.table][:, None]
        rows, wide = [], c.wide
        step = max(1, PIECE // 8 // wide)
        for y in range(0, c.high, step):
            part = c.blocks[y * wide : (y + step) * wide].astype(np.float64) @ scaled  # whole numbers below 2**53: exact
            part = np.clip(np.floor(part * (1.0 / _SCALE) + 128.5), 0, 255).astype(np.uint8)
            rows.append(part.reshape(-1, wide, 8, 8).swapaxes(1, 2).reshape(-1, wide * 8))
        return np.concatenate(rows)

    def rgb(self) -> np.ndarray:
        """The tensor (height, width, 3) of full resolution."""
        planes = []
        for c in self.components:
            p, up, across = self._plane(c), self.vmax // c.v, self.hmax // c.h
            planes.append((p.repeat(up, axis=0) if up > 1 else p).repeat(across, axis=1)[: self.height, : self.width] if across > 1 else (p.repeat(up, axis=0) if up > 1 else p)[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2)
        y, cb, cr = (x.astype(np.int32) for x in planes)
        out = np.empty((*y.shape, 3), np.uint8)
        cb -= 128
        cr -= 128
        # Fixed values of the transform, as multiples of 1 / 65536.
        np.clip(y + ((91881 * cr + 32768) >> 16), 0, 255, out=out[:, :, 0], casting="unsafe")
        np.clip(y - ((22554 * cb + 46802 * cr + 32768) >> 16), 0, 255, out=out[:, :, 1], casting="unsafe")
        np.clip(y + ((116130 * cb + 32768) >> 16), 0, 255, out=out[:, :, 2], casting="unsafe")
        return out


_MARKER, _RESTART = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]"), re.compile(rb"\xff[\xd0-\xd7]")
