"""Packing token pieces into sequences by vector bin packing with the dot-product heuristic.

A sequence has three limits at once: tokens, segments and loss-bearing tokens. The open sequence takes, of all pieces
in the pool that still fit, the one whose demand has the largest dot product with what is left (each dimension as a
share of its limit). When nothing fits any more, the best piece is cut so that the sequence is full. A document
longer than a sequence is cut into whole sequences first. A sequence that cannot be filled (the end of the input, the
segment or loss limit) ends at a power of two, so that it needs no padding, and its tail goes back to the pool.

Where all tokens bear loss and the limits are equal, as in the registered query, only the token limit binds, and the
heuristic is best fit by length; instruction data with parts that bear no loss (exchanges) makes all three bind.

Every task packs its own part of the input with a pool of bounded size: nothing is shuffled, and no bin waits for
another task. At the end of a task at most one sequence of each power of two is short.

Defined results: a null text has the end mark only. Rows that repeat, null ids included, are packed one by one. An
empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import CHUNK_BYTES, give_back, mix, powers, prefix_hash, table

POOL = 256
#: Words whose ids a worker remembers (some 16 bytes each and their ids); beyond that it forgets them and starts anew.
WORDS_KEPT = 1_000_000
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[[9, 10, 13, 32]] = _SPACE
    out[[*b"0123456789", 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT
    letters = [*range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]
    out[letters] = _LETTER
    return out


_CLASS = _classes()
#: What may follow an apostrophe as one token with it.
_TAILS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def pre_tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of lower-case Latin-1 that ends with a space: an apostrophe with its tail, letters, one digit, other runs."""
    cls = _CLASS[data]
    start = np.empty(len(cls), bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    quote = np.flatnonzero((data == 39) & start)
    start |= cls == _DIGIT
    quote = quote[quote + 3 < len(data)]
    if len(quote):
        after = np.zeros(len(quote), np.int64)
        for tail in reversed(_TAILS):
            fits = np.ones(len(quote), bool)
            for j, c in enumerate(tail, 1):
                fits &= data[quote + j] == c
            after[fits] = len(tail)
        quote, after = quote[after > 0], after[after > 0]
        start[quote + 1] = False
        behind = quote + after + 1
        start[behind[cls[behind] == _LETTER]] = True
    word = cls != _SPACE
    ends = np.flatnonzero((start[1:] | ~word[1:]) & word[:-1]) + 1
    return np.flatnonzero(start & word), ends


class WordEncoder:
    """Ids by a tokenizer (its JSON) of lower-cased words without white space, whose last token of a word ends with a mark.

    Such a tokenizer treats each pre-token alone, so the ids of a word are remembered under its 64-bit hash; new words
    are encoded together, with spaces between them. Texts with other characters than printable Latin-1 and plain line
    ends, or with special tokens, go to the library as they are.
    """

    PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
    MARK = "</w>"

    def __init__(self, tokenizer: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(self.MARK)]] = True
        self.forget()

    def forget(self) -> None:
        # Two sorted tables of hashes with the numbers of their words: a large one, and a small one that is merged into it.
        self.tables = [(np.empty(0, np.uint64), np.empty(0, np.int32)) for _ in range(2)]
        self.flat, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words; -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        for known, number in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                out[hit] = number[at[hit]]
        return out

    def _learn(self, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Encodes new words (their hashes in rising order); returns their numbers."""
        parts = [b" ".join(words[i : i + 2000]).decode("latin-1") for i in range(0, len(words), 2000)]
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.library.encode_batch(parts, add_special_tokens=False)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            raise ValueError("the tokenizer does not mark the ends of words")
        number = np.arange(len(self.starts) - 1, len(self.starts) - 1 + len(words), dtype=np.int32)
        self.starts = np.concatenate([self.starts, len(self.flat) + stops])
        self.flat = np.concatenate([self.flat, ids])
        known = np.concatenate([self.tables[1][0], hashes])
        order = np.argsort(known)
        self.tables[1] = known[order], np.concatenate([self.tables[1][1], number])[order]
        if len(known) > WORDS_KEPT // 10:
            known = np.concatenate([self.tables[0][0], self.tables[1][0]])
            order = np.argsort(known)
            self.tables[0] = known[order], np.concatenate([self.tables[0][1], self.tables[1][1]])[order]
            self.tables[1] = np.empty(0, np.uint64), np.empty(0, np.int32)
        return number

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.starts) > WORDS_KEPT:
            self.forget()
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        plain, pieces = [], []
        for i, t in enumerate(texts):
            if self.PLAIN.fullmatch(t) and not any(s in t for s in self.special):
                plain.append(i)
                pieces.append(t.lower().encode("latin-1"))
            else:
                out[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
        joined = b" ".join(pieces) + b" "
        data = np.frombuffer(joined, np.uint8)
        start, end = pre_tokens(data)
        if not len(start):
            return out
        h = prefix_hash(data)
        size = end - start
        hashes, first, inverse = np.unique(mix((h[end] - h[start]) * powers(len(data) + 1)[1][start] + size.astype(np.uint64)), return_index=True, return_inverse=True)
        number = self._numbers(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self._learn([joined[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)], hashes[new])
        at = number[inverse]
        n = self.starts[at + 1] - self.starts[at]
        stop = np.cumsum(n)
        ids = self.flat[np.repeat(self.starts[at] - (stop - n), n) + np.arange(stop[-1])]
        bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in pieces])])
        cut = np.concatenate([[0], stop])[np.searchsorted(start, bounds)]
        for j, i in enumerate(plain):
            out[i] = ids[cut[j] : cut[j + 1]]
        return out


class Packer:
    """Takes documents' ids one after the other; gives rows (key, start, length, crc, total, sequence, offset)."""

    def __init__(self, tokens: int, segments: int, loss: int, first_sequence: int = 0):
        self.limits = np.array([tokens, segments, loss], np.float64)
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.sequence = first_sequence
        self.pool: list[tuple] = []  # (key, total, start, ids, loss mask or None)
        self.rows: list[tuple] = []

    def add(self, key: object, ids: np.ndarray, mask: np.ndarray | None = None) -> None:
        whole = len(ids) - len(ids) % self.tokens if self.loss >= self.tokens else 0
        for at in range(0, whole, self.tokens):
            self._emit([(key, len(ids), at, ids[at : at + self.tokens], None)])
        if whole < len(ids):
            self.pool.append((key, len(ids), whole, ids[whole:], None if mask is None else mask[whole:]))
        if len(self.pool) >= POOL:
            self._pack(POOL // 4)

    def finish(self) -> None:
        self._pack(0)

    @staticmethod
    def _loss(piece: tuple) -> int:
        return len(piece[3]) if piece[4] is None else int(piece[4].sum())

    def _cut(self, piece: tuple, n: int) -> tuple[tuple, tuple]:
        key, total, start, ids, mask = piece
        return (key, total, start, ids[:n], mask if mask is None else mask[:n]), (key, total, start + n, ids[n:], mask if mask is None else mask[n:])

    def _fitting(self, piece: tuple, left: np.ndarray) -> int:
        """How many tokens of the piece fit."""
        n = int(min(len(piece[3]), left[0])) if left[1] >= 1 else 0
        if piece[4] is None:
            return int(min(n, left[2]))
        return int(min(n, np.searchsorted(np.cumsum(piece[4]), left[2], "right")))

    def _demand(self, piece: tuple) -> tuple[float, float, float]:
        n = len(piece[3]) / self.tokens
        return n, 1 / self.segments, n * self.tokens / self.loss if piece[4] is None else float(piece[4].sum()) / self.loss

    def _pack(self, keep: int) -> None:
        """Fills sequences until at most `keep` pieces are left in the pool."""
        pool, here = self.pool, len(self.pool)
        if not here:
            return
        demand = np.full((2 * here + 64, 3), np.inf)  # of pieces that are gone: infinite
        demand[:here] = [self._demand(p) for p in pool]
        while here > keep:
            left, taken = np.ones(3), []
            while True:
                fits = np.flatnonzero((demand <= left + 1e-12).all(axis=1))
                if not len(fits):
                    break
                best = int(fits[np.argmax(demand[fits] @ left)])
                taken.append(pool[best])
                left = left - demand[best]
                demand[best] = np.inf
                here -= 1
            space = np.rint(left * self.limits)
            back: list[tuple] = []
            if space[0] and here:  # nothing fits whole: the longest piece is cut
                rest = np.flatnonzero(demand[:, 0] < np.inf)
                best = int(rest[np.argmax(demand[rest, 0])])
                if n := self._fitting(pool[best], space):
                    head, tail = self._cut(pool[best], n)
                    taken.append(head)
                    back.append(tail)
                    demand[best] = np.inf
                    here -= 1
            back += self._ended(taken)
            if len(pool) + len(back) > len(demand):
                kept = [pool[i] for i in np.flatnonzero(demand[:, 0] < np.inf)]
                self.pool = kept + back
                return self._pack(keep)
            for p in back:
                demand[len(pool)] = self._demand(p)
                pool.append(p)
                here += 1
        self.pool = [pool[i] for i in np.flatnonzero(demand[:, 0] < np.inf)]

    def _ended(self, taken: list[tuple]) -> list[tuple]:
        """Emits the sequence, up to a power of two if it isn't full; returns what comes after that."""
        size = sum(len(p[3]) for p in taken)
        room = size if size == self.tokens else 1 << (size.bit_length() - 1)
        out, back = [], []
        for p in taken:
            if room >= len(p[3]):
                out.append(p)
                room -= len(p[3])
            elif room:
                head, tail = self._cut(p, room)
                out.append(head)
                back.append(tail)
                room = 0
            else:
                back.append(p)
        self._emit(out)
        return back

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, total, start, ids, _ in pieces:
            self.rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_encoders: dict[int, WordEncoder] = {}


def _encoder(tokenizer: str) -> WordEncoder:
    """One for each file in a worker."""
    key = zlib.crc32(tokenizer.encode())
    if key not in _encoders:
        _encoders[key] = WordEncoder(tokenizer)
    return _encoders[key]


def _spans(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts that have about CHUNK_BYTES characters; a longer one is alone."""
    at = 0
    while at < len(sizes):
        to, size = at, 0
        while to < len(sizes) and (to == at or size < CHUNK_BYTES):
            size += sizes[to]
            to += 1
        yield at, to
        at = to


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 2, tokens: int = 4096, segments: int = 4096, loss: int = 4096) -> DataFrame:
    """The pieces of all docs(doc_id, text), whose tokens all bear loss, or of docs(doc_id, parts).

    parts: array<struct<text string, loss boolean>>, in order; the tokens of a part bear loss if it says so, and the end
    mark as the last part does. A null part, text or loss is an empty text without loss. A table that has a text is
    packed by it, whatever parts it has. tokenizer: a file on the driver; its content is sent to the executors.
    """
    with open(tokenizer, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    by_parts = "text" not in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        packer = Packer(tokens, segments, loss, TaskContext.get().partitionId() << 36)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            if by_parts:
                lists = [[x or {"text": None, "loss": None} for x in parts or []] for parts in batch.column("parts").to_pylist()]
                texts, bears = [[x["text"] or "" for x in parts] for parts in lists], [[bool(x["loss"]) for x in parts] for parts in lists]
            else:
                texts, bears = [[t or ""] for t in batch.column("text").to_pylist()], None
            for a, b in _spans([sum(map(len, x)) for x in texts]):
                encoded = iter(encoder.encode([t for parts in texts[a:b] for t in parts]))
                for i in range(a, b):
                    own = [next(encoded) for _ in texts[i]]
                    mask = None if bears is None else np.repeat([*bears[i], bool(bears[i]) and bears[i][-1]], [*map(len, own), 1])
                    packer.add(ids[i], np.concatenate([*own, np.array([end], np.uint32)]), mask)
            yield _rows(packer.take())
        packer.finish()
        yield _rows(packer.take())
        give_back()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "parts" if by_parts else "text").mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))


def exchanges(conversations: DataFrame, answers: str = "assistant") -> DataFrame:
    """doc_id and parts for pack_documents: every answer of conversations(conv_id, turn, role, text) after the turn before it.

    Only the answer bears loss. Turns are joined by conversation and number, so a long conversation isn't gathered
    anywhere. A turn that several rows have comes with each of them; an answer without a turn before it stands alone.
    """
    own = conversations.filter(F.col("role") == answers).select("conv_id", "turn", "text")
    before = conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.struct("text", F.lit(False).alias("loss")).alias("asked"))
    answer = F.struct(F.col("text"), F.lit(True).alias("loss"))
    return own.join(before, ["conv_id", "turn"], "left").select(F.col("conv_id").cast("long").alias("doc_id"), F.array_compact(F.array("asked", answer)).alias("parts"))


def _rows(rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)


def tokenizer_path() -> str:
    """The public word tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
