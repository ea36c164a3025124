"""Removal of long repeated byte strings by longest-previous-factor arrays in suffix order.

A byte goes if it is covered by an L-byte string that also starts in a document with a smaller id. Only the first L
bytes of a suffix matter, so the suffix order of the corpus may be dealt out by any function of those L bytes: here
the smallest hash of their K-byte grams (a minimiser). Neighbouring suffixes mostly share it, so what travels is one
string for a run of suffixes. Grams that are frequent in a sample of bounded size are a minimiser only of strings that
have no other: so a common phrase in many contexts doesn't bring them all to one bucket. That concerns the dealing
alone; the result is the same whatever the sample has.

1. Copies are aggregated before anything is compared. Of runs that are equal as a whole (104 bits of two hashes), only
   the one in the smallest document is compared further; the others have a previous factor as long as themselves, and
   are covered. Every task sends a run once, so a passage in a third of all documents costs a row a task. Runs whose
   minimiser has no other document can have no previous factor and go no further.
2. The remaining runs go to the bucket of their minimiser. It puts their suffixes in the order of their first L bytes,
   with the common prefix of neighbours, finds the previous and the next position in that order with a smaller document,
   and the least common prefix on the way to each. The longer of the two is the longest previous factor (up to L).
   Suffixes whose factor reaches L cover their first L bytes.

Then every document drops its covered bytes.

Defined results: a null text is empty. A null doc_id is neither smaller than another nor has a smaller one: nothing
is removed. Rows that repeat a doc_id are judged each by its text against smaller ids. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import byte_values, chunks, give_back, mix, powers, prefix_hash, stored_bytes, table

L, K = 50, 25
#: Bytes of input (as stored) for each bucket of the first and of the second round, and of the sample for frequent grams.
BUCKET_BYTES, SAMPLE_BYTES = (8 << 20, 2 << 20), 64 << 20
MOST_BUCKETS, MOST_PARTITIONS = 1 << 22, 1 << 17
#: Frequent grams are the minimisers of at least that many runs of the sample; so many of them at most are told apart.
FREQUENT, MOST_FREQUENT = 256, 8192
LONGEST_RUN = 4096
FLUSH = 1 << 20
_LOW48 = np.uint64((1 << 48) - 1)
_DEALT = "bucket int, kind int, owners binary, keys binary, more binary"


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each position."""
    h = prefix_hash(data)
    m = len(data) - n + 1
    return mix((h[n:] - h[:m]) * powers(len(data) + 1)[1][:m]) if m > 0 else np.empty(0, np.uint64)


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` values from each position on."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Frequent:
    """Grams that are minimisers only where there is no other."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(grams)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[grams & np.uint64(0xFFFFF)] = True

    def last(self, values: np.ndarray) -> np.ndarray:
        """Gram hashes in their order, those of frequent grams above all others."""
        if not len(self.grams):
            return values
        at = np.flatnonzero(self.maybe[values & np.uint64(0xFFFFF)])
        found = self.grams[np.minimum(np.searchsorted(self.grams, values[at]), len(self.grams) - 1)] == values[at]
        values = values >> np.uint64(1)
        values[at[found]] |= np.uint64(1 << 63)
        return values


def runs_of(texts: list[bytes], frequent: Frequent | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of L-byte suffixes with one minimiser: text's number, first start, number of starts, minimiser (48 bits; 64 if frequent is None), hash of all its bytes (56 bits)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.empty(0, np.int64)
    if len(data) < L:
        return empty, empty, empty, np.empty(0, np.uint64), np.empty(0, np.uint64)
    h, back = prefix_hash(data), powers(len(data) + 1)[1]
    m = len(data) - K + 1
    grams = mix((h[K:] - h[:m]) * back[:m])
    least = window_least(grams if frequent is None else frequent.last(grams), L - K + 1)
    valid = np.ones(len(least), bool)
    for n in range(1, L):  # starts whose L bytes leave their text
        at = bounds[1:-1] - n
        valid[at[(at >= 0) & (at < len(least))]] = False
    cut = np.empty(len(least), bool)
    cut[0] = True
    np.not_equal(least[1:], least[:-1], out=cut[1:])
    inner = bounds[1:-1]
    cut[inner[inner < len(least)]] = True
    # Counted from the text's start, so that a text has the same runs in whatever batch it comes.
    cut |= (np.arange(len(least)) - np.repeat(bounds[:-1], sizes)[: len(least)]) % LONGEST_RUN == 0
    cut |= np.concatenate([[True], valid[1:] != valid[:-1]])
    first = np.flatnonzero(cut)
    length = np.diff(np.append(first, len(least)))
    keep = valid[first]
    first, length = first[keep], length[keep]
    text = np.searchsorted(bounds, first, "right") - 1
    size = length + L - 1
    ident = mix((h[first + size] - h[first]) * back[first] + size.astype(np.uint64)) >> np.uint64(8)
    return text, first - bounds[text], length, least[first] if frequent is None else mix(least[first]) & _LOW48, ident


def pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes], int]]:
    """(number of the first text, texts, offset): batches of about a chunk; a very long text in parts that overlap by L - 1."""
    limit = 1 << 20
    for a, b in chunks(texts, limit):
        if b - a == 1 and len(texts[a]) > 2 * limit:
            for at in range(0, max(1, len(texts[a]) - L + 1), limit):
                yield a, [texts[a][at : at + limit + L - 1]], at
        else:
            yield a, texts[a:b], 0


def _pack(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(blob: bytes, width: int) -> np.ndarray:
    raw = np.zeros((len(blob) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return raw.view(np.uint64).reshape(-1)


def _shrunk(ids: np.ndarray) -> bytes:
    """Ids as 4 or 8 bytes each; the first byte says which."""
    small = not len(ids) or (ids.min() >= -(1 << 31) and ids.max() < 1 << 31)
    return (b"4" + ids.astype("<i4").tobytes()) if small else (b"8" + ids.astype("<i8").tobytes())


def _grown(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<i{blob[:1].decode()}", offset=1).astype(np.int64)


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "kind", "owners", "keys", "more"])


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _common_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, some, _ in pieces(byte_values(batch.column("text"))):
            gram, n = np.unique(runs_of(some)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["gram", "n"])
    give_back()


def frequent_grams(docs: DataFrame, size: int) -> Frequent:
    """From a sample of some SAMPLE_BYTES of the input."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, size // SAMPLE_BYTES))) == 0).select("text")
    counts = some.mapInArrow(_common_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    return Frequent(counts.orderBy(F.col("n").desc(), "gram").limit(MOST_FREQUENT).select("gram").toArrow().column("gram").to_numpy().view(np.uint64))


def _first_round(buckets: int, frequent: Frequent):
    def flush(keys: np.ndarray, idents: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(mix(keys * np.uint64(0x9E3779B97F4A7C15) + idents))
        keys, idents, docs = keys[order], idents[order], docs[order]
        start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (idents[1:] != idents[:-1])]))
        least = np.minimum.reduceat(docs, start)
        later = docs > np.repeat(least, np.diff(np.append(start, len(docs))))
        rows = []
        one_keys, one_idents = keys[start], idents[start]
        for b, at in _by_bucket((one_keys % np.uint64(buckets)).astype(np.int64)):
            rows.append((b, 0, _shrunk(least[at]), _pack(one_keys[at], 6), _pack(one_idents[at], 7)))
        docs, idents = docs[later], idents[later]
        for b, at in _by_bucket((mix(docs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)) if len(docs) else ():
            rows.append((b, 1, _shrunk(docs[at]), b"", _pack(idents[at], 7)))
        return _dealt(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            texts, ids = byte_values(batch.column("text")), batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, some, _ in pieces(texts):
                text, _, _, keys, idents = runs_of(some, frequent)
                if len(keys):
                    held.append((keys, idents, ids[a + text]))
                    size += len(keys)
                if size > FLUSH:
                    out = flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0  # nothing of it is kept while Spark takes it
                    yield out
                    del out
        if held:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
        give_back()

    return run


_COVERED, _ASKED = np.uint64(0), np.uint64(1)


def _first_answers(group: pa.Table) -> pa.Table:
    """(doc_id, runs): for each document, runs (by hash) that are covered or asked for; the lowest byte says which."""
    cols = group.to_pydict()
    sent = [(_grown(o), _unpack(k, 6), _unpack(m, 7)) for kind, o, k, m in zip(cols["kind"], cols["owners"], cols["keys"], cols["more"], strict=True) if kind == 0]
    known = [(_grown(o), _unpack(m, 7) << np.uint64(8)) for kind, o, m in zip(cols["kind"], cols["owners"], cols["more"], strict=True) if kind == 1]
    if sent:
        docs, keys, idents = (np.concatenate(x) for x in zip(*sent, strict=True))
        order = np.argsort(mix(keys * np.uint64(0x9E3779B97F4A7C15) + idents))
        docs, keys, idents = docs[order], keys[order], idents[order]
        start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (idents[1:] != idents[:-1])]))
        least = np.minimum.reduceat(docs, start)
        later = docs > np.repeat(least, np.diff(np.append(start, len(docs))))
        known.append((docs[later], idents[later] << np.uint64(8)))
        docs, keys, idents = least, keys[start], idents[start]
        order = np.argsort(keys)
        docs, keys, idents = docs[order], keys[order], idents[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        asked = np.minimum.reduceat(docs, start) != np.maximum.reduceat(docs, start)
        asked = np.repeat(asked, np.diff(np.append(start, len(docs))))
        known.append((docs[asked], idents[asked] << np.uint64(8) | _ASKED))
    docs, runs = (np.concatenate(x) for x in zip(*known, strict=True)) if known else (np.empty(0, np.int64), np.empty(0, np.uint64))
    if not len(docs):
        return pa.table({"doc_id": pa.array([], pa.int64()), "runs": pa.array([], pa.binary())})
    order = np.argsort(docs, kind="stable")
    docs, runs = docs[order], runs[order]
    edges = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1], [True]]))
    blobs = [runs[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"doc_id": pa.array(docs[edges[:-1]]), "runs": pa.array(blobs, pa.binary())})


def _second_round(buckets: int, frequent: Frequent):
    def flush(asked: list[tuple], spans: list[np.ndarray]) -> pa.RecordBatch:
        rows, dealt = [], {}
        for key, *place, string in asked:
            dealt.setdefault(key % buckets, []).append((*place, string))
        for b, some in dealt.items():
            ints = np.array([x[:3] + (len(x[3]),) for x in some], np.int64)
            rows.append((b, 0, ints.tobytes(), b"", zlib.compress(b"".join(x[3] for x in some), 1)))
        rows += [(int(x[0, 0]) % buckets, 1, x.tobytes(), b"", b"") for x in spans]
        return _dealt(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, size = [], 0
        for batch in batches:
            texts, ids, prints = byte_values(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("print").to_pylist()
            lists, spans = batch.column("runs").to_pylist(), []
            for a, some, offset in pieces(texts):
                text, first, length, keys, idents = runs_of(some, frequent)
                bounds = np.searchsorted(text, np.arange(len(some) + 1))
                for i, value in enumerate(some):
                    told = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in lists[a + i]]))
                    part = slice(bounds[i], bounds[i + 1])
                    own, f, n = idents[part] << np.uint64(8), first[part], length[part]
                    if not len(own):
                        continue
                    doc, print_ = ids[a + i], prints[a + i]
                    at = np.minimum(np.searchsorted(told, own), len(told) - 1)
                    is_covered = told[at] == own
                    if is_covered.any():
                        s = merged(np.stack([f, f + n + L - 1], axis=1)[is_covered]) + offset
                        spans.append(np.column_stack([np.full(len(s), doc), np.full(len(s), print_), s]))
                    is_asked = told[np.minimum(np.searchsorted(told, own | _ASKED), len(told) - 1)] == own | _ASKED
                    hit = np.flatnonzero(is_asked & ~is_covered)
                    for k, x, m in zip(keys[part][hit].tolist(), f[hit].tolist(), n[hit].tolist(), strict=True):
                        asked.append((k, doc, print_, offset + x, value[x : x + m + L - 1]))
                        size += m + L + 100
            if size > 32 << 20 or spans:
                out = flush(asked if size > 32 << 20 else [], spans)
                asked, size = ([], 0) if size > 32 << 20 else (asked, size)
                yield out
                del out
        if asked:
            yield flush(asked, [])
        give_back()

    return run


def suffix_order(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of their first n bytes, equal ones in the given order; and how many of n bytes each has in common with the one before.

    Starts of one hash form a class; bytes are compared to make sure, and only one start of a class is sorted.
    """
    view = np.lib.stride_tricks.sliding_window_view(data, n)
    _, leader, cls = np.unique(gram_hashes(data, n)[starts], return_index=True, return_inverse=True)
    w = np.zeros(len(data) - 7, np.uint64)
    for j in range(8):
        w = w << np.uint64(8) | data[j : len(data) - 7 + j]
    same = np.ones(len(starts), bool)
    for at in {*range(0, n - 7, 8), n - 8}:
        mine = w[starts + at]
        same &= mine == mine[leader][cls]
    if not same.all():  # two strings of one hash: classes by their bytes
        _, leader, cls = np.unique(view[starts].copy().view(f"S{n}").reshape(-1), return_index=True, return_inverse=True)
    grams = view[starts[leader]]
    by_bytes = np.argsort(grams.copy().view(f"S{n}").reshape(-1), kind="stable")
    rank = np.empty(len(leader), np.int64)
    rank[by_bytes] = np.arange(len(leader))
    order = np.argsort(rank[cls], kind="stable")
    sorted_ = rank[cls][order]
    grams = grams[by_bytes]
    differs = grams[1:] != grams[:-1]
    between = np.concatenate([[0], np.where(differs.any(axis=1), differs.argmax(axis=1), n)])
    lcp = np.where(np.diff(sorted_, prepend=-1) == 0, n, between[sorted_])
    return order, lcp


def smaller_neighbours(values: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each position of a suffix order, the previous one with a smaller value and the common prefix with it, then the next one and that; -1 and 0 if there is none.

    lcp: the common prefix of each position with the one before.
    """
    out = []
    for v, c in ((values, lcp), (values[::-1], np.concatenate([[0], lcp[:0:-1]]))):
        p, common = np.arange(-1, len(v) - 1), c.copy()
        bad = np.flatnonzero((p >= 0) & (v[p] >= v))
        while len(bad):  # over all in between, whose values are not smaller either
            via = p[bad]
            p[bad], common[bad] = p[via], np.minimum(common[bad], common[via])
            bad = bad[(p[bad] >= 0) & (v[p[bad]] >= v[bad])]
        out += [p, np.where(p >= 0, common, 0)]
    prev, prev_common, nxt, nxt_common = out
    nxt = nxt[::-1]
    return prev, prev_common, np.where(nxt >= 0, len(values) - 1 - nxt, -1), nxt_common[::-1]


def previous_factors(data: np.ndarray, starts: np.ndarray, docs: np.ndarray, n: int = L) -> np.ndarray:
    """For each start the length, up to n, of the longest prefix of its suffix that also starts (among the starts) in a smaller document."""
    order, lcp = suffix_order(data, starts, n)
    _, before, _, after = smaller_neighbours(docs[order], lcp)
    out = np.empty(len(starts), np.int64)
    out[order] = np.maximum(before, after)
    return out


def covered(data: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each start: is its longest previous factor at least L? Only starts whose first L bytes occur twice are put in order."""
    out = np.zeros(len(starts), bool)
    h = gram_hashes(data, L)[starts]
    order = np.argsort(h)
    twin = h[order][1:] == h[order][:-1]
    some = np.zeros(len(starts), bool)
    some[order[1:][twin]] = True
    some[order[:-1][twin]] = True
    at = np.flatnonzero(some)
    if len(at):
        out[at] = previous_factors(data, starts[at], docs[at]) >= L
    return out


def _second_answers(group: pa.Table) -> pa.Table:
    """(doc_id, print, spans): covered [start, end) of each document."""
    cols = group.to_pydict()
    spans = [np.frombuffer(o, np.int64).reshape(-1, 4) for kind, o in zip(cols["kind"], cols["owners"], strict=True) if kind == 1]
    sent = [(np.frombuffer(o, np.int64).reshape(-1, 4), zlib.decompress(m)) for kind, o, m in zip(cols["kind"], cols["owners"], cols["more"], strict=True) if kind == 0]
    if sent:
        places = np.concatenate([s[0] for s in sent])
        data = np.frombuffer(b"".join(s[1] for s in sent), np.uint8)
        begin = np.cumsum(places[:, 3]) - places[:, 3]
        n = places[:, 3] - L + 1
        which = np.repeat(np.arange(len(places)), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        hit = np.flatnonzero(covered(data, begin[which] + inside, places[which, 0]))
        if len(hit):  # consecutive starts of a string make one span
            cut = np.concatenate([[True], np.diff(hit) != 1]) | np.concatenate([[True], np.diff(which[hit]) != 0])
            first = np.flatnonzero(cut)
            last = np.append(first[1:], len(hit)) - 1
            owner = which[hit[first]]
            spans.append(np.stack([places[owner, 0], places[owner, 1], places[owner, 2] + inside[hit[first]], places[owner, 2] + inside[hit[last]] + L], axis=1))
    spans = np.concatenate(spans) if spans else np.empty((0, 4), np.int64)
    ids, prints, blobs = [], [], []
    if len(spans):
        spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
        edge = np.flatnonzero(np.concatenate([[True], (spans[1:, :2] != spans[:-1, :2]).any(axis=1), [True]]))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            ids.append(int(spans[a, 0]))
            prints.append(int(spans[a, 1]))
            blobs.append(np.ascontiguousarray(spans[a:b, 2:]).tobytes())
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "print": pa.array(prints, pa.int64()), "spans": pa.array(blobs, pa.binary())})


def merged(s: np.ndarray) -> np.ndarray:
    """The union of spans as disjoint maximal ones in order."""
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.concatenate([[True], s[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([s[first, 0], reach[np.append(first[1:], len(s)) - 1]], axis=1)


def _trimmed(answers: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The answers of a bucket, after which its memory goes back to the system: the worker stays for the next bucket."""

    def run(group: pa.Table) -> pa.Table:
        out = answers(group)
        give_back()
        return out

    return run


def covered_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, found (list of print and spans, or null) for docs(doc_id, text, print) with ids."""
    size = stored_bytes(docs)
    few, many = (int(min(max(8, size // x), MOST_BUCKETS)) for x in BUCKET_BYTES)
    frequent = frequent_grams(docs, size)
    # As many partitions as buckets: what a task reads is a few buckets, however large the input.
    runs = docs.mapInArrow(_first_round(few, frequent), _DEALT).repartition(min(few, MOST_PARTITIONS), "bucket")
    live = runs.groupBy("bucket").applyInArrow(_trimmed(_first_answers), "doc_id long, runs binary")
    live = live.groupBy("doc_id").agg(F.collect_list("runs").alias("runs"))
    sent = docs.join(live, "doc_id").mapInArrow(_second_round(many, frequent), _DEALT).repartition(min(many, MOST_PARTITIONS), "bucket")
    spans = sent.groupBy("bucket").applyInArrow(_trimmed(_second_answers), "doc_id long, print long, spans binary")
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("print", "spans")).alias("found"))
    return docs.join(spans, "doc_id", "left")


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, print_, found in zip(byte_values(batch.column("text")), batch.column("print").to_pylist(), batch.column("found").to_pylist(), strict=True):
            own = [f["spans"] for f in found or [] if f["print"] == print_]
            spans = merged(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in own])).tolist() if own else []
            at, kept = 0, hashlib.sha256()
            for a, b in spans:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            rows.append((len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    give_back()


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs(doc_id, text)."""
    if docs.schema["doc_id"].dataType.simpleString() != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))  # nothing else: both joins use one exchange of this
    known = covered_spans(docs.filter("doc_id is not null"))
    nameless = docs.filter("doc_id is null").withColumn("found", F.lit(None).cast("array<struct<print:bigint,spans:binary>>"))
    return known.unionByName(nameless).mapInArrow(_cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to smaller documents."""
    return repeated_bytes(table(spark, sf_dir, "documents"))
