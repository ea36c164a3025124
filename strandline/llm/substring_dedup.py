"""Substring dedup by hashing units of words and whole lines.

A unit is UNIT words (A-Z lower-cased, white space and line breaks as one space). Of the units at all places of a text
those stay that have the least hash of WINDOW neighbouring ones (winnowing), and the text's first: about one place in
five, never more than WINDOW apart, so units that stay follow each other without a gap. Two texts that share
UNIT + WINDOW - 1 words anywhere share a unit, and of a longer passage all but WINDOW - 1 words at either end at most,
which lie in no unit that both have: a passage of MIN_WORDS + 2 * (WINDOW - 1) = 38 words is always found.
Lines are hashed as a whole as well, so a passage of whole lines has exact edges.

Per digest the first occurrence in the order of (doc_id, start) stays. Words of occurrences that are not the first form
runs; runs of at least MIN_WORDS words with a unit in them go, and whole lines of at least MIN_LINE words, with white
space up to the next word. Shorter repeated lines outside such runs, which prose has by chance, stay.

With by="lines" or by="paragraphs" (parted by a line without words), units are those alone, and every later one goes,
however short it is.

Units are made once and shuffled once, by digest (96 bits); a window over each digest tells the first from the later
ones. Digests that are frequent in a sample of bounded size are dealt out over as many groups as they would fill with
SALTED rows; the firsts of those groups are then compared with each other. That concerns the dealing alone: the result
is the same whatever the sample has.

Defined results: a null text stays null and loses nothing. A null doc_id ranks after all others. Rows that repeat a
doc_id and text are one document: they are judged alike. Extra columns are ignored, or kept where the documents are
returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import SPACED, batch_words_of, byte_values, chunks, give_back, mix, powers, stage, stored_bytes, table

MIN_WORDS, MIN_LINE = 20, 3
#: Words of a unit, and how many neighbouring units one is chosen from. A window must not reach the next text: WINDOW <= UNIT.
UNIT, WINDOW = 10, 10
#: Stored bytes of the sample for frequent digests, from how often on one counts, how many are told apart, rows of a group.
SAMPLE_BYTES, FREQUENT, MOST_FREQUENT, SALTED = 64 << 20, 128, 4096, 8192
#: The start of a line, as a whole, is given with this offset: its first unit starts there too.
LINE = 1 << 40


class Units:
    """Units, then whole lines, of several texts: text's number, start (of a line: LINE more), hash (and 32 bits more), first and last word.

    by: words for units and lines, or lines or paragraphs alone.
    """

    def __init__(self, texts: list[bytes], by: str = "words"):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = SPACED[data]
        edge = np.diff(inside)
        starts = np.flatnonzero(edge == 1)
        hashes, _ = batch_words_of(joined, bounds, SPACED)
        #: Places of all words; text i has those from begin[i] to begin[i + 1].
        self.words, self.bounds = starts, bounds
        self.begin = begin = np.searchsorted(starts, bounds)
        up, self._down = powers(len(hashes) + 1)
        zero = [np.uint64(0)]
        self._prefix, more = (np.concatenate([zero, np.cumsum(x * up[:-1])]) for x in (hashes, mix(hashes)))
        line = np.searchsorted(np.flatnonzero(data == 10), starts)
        first = self._chosen(begin) if by == "words" else np.empty(0, np.int64)
        stop = first + UNIT
        begins = np.diff(line, prepend=-2) > (1 if by == "paragraphs" else 0)
        begins[begin[:-1][np.diff(begin) > 0]] = True
        top = np.flatnonzero(begins)
        tail = np.append(top[1:], len(starts))[: len(top)]
        self.whole = np.repeat([False, True], [len(first), len(top)])
        self.hash = np.concatenate([self._digest(first, stop), mix(self._digest(top, tail) + np.uint64(LINE))])
        self.first, self.stop = np.concatenate([first, top]), np.concatenate([stop, tail])
        self.more = (mix((more[self.stop] - more[self.first]) * self._down[self.first]) >> np.uint64(32)).astype(np.uint32)
        self.text = np.searchsorted(bounds, starts[self.first], "right") - 1
        self.start = starts[self.first] - bounds[self.text] + np.where(self.whole, LINE, 0)

    def _digest(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self._prefix[stop] - self._prefix[first]) * self._down[first] + (stop - first).astype(np.uint64))

    def covered(self, which: np.ndarray) -> np.ndarray:
        """For each word, whether one of these units or lines has it."""
        n = len(self.words) + 1
        return np.cumsum(np.bincount(self.first[which], minlength=n) - np.bincount(self.stop[which], minlength=n))[:-1] > 0

    def _chosen(self, begin: np.ndarray) -> np.ndarray:
        """The first words of the units that have the least hash in some window, and of each text's first unit."""
        n, sizes = len(self.words), np.diff(begin)
        some = sizes >= UNIT
        if not some.any():
            return np.empty(0, np.int64)
        valid = np.arange(n) + UNIT <= np.repeat(begin[1:], sizes)
        place = np.flatnonzero(valid)
        value = np.full(n, np.iinfo(np.uint64).max)
        value[place] = self._digest(place, place + UNIT)
        least = np.where(valid, _sliding(value, np.minimum), np.uint64(0))
        chosen = valid & (_sliding(least[::-1], np.maximum)[::-1] == value)
        chosen[begin[:-1][some]] = True
        return np.flatnonzero(chosen)


def _sliding(values: np.ndarray, best) -> np.ndarray:  # noqa: ANN001
    """The best of each value and the WINDOW - 1 after it (fewer at the end)."""
    out, done = values.copy(), 1
    while done < WINDOW:
        step = min(done, WINDOW - done)
        out[: len(out) - step] = best(out[: len(out) - step], out[step:])
        done += step
    return out


def _units(by: str, frequent: tuple[np.ndarray, np.ndarray]):
    """Rows of units. frequent: digests in rising order, and over how many groups each is dealt."""
    digests, groups = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, prints = byte_values(batch.column("text")), batch.column("doc_id"), batch.column("print")
            for a, b in chunks(texts):
                u = Units(texts[a:b], by)
                rows = pa.array(a + u.text)
                key, place = u.hash.copy(), np.full(len(u.hash), -1)
                if len(digests):
                    at = np.minimum(np.searchsorted(digests, key), len(digests) - 1)
                    hit = np.flatnonzero(digests[at] == key)
                    place[hit] = at[hit]
                    salt = mix(mix(u.start[hit].astype(np.uint64)) + prints.take(pa.array(a + u.text[hit])).to_numpy().view(np.uint64)) % groups[at[hit]]
                    key[hit] = mix(key[hit] + mix(salt + np.uint64(1)))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), prints.take(rows), pa.array(u.start.astype(np.int64)), pa.array(key.view(np.int64)), pa.array(u.more.view(np.int32)), pa.array(place, pa.int32(), mask=place < 0)],
                    names=["doc_id", "print", "start", "digest", "more", "frequent"],
                )
        give_back()

    return run


def frequent_digests(docs: DataFrame, by: str) -> tuple[np.ndarray, np.ndarray]:
    """Digests that would make large groups, by a sample of some SAMPLE_BYTES, in rising order; and over how many groups to deal each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_values(batch.column("text"))
            for a, b in chunks(texts):
                digest, n = np.unique(Units(texts[a:b], by).hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(digest[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["digest", "n"])
        give_back()

    share = max(1, stored_bytes(docs) // SAMPLE_BYTES)
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "print"), F.lit(share)) == 0).select("text")
    counts = some.mapInArrow(count, "digest long, n long").groupBy("digest").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    got = counts.orderBy(F.col("n").desc(), "digest").limit(MOST_FREQUENT).toArrow()
    digest, n = got.column("digest").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(digest)
    return digest[order], (n[order] * share // SALTED + 1).astype(np.uint64)


def _print() -> Column:
    """Tells rows of one doc_id apart by 32 bits, rows without by 64: that is less to shuffle with each unit."""
    whole = F.xxhash64("text")
    return F.when(F.col("doc_id").isNull(), whole).otherwise(whole.bitwiseAND(F.lit(0xFFFFFFFF)))


def repeated_units(docs: DataFrame, by: str = "words") -> DataFrame:
    """doc_id, print and later: the starts of units that are not their digest's first occurrence."""
    frequent = frequent_digests(docs, by)
    units = docs.mapInArrow(_units(by, frequent), "doc_id long, print long, start long, digest long, more int, frequent int")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("print"), F.col("start"))
    units = units.withColumn("first", F.min(rank).over(Window.partitionBy("digest", "more")))
    own = units.filter((rank > F.col("first")) | F.col("frequent").isNotNull())
    later = F.collect_set(F.when(rank > F.col("first"), F.col("start"))).alias("later")
    if not len(frequent[0]):
        return own.groupBy("doc_id", "print").agg(later)
    group_first = F.when(rank <= F.col("first"), F.struct("start", "frequent", "more"))
    found = stage(own.groupBy("doc_id", "print").agg(later, F.collect_set(group_first).alias("firsts")), "repeats")
    # One row a group of a frequent digest: its first. Of these, all but the first of the digest are later too.
    firsts = found.filter(F.size("firsts") > 0).select("doc_id", "print", F.inline("firsts"))
    least = firsts.groupBy("frequent", "more").agg(F.min(rank).alias("first"))
    more = firsts.join(least, ["frequent", "more"]).filter(rank > F.col("first")).groupBy("doc_id", "print").agg(F.collect_set("start").alias("later"))
    both = found.filter(F.size("later") > 0).select("doc_id", "print", "later").unionByName(more)
    return both.groupBy("doc_id", "print").agg(F.flatten(F.collect_list("later")).alias("later"))


def spans_of(text: bytes, later: list[int], units: Units | None = None, by: str = "words") -> tuple[list[tuple[int, int]], int, int]:
    """What goes of a text, as (start, end) in bytes; how many units it has and how many go."""
    return spans_of_all([text], [later], units, by)[0]


def spans_of_all(texts: list[bytes], later: list[list[int]], units: Units | None = None, by: str = "words") -> list[tuple[list[tuple[int, int]], int, int]]:
    """The same for several texts at once."""
    u = units or Units(texts, by)
    told = np.repeat(np.arange(len(texts)), [len(x) for x in later]) << 42 | np.concatenate([np.empty(0, np.int64), *(np.array(x, np.int64) for x in later)])
    hit = np.isin(u.text << 42 | u.start, told)
    of_unit, of_line = u.covered(hit & ~u.whole), u.covered(hit & u.whole)
    go = u.covered(hit & u.whole & (u.stop - u.first >= (MIN_LINE if by == "words" else 1)))
    a, b = _runs(of_unit | of_line, u.begin)
    some = np.concatenate([[0], np.cumsum(of_unit)])
    long = (b - a >= MIN_WORDS) & (some[b] > some[a])
    n = len(go) + 1
    go |= np.cumsum(np.bincount(a[long], minlength=n) - np.bincount(b[long], minlength=n))[:-1] > 0
    a, b = _runs(go, u.begin)
    text = np.searchsorted(u.begin, a, "right") - 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.where(b < u.begin[text + 1], np.append(u.words, 0)[b] - u.bounds[text], sizes[text])
    spans = list(zip((u.words[a] - u.bounds[text]).tolist(), end.tolist(), strict=True))
    cut = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    left = np.concatenate([[0], np.cumsum(~go)])
    gone = left[u.first] == left[u.stop]
    counts = (np.bincount(x, minlength=len(texts)).tolist() for x in (u.text, u.text[gone]))
    return [(spans[i:j], n, g) for i, j, n, g in zip(cut[:-1], cut[1:], *counts, strict=True)]


def _runs(flags: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of runs of flagged words, and the words after them; a run ends with its text."""
    inner = np.zeros(len(flags) + 1, bool)
    inner[begin] = True
    f = np.concatenate([[False], flags, [False]])
    return np.flatnonzero(f[1:] & (~f[:-1] | inner)), np.flatnonzero(f[:-1] & (~f[1:] | inner))


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _judged(docs: DataFrame, by: str) -> DataFrame:
    """docs(…, print) with the column later (null: nothing is repeated)."""
    found = repeated_units(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "print"), by).select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), F.col("later").alias("_later"))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")), "left").drop("_id", "_print")


def substring_spans(docs: DataFrame, by: str = "words") -> DataFrame:
    """doc_id, n_units, n_removed, spans (start and end in bytes of the text), kept_sha256 for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts, later = byte_values(batch.column("text")), batch.column("_later").to_pylist()
            for i, j in chunks(texts):
                for text, (spans, n, gone) in zip(texts[i:j], spans_of_all(texts[i:j], [x or [] for x in later[i:j]], by=by), strict=True):
                    out.append((n, gone, [{"start": a, "end": b} for a, b in spans], hashlib.sha256(without(text, spans)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_units", "n_removed", "spans", "kept_sha256"])
        give_back()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _print().alias("print"))
    return _judged(docs, by).mapInArrow(run, "doc_id long, n_units long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string")


def remove_repeats(docs: DataFrame, by: str = "words") -> DataFrame:
    """docs with the repeats taken out of text; a document of which nothing is left goes. Other columns stay."""
    columns = docs.columns

    @F.pandas_udf("string")
    def cleaned(text, later):  # noqa: ANN001, ANN202
        import pandas as pd

        out = text.tolist()
        some = [i for i, (t, x) in enumerate(zip(out, later, strict=True)) if t is not None and x is not None]
        texts = [out[i].encode() for i in some]
        for i, j in chunks(texts):
            for k, (spans, *_) in zip(some[i:j], spans_of_all(texts[i:j], [later.iloc[x] for x in some[i:j]], by=by), strict=True):
                out[k] = without(out[k].encode(), spans).decode()
        give_back()
        return pd.Series(out)

    judged = _judged(docs.withColumn("print", _print()), by)
    done = judged.withColumn("_clean", F.when(F.col("_later").isNull(), F.col("text")).otherwise(cleaned("text", "_later")))
    gone = (F.length(F.trim("_clean")) == 0) & (F.length(F.trim("text")) > 0)
    return done.filter(~F.coalesce(gone, F.lit(False))).select(*(F.col("_clean").alias("text") if c == "text" else F.col(c) for c in columns))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses because an earlier document, or an earlier place in it, has it."""
    return substring_spans(table(spark, sf_dir, "documents"))
