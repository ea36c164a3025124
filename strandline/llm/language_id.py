"""Language ID by multilingual mixture inference.

A language is a distribution of hashed 4-byte grams (letters lower-cased, everything else one space), counted over all
labelled texts. A text is cut into segments; each gives a log-likelihood under every language. Its language proportions
are estimated by expectation-maximisation over the segments. The set of languages grows one by one: a language joins
if it raises the log-likelihood by more than the penalty for one more proportion (half the logarithm of the number of
segments, plus a margin), until none does. Languages that cannot do so are not tried: no mixture explains a segment
better than the best of its languages, which bounds what a language may add. The prediction is the language with the
largest proportion; its score is that proportion, for a single language times its posterior probability.

The model has 32,768 numbers a language while it stays below MODEL numbers in all; with more languages, grams are hashed
to fewer values, so it can always be collected and broadcast. A text takes memory for its segments times languages.

A corpus keeps the texts that their set of languages explains better than a model without knowledge, for which all
grams are equally likely. Texts in several languages are judged by the whole set, not by its largest part.

Defined results: a null text, one without a letter, and any text if nothing was learned, is `und` with score 0. Ties go
to the language that is first by code point. A null doc_id counts as not held out. Rows that repeat are predicted one
by one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import byte_values, chunks, forget, give_back, stage, table

BITS, GRAM, SEGMENT = 15, 4, 64
MODEL = 1 << 24
MARGIN, ROUNDS = 3.0, 12
UNDECIDED = "und"
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True


def grams(text: bytes) -> np.ndarray:
    """Hashes of the grams of a text with one space before and after."""
    data = np.empty(len(text) + 2 + GRAM, np.uint8)
    data[:] = 32
    data[1 : len(text) + 1] = _PLAIN[np.frombuffer(text, np.uint8)]
    upper = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)  # capital letters of Latin-1 in UTF-8
    data[1:][upper] += 32
    n = max(1, len(text) + 2 - GRAM + 1)
    x = data[:n].astype(np.uint32)
    for i in range(1, GRAM):
        x |= data[i : n + i].astype(np.uint32) << np.uint32(8 * i)
    return (x * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def has_letter(text: bytes) -> bool:
    data = np.frombuffer(text, np.uint8)
    if _LETTER[data].any():
        return True
    return bool((data >= 0x80).any()) and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


class Model:
    """Log-probabilities of grams by language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts))).astype(np.float32)
        self.fewer = np.uint32(BITS - (len(counts).bit_length() - 1))
        self.noise = -np.log(len(counts)) / GRAM

    @classmethod
    def learn(cls, docs: DataFrame) -> Model:
        """From all rows of docs(text, lang) that have both."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[str, np.ndarray] = {}
            for batch in batches:
                for text, lang in zip(byte_values(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
                    for at in range(0, max(1, len(text)), 1 << 20):
                        own = found.get(lang)
                        if own is None:
                            own = found[lang] = np.zeros(1 << BITS, np.int64)
                        g = grams(text[at : at + (1 << 20)])
                        if len(g) > 1 << (BITS - 4):
                            own += np.bincount(g, minlength=1 << BITS)
                        else:
                            np.add.at(own, g, 1)
            for lang, own in found.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "gram", "n"])

        known = docs.filter("text is not null and lang is not null").select("text", "lang")
        rows = stage(known.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
        names = sorted(r.lang for r in rows.select("lang").distinct().collect())
        fewer = min(BITS - 1, (max(0, (len(names) << BITS) - 1) // MODEL).bit_length())
        got = rows.groupBy("lang", F.shiftright("gram", fewer).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
        forget(rows)
        counts = np.zeros((1 << (BITS - fewer), len(names)))
        at = {n: i for i, n in enumerate(names)}
        counts[got.column("gram").to_numpy(), [at[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
        return cls(names, counts)

    def segments(self, text: bytes) -> np.ndarray:
        """Log-likelihoods (segment, language); grams overlap, so each counts for one byte."""
        out = []
        for at in range(0, max(1, len(text)), 1 << 20):
            logs = self.logs[grams(text[at : at + (1 << 20)]) >> self.fewer]
            out.append(np.add.reduceat(logs, np.arange(0, len(logs), SEGMENT), axis=0))
        return np.concatenate(out).astype(np.float64) / GRAM


def mixture(logs: np.ndarray, bounds: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text under the languages of its mask, by expectation-maximisation.

    logs: (segment, language); bounds: the first segment of each text; masks: (text, language).
    """
    sizes = np.diff(np.append(bounds, len(logs)))
    top = logs.max(axis=1, keepdims=True)
    p = np.exp(logs - top)
    pi = masks / masks.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        joint = p * np.repeat(pi, sizes, axis=0)
        total = joint.sum(axis=1, keepdims=True)
        joint /= np.maximum(total, 1e-300)
        pi = np.add.reduceat(joint, bounds, axis=0) / sizes[:, None]
    total = (p * np.repeat(pi, sizes, axis=0)).sum(axis=1)
    return pi, np.add.reduceat(np.log(np.maximum(total, 1e-300)) + top[:, 0], bounds)


def infer(logs: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions (text, language) of the chosen sets, the score of each text, and its log-likelihood under its set."""
    sizes = np.diff(np.append(bounds, len(logs)))
    n, langs = len(bounds), logs.shape[1]
    single = np.add.reduceat(logs, bounds, axis=0)
    best = single.argmax(axis=1)
    masks = np.eye(langs)[best]
    pi, value = masks.copy(), single[np.arange(n), best]
    penalty = 0.5 * np.log(sizes + 1.0) + MARGIN
    active = np.flatnonzero(sizes > 1)
    while len(active):
        rows = _rows_of(bounds, sizes, active)
        part, at = logs[rows], np.cumsum(sizes[active]) - sizes[active]
        chosen = np.where(np.repeat(masks[active] > 0, sizes[active], axis=0), part, -np.inf).max(axis=1, keepdims=True)
        hope = np.add.reduceat(np.maximum(part, chosen), at, axis=0) - value[active, None]
        hope = (hope > penalty[active, None]) & (masks[active] == 0)
        gain, found = np.full(len(active), -np.inf), np.zeros((len(active), langs))
        for lang in np.flatnonzero(hope.any(axis=0)):
            some = np.flatnonzero(hope[:, lang])
            wider = masks[active[some]].copy()
            wider[:, lang] = 1
            own = sizes[active[some]]
            share, ll = mixture(part[_rows_of(at, sizes[active], some)], np.cumsum(own) - own, wider)
            more = ll - value[active[some]]
            better = more > gain[some]
            gain[some[better]], found[some[better]] = more[better], share[better]
        take = gain > penalty[active]
        active = active[take]
        pi[active], value[active] = found[take], value[active] + gain[take]
        masks[active] = np.maximum(masks[active], found[take] > 0)
    lead = pi.argmax(axis=1)
    score = pi[np.arange(n), lead]
    posterior = 1 / np.exp(np.minimum(single - single[np.arange(n), lead][:, None], 50)).sum(axis=1)
    return pi, np.where(masks.sum(axis=1) == 1, score * posterior, score), value


def _rows_of(bounds: np.ndarray, sizes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The segments of some texts."""
    n = sizes[texts]
    ends = np.cumsum(n)
    return np.repeat(bounds[texts] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, languages (the set with its proportions) for each row of docs(doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts, ids = byte_values(batch.column(1)), batch.column(0)
            for a, b in chunks(texts):
                lang, score, sets, _ = predict(m, texts[a:b])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(lang), pa.array(score), pa.array(sets)], names=["doc_id", "lang_pred", "score", "languages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, languages string")


def predict(model: Model, texts: list[bytes]) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """Language, score, set with its proportions, and whether the set explains the text better than noise."""
    lang, sets, score, fits = [UNDECIDED] * len(texts), [""] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    known = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
    if known:
        logs = [model.segments(texts[i]) for i in known]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in logs])[:-1]])
        pi, got, value = infer(np.concatenate(logs), bounds)
        fits[known] = value > [max(1, len(texts[i]) + 3 - GRAM) * model.noise for i in known]
        for i, p, s in zip(known, pi, got, strict=True):
            lang[i], score[i] = model.languages[int(p.argmax())], min(1.0, float(s))
            sets[i] = ",".join(f"{model.languages[k]}:{p[k]:.3f}" for k in np.flatnonzero(p > 1e-6))
    return lang, score, sets, fits


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with a language that explains them better than noise; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = byte_values(batch.column(place)), []
            for a, b in chunks(texts):
                keep += predict(sent.value, texts[a:b])[3].tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = Model.learn(docs.filter(~held_out()).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
