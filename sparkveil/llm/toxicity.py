"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic model
of its hashed byte n-grams; the document's is the noisy-or of its sentences',
so a label on the document trains the sentences, and a high document score can
be traced to the sentences that cause it. Fitting takes a bounded sample of
labelled documents; scoring is one pass in Arrow batches without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import agreed
from .features import BLANK, LOWER, PIECE, calibrate, gram_codes, logistic

#: Most toxic and (twice as many) clean documents that the model is fitted on, and the most characters that their texts add up to: what the driver gathers.
SAMPLE = 1500
SAMPLE_CHARS = 16_000_000
GRAMS = (4, 6)
BITS = 18
EPOCHS = 12
#: Most that a toxic document counts against a clean one, where there are fewer.
MOST_WEIGHT = 3.0
START_BIAS = -6.0
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # GRAMS x 2^BITS
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    @cached_property
    def evidence(self) -> np.ndarray:
        """Which n-grams count; few do."""
        return self.weights != 0


def sentences(text: bytes, evidence: np.ndarray | None = None, size: int = PIECE) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Starts of the sentences of ``text``, some at a time in order, and per n-gram length the (sentence, code) pairs that occur in them, each once.

    A sentence ends with the run of end marks and line feeds that closes it. An
    n-gram belongs to the sentence that its second byte is in; bytes are
    lower-cased, blanks alike, with blanks before and after the text. ``size``
    bytes are worked on at a time; a sentence that reaches over more than one
    such piece is put together, so it doesn't matter where pieces end. With
    ``evidence``, only codes that it has.
    """
    data, reach = np.frombuffer(text, np.uint8), max(GRAMS) - 1
    n, start, held = len(data), 0, [np.zeros(0, np.int64) for _ in GRAMS]  # the open sentence
    for at in range(0, n, size):
        stop = min(n, at + size)
        near = data[max(0, at - 1) : stop + reach]
        padded = np.full(1 + stop - at + reach, 32, np.uint8)
        padded[(at == 0) : (at == 0) + len(near)] = np.where(BLANK[near], np.uint8(32), LOWER[near])
        end = _END[data[at:stop]]
        new = np.flatnonzero(np.r_[at > 0 and _END[data[at - 1]], end[:-1]] & ~end)
        new = new[new > 0] if at == 0 else new
        last, pairs = len(new), []
        for g, size_ in enumerate(GRAMS):
            codes = gram_codes(padded, size_, BITS)[: stop - at].astype(np.int64)
            here = np.arange(stop - at) if evidence is None else np.flatnonzero(evidence[g][codes])
            own = (np.searchsorted(new, here, "right") << BITS) + codes[here]
            own = np.unique(np.concatenate([held[g], own]))
            cut = np.searchsorted(own, last << BITS)
            held[g] = own[cut:] - (last << BITS)
            pairs.append((own[:cut] >> BITS, own[:cut] & ((1 << BITS) - 1)))
        if last:
            yield np.r_[start, at + new[:-1]], pairs
            start = at + int(new[-1])
    if n:
        yield np.array([start]), [(np.zeros(len(h), np.int64), h) for h in held]


def sentence_logits(text: bytes, model: Model, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and log odds of the sentences of ``text``, some at a time."""
    for starts, pairs in sentences(text, model.evidence, size):
        z = np.full(len(starts), model.bias)
        for w, (sentence, code) in zip(model.weights, pairs):
            z += np.bincount(sentence, w[code], len(starts))
        yield starts, z


def _some(total: float) -> float:
    """The log odds of 1 - prod(1 - p), where ``total`` sums -log(1 - p)."""
    return float(total + np.log(max(-np.expm1(-total), 1e-30)))


def document_logit(text: bytes | None, model: Model, size: int = PIECE) -> float:
    """The log odds of 1 - prod(1 - p) over the sentences' probabilities p."""
    return _some(sum(np.logaddexp(0, z).sum() for _, z in sentence_logits(text or b"", model, size)))


def document_score(text: bytes | None, model: Model) -> float:
    """The calibrated probability that a sentence is toxic; null or empty text: 0."""
    return float(logistic(model.slope * document_logit(text, model) + model.shift)) if text else 0.0


def train_calibrated(texts: list[bytes], y: np.ndarray, odds: float | None = None, **options) -> Model:
    """A model trained on three quarters of the documents and calibrated on the rest; ``odds`` are those of label 1 in the whole table, where the documents are a stratified sample."""
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return train(texts, y, **options)
    m = train([t for t, h in zip(texts, held) if not h], y[~held], **options)
    slope, shift = calibrate(np.array([document_logit(t, m) for t, h in zip(texts, held) if h]), y[held])
    if odds:
        shift += np.log(odds / ((y == 1).sum() / (y == 0).sum()))
    return Model(m.weights, m.bias, slope, float(shift))


def _bag(text: bytes) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of sentences of a text and all its (sentence, code) pairs."""
    n, parts = 0, [[] for _ in GRAMS]
    for starts, pairs in sentences(text):
        for part, (sentence, code) in zip(parts, pairs):
            part.append(((sentence + n).astype(np.int32), code.astype(np.int32)))
        n += len(starts)
    return n, [tuple(map(np.concatenate, zip(*part))) for part in parts]


def train(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.3, ridge: float = 2e-6, batch: int = 48, sparse: float = 2e-5) -> Model:
    """Weights by Adagrad on the likelihood of the documents' labels under the noisy-or.

    Weights are kept at zero or more, with a lasso penalty: an n-gram is evidence
    or it is nothing, so a long sentence can't outweigh the word that matters.
    """
    rng = np.random.default_rng(0)
    dim = 1 << BITS
    w, b = np.zeros((len(GRAMS), dim)), START_BIAS
    gw, gb = np.full((len(GRAMS), dim), 1e-3), 1e-1
    weight = np.where(y > 0, min(MOST_WEIGHT, (y == 0).sum() / max(1, (y > 0).sum())), 1.0)
    bags = [_bag(t) if t else None for t in texts]
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            own = [k for k in order[i : i + batch] if bags[k] is not None]
            if not own:
                continue
            base = np.cumsum([0, *(bags[k][0] for k in own)])
            pairs = [tuple(np.concatenate([bags[k][1][g][x] + (o if x == 0 else 0) for k, o in zip(own, base)]) for x in (0, 1)) for g in range(len(GRAMS))]
            z = np.full(base[-1], b)
            for g, (sentence, code) in enumerate(pairs):
                z += np.bincount(sentence, w[g][code], base[-1])
            doc = np.repeat(np.arange(len(own)), [bags[k][0] for k in own])
            none = np.exp(-np.bincount(doc, np.logaddexp(0, z), len(own)))  # probability that no sentence is toxic
            some = np.maximum(1 - none, 1e-9)
            pull = np.where(y[own] > 0, -none / some, 1.0)  # of the loss with respect to the sum of log(1 + e^z)
            d = logistic(z) * (pull * weight[own])[doc] / len(own)
            for g, (sentence, code) in enumerate(pairs):
                grad = np.bincount(code, d[sentence], dim) + ridge * w[g]
                gw[g] += grad * grad
                w[g] = np.maximum(0, w[g] - rate * (grad + sparse) / np.sqrt(gw[g]))
            gb += d.sum() ** 2
            b -= rate * d.sum() / np.sqrt(gb)
    return Model(w.astype(np.float32), float(b))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn=None, sample: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> Model:
    """A model from ``sample`` toxic and twice as many clean documents at most, those whose ids hash lowest, as long as their texts add up to a third and two thirds of ``most_chars``; ``learn`` (a condition on ``_id``) says which labels may be seen.

    An id that is labelled both ways is left out; documents that share an id are
    taken in the order of their texts' hashes, equal ones once. Without labels
    of both kinds, every score is near 0. Only ids, lengths and hashes go
    through the choice; then the chosen texts alone are gathered.
    """
    rows = agreed(labels, id_col, label_col)
    if learn is not None:
        rows = rows.where(learn)
    # twice as many by id, as some have no text
    pool = [rows.where(F.col("_y") == k).orderBy(F.xxhash64("_id"), "_id").limit((4 - 2 * k) * sample) for k in (0, 1)]
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_c")).where("_text <> ''")
    found = texts.join(F.broadcast(pool[0].union(pool[1])), "_id").groupBy("_y", "_id", "_c").agg(F.max(F.length("_text")).alias("n"))
    chosen = []
    for k in (0, 1):
        left = most_chars * (2 - k) // 3
        for r in found.where(F.col("_y") == k).orderBy(F.xxhash64("_id"), "_id", "_c").limit((2 - k) * sample).collect():
            if r.n <= left:
                left -= r.n
                chosen.append((r._id, r._c, k))
    if len({k for *_, k in chosen}) < 2:
        return Model(np.zeros((len(GRAMS), 1 << BITS), np.float32), -20.0)
    wanted = docs.sparkSession.createDataFrame(chosen, "_id bigint, _c bigint, _y int")
    got = texts.join(F.broadcast(wanted), ["_id", "_c"]).select("_id", "_c", "_text").toArrow()
    by_key = dict(zip(zip(got["_id"].to_pylist(), got["_c"].to_pylist()), got["_text"].cast(pa.binary()).to_pylist()))
    shuffled = [chosen[k] for k in np.random.default_rng(0).permutation(len(chosen))]
    count = dict(rows.groupBy("_y").count().collect())
    return train_calibrated([by_key[i, c] for i, c, _ in shuffled], np.array([float(y) for *_, y in shuffled]), count[1] / count[0])


def held_out(id_col) -> F.Column:
    """Whether a document's label is kept from learning: crc32 of the id as text is a multiple of 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def offending_sentences(text: bytes | None, model: Model, threshold: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
    """The text's score, and (start, end, score) in bytes of each sentence whose own calibrated probability is ``threshold`` at least, in order; of a text that scores so as a whole, the likeliest sentence in any case."""
    if not text:
        return 0.0, []
    starts, z = (np.concatenate(x) for x in zip(*sentence_logits(text, model)))
    total, p = _some(np.logaddexp(0, z).sum()), logistic(model.slope * z + model.shift)
    whole = float(logistic(model.slope * total + model.shift))
    ends, hit = np.r_[starts[1:], len(text)], p >= threshold
    hit[p.argmax()] |= whole >= threshold
    return whole, [(int(starts[k]), int(ends[k]), float(p[k])) for k in np.flatnonzero(hit)]


_SENTENCES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, sentences) for every row of ``docs``; sentences locates what offends, in bytes of the text's UTF-8.

    Null or empty text has score 0 and no sentence. Repeated rows stay repeated;
    a null id is never held out; an empty table gives no rows; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [offending_sentences(t, shared.value, threshold) for t in b.column(2).cast(pa.binary()).to_pylist()]
            p = [x for x, _ in found]
            spots = [[dict(zip(("start", "end", "score"), x)) for x in own] for _, own in found]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array(spots, _SENTENCES)], ["doc_id", "held_out", "score", "predicted", "sentences"])

    id_ = F.col(id_col).cast("bigint")
    rows = docs.select(id_.alias("doc_id"), F.coalesce(held_out(id_), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, sentences array<struct<start:bigint,end:bigint,score:double>>")


def offending(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, sentence, score) for each sentence that ``score`` locates; start and end count bytes of the text's UTF-8."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                rows.extend((doc, s, e, t[s:e].decode("utf-8", "replace"), p) for s, e, p in offending_sentences(t, shared.value, threshold)[1])
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()))], ["doc_id", "start", "end", "sentence", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, start bigint, end bigint, sentence string, score double")
