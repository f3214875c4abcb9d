"""Quality rules: counts with fixed limits, and a calibrated classifier.

The classifier is a logistic regression on hashed words and character n-grams,
trained on a bounded sample of labelled rows (``SAMPLE`` by hash of the id;
features are made on the executors and have a fixed width, so what the driver
gathers is bounded whatever the length of the texts), calibrated on a quarter
of it, and applied in Arrow batches in one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import agreed
from .features import BLANK, PIECE, calibrate, fit_logistic, gram_codes, logistic, word_hashes

#: Most labelled rows that the classifier is fitted on.
SAMPLE = 4000
BITS = 13
DIM = 2 << BITS
GRAM = 3
LEAST_WORDS, MOST_REPEATED = 10, 20
#: A document is kept if the calibrated probability of good quality is this at least.
THRESHOLD = 0.5
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_WINDOW = 5
_ODD = np.random.default_rng(2).integers(1, 1 << 62, _WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def measure(text: bytes | None, size: int = PIECE) -> tuple[tuple[int, int, int, int, int], np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the counts of hashed features of a whole text, whatever ``size`` bytes are worked on at a time."""
    counts = np.zeros(DIM)
    if not text:
        return (0, 0, 0, 0, 0), counts
    chars = symbols = 0
    whole = np.frombuffer(text, np.uint8)
    for at in range(0, len(whole), size):
        data = whole[at : at + size]
        chars += int(((data & 0xC0) != 0x80).sum() - BLANK[data].sum())
        symbols += int(SYMBOL[data].sum())
        counts[1 << BITS :] += np.bincount(gram_codes(whole[at : at + size + GRAM - 1], GRAM, BITS), minlength=1 << BITS)
    hashes = []
    for h in word_hashes(text, size):
        hashes.append(h)
        counts[: 1 << BITS] += np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    n, repeated = len(h), 0
    if n > _WINDOW:
        size = n - _WINDOW + 1
        windows = h[:size] * _ODD[0]
        for k in range(1, _WINDOW):
            windows += h[k : k + size] * _ODD[k]
        ordered = np.sort(windows)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            at = np.flatnonzero(np.isin(windows, twice))
            depth = np.zeros(n + 1, np.int64)
            np.add.at(depth, at, 1)
            np.add.at(depth, at + _WINDOW, -1)
            repeated = int((np.cumsum(depth)[:n] > 0).sum())
    lines = text.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        dup = sum(c - 1 for line, c in Counter(lines).items() if c > 1 and line.strip())
    return (n, chars, symbols, dup, repeated), counts


def _unit(counts: np.ndarray) -> np.ndarray:
    v = np.log1p(counts)
    return v / max(np.sqrt(v @ v), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from the ``sample`` labelled documents (label 0 or 1) whose ids hash lowest; without labels of both kinds, one that keeps every text. An id that is labelled both ways is left out; documents that share an id are learned from in the order of their texts' hashes, equal ones once."""
    chosen = agreed(labels, id_col, label_col).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_y", "_text", F.xxhash64("_text").alias("_c"))

    def run(batches):
        for b in batches:
            found = [measure(t)[1] for t in b.column(2).cast(pa.binary()).to_pylist()]
            at = [np.flatnonzero(c) for c in found]
            unit = [_unit(c)[k].astype(np.float32) for c, k in zip(found, at)]
            yield pa.record_batch([b.column(0), b.column(3), b.column(1), pa.array([k.astype(np.int32) for k in at], pa.list_(pa.int32())), pa.array(unit, pa.list_(pa.float32()))], ["id", "c", "y", "at", "v"])

    got = texts.mapInArrow(run, "id bigint, c bigint, y int, at array<int>, v array<float>").toArrow().sort_by([("id", "ascending"), ("c", "ascending")])
    key = np.stack([got[k].to_numpy() for k in ("id", "c")])
    got = got.filter(pa.array(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)][: got.num_rows]))
    y = got["y"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return Model(np.zeros(DIM), 10.0, 1.0, 0.0)
    sizes = np.array([len(x) for x in got["at"]])
    rows_, cols = np.repeat(np.arange(len(y)), sizes), np.concatenate([x.values.to_numpy() for x in got["at"]]).astype(np.int64)
    vals = np.concatenate([x.values.to_numpy() for x in got["v"]]).astype(float)
    held = np.arange(len(y)) % 4 == 3
    part = ~held[rows_]
    place = np.cumsum(~held) - 1
    w, b = fit_logistic(place[rows_[part]], cols[part], vals[part], y[~held], DIM)
    z = np.bincount(rows_, w[cols] * vals, len(y)) + b
    both = len(set(y[held])) == 2
    slope, shift = calibrate(z[held], y[held]) if both else (1.0, 0.0)
    return Model(w, b, slope, shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, the five counts, base_failed, kept, and score, the calibrated probability of good quality.

    Null or empty text: all counts 0, base_failed. Repeated rows stay repeated;
    an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            stats, z = [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                s, counts = measure(t)
                stats.append(s)
                z.append(m.weights @ _unit(counts) + m.bias)
            p = logistic(m.slope * np.array(z) + m.shift)
            s = np.array(stats, np.int64).reshape(-1, 5)
            failed = (s[:, 0] < LEAST_WORDS) | (100 * s[:, 4] > MOST_REPEATED * s[:, 0])
            yield pa.record_batch([b.column(0), *(pa.array(s[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass the limits and the classifier, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            keep = []
            for t in b.column(at).cast(pa.binary()).to_pylist():
                s, counts = measure(t)
                failed = s[0] < LEAST_WORDS or 100 * s[4] > MOST_REPEATED * s[0]
                keep.append(not failed and bool(logistic(m.slope * (m.weights @ _unit(counts) + m.bias) + m.shift) >= threshold))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
