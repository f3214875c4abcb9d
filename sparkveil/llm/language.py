"""Language identification by hyperdimensional profiles.

Each letter class has a random vector of +1 and -1. An n-gram's vector binds
(multiplies) its letters' vectors, each permuted by its place; a document's
vector bundles (adds) those of its n-grams, a language's prototype those of its
documents. A document takes the language whose prototype has the largest cosine
with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Width of the vectors, letters per n-gram, letter classes (class 0: anything but a letter).
WIDTH, GRAM, CLASSES = 1024, 3, 256
#: Documents that prototypes are made from, over all languages, and about how many at least (or all there are) of each.
SAMPLE, LEAST = 12_000, 1_000
UNKNOWN = "und"
#: Characters that are counted at a time: bounds the memory of a batch.
AT_ONCE = 1 << 20
#: A document's vector is rounded to this part of its length, so that sums of them are exact in any order; tasks that add up the sums.
UNIT, ADDERS = 1 << 20, 16

_LETTERS = np.random.default_rng(3).choice(np.array([-1, 1], np.int8), (CLASSES, WIDTH))
_KEYS = np.int64(CLASSES**GRAM)
_plane: list[np.ndarray] = []


def _class(point: int) -> int:
    """Letter class of a code point: 0 for what isn't a letter, else a hash of its lower case in 1 to CLASSES - 1."""
    c = chr(point)
    return ord(c.lower()[0]) % (CLASSES - 1) + 1 if c.isalpha() else 0


def _class_of(points: np.ndarray) -> np.ndarray:
    if not _plane:
        _plane.append(np.fromiter(map(_class, range(1 << 16)), np.int64, 1 << 16))
    high = points >= 1 << 16
    out = _plane[0][np.where(high, 0, points)]
    if high.any():
        values, back = np.unique(points[high], return_inverse=True)
        out[high] = np.fromiter(map(_class, values.tolist()), np.int64, len(values))[back]
    return out


def _grams(text: str, at_once: int) -> Iterator[np.ndarray]:
    """The n-grams of a text's letter classes in order, some at a time; runs of other characters are one blank, as are both ends. Empty if there is no letter."""
    kept, end = np.zeros(1, np.int64), len(text)  # the last of the classes so far
    for at in range(0, end, at_once):
        c = _class_of(np.frombuffer(text[at : at + at_once].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))
        c = np.r_[c, 0] if at + at_once >= end else c
        c = c[(c != 0) | (np.r_[kept[-1], c[:-1]] != 0)]
        c = np.r_[kept, c]
        n = len(c) - GRAM + 1
        if n > 0:
            g = c[:n].copy()
            for k in range(1, GRAM):
                g = g * CLASSES + c[k : n + k]
            yield g
        kept = c[-(GRAM - 1) :]


def vectors(texts: list[str | None], at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, and whether it has a letter. ``at_once`` characters are worked on at a time; the sums are exact, so that it doesn't matter how many."""
    n = len(texts)
    total, lettered = np.zeros((n, WIDTH)), np.zeros(n, bool)
    held: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        doc, gram = keys // _KEYS, keys % _KEYS
        kinds, at = np.unique(gram, return_inverse=True)
        own, row = np.unique(doc, return_inverse=True)
        for i in range(0, len(kinds), 8192):  # a rare script may have many n-grams
            some = (at >= i) & (at < i + 8192)
            part = kinds[i : i + 8192]
            bound = np.ones((len(part), WIDTH), np.int8)
            for k in range(GRAM):
                bound *= np.roll(_LETTERS, k, axis=1)[part // CLASSES**k % CLASSES]
            table = np.zeros((len(own), len(part)), np.float32)
            table[row[some], at[some] - i] = counts[some]
            total[own] += table @ bound.astype(np.float32)

    for i, text in enumerate(texts):
        for g in _grams(text or "", at_once):
            lettered[i] = True  # every n-gram has a letter
            held.append(i * _KEYS + g)
            size += len(g)
            if size >= at_once:
                flush()
                held, size = [], 0
    if held:
        flush()
    return total, lettered


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prototypes: np.ndarray


def held_out(id_) -> F.Column:
    """Whether a document is kept from learning: crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(id_.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Prototypes from the ``sample`` documents with a language, not held out, whose ids hash lowest, and of each language those in the lowest share of hashes that has ``LEAST`` of them. What reaches the driver is a vector for each language from each of ``ADDERS`` tasks."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    last = rows.select(F.xxhash64(F.col(id_col)).alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return Model([], np.zeros((0, WIDTH), np.float32))
    up_to = F.when(F.col("n") <= LEAST, F.lit((1 << 63) - 1)).otherwise((F.lit(-(2.0**63)) + F.lit(2.0**64) * LEAST / F.col("n")).cast("bigint"))
    limits = stage(rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).select("lang", F.greatest(up_to, F.lit(last)).alias("up_to")), "language-limits")
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h"))
    chosen = rows.join(limits, "lang").where(F.col("h") <= F.col("up_to")).select("lang", "text")

    def bundle(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([*sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            v, lettered = vectors(b.column(1).to_pylist())
            v = np.rint(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9) * UNIT).astype(np.int64)
            for lang in set(langs := b.column(0).to_pylist()):
                own = np.fromiter((x == lang for x in langs), bool, len(langs)) & lettered
                sums[lang] = sums.get(lang, 0) + v[own].sum(0)
        yield from bundle(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, v in zip(b.column(0).to_pylist(), b.column(1)):
                sums[lang] = sums.get(lang, 0) + v.values.to_numpy()
        yield from bundle(sums)

    kind = "lang string, v array<bigint>"
    # a task of the scan gives a vector for each language it met; a few tasks add these up for the driver
    made: dict[str, np.ndarray] = {}
    for lang, v in chosen.mapInArrow(run, kind).repartition(ADDERS).mapInArrow(add, kind).collect():
        made[lang] = made.get(lang, 0) + np.array(v, np.int64)
    names = sorted(k for k, v in made.items() if v.any())
    p = np.array([made[k] / UNIT for k in names]).reshape(-1, WIDTH)
    return Model(names, (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)).astype(np.float32))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``; score is the cosine with the chosen prototype, 0 where it is negative.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text if nothing was learned. A tie goes to the first language in code point
    order. Repeated rows stay repeated; a null id is never held out; an empty
    table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            v, lettered = vectors(b.column(2).to_pylist())
            if not m.languages:
                lettered[:] = False
                cos = np.zeros((len(v), 1))
            else:
                cos = v @ m.prototypes.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            best = cos.argmax(1) if len(v) else np.zeros(0, int)
            names = [m.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered)]
            score = np.where(lettered, np.clip(cos[np.arange(len(v)), best], 0, 1), 0.0).astype(float)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    id_ = F.col(id_col).cast("bigint")
    rows = docs.select(id_.alias("doc_id"), F.coalesce(held_out(id_), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
