"""Document fingerprints by a homomorphic multiset hash.

Every paragraph (what stands between line feeds) is hashed to a wide vector:
the sum, over its word shingles, of pseudorandom vectors of +1 and -1. A
document's fingerprint is the sum of its paragraphs' vectors, each lane modulo
2^32, more than the shingles of any text that fits a row, so no sum wraps. It doesn't depend on the order of paragraphs, and adding or subtracting a
paragraph's vector is all that an insertion or deletion needs. As lanes are
signed sums, the cosine of two fingerprints estimates how much of the
documents' shingles they share.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage, word_blocks

LANES = 128
SHINGLE = 3
#: Rows that one range of ids holds, about, and the most ranges, whose starts every task gets (16 bytes each).
RANGE_ROWS, MOST_RANGES = 2048, 100_000
_FIRST = -(1 << 63)


def paragraph_vector(paragraph: str) -> np.ndarray:
    """The vector of one paragraph, modulo 2^32; one without a word has the zero vector, one of under three words is one shingle."""
    total = np.zeros(LANES, np.int64)
    hashed, carry, any_ = xxhash.xxh3_128_digest, [], False
    for words in word_blocks(paragraph.encode("utf-8", "surrogatepass")):
        words = carry + words
        n = len(words) - SHINGLE + 1
        if n > 0:
            joined = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            starts = (ends - sizes)[:n].tolist()
            raw = b"".join([hashed(joined[a:b]) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())])
            bits = np.frombuffer(raw, np.uint8).reshape(n, LANES // 8)
            for i in range(0, n, 1 << 15):
                part = bits[i : i + (1 << 15)]
                total += 2 * np.unpackbits(part, axis=1).sum(0, dtype=np.int64) - len(part)
            any_, words = True, words[n:]
        carry = words
    if carry and not any_:
        total += 2 * np.unpackbits(np.frombuffer(hashed(b" ".join(carry)), np.uint8)).astype(np.int64) - 1
    return total.astype(np.uint32)


def text_vector(text: str, known: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """The sum of the vectors of a text's paragraphs; ``known`` holds those already hashed."""
    total = np.zeros(LANES, np.uint32)
    known = {} if known is None else known
    for p in text.split("\n"):
        if p:
            if p not in known:
                known[p] = paragraph_vector(p)
            total += known[p]
    return total


def insert(vector: np.ndarray, paragraph: str) -> np.ndarray:
    return vector + paragraph_vector(paragraph)


def delete(vector: np.ndarray, paragraph: str) -> np.ndarray:
    return vector - paragraph_vector(paragraph)


def to_text(vector: np.ndarray) -> str:
    return vector.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, else the cosine of the signed lanes, 0 where it is negative."""
    if (a == b).all():
        return 1.0
    x, y = a.view(np.int32).astype(np.float64), b.view(np.int32).astype(np.float64)
    norm = np.sqrt((x @ x) * (y @ y))
    return float(min(1.0, max(0.0, x @ y / norm))) if norm else 0.0


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _starts(keys: DataFrame, range_rows: int) -> list[tuple[int, int]]:
    """The least key (k, h) of each of about rows / ``range_rows`` ranges of equal size, ascending; only these reach the driver."""
    n = keys.count()
    if not n:
        return []
    parts = keys.repartitionByRange(min(MOST_RANGES, max(1, n // range_rows)), "k", "h")
    return sorted({(r.m.k, r.m.h) for r in parts.groupBy(F.spark_partition_id()).agg(F.min(F.struct("k", "h")).alias("m")).collect()})


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """For every row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next row is that with the next id (null ids first, equal ids by a hash
    of their texts); the last row's is the first. Ranges of this order are dealt
    to tasks, and the first row of each range goes to the range before as well,
    so that every row meets the next in one shuffle. An id that many rows share
    is split by text; rows that repeat id and text travel once for each task
    that has them, with their number, and stay repeated in the result. A null
    text is empty and has the zero fingerprint; an empty table gives no rows;
    other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    keys = stage(rows.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("k"), "h"), "neighbour-keys")
    starts = _starts(keys, range_rows)
    unstage(keys)
    last = len(starts) - 1
    shared = docs.sparkSession.sparkContext.broadcast(starts)
    names = ["part", "ahead", "doc_id", "h", "copies", "text"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = shared.value
        known: dict[tuple, int] = {}  # copies of each row beyond the first
        range_of = lambda doc, h: bisect.bisect_right(starts, (_FIRST if doc is None else doc, h)) - 1

        def made(parts, ahead, docs_, hs, copies, texts) -> pa.RecordBatch:
            return pa.record_batch([pa.array(parts, pa.int32()), pa.array([ahead] * len(parts), pa.bool_()), docs_, hs, pa.array(copies, pa.int64()), texts], names)

        for b in batches:
            own = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            new = []
            for i, key in enumerate(own):
                if key in known:
                    known[key] += 1
                else:
                    known[key] = 0
                    new.append(i)
            parts = [range_of(*own[i]) for i in new]
            b = b.take(pa.array(new, pa.int64()))
            yield made(parts, False, b.column(0), b.column(1), [1] * len(new), b.column(2))
            first = [j for j, (i, r) in enumerate(zip(new, parts)) if starts[r] == (_FIRST if own[i][0] is None else own[i][0], own[i][1])]
            if first:
                f = b.take(pa.array(first))
                yield made([parts[j] - 1 if parts[j] else last for j in first], True, f.column(0), f.column(1), [1] * len(first), f.column(2))
        more = [(key, n) for key, n in known.items() if n]
        if more:
            yield made([range_of(*key) for key, _ in more], False, pa.array([k[0] for k, _ in more], pa.int64()), pa.array([k[1] for k, _ in more], pa.int64()), [n for _, n in more], pa.nulls(len(more), pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # what waits for its next: id, hash, text, known paragraphs, vector, copies
        out: list[tuple] = []

        def row(following: str, vector: np.ndarray, known: dict) -> tuple:
            doc, _, own, paragraphs, v, _ = held
            e = edited(own, following)
            ev = text_vector(e, {**paragraphs, **known})
            return (doc, len(own), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), to_text(v), to_text(ev), likeness(v, ev), likeness(v, vector))

        for b in batches:
            for ahead, doc, h, copies, text in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
                if held is not None and not ahead and (doc, h) == (held[0], held[1]):
                    held[5] += copies
                    continue
                if ahead and held is None:
                    continue  # the range's rows are done
                known: dict[str, np.ndarray] = {}
                vector = text_vector(text, known)
                if held is not None:
                    if held[5] > 1:
                        same = row(held[2], held[4], {})
                        for _ in range(held[5] - 1):
                            out.append(same)
                            if len(out) >= 500:
                                yield made(out)
                                out = []
                    out.append(row(text, vector, known))
                held = None if ahead else [doc, h, text, known, vector, copies]
                if len(out) >= 500:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    def made(out):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    dealt = rows.mapInArrow(deal, "part int, ahead boolean, doc_id bigint, h bigint, copies bigint, text string")
    ordered = dealt.repartitionById(max(1, len(starts)), F.col("part")).sortWithinPartitions("ahead", "doc_id", "h", F.col("text").isNull())
    return ordered.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
