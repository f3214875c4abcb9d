"""Removal of long repeated substrings with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else in the table. Strings ("windows") are told apart in three steps, each on
far fewer bytes than the one before, and each exact about what it decides:

1. Anchors. Each window has one anchor, the run of ``GRAM`` bytes in it with the
   least hash; equal windows have equal anchors at equal places. Windows in a
   row that share an anchor are handled together. An anchor whose content
   occurs once decides against its windows; an anchor whose whole context (all
   its windows' bytes) occurs twice decides for them.
2. Cores. What is left are contexts at the rim of repeats. They are cut into
   strips of ``STRIP`` windows; all windows of a strip share a core, so only
   strips whose core occurs twice go on, as the few bytes left and right of it.
3. Suffix array. In a strip, the core stands for one symbol, so each window is
   a string of ``STRIP`` symbols around it. The strips of many cores are
   concatenated and sorted with the linear grouping construction; suffixes that
   share ``STRIP`` symbols with a neighbour start repeated windows.

A core with over ``GROUP`` strips is never gathered in one task: its windows
are counted one by one with partial sums. Contexts, cores and such windows are
compared by 128 bits of hash of their content, anchors by 64 bits: an anchor
only says what is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import Scratch, stage
from .features import _BYTE, _MIX, _power
from .suffixes import common_prefixes, suffix_array

LENGTH = 400
GRAM = 128
STRIP = 16
#: Strips of one core that a task may gather; beyond, windows are counted one by one.
GROUP = 4096
#: Bytes hashed at a time, and symbols sorted at a time.
PIECE = 1 << 19
SYMBOLS = 1 << 16
_AT = np.uint64((1 << 20) - 1)


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(len(data))[0], out=out[1:])
    return out


def _hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of the summed bytes."""
    h = (sums[ends] - sums[starts]) * _power(len(sums))[1][starts]
    h = (h ^ (h >> np.uint64(29))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _contents(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *salts: np.ndarray) -> list[bytes]:
    """128 bits of each stretch of bytes together with its salts (under 2^16)."""
    raw = data.tobytes()
    salt = np.stack(salts, 1).astype("<u2").tobytes()
    n = 2 * len(salts)
    return [xxh3_128_digest(raw[a:z] + salt[k : k + n]) for a, z, k in zip(starts.tolist(), ends.tolist(), range(0, n * len(starts), n))]


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(key, context, low, high, at) of each run of windows of ``data`` with one anchor: hashes of the anchor and of the context, first and last window start, and the anchor's start. ``data`` is shorter than 2^20 bytes."""
    n, span = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.uint64), [], *(np.zeros(0, np.int64) for _ in range(3))
    sums = _sums(data)
    starts = np.arange(n - gram + 1)
    h = _hash(sums, starts, starts + gram)
    least = (h & ~_AT) | starts.astype(np.uint64)  # ties go to the leftmost
    step = 1
    while step * 2 <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < span:
        least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
    at = (least & _AT).astype(np.int64)
    low = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    high = np.r_[low[1:], len(at)] - 1
    at = at[low]
    return h[at], _contents(data, low, high + length, at - low, high - low), low, high, at


def _document_anchors(text: bytes, length: int, gram: int) -> Iterator[tuple]:
    data = np.frombuffer(text, np.uint8)
    for start in range(0, max(len(data) - length + 1, 0), PIECE):
        key, context, low, high, at = anchors(data[start : start + PIECE + length - 1], length, gram)
        yield key, context, low + start, high + start, at + start


def strips(data: np.ndarray, found: list[tuple[int, int, int]], length: int = LENGTH, strip: int = STRIP) -> Iterator[tuple[bytes, int, bytes, bytes]]:
    """(core hash, last window start, left bytes, right bytes) of each strip of the windows (low, high, anchor) of one document."""
    n = len(data)
    for start in sorted({low // PIECE for low, _, _ in found}):
        own = [x for x in found if x[0] // PIECE == start]
        base = max(0, start * PIECE - length)
        part = data[base : min(n, (start + 1) * PIECE + 3 * length)]
        lasts, index = [], []
        for low, high, at in own:
            # windows at distance [strip * b, strip * (b + 1)) before the anchor
            for b in range((at - high) // strip, (at - low) // strip + 1):
                lasts.append(at - b * strip)
                index.append(b)
        last, b = np.array(lasts, np.int64), np.array(index, np.int64)
        ok = (last >= 0) & (last - strip + 1 + length <= n)
        last, b = last[ok], b[ok]
        if not len(last):
            continue
        ends = last - strip + 1 + length
        core = _contents(part, last - base, ends - base, b)
        for c, s, e in zip(core, last.tolist(), ends.tolist()):
            yield c, s, data[max(0, s - strip + 1) : s].tobytes(), data[e : e + strip - 1].tobytes()


def repeated_windows(groups: list[tuple[list[tuple[bytes, bytes]], list[bool]]], strip: int = STRIP) -> list[list[list[int]]]:
    """For each group (one core's distinct strips and whether each occurs more than once) and strip, the distances before the strip's last start at which a window is repeated."""
    symbols: list[int] = []
    origin: list[tuple[int, int, int]] = []  # where a strip's symbols begin: group, strip, place
    separator = 1
    offset = 256 + 2 * sum(len(g[0]) for g in groups) + 2
    for k, (members, _) in enumerate(groups):
        for j, (left, right) in enumerate(members):
            origin.append((k, j, len(symbols)))
            symbols.extend(c + offset for c in left)
            symbols.append(offset + 256 + k)
            symbols.extend(c + offset for c in right)
            symbols.append(separator)  # each once, so that no match crosses it
            separator += 1
    order = suffix_array(symbols)
    shared = common_prefixes(symbols, order)
    rank = np.empty(len(order), np.int64)
    rank[np.array(order)] = np.arange(len(order))
    above = np.r_[shared[1:], 0]
    hit = np.maximum(shared, above)[rank] >= strip
    out: list[list[list[int]]] = [[[] for _ in members] for members, _ in groups]
    for k, j, begin in origin:
        (left, right), many = groups[k][0][j], groups[k][1][j]
        for i in range(len(left) + 1):
            d = len(left) - i  # this window starts d bytes before the last one
            if strip - 1 - d <= len(right) and (many or hit[begin + i]):
                out[k][j].append(d)
    return out


def _runs(distances: list[int], last: int, length: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted(last - d for d in distances):
        if out and s <= out[-1][1] - length + 1:
            out[-1] = (out[-1][0], s + length)
        else:
            out.append((s, s + length))
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, strip: int = STRIP, group: int = GROUP, scratch: Scratch | None = None) -> DataFrame:
    """(i, h, s, e): stretches [s, e) of the text with key (i, h) that repeated windows cover; they may overlap. ``docs`` has i, h and text; tables on the way are ``scratch``'s."""
    scratch = scratch or Scratch()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "context", "i", "h", "low", "high", "at"]
        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                for key, context, low, high, at in _document_anchors(t or b"", length, gram):
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(context, pa.binary()), pa.array(np.full(len(key), i)), pa.array(np.full(len(key), h)), pa.array(low), pa.array(high), pa.array(at)], names)

    def joined(batches, size=1 << 16):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= size:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    found = scratch.stage(docs.mapInArrow(lambda it: joined(find(it)), "key bigint, context binary, i bigint, h bigint, low bigint, high bigint, at bigint"), "anchors")
    often = scratch.stage(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "anchor-keys")
    found = scratch.stage(found.join(often, "key", "left_semi"), "repeated-anchors")
    contexts = scratch.stage(found.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("i", "h", "low", "high", "at")).alias("one")), "contexts")
    whole = found.join(contexts.where("n > 1").select("key", "context"), ["key", "context"], "left_semi").select("i", "h", F.col("low").alias("s"), (F.col("high") + length).alias("e"))
    rims = scratch.stage(contexts.where("n = 1").select("key").distinct(), "rim-keys")
    open_ = contexts.where("n = 1").unionByName(contexts.where("n > 1").join(rims, "key", "left_semi")).select("one.*")
    open_ = scratch.stage(open_.groupBy("i", "h").agg(F.collect_list(F.struct("low", "high", "at")).alias("found")), "open-contexts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, h, t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()):
                data = np.frombuffer(t or b"", np.uint8)
                rows.extend((c, left, right, i, h, s) for c, s, left, right in set(strips(data, [(x["low"], x["high"], x["at"]) for x in f], length, strip)))
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["core", "l", "r", "i", "h", "last"])

    parts = docs.join(open_, ["i", "h"])
    parts = scratch.stage(parts.select("i", "h", "text", "found").mapInArrow(cut, "core binary, l binary, r binary, i bigint, h bigint, last bigint"), "strips")
    size = scratch.stage(parts.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"), "core-sizes")
    few, many = size.where(F.col("n") <= group).select("core"), scratch.stage(size.where(F.col("n") > group).select("core"), "large-cores")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # groups to be sorted together: strips, repeated, owners
        n = 0
        out: list[tuple[int, int, int, int]] = []

        def flush() -> None:
            nonlocal n
            if waiting:
                for (_, _, owners), hits in zip(waiting, repeated_windows([(m, r) for m, r, _ in waiting], strip)):
                    for own, d in zip(owners, hits):
                        for i, h, last in own:
                            out.extend((i, h, s, e) for s, e in _runs(d, last, length))
            waiting.clear()
            n = 0

        def close(rows: list[tuple]) -> None:
            nonlocal n
            if len(rows) < 2:
                return
            by: dict[tuple[bytes, bytes], list[tuple[int, int, int]]] = {}
            for left, right, i, h, last in rows:
                by.setdefault((left, right), []).append((i, h, last))
            if all(len(v) > 1 for v in by.values()):  # no strip is alone: each window is repeated
                for (left, right), own in by.items():
                    d = [k for k in range(len(left) + 1) if strip - 1 - k <= len(right)]
                    for i, h, last in own:
                        out.extend((i, h, s, e) for s, e in _runs(d, last, length))
                return
            waiting.append((list(by), [len(v) > 1 for v in by.values()], list(by.values())))
            n += sum(len(a) + len(b) + 2 for a, b in by)
            if n >= SYMBOLS:
                flush()

        core, rows = None, []
        for b in batches:
            for c, *row in zip(*(b.column(k).to_pylist() for k in range(6))):
                if c != core:
                    close(rows)
                    core, rows = c, []
                rows.append(row)
            if len(out) > 20_000:
                yield made(out)
                out.clear()
        close(rows)
        flush()
        if out:
            yield made(out)

    def made(rows):
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["i", "h", "s", "e"])

    sorted_ = parts.join(few, "core", "left_semi").select("core", "l", "r", "i", "h", "last").repartition("core").sortWithinPartitions("core").mapInArrow(sort, "i bigint, h bigint, s bigint, e bigint")
    spans = whole.unionByName(sorted_)
    if not many.isEmpty():
        d, before, after = F.col("d"), F.length("l"), F.length("r")
        windows = parts.join(many, "core", "left_semi").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(strip - 1)))).where((before >= d) & (after >= strip - 1 - d))
        inside = [F.expr("substring(l, length(l) - d + 1, d)"), F.expr(f"substring(r, 1, {strip - 1} - d)")]
        windows = windows.select("i", "h", (F.col("last") - d).alias("s"), F.xxhash64("core", "d", *inside).alias("a"), F.xxhash64(*inside, "d", "core").alias("b"))
        windows = scratch.stage(windows.distinct(), "windows")
        twice = scratch.stage(windows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "repeated-windows")
        spans = spans.unionByName(windows.join(twice, ["a", "b"], "left_semi").select("i", "h", "s", (F.col("s") + length).alias("e")))
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` kept, the bytes that stay.

    Null text is empty. A repeated row repeats every string it has, so all its
    strings of ``length`` bytes go. Texts shorter than ``length`` lose nothing;
    an empty table gives no rows; other columns are ignored. Bytes are judged on
    the input and may be cut inside a character.
    """
    id_ = F.col(id_col).cast("bigint")
    keyed = docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(-(1 << 63))).alias("i"), F.xxhash64(F.col(text_col)).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scratch = Scratch()
    spans = repeated_spans(keyed.select("i", "h", "text"), length, scratch=scratch)
    # rows that repeat an id and a text have the same spans: these are made one before they meet
    spans = stage(spans.distinct().groupBy("i", "h").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans")), "spans")
    scratch.clear()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
        for b in batches:
            rows = []
            for doc, t, spans in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2)):
                digest, at, removed, n, kept = hashlib.sha256(), 0, 0, 0, []
                if spans.is_valid:
                    s, e = (spans.values.field(k).to_numpy() for k in (0, 1))
                    reach = np.maximum.accumulate(e)
                    heads = np.flatnonzero(np.r_[True, s[1:] > reach[:-1]])
                    for a, z in zip(s[heads].tolist(), reach[np.r_[heads[1:], len(s)] - 1].tolist()):
                        digest.update(t[at:a])
                        if with_text:
                            kept.append(t[at:a])
                        removed, n, at = removed + z - a, n + 1, z
                digest.update(t[at:])
                kept.append(t[at:])
                rows.append((doc, len(t), removed, n, digest.hexdigest(), *[b"".join(kept)] * with_text))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    both = keyed.join(spans, ["i", "h"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(apply, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)
