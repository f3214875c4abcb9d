"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits. The bits are grouped by correlation into parts, and
a threshold is allotted to each part so that the thresholds add up to
``distance - parts + 1``: two fingerprints within ``distance`` then lie within
the threshold of at least one part (a part with threshold -1 is never probed).
The allotment is found by dynamic programming over candidate counts estimated
from statistics of all fingerprints. A part with threshold e is probed by the
keys that leave out each choice of e of its bits. Blocks of equal keys are
verified bit by bit; a block over ``BLOCK`` rows is first split by the same
principle on the bits it doesn't share yet, until it is small or all its
members link by construction, so that no block size is assumed and no link is
lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stage, word_blocks
from .components import connected_components

DISTANCE = 3
PARTS = 4
SHINGLE = 3
SEED = 42
#: Largest block that is compared in one piece: a bound on memory and time, not on links.
BLOCK = 2048
#: Rows of a large family that each of its parts is compared with.
PIVOTS = 64
#: Cost of one emitted key in units of one compared pair.
KEY_COST = 50.0
ALL = (1 << 64) - 1


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit fingerprint of a whole text: A-Z lower-cased, words between ASCII blanks, 3-word shingles with repeats, bit set if set in over half of the shingles' XXH64. Fewer words: the whole sequence; none or null: zero."""
    if not text:
        return 0
    hashed, total, counts, carry = xxhash.xxh64_intdigest, 0, np.zeros(64, np.int64), []
    for words in word_blocks(text.lower()):
        words = carry + words
        n = len(words)
        if n >= SHINGLE:
            joined = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, n)
            ends = np.cumsum(sizes + 1) - 1
            starts = (ends - sizes)[: n - SHINGLE + 1].tolist()
            h = np.fromiter([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64, n - SHINGLE + 1)
            for i in range(0, len(h), 1 << 16):
                counts += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            total += len(h)
            words = words[n - SHINGLE + 1 :]
        carry = words
    if not total:
        return hashed(b" ".join(carry), SEED) if carry else 0
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fp: bigint) for each row of ``docs``; null text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t) for t in b.column(2).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["id", "text_hash", "fp"])

    id_, text = F.col(id_col).cast("bigint"), F.col(text_col)
    rows = docs.select(id_.alias("id"), F.xxhash64(id_, text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "id bigint, text_hash bigint, fp bigint")


# -- parts and thresholds ---------------------------------------------------


def _bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Row count and the 64 x 64 matrix of how often two bits are set together, over all fingerprints."""

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            total += bits.T @ bits
            n += len(x)
        yield pa.record_batch([pa.array(range(4097), pa.int32()), pa.array([*total.ravel().astype(np.int64).tolist(), n], pa.int64())], ["k", "c"])

    rows = fps.select("fp").mapInArrow(run, "k int, c bigint").groupBy("k").agg(F.sum("c").alias("c")).collect()
    flat = np.zeros(4097)
    for r in rows:
        flat[r.k] = r.c
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of equal size; a group grows by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for g in range(parts):
        size = (64 - sum(map(len, groups))) // (parts - g)
        first = max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())
        group = [first]
        left.remove(first)
        while len(group) < size:
            b = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(b)
            left.remove(b)
        groups.append(sorted(group))
    return groups


def allot(costs: list[list[float]], distance: int) -> list[int]:
    """Thresholds, one per part, -1 at least, that add up to distance - parts + 1 at the least total cost; costs[i][e + 1] is that of threshold e."""
    parts = len(costs)
    best = {0: (0.0, [])}  # by the sum of e + 1
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for k, c in enumerate(row):
                at = used + k
                if at <= distance + 1 and (at not in step or cost + c < step[at][0]):
                    step[at] = (cost + c, [*chosen, k - 1])
        best = step
    assert all(t >= -1 for t in best[distance + 1][1]) and sum(best[distance + 1][1]) == distance - parts + 1
    return best[distance + 1][1]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def plan(fps: DataFrame, distance: int = DISTANCE, parts: int = PARTS) -> list[int]:
    """The probe masks: each says which bits a block's members share."""
    n, both = _bit_statistics(fps)
    groups = group_bits(n, both, parts)
    equal = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(g)))).alias("v")) for i, g in enumerate(groups)])).alias("k")).select("k.*")
    pairs = dict(equal.groupBy("i", "v").agg(F.count("*").alias("c")).groupBy("i").agg(F.sum(F.expr("cast(c as double) * (c - 1) / 2")).alias("p")).collect())
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    costs = []
    for i, g in enumerate(groups):
        odds, sums = differ[g] / np.maximum(1 - differ[g], 1e-9), np.zeros(distance + 1)
        sums[0] = 1  # elementary symmetric sums of the odds: pairs that differ in k bits for each that differs in none
        for o in odds:
            sums[1:] += sums[:-1] * o
        costs.append([0.0] + [KEY_COST * n * comb(len(g), e) + (pairs.get(i, 0) + 1) * sums[: e + 1].sum() * comb(len(g), e) ** 0.5 for e in range(distance + 1)])
    masks = []
    for g, e in zip(groups, allot(costs, distance)):
        if e >= 0:
            masks += [_mask(set(g) - set(c)) for c in combinations(g, e)]
    return masks


def split_mask(mask: int, distance: int = DISTANCE) -> list[int]:
    """Masks of which at least one holds for any two that share ``mask`` and differ in at most ``distance`` bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | _mask(free[i :: distance + 1]) for i in range(distance + 1)]


# -- blocks -----------------------------------------------------------------


def _spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) by place for every row that links to another, from the matrix of links; rows linked over others have the same root."""
    n = len(near)
    label = np.arange(n)
    while True:
        least = np.where(near, label[None, :], n).min(1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    return [(int(label[i]), int(i)) for i in np.flatnonzero(label != np.arange(n))]


def _block_links(distance: int, more: int | None):
    """Links of the blocks of (mask, fp) rows in order, as pairs of fingerprints; with ``more``, rows have a second fingerprint, which links must be within ``more`` bits of too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        width = 1 if more is None else 2

        def near(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
            hit = np.bitwise_count(a[0] ^ b[0]) <= distance
            return hit if more is None else hit & (np.bitwise_count(a[1] ^ b[1]) <= more)

        def links(m: np.ndarray, *x: np.ndarray) -> pa.RecordBatch:
            val = m & x[0].view(np.int64)
            u, w = [], []
            cuts = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (val[1:] != val[:-1]), True])
            sizes = np.diff(cuts)
            block = np.repeat(np.arange(len(sizes)), sizes)
            small = np.flatnonzero(np.repeat(sizes <= 32, sizes))
            for d in range(1, 32):
                same = small[:-d][block[small[d:]] == block[small[:-d]]] if len(small) > d else small[:0]
                if not len(same):
                    break
                hit = same[near([k[same] for k in x], [k[same + d] for k in x])]
                u.append(hit)
                w.append(hit + d)
            for k in np.flatnonzero(sizes > 32):
                own = [c[cuts[k] : cuts[k + 1]] for c in x]
                if found := _spanning(near([c[:, None] for c in own], [c[None, :] for c in own])):
                    f = np.array(found) + cuts[k]
                    u.append(f[:, 0])
                    w.append(f[:, 1])
            u, w = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (u, w))
            return pa.record_batch([pa.array(k[z].view(np.int64)) for z in (u, w) for k in x], [f"{z}{k}" for z in "uv" for k in range(width)])

        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1 + width)]
            now[1:] = [k.view(np.uint64) for k in now[1:]]
            if kept is not None:
                now = [np.concatenate(p) for p in zip(kept, now)]
            m, val = now[0], now[0] & now[1].view(np.int64)
            changes = np.flatnonzero((m[1:] != m[:-1]) | (val[1:] != val[:-1]))
            cut = changes[-1] + 1 if len(changes) else 0
            if cut:
                yield links(*(k[:cut] for k in now))
            kept = [k[cut:] for k in now]
        if kept is not None:
            yield links(*kept)

    return run


def _part_links(distance: int, more: int):
    """Links between labels (u, v) that connect those whose rows link in a part, of parts of large blocks as (key, part, label, fp, aux) rows in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            near = (np.bitwise_count(x[:, None] ^ x[None, :]) <= distance) & (np.bitwise_count(y[:, None] ^ y[None, :]) <= more)
            kinds, kind = np.unique(label.view(np.int64), return_inverse=True)
            i, j = np.nonzero(near)
            near = np.zeros((len(kinds), len(kinds)), bool)
            near[kind[i], kind[j]] = True
            found = np.array(_spanning(near), np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(kinds[found[:, z]]) for z in (0, 1)], ["u", "v"])

        kept: list[np.ndarray] | None = None
        for b in batches:
            now = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
            if kept is not None:
                now = [np.concatenate(p) for p in zip(kept, now)]
            cuts = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], cuts.tolist()):
                if j - i > 1:
                    yield links(*(k[i:j].view(np.uint64) for k in now[2:]))
            kept = [k[cuts[-1] if len(cuts) else 0 :] for k in now]
        if kept is not None and len(kept[0]) > 1:
            yield links(*(k.view(np.uint64) for k in kept[2:]))

    return run


def _mixed(rows: DataFrame, *by: str) -> DataFrame:
    """Of each group of ``rows`` that has more than one label: n, its rows, top, the label most of them have, and rest, how many have others."""
    each = rows.groupBy(*by, "label").agg(F.count("*").alias("c"))
    sums = each.groupBy(*by).agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("most"))
    return sums.select(*by, "n", F.col("most.label").alias("top"), (F.col("n") - F.col("most.c")).alias("rest")).where("rest > 0")


def tiles(n, rest, is_rest, size: int, *on) -> F.Column:
    """The tiles of a row of a group of ``n`` rows: each of the ``rest`` rows marked ``is_rest`` meets each row of the group in some tile, of about ``2 * size`` rows; ``on`` are columns to deal by."""
    across, down = (F.ceil(x / size).cast("bigint") for x in (n, rest))
    home, turn = F.pmod(F.xxhash64(F.lit(1), *on), across), F.pmod(F.xxhash64(F.lit(2), *on), down)
    column = F.transform(F.sequence(F.lit(0).cast("bigint"), down - 1), lambda k: k * across + home)
    row = F.transform(F.sequence(F.lit(0).cast("bigint"), across - 1), lambda k: turn * across + k)
    return F.when(is_rest, F.array_union(column, row)).otherwise(column)


def near_links(fps: DataFrame, distance: int = DISTANCE, parts: int = PARTS, block: int = BLOCK, scratch: Scratch | None = None, more: int | None = None) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fps`` (fp) that connect exactly those a chain of steps of at most ``distance`` bits connects.

    With ``more``, rows have a second fingerprint (aux), and a step must be of
    at most ``more`` bits there too; u and v are then xxhash64(fp, aux). A block of
    over ``block`` rows may be one large family there, which no bits split. So it is
    first dealt to parts of half that size, each beside the same ``PIVOTS`` or so of
    its rows, and rows are labelled by what the links of the parts connect. A link
    that is still missing joins two labels: a block with one label is done with;
    in any other all rows outside its commonest label are compared with all rows,
    tile by tile, or, where that leaves less to compare, the block is split on,
    whole, into blocks of which those with one label are left out.

    In a block of over 32 members, links are thinned to a spanning forest of
    the block's own links, so the output never grows with the square of a group.
    """
    masks, scratch = plan(fps, distance, parts), scratch or Scratch()
    own = ["fp"] if more is None else ["fp", "aux"]
    names = [f"{z}{k}" for z in "uv" for k in range(len(own))]

    def ends(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"{z}0").alias(z) if more is None else F.xxhash64(f"{z}0", f"{z}1").alias(z) for z in "uv"])

    def keyed(rows: DataFrame, mask_lists: dict[int, list[int]] | None, *others: str) -> DataFrame:
        if mask_lists is None:
            options = F.array(*[F.lit(_signed(m)) for m in masks])
        else:
            options = F.element_at(F.create_map(*[y for m, s in mask_lists.items() for y in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in s]))]), F.col("mask"))
        return rows.select(*others, *own, F.explode(options).alias("mask")).select(*others, "mask", *own)

    def part_links(rows: DataFrame, places: F.Column) -> DataFrame:
        dealt = rows.select("key", F.explode(places).alias("part"), "label", *own).repartition("key", "part").sortWithinPartitions("key", "part")
        return scratch.stage(dealt.mapInArrow(_part_links(distance, more), "u bigint, v bigint"), "part-links")

    # rows travel as mask and fingerprint; what they share is worked out on either side
    value = F.col("fp").bitwiseAND(F.col("mask"))
    key = F.xxhash64("mask", value)
    rows, out, level, known = keyed(fps, None), None, masks, None
    while True:
        # blocks are counted by 64 bits of their key: one that shares these with a large block is split like it, which loses nothing
        large = scratch.stage(rows.groupBy(key.alias("key")).agg(F.count("*").alias("c")).where(F.col("c") > block), "large-blocks")
        some = not large.isEmpty()
        ready = rows.join(large, key == F.col("key"), "left_anti") if some else rows
        pairs = ready.repartition("mask", value).sortWithinPartitions("mask", value).select("mask", *own).mapInArrow(_block_links(distance, more), ", ".join(f"{k} bigint" for k in names))
        out = ends(pairs) if out is None else out.union(ends(pairs))
        if not some:
            return out
        full = [m for m in level if 64 - m.bit_count() <= distance]
        is_full = F.col("mask").isin([_signed(m) for m in full])
        if more is None:
            hot = rows.join(large, key == F.col("key"), "left_semi")
        else:
            hot = scratch.stage(rows.join(large, key == F.col("key")).select("key", "c", is_full.alias("full"), "mask", *own, F.xxhash64(*own).alias("label")), "hot")
            count = F.ceil(F.col("c") / (block // 2)).cast("bigint")
            pivot = F.pmod(F.xxhash64("fp", "aux", "mask"), F.col("c")) < PIVOTS
            found = part_links(hot, F.when(pivot, F.sequence(F.lit(0).cast("bigint"), count - 1)).otherwise(F.array(F.pmod(F.xxhash64("mask", "fp", "aux"), count))))
            out, known = out.union(found), found if known is None else known.union(found)
            roots = connected_components(known).withColumnRenamed("node", "label")
            hot = scratch.stage(hot.join(roots, "label", "left").select("key", "full", "mask", *own, F.coalesce("root", "label").alias("label")), "labelled")
            mixed = scratch.stage(_mixed(hot, "key", "full"), "mixed-blocks")
            # a block is split on where more pairs would be compared in it than in what it splits into, where each key counts as KEY_COST pairs
            keys = (distance + 1) * KEY_COST
            asked = hot.join(mixed.where((F.col("rest") > keys) & ~F.col("full")).select("key", "full"), ["key", "full"], "left_semi")
            open_masks = {r[0] for r in asked.select("mask").distinct().collect()}
            split = {m: split_mask(m, distance) for m in level if m not in full and _signed(m) in open_masks}
            tiled = mixed
            if split:
                inner = keyed(asked, split, "key", "label").withColumn("inner", key)
                within = scratch.stage(_mixed(inner, "key", "inner"), "mixed-splits")
                left = within.groupBy("key").agg(F.sum(F.col("n").cast("double") * F.col("rest")).alias("pairs"))
                worth = F.col("n").cast("double") * F.col("rest") > keys * F.col("n") + F.coalesce("pairs", F.lit(0.0))
                apart = scratch.stage(mixed.where((F.col("rest") > keys) & ~F.col("full")).join(left, "key", "left").where(worth).select("key", "full"), "split-keys")
                tiled = mixed.join(apart, ["key", "full"], "left_anti")
            met = hot.join(tiled, ["key", "full"])
            found = part_links(met, tiles(F.col("n"), F.col("rest"), F.col("label") != F.col("top"), max(1, block // 4), "key", *own))
            out, known = out.union(found), known.union(found)
            if not split:
                return out
            level = sorted({k for s in split.values() for k in s})
            rows = scratch.stage(inner.join(apart, "key", "left_semi").join(within.select("key", "inner"), ["key", "inner"], "left_semi").select("mask", *own).distinct(), "split-blocks")
            continue
        open_masks = {r[0] for r in hot.select("mask").distinct().collect()}
        if full:  # all members of such a block link by construction
            alike = hot.where(is_full).select("mask", value.alias("val"), F.struct(*own).alias("v"))
            least = alike.groupBy("mask", "val").agg(F.min("v").alias("u"))
            out = out.union(ends(alike.join(least, ["mask", "val"]).select(*[F.col(f"{z}.{c}").alias(f"{z}{k}") for z in "uv" for k, c in enumerate(own)])))
        hot = hot.where(~is_full) if full else hot
        split = {m: split_mask(m, distance) for m in level if m not in full and _signed(m) in open_masks}
        if not split:
            return out
        level = sorted({k for s in split.values() for k in s})
        rows = scratch.stage(keyed(hot, split).distinct(), "split-blocks")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id, text_hash, fp, root, component_id) for every row of ``docs``: its fingerprint, its group's smallest fingerprint, and the smallest id reachable over links of at most ``distance`` differing bits, itself included.

    Null or blank texts have fingerprint zero and link like any other. Repeated
    rows stay repeated. A null id is never a component_id unless the whole group
    has only null ids. An empty table gives an empty result. Other columns of
    ``docs`` are ignored, whatever their names.
    """
    each = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    scratch = Scratch()
    distinct = scratch.stage(each.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    links = near_links(distinct.select("fp"), distance, scratch=scratch)
    member = scratch.stage(connected_components(links), "members").select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    group = scratch.stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "groups")
    known = stage(rooted.select("fp", "root").join(group, "root").select("fp", "root", "component_id"), "known")
    scratch.clear()
    return each.join(known, "fp").select("id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    return simhash_groups(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
