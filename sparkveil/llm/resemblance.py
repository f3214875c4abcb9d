"""SimHash near-dedup of texts that share most of their five-word shingles.

Two texts are near-duplicates if the sets of their ``WORDS``-word shingles have
a Jaccard similarity of ``SIMILARITY`` or more. A few changed words turn many
bits of a fingerprint over shingles, but few of one over single words. So texts
are probed by SimHash over words (each weighs the root of its count) within
``DISTANCE`` bits, with the generalised pigeonhole of ``simhash``; a second
fingerprint over pairs of words, within ``PAIRS`` bits, tells apart what shares
common words only; and what is left is verified on the shingles.

What a probe links, directly or in a chain, is one candidate group. Texts of a
group are compared by the ``SKETCH`` smallest hashes of their shingles, which are
all of them in most texts: then the similarity is exact, else its standard error
is 0.0125 at 0.8. A group of up to ``GROUP`` different texts is compared whole.
A larger one is dealt ``DEALS`` times to parts of about that size, each time
beside the same ``LEADERS`` or so of its texts; texts are labelled by what links
found in any part connect. A link that is still missing joins two labels, and its
two texts share one of the smallest hashes of each (all but ``SIMILARITY`` of
them). Texts that share such a hash with another label are compared, all outside
their commonest label with all, tile by tile, so no link is lost. Near-duplicates
are what chains of links connect. Equal texts are one text from the start.
Nothing is gathered that grows with a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, stage
from .components import connected_components
from .features import LOWER, word_hashes
from .simhash import _mixed, near_links, tiles

WORDS, SIMILARITY = 5, 0.8
DISTANCE, PAIRS = 7, 14
SKETCH = 1024
GROUP, DEALS, LEADERS = 512, 3, 64
_ODD = np.random.default_rng(5).integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FIRST = -(1 << 63)


def _scattered(h: np.ndarray) -> np.ndarray:
    """Hashes mixed once more, so that each bit depends on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word of a text, A-Z lower-cased, in order."""
    found = list(word_hashes(LOWER[np.frombuffer(text, np.uint8)].tobytes())) if text else []
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _bits(h: np.ndarray) -> int:
    """The unsigned 64-bit SimHash of hashes: a bit is set if the kinds that have it outweigh the others, each with the root of its count. None: 0."""
    kinds, counts = np.unique(h, return_counts=True)
    weight, sums = np.sqrt(counts), np.zeros(64)
    for i in range(0, len(kinds), 1 << 15):
        bits = np.unpackbits(kinds[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums += weight[i : i + (1 << 15)] @ bits
    return int.from_bytes(np.packbits(2 * sums > weight.sum()).tobytes(), "big")


def probe(text: bytes | None) -> tuple[int, int]:
    """The SimHashes of a text's words and of its pairs of words in a row (one word alone is its own pair)."""
    h = words_of(text)
    pairs = h[:-1] * _ODD[0] + h[1:] * _ODD[1] if len(h) > 1 else h
    return _bits(_scattered(h)), _bits(_scattered(pairs))


def sketch(text: bytes | None, most: int = SKETCH) -> np.ndarray:
    """The smallest ``most`` hashes of a text's distinct shingles, ascending; fewer words are one shingle, no word has none."""
    h = words_of(text)
    if not len(h):
        return h
    n = max(1, len(h) - WORDS + 1)
    shingles = np.full(n, min(len(h), WORDS), np.uint64)
    for k in range(min(len(h), WORDS)):
        shingles += h[k : k + n] * _ODD[k]
    return np.unique(_scattered(shingles))[:most]


def similar_links(sketches: list[np.ndarray], similarity: float = SIMILARITY, most: int = SKETCH) -> list[tuple[int, int]]:
    """(first, other) for every text that a chain of links connects to an earlier one; first is the earliest of its group."""
    n = len(sketches)
    sizes = np.array([len(s) for s in sketches])
    flat = np.concatenate(sketches) if n else np.zeros(0, np.uint64)
    kinds, ids = np.unique(flat, return_inverse=True)
    order = np.argsort(ids, kind="stable")
    owner = np.repeat(np.arange(n), sizes)[order]
    begin = np.searchsorted(ids[order], np.arange(len(kinds) + 1))
    at = np.r_[0, np.cumsum(sizes)]
    top = np.uint64((1 << 64) - 1)
    limit = np.array([s[-1] if len(s) >= most else top for s in sketches], np.uint64)
    label = np.full(n, -1)
    out = []
    empty = np.flatnonzero(sizes == 0)  # texts without a word are equal
    out.extend((int(empty[0]), int(k)) for k in empty[1:])
    label[empty] = 0
    for first in range(n):
        if label[first] >= 0:
            continue
        label[first], waiting = first, [first]
        while waiting:
            u = waiting.pop()
            own = ids[at[u] : at[u + 1]]
            lengths = begin[own + 1] - begin[own]
            places = np.repeat(begin[own] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            shared = np.bincount(owner[places], minlength=n)
            for v in np.flatnonzero((shared > 0) & (label < 0)).tolist():
                upto = min(limit[u], limit[v])
                a, b = (sizes[k] if limit[k] == upto else int(np.searchsorted(sketches[k], upto, "right")) for k in (u, v))
                if shared[v] >= similarity * (a + b - shared[v]) - 1e-9:
                    label[v] = first
                    waiting.append(v)
                    out.append((first, v))
    return out


def probes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, u, fp, aux) for each row of ``docs``: two hashes of its text, 128 bits together, and its probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([probe(t) for t in b.column(3).cast(pa.binary()).to_pylist()], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch([*b.columns[:3], pa.array(fps[:, 0]), pa.array(fps[:, 1])], ["id", "t", "u", "fp", "aux"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("t"), F.xxhash64(F.lit(1), F.col(text_col)).alias("u"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, t bigint, u bigint, fp bigint, aux bigint")


def _sketched(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(root, t, n, sketch) of the texts that ``wanted`` (root, t, id, n) names by one of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            new = []
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if key not in seen:  # rows that repeat id and text
                    seen.add(key)
                    new.append(i)
            b = b.take(pa.array(new, pa.int64()))
            found = [sketch(t).view(np.int64) for t in b.column(3).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([*b.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["root", "t", "n", "sketch"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_FIRST)).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    # the number of such texts grows with the input: a shuffled join at every size
    both = rows.join(wanted.withColumn("id", F.coalesce("id", F.lit(_FIRST))).hint("merge"), ["id", "t"]).select("root", "t", "n", "text")
    return both.mapInArrow(run, "root bigint, t bigint, n bigint, sketch array<bigint>")


def _dealt(texts: DataFrame, group: int, deals: int, leaders: int) -> DataFrame:
    """``texts`` (root, t, n, sketch) with deal and part: one part for a group of up to ``group`` texts; a larger group's texts are in a part of each deal, its leaders in all."""
    parts = F.ceil(F.col("n") / group).cast("int")

    def places(deal) -> F.Column:
        leads = F.pmod(F.xxhash64("t", deal, F.lit(1)), F.col("n")) < leaders
        own = F.array(F.pmod(F.xxhash64("t", deal, F.lit(2)), parts).cast("int"))
        return F.transform(F.when(leads, F.sequence(F.lit(0), parts - 1)).otherwise(own), lambda p: F.struct(deal.alias("deal"), p.alias("part")))

    once = F.array(F.struct(F.lit(0).alias("deal"), F.lit(0).alias("part")))
    many = F.flatten(F.array(*[places(F.lit(d)) for d in range(deals)]))
    return texts.select("root", "t", "sketch", F.explode(F.when(F.col("n") <= group, once).otherwise(many)).alias("x")).select("root", "x.deal", "x.part", "t", "sketch")


def _first_hashes(sketched: DataFrame, similarity: float) -> DataFrame:
    """(root, t, hash) of ``sketched`` (root, t, n, sketch): of two texts that are ``similarity`` alike, at least one hash is the same. Texts without a word have hash 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [s.values.to_numpy() for s in b.column(3)]
            found = [s[: len(s) - int(np.ceil(similarity * len(s) - 1e-6)) + 1] if len(s) else np.zeros(1, np.int64) for s in found]
            if found:
                at = np.repeat(np.arange(len(found)), [len(s) for s in found])
                yield pa.record_batch([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(np.concatenate(found))], ["root", "t", "hash"])

    return sketched.mapInArrow(run, "root bigint, t bigint, hash bigint")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, distance: int = DISTANCE, group: int = GROUP, deals: int = DEALS, leaders: int = LEADERS) -> DataFrame:
    """(fp, t, u, id, same, rows, least) for every different text of ``docs``: its probe and hashes, its smallest id (null if it has no other), how many rows have it with that id and at all, and ``least``, the struct (no_id, id, fp, t) of the first text of its group: with the smallest id, then the smallest hashes.

    Null text and texts without a word are alike and form one group. Texts of
    fewer than ``WORDS`` words are near-duplicates only of those with the same
    words. Repeated rows and equal texts are one text. An empty table gives an
    empty result. Other columns of ``docs`` are ignored, whatever their names.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def links() -> pa.RecordBatch:
            names = list(held)
            found = similar_links([held[t] for t in names], similarity)
            return pa.record_batch([pa.array([names[x[k]] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for b in batches:
            for *now, t, s in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4)):
                if now != key:
                    if len(held) > 1:
                        yield links()
                    key, held = now, {}
                held[t] = s.values.to_numpy().view(np.uint64)
        if len(held) > 1:
            yield links()

    scratch = Scratch()
    each = scratch.stage(probes(docs, id_col, text_col), "probes")
    named = each.groupBy("fp", "aux", "t", "u", "id").agg(F.count("*").alias("c"))
    own = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "c")).alias("own")
    texts = scratch.stage(named.groupBy("fp", "aux", "t", "u").agg(own, F.sum("c").alias("rows")).select("fp", F.xxhash64("fp", "aux").alias("node"), "aux", "t", "u", F.col("own.id").alias("id"), F.col("own.c").alias("same"), "rows"), "probe-texts")
    member = scratch.stage(connected_components(near_links(texts.select("fp", "aux").distinct(), distance, scratch=scratch, more=PAIRS)), "probe-groups")
    rooted = scratch.stage(texts.join(member, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node", "aux"), "probe-rooted")
    sizes = scratch.stage(rooted.groupBy("root").agg(F.count("*").alias("n")).where("n > 1"), "probe-sizes")
    wanted = scratch.stage(rooted.join(sizes, "root").select("root", "t", "id", "n"), "to-verify")

    def linked(dealt: DataFrame) -> DataFrame:
        ordered = dealt.repartition("root", "deal", "part").sortWithinPartitions("root", "deal", "part")
        return scratch.stage(ordered.mapInArrow(link, "u bigint, v bigint"), "similar-links")

    large, sketched = wanted.where(F.col("n") > group), _sketched(docs, wanted, id_col, text_col)
    some = not large.isEmpty()
    if some:  # sketches of large groups are read again: texts meet what is wanted of them once only
        sketched = scratch.stage(sketched, "sketches")
    links = linked(_dealt(sketched, group, deals, leaders))
    if some:
        sketched = sketched.where(F.col("n") > group)
        label = connected_components(links).select(F.col("node").alias("t"), F.col("root").alias("label"))
        labelled = scratch.stage(large.join(label, "t", "left").withColumn("label", F.coalesce("label", "t")), "labelled-texts")
        first = _first_hashes(sketched, similarity).join(labelled.select("root", "t", "label"), ["root", "t"])
        first = scratch.stage(first, "first-hashes")
        asked = first.join(_mixed(first, "root", "hash").select("root", "hash"), ["root", "hash"], "left_semi").select("root", "t").distinct()
        asked = scratch.stage(labelled.join(asked, ["root", "t"], "left_semi"), "asked-texts")
        met = scratch.stage(asked.drop("n").join(_mixed(asked, "root"), "root"), "met-texts")
        places = tiles(F.col("n"), F.col("rest"), F.col("label") != F.col("top"), max(1, group // 2), "root", "t")
        parts = met.select("root", "t", F.explode(places).alias("part"))
        again = sketched.join(parts, ["root", "t"])
        links = links.union(linked(again.select("root", F.lit(0).alias("deal"), "part", "t", "sketch")))
    found = scratch.stage(connected_components(links), "similar").select(F.col("node").alias("t"), F.col("root").alias("c"))
    grouped = scratch.stage(rooted.join(found, "t", "left").withColumn("c", F.coalesce("c", "t")), "similar-texts")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "fp", "t")).alias("least")
    least = scratch.stage(grouped.groupBy("root", "c").agg(first), "similar-first")
    out = stage(grouped.join(least, ["root", "c"]).select("fp", "t", "u", "id", "same", "rows", "least"), "similar-groups")
    scratch.clear()
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest id (null ids last), then the smallest hashes. All columns are kept as they are."""
    t, u, i, some, first, many = fresh(docs, "_t", "_u", "_i", "_some", "_first", "_many")
    groups = similar_groups(docs, id_col, text_col, **options)
    is_first = (F.col("least.fp") == F.col("fp")) & (F.col("least.t") == F.col("t"))
    asked = groups.where(~is_first | (F.col("rows") > 1)).select(F.col("t").alias(t), F.col("u").alias(u), F.col("id").alias(i), F.lit(True).alias(some), is_first.alias(first), (F.col("same") > 1).alias(many))
    asked = stage(asked, "similar-asked")
    text = F.col(text_col)
    both = docs.withColumns({t: F.xxhash64(text), u: F.xxhash64(F.lit(1), text)}).join(asked.hint("merge"), [t, u], "left")
    stays = F.col(some).isNull() | (F.col(first) & F.col(id_col).cast("bigint").eqNullSafe(F.col(i)))
    kept = both.where(stays & ~F.coalesce(F.col(many), F.lit(False))).select(*docs.columns)
    if asked.where(F.col(first) & F.col(many)).isEmpty():
        return kept
    return kept.unionByName(both.where(stays & F.col(many)).dropDuplicates([t, u]).select(*docs.columns))
