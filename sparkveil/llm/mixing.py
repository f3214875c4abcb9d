"""Mixing sources to target weights by hash-threshold histograms.

Every document has a place in [0, 1) from a hash of its id. A source's budget
is a threshold on that place: whole passes over the source come first, and the
documents below the threshold come once more. The threshold is read off a
histogram of tokens by hash bucket; only the bucket in which the budget runs
out is opened into a finer histogram, so that nothing is sorted. Thresholds for
growing budgets are nested: a larger budget keeps all that a smaller one took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stage

#: Bits of the hash that each histogram resolves, and how many are nested.
BITS, LEVELS = 12, 4
SHARE = 1.5
WEIGHTS = (3.0, 1.0, 2.0)
MOST = 2


def words(text: Column) -> Column:
    """Number of words between ASCII blanks; null: 0."""
    cut = F.split(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " +")
    return F.when(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")) == "", 0).otherwise(F.coalesce(F.size(cut), F.lit(0))).cast("bigint")


def place(id_: Column) -> Column:
    """48 bits of the MD5 of the id as text, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes; none is above ``most`` times its size, and what
    is over is shared again by weight. With caps, every share is
    min(cap, level * weight) for one level; sources reach their cap in the order
    of cap / weight, so the level follows from running sums over that order.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("n_before"), F.lit(len(weights))) + 1).cast("int"))
    sizes = sizes.withColumns({"missing": F.col("source").isNull(), "code": F.encode("source", "utf-8"), "n": F.lit(1)})
    ranked = _with_sums_before(sizes, ["missing", "code"], ["n"], "source-ranks").withColumns({"w": weight, "cap": F.col("source_size") * float(most)})
    ranked = ranked.withColumn("rise", F.col("cap") / F.col("w"))
    rising = _with_sums_before(ranked.drop("n_before", "n"), ["rise", "missing", "code"], ["cap", "w"], "source-levels")
    total, weighed = rising.agg(F.sum("source_size"), F.sum("w")).first()
    # a source is capped if the level that would share the rest among it and all later ones is above its own
    level = ((total or 0) * share - F.col("cap_before")) / ((weighed or 0.0) - F.col("w_before"))
    least = rising.where(level * F.col("w") < F.col("cap")).agg(F.min(F.struct("rise", "missing", "code", level.alias("level")))).first()[0]
    goal = F.col("cap") if least is None else F.least("cap", F.lit(least["level"]) * F.col("w"))
    return rising.select("source", "source_size", goal.alias("target"))


def _with_sums_before(rows: DataFrame, order: list[str], sums: list[str], name: str) -> DataFrame:
    """``rows`` with x_before for each x of ``sums``: its sum over all rows that come before in ``order``.

    Ranges of the order are summed apart; only the ranges' totals, one row a
    range, are summed in one place.
    """
    ranges = stage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("part").agg(*[F.sum(x).alias(x) for x in sums])
    totals = totals.select(F.col("part").alias("p"), *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_base") for x in sums])
    both = ranges.join(totals, F.col("part") == F.col("p"))
    return stage(both.withColumns({f"{x}_before": F.col(f"{x}_base") + F.coalesce(F.sum(x).over(within), F.lit(0)) for x in sums}).drop("part", "p", *[f"{x}_base" for x in sums]), f"{name}-sums")


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), place(F.col(id_col)).alias("at")), "sizes")


def limits(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, passes, threshold) for each source of ``rows`` (source, size, at): how often it is taken whole, and the place below which documents come once more."""
    goal = stage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    rest = F.when(F.col("source_size") > 0, F.greatest(F.lit(0.0), F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size"))).otherwise(0.0)
    found = goal.select(F.col("source").alias("s"), rest.alias("rest"), F.lit(0).cast("bigint").alias("prefix"))
    total = BITS * LEVELS
    for k in range(1, LEVELS + 1):
        above, here = total - BITS * (k - 1), total - BITS * k
        inside = rows.join(found, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("at", above) == F.col("prefix")), "inner")
        bins = inside.groupBy("s", "rest", F.shiftright("at", here).alias("bin")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("s").orderBy("bin")
        run = bins.withColumn("run", F.sum("n").over(upto))
        # the first bin that doesn't fit whole; if all fit, one past the last
        edge = run.groupBy("s", "rest").agg(F.min(F.when(F.col("run") > F.col("rest"), F.struct("bin", (F.col("rest") - F.col("run") + F.col("n")).alias("left")))).alias("e"), F.max("bin").alias("last"), (F.first("rest") - F.sum("n")).alias("over"))
        found = edge.select("s", F.coalesce(F.col("e.left"), F.col("over")).alias("rest"), F.coalesce(F.col("e.bin"), F.col("last") + 1).alias("prefix"))
        found = stage(found, f"edges{k}")
        if k == 1:
            known = found
            continue
        # a source whose boundary was past its last bin has no rows to open; its threshold stays
        known = stage(known.join(found.select(F.col("s").alias("t"), F.col("rest").alias("r2"), F.col("prefix").alias("p2")), F.col("s").eqNullSafe(F.col("t")), "left").select("s", F.coalesce("r2", "rest").alias("rest"), F.coalesce(F.col("p2"), F.shiftleft("prefix", BITS)).alias("prefix")), f"known{k}")
        found = known
    limit = goal.join(known.select("s", F.col("prefix").alias("threshold")), F.col("source").eqNullSafe(F.col("s")), "left")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    return stage(limit.select("source", "source_size", "target", passes.alias("passes"), F.when(passes < most, F.coalesce("threshold", F.lit(0))).otherwise(0).alias("threshold")), "limits")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    taken is the document's size times its repeats in the mix. Each source is
    taken whole floor(target / source_size) times; documents below the source's
    threshold come once more, as long as the sum of their sizes stays within
    the rest. Rows with equal ids have one place and come together. Null text
    has size 0, null sources are one source (the last), a source of size 0 has
    target 0. The result depends on ids, sizes and sources only, not on the
    order or partition of rows. Other columns are ignored; an empty table gives
    no rows.
    """
    rows = _measured(docs, id_col, text_col, source_col)
    limit = limits(rows, weights, share, most).withColumnRenamed("source", "s")
    taken = F.col("size") * (F.col("passes") + (F.col("at") < F.col("threshold")).cast("int"))
    out = rows.join(limit, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``docs`` as the mix has them: each row as often as it is taken, with its own columns.

    Texts are read where they are: only the table of limits, one row per source, is joined to them.
    """
    found = limits(_measured(docs, id_col, text_col, source_col), weights, share, most)
    s, p, t, k = fresh(docs, "_source", "_passes", "_threshold", "_k")
    found = found.select(F.col("source").alias(s), F.col("passes").alias(p), F.col("threshold").alias(t))
    times = F.col(p) + (place(F.col(id_col)) < F.col(t)).cast("int")
    joined = docs.join(found, F.col(source_col).eqNullSafe(F.col(s))).where(times > 0)
    return joined.withColumn(k, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS at
  FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM g),
f AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
  coalesce(sum(cap) OVER o, 0) AS filled, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS free
  FROM r WINDOW o AS (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total - filled) / free AS lev FROM f),
l AS (SELECT first(lev ORDER BY cap / w, source IS NULL, encode(source)) AS lev FROM v WHERE lev * w < cap),
t AS (SELECT source, source_size, coalesce(least(cap, l.lev * w), cap)::DOUBLE AS target FROM v CROSS JOIN l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes,
  CASE WHEN source_size > 0 THEN greatest(0, target - floor(target / source_size) * source_size) ELSE 0 END AS rest FROM t),
c AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.at) AS run
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (passes + CASE WHEN run <= rest AND passes < 2 THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
